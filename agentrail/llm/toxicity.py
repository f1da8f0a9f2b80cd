"""Toxicity by bags of subword embeddings.

Every word, with its borders, is a bag of character n-grams (3 to 6 bytes,
lower case) hashed to ``BUCKETS`` embeddings.  A bag of ``WINDOW`` neighbouring
words is the average of its n-grams' embeddings and goes through a linear
softmax over two classes; a document scores as its most toxic window, so a few
words are not lost in a long text.  Embeddings and softmax are trained jointly
in numpy, on the window that scores highest in each training document; they
start from how much oftener an n-gram's documents are toxic than chance allows,
so that the first windows chosen are the telling ones.  A misspelling never seen shares n-gram vectors with the word it stands for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, text_slices
from .language_id import held_out

BUCKETS_BITS = 17
SIZES = (3, 4, 5, 6)
WINDOW = 2
DIM = 8
#: An n-gram of fewer training documents keeps a zero embedding: it could only
#: be learned by heart.
LEAST_DOCS = 3
#: Labelled documents of each class that a model is trained on (expected
#: number, thinned by a hash of the key), and bytes of their texts; a text over
#: a twentieth of these is not learned from.
LEARN_DOCS, LEARN_BYTES = 1500, 24 << 20
#: Where training starts: constant terms by which unknown n-grams count as
#: clean, one dimension of the softmax, and the standard errors that log odds
#: have to be from zero.
BIAS, START, SURE = (1.0, -1.0), (-1.0, 1.0), 1.64
#: N-grams of documents that are counted at a time (more for one larger document).
COUNTED = 2_000_000
EPOCHS, RATE, DECAY = 40, 0.02, 1e-5
THRESHOLD = 0.7
SEED = 7


def _bags(data: np.ndarray, offs: np.ndarray):
    """N-gram buckets of words: (buckets, word of each, row of each word)."""
    n_rows = len(offs) - 1
    row = np.repeat(np.arange(n_rows), np.diff(offs))
    text = np.full(len(data) + n_rows + 1, 32, np.uint8)       # a space between rows
    text[np.arange(len(data)) + row + 1] = data
    text[(text >= 9) & (text <= 13)] = 32
    upper = (text >= 65) & (text <= 90)
    text[upper] += 32
    space = text == 32
    first = ~space
    first[1:] &= space[:-1]
    word = np.cumsum(first) - 1                                 # a space belongs to the word before
    starts = np.flatnonzero(first)
    ends = np.cumsum(np.concatenate([[0], np.diff(offs) + 1]))  # where rows start in ``text``
    word_row = np.searchsorted(ends, starts, "right") - 1
    weights = mix64(np.arange(max(SIZES), dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    wide, gaps = text.astype(np.uint32), np.concatenate([[0], np.cumsum(space)])
    buckets, words = [], []
    with np.errstate(over="ignore"):
        total = np.zeros(0, np.uint32)
        for n in range(1, max(SIZES) + 1):
            m = len(wide) - n + 1
            if m <= 0:
                break
            total = wide[:m] * weights[0] if n == 1 else total[:m] + wide[n - 1:] * weights[n - 1]
            if n in SIZES:
                at = np.flatnonzero(gaps[n - 1:n - 1 + m] == gaps[1:m + 1])  # no space inside
                h = (total[at] + np.uint32(n)) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA77)
                buckets.append((h >> np.uint32(32 - BUCKETS_BITS)).astype(np.int32))
                words.append(word[at] + space[at])              # a leading space belongs to the next word
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), word_row
    return np.concatenate(buckets), np.concatenate(words), word_row


def _windows(sums: np.ndarray, numbers: np.ndarray, word_row: np.ndarray, n_rows: int):
    """Means over each word and the ``WINDOW - 1`` after it in its row:
    (mean, first word, end word)."""
    n = len(word_row)
    last = np.searchsorted(word_row, np.arange(n_rows), "right")  # end word of each row
    first = np.arange(n)
    end = np.minimum(first + WINDOW, last[word_row] if n else first)
    s, c = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0.0], np.cumsum(numbers)])
    return (s[end] - s[first]) / np.maximum(c[end] - c[first], 1), first, end


def _best(means: np.ndarray, word_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first highest window of each row with words: (rows, windows)."""
    at = np.flatnonzero(np.diff(word_row, prepend=-1))
    top = np.maximum.reduceat(means, at)
    found = np.flatnonzero(means == np.repeat(top, np.diff(np.append(at, len(means)))))
    rows, first = np.unique(word_row[found], return_index=True)
    return rows, found[first]


class Model:
    """Embeddings and softmax; ``logit`` is their product, one number a bucket
    (the difference of the two classes), which is all that scoring needs."""

    def __init__(self, logit: np.ndarray, bias: float):
        self.logit, self.bias = logit.astype(np.float32), float(bias)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        top = np.full(n, -np.inf)                   # no words: score 0
        buckets, words, word_row = _bags(data, offs)
        if len(word_row):
            sums = np.bincount(words, self.logit[buckets], len(word_row))
            means, _, _ = _windows(sums, np.bincount(words, minlength=len(word_row)), word_row, n)
            at = np.flatnonzero(np.diff(word_row, prepend=-1))
            top[word_row[at]] = np.maximum.reduceat(means, at)
        return 1 / (1 + np.exp(-np.clip(top + self.bias, -40, 40)))


def _spread(buckets, begins, numbers, words):
    """The n-grams of each of ``words`` in turn."""
    n = numbers[words]
    return buckets[np.repeat(begins[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Joint training by Adam on cross-entropy, classes weighed alike."""
    rng = np.random.default_rng(SEED)
    size = 1 << BUCKETS_BITS
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size), -2.0 if not len(y) or y.max() == 0 else 2.0)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    vocab: dict[bytes, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in b.lower().split()], np.int64) for b in raw]
    word, row = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    spelt = list(vocab)
    buckets, of, _ = _bags(np.frombuffer(b"".join(spelt), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in spelt])]))
    order = np.argsort(of, kind="stable")
    buckets, of = buckets[order], of[order]
    numbers = np.bincount(of, minlength=len(spelt))
    begins = np.concatenate([[0], np.cumsum(numbers)])
    # documents of each bucket, from the words of each document
    pair = np.unique(row * np.int64(len(spelt)) + word)
    said, at = pair % len(spelt), pair // len(spelt)
    n1, n0 = y.sum(), (1 - y).sum()
    d1, d0 = np.zeros(size), np.zeros(size)
    starts = np.searchsorted(at, np.arange(len(y) + 1))
    before = np.concatenate([[0], np.cumsum(numbers[said])])[starts]      # n-grams of the documents before each
    first = 0
    while first < len(y):
        end = max(first + 1, int(np.searchsorted(before, before[first] + COUNTED, "right")) - 1)
        some = slice(starts[first], starts[end])
        held = np.unique(np.repeat(at[some], numbers[said[some]]) * np.int64(size) + _spread(buckets, begins, numbers, said[some]))
        d1 += np.bincount(held % size, y[held // size], size)
        d0 += np.bincount(held % size, 1 - y[held // size], size)
        first = end
    del pair, said, at
    known = d1 + d0 >= LEAST_DOCS
    odds = np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - SURE * np.sqrt(1 / (d1 + 0.5) + 1 / (d0 + 0.5)), 0)
    emb, soft, bias = rng.normal(0, 0.01, (size, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.array(BIAS)
    emb[:, 0], soft[0] = odds, START
    emb[~known] = 0
    params = [emb, soft, bias]
    moment, speed = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for step in range(1, epochs + 1):
        logit = emb @ (soft[:, 1] - soft[:, 0])
        sums = np.bincount(of, logit[buckets], len(spelt))
        means, first, end = _windows(sums[word], numbers[word], row, len(y))
        rows, win = _best(means, row)
        # the n-grams of the chosen windows
        span = [np.arange(first[w], end[w]) for w in win]
        chosen = word[np.concatenate(span)]
        doc = np.repeat(np.arange(len(rows)), [len(s) for s in span])
        n_each = numbers[chosen]
        total = np.bincount(doc, n_each, len(rows))
        gram, gram_doc = _spread(buckets, begins, numbers, chosen), np.repeat(doc, n_each)
        mean = np.zeros((len(rows), DIM))
        for d in range(DIM):
            mean[:, d] = np.bincount(gram_doc, emb[gram, d], len(rows)) / np.maximum(total, 1)
        z = mean @ soft + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        p[np.arange(len(rows)), y[rows].astype(int)] -= 1
        p *= weight[rows][:, None]
        back = (p @ soft.T) / np.maximum(total, 1)[:, None]
        g_emb = np.stack([np.bincount(gram, back[gram_doc, d], size) for d in range(DIM)], 1)
        grads = [np.where(known[:, None], g_emb + DECAY * emb, 0), mean.T @ p + 1e-5 * soft, p.sum(0)]
        for i, g in enumerate(grads):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            speed[i] = 0.99 * speed[i] + 0.01 * g * g
            params[i] -= RATE * (moment[i] / (1 - 0.9 ** step)) / (np.sqrt(speed[i] / (1 - 0.99 ** step)) + 1e-8)
    return Model(emb @ (soft[:, 1] - soft[:, 0]), bias[1] - bias[0])


def chosen(docs: DataFrame, labels: DataFrame, most: int = LEARN_DOCS, most_bytes: int = LEARN_BYTES) -> DataFrame | None:
    """(key, label, text) of about ``most`` documents of each class, in all of
    about ``most_bytes``, from (key, text) and (key, label), or nothing.  A key
    labelled twice counts as its higher label, a key that repeats by its first
    text.  Keys meet their labels without texts, which may be shuffled; the
    keys taken are few and broadcast to the texts."""
    labels = labels.where("key is not null and label is not null").groupBy("key").agg((F.max("label") > 0).cast("int").alias("label"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    docs = docs.where(size <= most_bytes // 20)
    rows = docs.select("key", size.alias("size")).join(labels, "key")
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    part = {r["label"]: min(1.0, most / r["n"], most_bytes / 2 / max(1, r["size"])) for r in found}
    if not part:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for kv in part.items() for x in kv]), F.col("label"))
    keys = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * float(1 << 30)).select("key", "label").distinct()
    some = docs.select("key", "text").join(F.broadcast(keys), "key")
    return some.groupBy("key", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def sample(docs: DataFrame, labels: DataFrame, most: int = LEARN_DOCS, most_bytes: int = LEARN_BYTES) -> list[tuple[str, int]]:
    """Texts and labels of the documents ``chosen``, by key."""
    some = chosen(docs, labels, most, most_bytes)
    return [] if some is None else [(r["text"], r["label"]) for r in some.orderBy("key").collect()]


def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        top = np.full(n, -np.inf)                   # no words: score 0
        buckets, words, word_row = _bags(data, offs)
        if len(word_row):
            sums = np.bincount(words, self.logit[buckets], len(word_row))
            means, _, _ = _windows(sums, np.bincount(words, minlength=len(word_row)), word_row, n)
            at = np.flatnonzero(np.diff(word_row, prepend=-1))
            top[word_row[at]] = np.maximum.reduceat(means, at)
        return 1 / (1 + np.exp(-np.clip(top + self.bias, -40, 40)))


def _spread(buckets, begins, numbers, words):
    """The n-grams of each of ``words`` in turn."""
    n = numbers[words]
    return buckets[np.repeat(begins[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Joint training by Adam on cross-entropy, classes weighed alike."""
    rng = np.random.default_rng(SEED)
    size = 1 << BUCKETS_BITS
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size), -2.0 if not len(y) or y.max() == 0 else 2.0)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    vocab: dict[bytes, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in b.lower().split()], np.int64) for b in raw]
    word, row = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    spelt = list(vocab)
    buckets, of, _ = _bags(np.frombuffer(b"".join(spelt), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in spelt])]))
    order = np.argsort(of, kind="stable")
    buckets, of = buckets[order], of[order]
    numbers = np.bincount(of, minlength=len(spelt))
    begins = np.concatenate([[0], np.cumsum(numbers)])
    # documents of each bucket, from the words of each document
    pair = np.unique(row * np.int64(len(spelt)) + word)
    said, at = pair % len(spelt), pair // len(spelt)
    n1, n0 = y.sum(), (1 - y).sum()
    d1, d0 = np.zeros(size), np.zeros(size)
    starts = np.searchsorted(at, np.arange(len(y) + 1))
    before = np.concatenate([[0], np.cumsum(numbers[said])])[starts]      # n-grams of the documents before each
    first = 0
    while first < len(y):
        end = max(first + 1, int(np.searchsorted(before, before[first] + COUNTED, "right")) - 1)
        some = slice(starts[first], starts[end])
        held = np.unique(np.repeat(at[some], numbers[said[some]]) * np.int64(size) + _spread(buckets, begins, numbers, said[some]))
        d1 += np.bincount(held % size, y[held // size], size)
        d0 += np.bincount(held % size, 1 - y[held // size], size)
        first = end
    del pair, said, at
    known = d1 + d0 >= LEAST_DOCS
    odds = np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - SURE * np.sqrt(1 / (d1 + 0.5) + 1 / (d0 + 0.5)), 0)
    emb, soft, bias = rng.normal(0, 0.01, (size, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.array(BIAS)
    emb[:, 0], soft[0] = odds, START
    emb[~known] = 0
    params = [emb, soft, bias]
    moment, speed = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for step in range(1, epochs + 1):
        logit = emb @ (soft[:, 1] - soft[:, 0])
        sums = np.bincount(of, logit[buckets], len(spelt))
        means, first, end = _windows(sums[word], numbers[word], row, len(y))
        rows, win = _best(means, row)
        # the n-grams of the chosen windows
        span = [np.arange(first[w], end[w]) for w in win]
        chosen = word[np.concatenate(span)]
        doc = np.repeat(np.arange(len(rows)), [len(s) for s in span])
        n_each = numbers[chosen]
        total = np.bincount(doc, n_each, len(rows))
        gram, gram_doc = _spread(buckets, begins, numbers, chosen), np.repeat(doc, n_each)
        mean = np.zeros((len(rows), DIM))
        for d in range(DIM):
            mean[:, d] = np.bincount(gram_doc, emb[gram, d], len(rows)) / np.maximum(total, 1)
        z = mean @ soft + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        p[np.arange(len(rows)), y[rows].astype(int)] -= 1
        p *= weight[rows][:, None]
        back = (p @ soft.T) / np.maximum(total, 1)[:, None]
        g_emb = np.stack([np.bincount(gram, back[gram_doc, d], size) for d in range(DIM)], 1)
        grads = [np.where(known[:, None], g_emb + DECAY * emb, 0), mean.T @ p + 1e-5 * soft, p.sum(0)]
        for i, g in enumerate(grads):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            speed[i] = 0.99 * speed[i] + 0.01 * g * g
            params[i] -= RATE * (moment[i] / (1 - 0.9 ** step)) / (np.sqrt(speed[i] / (1 - 0.99 ** step)) + 1e-8)
    return Model(emb @ (soft[:, 1] - soft[:, 0]), bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, most: int = LEARN_DOCS, most_bytes: int = LEARN_BYTES) -> list[tuple[str, int]]:
    """Texts and labels of about ``most`` documents of each class, in all of
    about ``most_bytes``, from (key, text) and (key, label).  A key labelled
    twice counts as its higher label, a key that repeats by its first text."""
    labels = labels.where("key is not null and label is not null").groupBy("key").agg((F.max("label") > 0).cast("int").alias("label"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    docs = docs.where(size <= most_bytes // 20)
    rows = docs.select("key", size.alias("size")).join(labels, "key")      # no texts: a join may shuffle both sides
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    part = {r["label"]: min(1.0, most / r["n"], most_bytes / 2 / max(1, r["size"])) for r in found}
    if not part:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for kv in part.items() for x in kv]), F.col("label"))
    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * float(1 << 30)).select("key", "label").distinct()
    some = docs.join(F.broadcast(some), "key")                             # about 2 * ``most`` keys
    some = some.groupBy("key", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return [(r["text"], r["label"]) for r in some.orderBy("key").collect()]


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (replaced if there); the whole of
    each text counts, a null one is empty."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast((model.logit, model.bias))  # one number a bucket

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        import pyarrow as pa
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
        own = Model(*shared.value)
        parts = [own.score(data, offs) for _, _, data, offs in text_slices(batch)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    out = docs.select(*keep, rate(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a model of those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = held_out(F.col("doc_id"), 3, 1)
    rows = sample(docs.where(~out).withColumnRenamed("doc_id", "key"),
                  labels.where(~out).select(F.col("doc_id").alias("key"), F.col("toxic").alias("label")))
    model = train([t for t, _ in rows], [y for _, y in rows])
    return score(docs.select("doc_id", "text", out.alias("held_out")), model).select(
        "doc_id", "held_out", "score", "predicted")
