"""Token counts, alignment and spelling variants against brute force, on texts
made to be awkward."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agentrail.llm import alignment, spelling, token_counts, tokens

from test_operators import SCHEMA, odd_rows

VOCAB, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list(" \t\n\r\x0b\x0c\x1c\x85\xa0  ab'sl9é漢.!▁") + [
    "<|endoftext|>", "<|endoftext", "|>", "\0", "word", " the", "'ll", "<s>", "</s>", "<0x41>", "aaaa", "ﬁ", "😀", "        "]


def awkward(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows() + [(100 + i, t, "en", "a", 1, 2, 0.5, "h") for i, t in enumerate(awkward(300))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_follows_the_library_with_special_strings():
    for special in (True, False):
        library = Tokenizer.from_file(VOCAB)
        library.encode_special_tokens = not special
        texts = awkward(2000, 2) + ["hello <|endoftext|> ok", "<|endoftext|>", "<|endoftext|><|endoftext|> x "]
        for t, raw in zip(texts, tokens.encoder(VOCAB, special).encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert len(tokens.encoder(VOCAB).encode(["hello <|endoftext|> ok"])[0]) == 4 * 4


def test_proved_strings_are_one_token():
    library, found = Tokenizer.from_file(VOCAB), token_counts.whole_tokens(VOCAB)
    assert len(found) > 40_000 and "the" in found and " the" in found
    got = library.encode_batch(found, add_special_tokens=False)
    alone = [e for t, e in zip(found, got) if tokens.PATTERN.findall(t) == [t]]
    assert len(alone) > 40_000 and {len(e.ids) for e in alone} == {1}
    with pytest.raises(ValueError):
        token_counts.whole_tokens(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_equal_the_library(odd, none):
    library = Tokenizer.from_file(VOCAB)
    got = token_counts.count_tokens(odd.withColumn("n_tokens", F.lit("mine")), VOCAB, limit=5)
    assert got.columns.count("n_tokens") == 1 and got.count() == odd.count()
    for r in got.collect():
        want = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((r.text or "").encode()), want > 5)
    assert token_counts.count_tokens(none, VOCAB).count() == 0


def test_long_texts_are_cut_where_the_pattern_cuts():
    library, counter = Tokenizer.from_file(VOCAB), token_counts.Counter(VOCAB, token_counts.whole_tokens(VOCAB))
    for t in (" ".join(awkward(200, 3)), "x" * 5000, " " * 3000 + "y", "a b " * 999):
        for most in (1, 7, 100):
            assert "".join(token_counts.runs(t, most)) == t
            plain = t.replace("<|endoftext|>", "")
            assert sum(counter.plain(x) for x in token_counts.runs(plain, most)) == len(library.encode(plain, add_special_tokens=False).ids)


def brute_alignment(texts):
    library = Tokenizer.from_file(VOCAB)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    back = {c: b for b, c in enumerate(tokens.byte_letters())}
    found, count = [], Counter()
    for t in texts:
        ids = library.encode(" " + (t or ""), add_special_tokens=False).ids, model.encode(t or "")
        spelt = ([bytes(back[c] for c in library.id_to_token(i)) for i in ids[0]],
                 [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
        if not t or any(b"".join(s) != (" " + t).encode() for s in spelt):
            found.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]) for s in spelt]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0].tolist()) & set(ends[1].tolist())):
            to = [int(np.searchsorted(e, cut)) + 1 for e in ends]
            groups.append((ids[0][at[0]:to[0]], ids[1][at[1]:to[1]]))
            at = to
        links = Counter((a, b) for x, y in groups for a in x for b in y)
        count.update(links.keys())
        found.append((len(ids[0]), len(ids[1]), groups, links))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for one in found:
        if one is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = one
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == top[p[0]]),
                    sum(n * count[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("many", [256, 1])
def test_alignment_equals_brute_force(spark, odd, none, monkeypatch, many):
    monkeypatch.setattr(alignment, "MANY_PAIRS", many)
    rows = odd.select("doc_id", "text").collect() + [(9000, "a" * 3001), (9001, "a" * 3001 + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit("own")).withColumn("key", F.lit(1))
    got = Counter(map(tuple, alignment.align(df, VOCAB, PIECES).collect()))
    assert got == Counter((k, *one) for (k, _), one in zip(rows, brute_alignment([t for _, t in rows])))
    text = alignment.align(df.where("doc_id = 25"), VOCAB, PIECES, whole_groups=True).first()
    assert re.fullmatch(r"[\d,]+\|[\d,]+(;[\d,]+\|[\d,]+)*", text.groups) and text.groups.count(";") == text.n_groups - 1
    assert alignment.align(none, VOCAB, PIECES).count() == 0


def test_counts_of_pairs_are_merged_over_runs(spark):
    df = spark.createDataFrame([(i, "one two three") for i in range(40)], "doc_id long, text string").repartition(8)
    runs = alignment.aligned_runs(df, VOCAB, PIECES)
    assert runs.count() > 1
    counts = alignment.pair_counts(runs).collect()
    assert len(counts) == 3 and {r["count"] for r in counts} == {40} and all(r.best and r.pair == r.a << 32 | r.b for r in counts)


def test_piece_encoder_equals_the_library():
    model, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), alignment.PieceEncoder(PIECES)
    texts = [t for t in awkward(3000, 4) + ["  a", " ", "   ", "a  ", "a b"] if t]
    assert mine.cuts
    for t, raw in zip(texts, mine.encode(texts)):
        assert np.frombuffer(raw, "<i4").tolist() == model.encode(t), repr(t)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, out = {}, {}
    for w in n:
        some = sorted((-n[x], x) for x in n if abs(len(x) - len(w)) < 2 and near(w, x))
        out[w] = len(some)
        if some and -some[0][0] >= 2 * n[w]:
            form[w] = some[0][1]

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], out[w], n[form[w]] if w in form else None) for w in n}


def spelling_rows():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeÉéÿ") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    said = []
    for w in base:
        for _ in range(rng.choice([0, 1, 4])):
            v, i = list(w), rng.randrange(len(w))
            rng.choice([lambda: v.pop(i), lambda: v.insert(i, rng.choice("abcé")), lambda: v.__setitem__(i, rng.choice("xyz"))])()
            said += ["".join(v)] * rng.randint(1, 9)
        said += [w.upper() if rng.random() < 0.1 else w] * rng.choice([1, 3, 8, 30])
    said += ["chain" + "x" * i for i in range(7) for _ in range(3 * 2 ** i)] + ["anger", "range", "grane"] * 4 + ["z" * 400] * 3 + ["z" * 401] * 9
    rng.shuffle(said)
    return [(i if i % 9 else None, rng.choice([" ", "\n", ", "]).join(said[i::90])) for i in range(90)] + [(5, None), (6, ""), (7, "a b 12")]


@pytest.mark.parametrize("cell", [8192, 12])
def test_spelling_equals_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", 5)
    rows = spelling_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("own")).withColumn("n", F.lit("x"))
    got = {tuple(r) for r in spelling.spelling_variants(df, cell=cell, sample=300 if cell == 8192 else 100).collect()}
    want = brute_spelling(rows)
    assert got == want and any(r[2] != r[1] and r[1] for r in want) and ("z" * 400, "z" * 401, "z" * 401, 3, 1, 9) in got


def test_trees_reach_every_near_word():
    rng = random.Random(3)
    words = list({"".join(rng.choice("abcde") for _ in range(7)) for _ in range(700)})
    for longer in (False, True):
        queries = list({w[:i] + w[i + 1:] for w in words[:60] for i in (0, 4)}) if longer else words
        got = {(queries[i], words[j]) for a, b in spelling.near_pairs(words, queries, longer) for i, j in zip(a, b)}
        assert got == {(q, w) for q in queries for w in words if near(q, w)}
    counts = spelling.letter_counts(spelling.letter_codes(words, 7))
    tree = spelling.Tree(counts, 20)
    assert sorted(i for m in tree.members for i in m) == list(range(len(words))) and max(map(len, tree.members)) <= 20
    assert sorted(i for _, rows in tree.reach(counts, 0, 0) for i in rows) == list(range(len(words)))


def test_spelling_of_odd_tables(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in spelling.spelling_variants(odd).collect()} == brute_spelling(rows)
    assert spelling.spelling_variants(none).count() == 0


def test_common_parts_are_merged_as_they_are_looked_up():
    own, library = tokens.Encoder(VOCAB), Tokenizer.from_file(VOCAB)
    texts = ["Über den Fluß, ñandú!!! kommt\nDie Öre... nada\nvoilà; ça ### (so) end.\nLast", "again, Über\nden"]
    learned, learn = [], own._learn
    own._learn = lambda parts: (learned.extend(parts), learn(parts))
    assert [array("I", raw).tolist() for raw in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not [p for p in learned if "(" not in p]
    odd = ["it's, a1 €... \n x\n\ny \n", " \n\n", "\na\tb\n c", "日本 語, ﬁ'll 'll 's", "a\n'll !\n! \x1c\nq\n\x1d", "a\u2028b\nc d\xa0\ne"]
    for _ in range(2):
        assert [array("I", raw).tolist() for raw in own.encode(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_a_run_of_alignment_is_small():
    import tracemalloc

    from agentrail.llm.common import text_slices
    texts = [" ".join(f"word{i * 7919 % 997}ing {k} thing" for i in range(60)) for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    lo, hi, data, offs = next(text_slices(batch, most=alignment.RUN_BYTES))
    both = alignment.Aligner(VOCAB, PIECES)
    alignment.align_run(both, texts[lo:hi], data, offs, False)       # what an encoder remembers is not counted
    tracemalloc.start()
    try:
        alignment.align_run(both, texts[lo:hi], data, offs, False)
        assert tracemalloc.get_traced_memory()[1] < 90 << 20
    finally:
        tracemalloc.stop()


def test_a_run_of_alignment_goes_in_pieces(monkeypatch):
    import tracemalloc

    from agentrail.llm.common import text_slices
    texts = [" ".join(f"word{i * 7919 % 997}ing {k} thing" for i in range(60)) for k in range(3000)] + [""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    lo, hi, data, offs = next(text_slices(batch, most=1 << 20))
    both = alignment.Aligner(VOCAB, PIECES)

    def of_each():
        *counts, said, table = alignment.align_run(both, texts[lo:hi], data, offs, False)
        return [c.tolist() for c in counts], said, sorted(zip(*(table[c].to_pylist() for c in ("doc", "pair", "n_sum"))))

    got = of_each()                                                 # what an encoder remembers is not counted
    tracemalloc.start()
    try:
        alignment.align_run(both, texts[lo:hi], data, offs, False)
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()
    for most in (1, 1 << 30):
        monkeypatch.setattr(alignment, "PIECE_BYTES", most, raising=False)
        assert of_each() == got


def test_runs_of_alignment_come_in_small_batches_and_row_groups(spark, monkeypatch):
    """An executor holds a batch of texts, and reads a row group, as a whole."""
    import pyarrow.parquet as pq
    df = spark.createDataFrame([(i, f"text number {i} " * 20) for i in range(400)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 10_000, raising=False)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    runs = alignment.aligned_runs(df, VOCAB, PIECES)
    assert spark.conf.get(setting, None) == before
    assert sorted(k for r in runs.select("key").collect() for k in r.key) == list(range(400)) and runs.count() >= 10
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in runs.inputFiles()]
    assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 4
