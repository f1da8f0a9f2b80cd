"""Language identification by rank-order profiles.

A profile is a language's ``PROFILE`` most frequent letter n-grams (1 to 3
letters, words padded by a space, lower case) in order.  A document's own most
frequent n-grams, among those that any profile holds, are ranked the same way;
its distance to a language is the sum of how far each is out of place there,
``PROFILE`` for one that the profile lacks.  The nearest language wins, ties
in order of name; the score is one less the distance as a share of the
greatest possible one.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROFILE = 300
#: Documents per language that a profile is learned from (expected number;
#: fewer if the language has fewer).  Counts, windows and predictions cover
#: whole texts.
LEARN_DOCS = 3000
UNKNOWN = "und"
_TABLE_BITS = 18


def held_out(key: Column, of: int, value: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of)) == value, F.lit(False))


def _letters() -> np.ndarray:
    """For every code point whether it is a letter; made once a worker."""
    if "_llm_letters" not in sys.__dict__:
        sys.__dict__["_llm_letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return sys.__dict__["_llm_letters"]


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after the other, each run of non-letters
    as one space, spaces around every text; and the text each belongs to."""
    low = [" " + t.lower() + " " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = _letters()[points]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    return np.where(letter, points, 32)[keep].astype(np.uint64), row[keep]


def _grams(points: np.ndarray, row: np.ndarray):
    """(codes, rows) of the 1-, 2- and 3-grams: 21 bits a code point."""
    yield points[points != 32], row[points != 32]
    if len(points) > 1:
        two = points[:-1] | (points[1:] << np.uint64(21))
        ok = row[:-1] == row[1:]
        yield two[ok], row[:-1][ok]
    if len(points) > 2:
        three = two[:-1] | (points[2:] << np.uint64(42))
        ok = (row[:-2] == row[2:]) & (points[1:-1] != 32)
        yield three[ok], row[:-2][ok]


def _slices(texts: list[str], most: int = 1 << 20):
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _count(frames):
    for df in frames:
        for lang, some in df.groupby("lang"):
            texts = some["text"].tolist()
            for lo, hi in _slices(texts, 4 << 20):
                codes = np.concatenate([g for g, _ in _grams(*_runs(texts[lo:hi]))])
                if len(codes):
                    found, n = np.unique(codes, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": found.astype(np.int64), "n": n.astype(np.int64)})


def learn(rows: DataFrame, per_lang: int = LEARN_DOCS, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from rows (key, text, lang): language -> n-gram codes in order.
    A language with many rows is thinned by a hash of the key; n-grams are
    counted by Spark, the driver gets ``size`` of each language."""
    rows = rows.where("lang is not null and text is not null")
    numbers = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    many = {k: per_lang / n for k, n in numbers.items() if n > per_lang}
    if many:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("lang")), F.lit(1.0))
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * float(1 << 30))
    grams = rows.select("lang", "text").mapInPandas(_count, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    out: dict[str, list[int]] = {}
    for r in grams.withColumn("nth", nth).where(F.col("nth") <= size).orderBy("lang", "nth").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Ranker:
    """Ranks documents' n-grams and measures them against profiles."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], np.int64)).astype(np.uint64)
        self.place = np.full((len(self.langs), len(self.codes)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.place[i, np.searchsorted(self.codes, np.array(profiles[lang], np.uint64))] = np.arange(len(profiles[lang]))
        # codes by a hash, so that most n-grams of a text go at one look-up
        slot = self._slot(self.codes)
        self.heads = np.full(1 << _TABLE_BITS, -1, np.int32)
        self.heads[slot] = np.arange(len(self.codes))
        self.rest = np.flatnonzero(self.heads[slot] != np.arange(len(self.codes)))  # share a slot with a later one

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text how often each known n-gram occurs, and its letters."""
        width = len(self.codes)
        points, row = _runs(texts)
        out = np.zeros(len(texts) * width, np.int64)
        for codes, at in _grams(points, row):
            ids = self.heads[self._slot(codes)]
            hit = ids >= 0
            codes, at, ids = codes[hit], at[hit], ids[hit]
            same = self.codes[ids] == codes
            out += np.bincount(at[same] * width + ids[same], minlength=len(out))
            for i in self.rest:
                out += np.bincount(at[codes == self.codes[i]] * width + i, minlength=len(out))
        return out.reshape(len(texts), width), np.bincount(row[points != 32], minlength=len(texts))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        langs, scores = [], []
        for lo, hi in _slices(texts):
            counts, letters = self.counts(texts[lo:hi])
            order = np.argsort(-counts, axis=1, kind="stable")[:, :self.size]
            top = np.take_along_axis(counts, order, 1) > 0
            ranks = np.arange(order.shape[1])
            far = np.stack([np.where(top, np.where(p[order] >= 0, np.abs(p[order] - ranks), self.size), 0).sum(1)
                            for p in self.place], 1)
            best = far.argmin(1)
            worst = np.maximum(top.sum(1) * self.size, 1)
            score = np.where(top.any(1), 1 - far[np.arange(len(best)), best] / worst, 0.0)
            langs += [self.langs[b] if n else UNKNOWN for b, n in zip(best, letters)]
            scores.append(np.where(letters > 0, score, 0.0))
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (replaced if there).  A null text or
    one without a letter is ``und`` with score 0."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE numbers a language; plain, as broadcasts
    mark = uuid.uuid4().hex                                      # are unpickled without this package

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        kept = sys.__dict__.setdefault("_llm_rankers", {})       # one at a time outlives a task's copy of this module
        if mark not in kept:
            kept.clear()
            kept[mark] = Ranker(shared.value)
        langs, scores = kept[mark].predict([t or "" for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    out = docs.select(*keep, judge(F.col(text)).alias("_p"))
    return out.select(*keep, "_p.lang_pred", "_p.score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by profiles of those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    profiles = learn(docs.where(~out).withColumnRenamed("doc_id", "key"))
    return predict(docs.select("doc_id", "text", out.alias("held_out")), profiles).select(
        "doc_id", "held_out", "lang_pred", "score")
