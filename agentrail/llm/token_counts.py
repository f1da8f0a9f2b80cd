"""Token counts by a whole-token shortcut.

Before any text is read, every string of the vocabulary is put through the
vocabulary's own merges: those that come out as one token are proved to be one
token wherever a text's pattern cuts them out, as merges never look beyond a
cut.  Counting then needs no ids: a text is cut, parts that are proved strings
count one each, and only the rest is merged, once per distinct part and worker.

Special strings inside texts are one token each, as the library has it by
default; nothing is added, cut off or padded.  A null text is empty; rows that
repeat are counted each; columns of the documents called like the results are
replaced; an empty table gives no rows.  Only byte-level vocabularies (.json)
can be counted this way; others are refused.
"""

from __future__ import annotations

import os
import re
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import _WS, PATTERN, byte_letters, cut_parts, special_pattern, special_strings, vocabulary

LIMIT = 512
#: Parts remembered in a worker that are not proved strings; beyond it the
#: counts of new ones, which are the rare ones, are not kept.
MOST_PARTS = 1_000_000
#: Longer texts are counted in runs of about so many characters, from one place
#: where the pattern cuts to another.
RUN = 1 << 20
_BETWEEN = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core already
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    if tokenizer.normalizer is not None or "ByteLevel" not in type(tokenizer.pre_tokenizer).__name__ or tokenizer.pre_tokenizer.add_prefix_space:
        raise ValueError(f"not a plain byte-level vocabulary: {path}")
    return tokenizer


def whole_tokens(path: str) -> list[str]:
    """The proof: strings of the vocabulary that its merges leave as that one
    token.  Entries that are no whole characters never stand alone in a text."""
    tokenizer, back = _library(path), {c: b for b, c in enumerate(byte_letters())}
    special, merge, out = special_strings(tokenizer), tokenizer.model.tokenize, []
    for name, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if name in special or any(c not in back for c in name):
            continue
        try:
            text = bytes(back[c] for c in name).decode()
        except UnicodeDecodeError:
            continue
        if [t.id for t in merge(name)] == [i]:
            out.append(text)
    return sorted(out)


def runs(text: str, most: int = RUN):
    """Parts of a long text; the pattern cuts before a single space between
    other characters whatever is around them."""
    lo = 0
    while len(text) - lo > most:
        cut = _BETWEEN.search(text, lo + most)
        if cut is None:
            break
        yield text[lo:cut.start()]
        lo = cut.start()
    yield text[lo:] if lo else text


class Counter:
    """Counts tokens in one worker."""

    def __init__(self, path: str, whole):
        tokenizer = _library(path)
        self.special = special_strings(tokenizer)
        self.apart = special_pattern(self.special)
        self.whole = dict.fromkeys(whole, 1)
        self.rest: dict[str, int] = {}
        self.merge = tokenizer.model.tokenize
        self.letters = byte_letters()

    def merged(self, piece: str) -> int:
        """Tokens of one piece of the pattern that is no proved string."""
        n = self.rest.get(piece)
        if n is None:
            n = len(self.merge(piece.encode().decode("latin-1").translate(self.letters)))
            if len(self.rest) < MOST_PARTS:
                self.rest[piece] = n
        return n

    def part(self, part: str) -> int:
        whole, n = self.whole, 0
        for piece in PATTERN.findall(part):
            n += 1 if piece in whole else self.merged(piece)
        if len(self.rest) < MOST_PARTS:
            self.rest[part] = n
        return n

    def plain(self, text: str) -> int:
        total, whole, rest = 0, self.whole, self.rest
        for run in runs(text):
            parts = cut_parts(run)
            known = [whole.get(p) or rest.get(p) for p in parts]
            if None in known:
                total += sum(n or self.part(p) for n, p in zip(known, parts))
            else:
                total += sum(known)
        return total

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return sum(1 if k % 2 else self.plain(x) for k, x in enumerate(self.apart.split(text)))
        return self.plain(text)


def count_tokens(docs: DataFrame, vocab: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit."""
    keep = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocab))  # strings of the vocabulary

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        store = sys.__dict__.setdefault("_llm_counters", {})  # outlives one task's copy of this module
        if vocab not in store:
            store[vocab] = Counter(vocab, whole.value)
        return pd.Series([store[vocab].count(t) if t else 0 for t in texts], dtype="int64")

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, F.octet_length(body).cast("long").alias("n_bytes"), count(body).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, vocabulary()).select("doc_id", "n_bytes", "n_tokens", "over_limit")
