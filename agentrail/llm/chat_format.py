"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with offsets, and the spans of
its assistant texts are intersected with the sorted token spans by binary
search.  The template::

    [INST]role\\ntext[/INST]     any turn but the assistant's
    <s>text</s>                  an assistant turn

The four control strings are tokens of their own, so no token crosses a turn's
edge.  Inside texts and roles a control string gets a backslash after its
first character (one more if it has some), which undoes exactly: formatted
texts hold control strings only where the template puts them.

Output rows: conv_id, formatted, input_ids, loss_starts and loss_ends (token
spans [start, end) under the loss mask), in Parquet.  A conversation is one
row, as its text is one string.  Turns are ordered by (turn, role, text), nulls
first; a null text is empty, a null role is an empty one; rows that repeat are
turns of their own; rows without conv_id are one conversation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import keyed
from .tokens import vocabulary

# Fixed values of the template.
OPEN, CLOSE, SAY, END = "[INST]", "[/INST]", "<s>", "</s>"
_CONTROL = re.compile(r"([\[<])(\\*)(INST\]|/INST\]|s>|/s>)")
_MARK = re.compile(r"\[INST\](.*?)\[/INST\]|<s>(.*?)</s>", re.S)
ASSISTANT = "assistant"


def _pairs(first: str, rest: str) -> bool:
    return (first == "[") == rest.endswith("]")


def escape(text: str) -> str:
    """A backslash more after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[1] + m[2] + "\\" + m[3] if _pairs(m[1], m[3]) else m[0], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3] if m[2] and _pairs(m[1], m[3]) else m[0], text)


def escape_role(role: str) -> str:
    """As ``escape``; the line end that ends the role is spelt out in it."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\\" if m[1] == "\\" else "\n", unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        if role == ASSISTANT:
            body = escape(text)
            spans.append((at + len(SAY), at + len(SAY) + len(body)))
            piece = SAY + body + END
        else:
            piece = OPEN + escape_role(role) + "\n" + escape(text) + CLOSE
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for m in _MARK.finditer(formatted):
        if m[2] is not None:
            turns.append((ASSISTANT, unescape(m[2])))
        else:
            role, _, text = m[1].partition("\n")
            turns.append((unescape_role(role), unescape(text)))
    return turns


def chat_tokenizer(path: str):
    """The vocabulary with the control strings as tokens of their own, and
    offsets that leave out nothing."""
    import os
    import sys
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    store = sys.__dict__.setdefault("_llm_chat_tokenizers", {})
    if path not in store:
        from tokenizers import AddedToken, Tokenizer, processors
        t = Tokenizer.from_file(path)
        # the vocabulary's own special strings stay ordinary text
        t.encode_special_tokens = True
        t.add_tokens([AddedToken(c, normalized=False, special=False) for c in (OPEN, CLOSE, SAY, END)])
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        store[path] = t
    return store[path]


def _format(vocab: str, schema):
    def format_(batches):
        import numpy as np
        t = chat_tokenizer(vocab)
        for batch in batches:
            rows = []
            for turns in batch.column("turns").to_pylist():
                text, spans = render([(x["role"] or "", x["text"] or "") for x in turns])
                e = t.encode(text, add_special_tokens=False)
                offs = np.array(e.offsets, np.int64).reshape(-1, 2)
                # token spans are sorted: the first that ends after a turn's
                # start, and the first that starts at its end or later
                first = np.searchsorted(offs[:, 1], [a for a, _ in spans], "right")
                end = np.searchsorted(offs[:, 0], [b for _, b in spans], "left")
                empty = np.array([a == b for a, b in spans], bool)
                end = np.where(empty, first, end)
                rows.append((text, list(e.ids), first.tolist(), end.tolist()))
            yield keyed(batch.column("conv_id"), rows, schema)
    return format_


def format_conversations(turns: DataFrame, vocab: str, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, formatted, input_ids, loss_starts,
    loss_ends.  Other columns of ``turns`` are left out."""
    one = turns.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    kind = turns.schema[conv].dataType.simpleString()
    schema = T.StructType.fromDDL(f"conv_id {kind}, formatted string, input_ids array<int>, loss_starts array<int>, loss_ends array<int>")
    return whole.mapInArrow(_format(vocab, schema), schema)


def _read_back(vocab: str, schema):
    def read(batches):
        import hashlib
        t = chat_tokenizer(vocab)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for text, ids, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("formatted", "input_ids", "loss_starts", "loss_ends"))):
                turns = parse(text)
                loss = "".join(unescape(t.decode(ids[a:b], skip_special_tokens=False))
                               for a, b in zip(starts, ends))
                rows.append((len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(text)))
            yield keyed(batch.column("conv_id"), rows, schema)
    return read


def read_back(formatted: DataFrame, vocab: str) -> DataFrame:
    """Per formatted conversation, from its text, ids and mask alone: number
    and digest of its turns, length and digest of what the loss mask covers
    (decoded from the masked ids), length of the formatted text."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                  "loss_sha256 string, formatted_chars long")
    return formatted.mapInArrow(_read_back(vocab, schema), schema)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations, and one whose texts are control strings,
    writes them, and describes each as read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = scratch_path(spark, "chats")
    format_conversations(turns.unionByName(own), vocabulary()).write.parquet(path)
    return read_back(spark.read.parquet(path), vocabulary())


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             length(regexp_replace(regexp_replace(coalesce(text, ''), '\[(\\*)(/?INST\])', '[\1\\\2', 'g'),
                                   '<(\\*)(/?s>)', '<\1\\\2', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
