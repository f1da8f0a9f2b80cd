"""JSON text as a stream of tokens, for transformations that keep or rewrite
values in place without building (or recursing into) a tree."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+)', re.S)


def compact(text: str) -> str | None:
    """The text as strict JSON without spaces, or None if it is not JSON."""
    try:
        return json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)
    except (ValueError, TypeError, RecursionError):
        return None


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, raw) of each token of compact JSON text; kind is ``key``,
    ``string``, ``atom`` or the punctuation itself."""
    holders: list[str] = []     # the open brackets
    due_key = False             # the next string names a member
    for m in _TOKEN.finditer(text):
        raw = m[1]
        if raw in "{[":
            holders.append(raw)
            due_key = raw == "{"
            yield raw, raw
        elif raw in "}]":
            holders.pop()
            due_key = False
            yield raw, raw
        elif raw == ",":
            due_key = bool(holders) and holders[-1] == "{"
            yield raw, raw
        elif raw == ":":
            due_key = False
            yield raw, raw
        elif raw[0] == '"':
            yield ("key" if due_key else "string"), raw
        else:
            yield "atom", raw


def any_value_text(text: str) -> str:
    """OTLP AnyValue JSON of compact JSON text, token by token: a bracket opens
    its wrapper, a leaf is wrapped by its type, and the end of a member closes
    the wrapper that its key opened."""
    out: list[str] = []
    ends: list[str] = []        # what closes each open bracket
    for kind, raw in tokens(text):
        if kind == "{":
            out.append('{"kvlistValue":{"values":[')
            ends.append("{")
        elif kind == "[":
            out.append('{"arrayValue":{"values":[')
            ends.append("[")
        elif kind == "key":
            out.append('{"key":' + raw + ',"value":')
        elif kind in "}]":
            ends.pop()
            # an empty object has no member to close
            out.append("]}}" if kind == "]" or out[-1].endswith("[") else "}]}}")
        elif kind == ",":
            out.append("}," if ends[-1] == "{" else ",")
        elif kind == "string":
            out.append('{"stringValue":' + raw + "}")
        elif kind == "atom":
            out.append(_leaf(raw))
    return "".join(out)


def _leaf(raw: str) -> str:
    if raw in ("true", "false"):
        return '{"boolValue":' + raw + "}"
    if raw == "null":
        return '{"stringValue":""}'
    if raw.lstrip("-").isdigit():
        return '{"intValue":"' + raw + '"}'
    return '{"doubleValue":' + raw + "}"


def redact_tokens(text: str, secret_name: re.Pattern, clean, marker: str, max_depth: int | None = None) -> str:
    """Compact JSON text with the value of every member whose name matches
    replaced by ``marker``, and ``clean`` applied to all other strings.
    ``max_depth`` leaves what lies deeper as it is."""
    out: list[str] = []
    depth, skip_from, named = 0, None, False
    for kind, raw in tokens(text):
        opens, closes = kind in ("{", "["), kind in ("}", "]")
        if closes:
            depth -= 1
        if skip_from is not None:                     # inside a replaced value
            if closes and depth == skip_from:
                skip_from = None
        elif named and kind != ":":                   # the value of a secret name
            out.append(json.dumps(marker))
            named = False
            if opens:
                skip_from = depth
        elif max_depth is not None and depth > max_depth:
            out.append(raw)
        elif kind == "key":
            named = bool(secret_name.search(json.loads(raw)))
            out.append(raw)
        elif kind == "string":
            out.append(json.dumps(clean(json.loads(raw)), ensure_ascii=False))
        else:
            out.append(raw)
        if opens:
            depth += 1
    return "".join(out)
