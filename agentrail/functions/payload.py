"""Typed access to the free-form JSON payloads (``inputs`` / ``outputs`` /
``metadata``).

Payloads stay JSON text in the tables.  Every accessor here parses a payload
once with ``from_json`` into a struct of the keys it needs and works on the
struct, so the work stays JVM-side inside whole-stage codegen.

A field declared ``string`` receives the raw text of any JSON value (objects
and arrays as compact JSON, numbers as their digits); a field declared
``bigint`` receives only JSON integers (strings and floats give null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fields(col, *keys: str, types: dict[str, str] | None = None) -> Column:
    """Parse a JSON object column once into a struct of ``keys``.

    All fields are ``string`` unless ``types`` names another Spark type;
    every key is back-quoted, so any key text is allowed.
    """
    types = types or {}
    ddl = ", ".join(f"`{k}` {types.get(k, 'string')}" for k in keys)
    return F.from_json(_c(col), ddl)


def to_long(text) -> Column:
    """JSON number text -> BIGINT (floats truncated toward zero); else null."""
    t = _c(text)
    return F.coalesce(t.try_cast("bigint"), t.try_cast("double").try_cast("bigint"))


def truthy(text) -> Column:
    """Python truthiness of a JSON value given as the text ``fields`` returns."""
    t = _c(text)
    num = t.try_cast("double")
    return (F.when(t.isNull(), F.lit(False))
            .when(t.isin("true"), F.lit(True))
            .when(t.isin("false", "", "[]", "{}"), F.lit(False))
            .when(num.isNotNull(), num != 0)
            .otherwise(F.lit(True)))


def after_first_colon(name) -> Column:
    """``s.split(':', 1)[-1]``: the part after the first colon, else all of s."""
    n = _c(name)
    pos = F.instr(n, ":")
    return F.when(pos > 0, n.substr(pos + 1, F.length(n))).otherwise(n)


def model_id(inputs_model, name) -> Column:
    """Model used for pricing: non-empty ``inputs.model``, else the part of
    the step name after its first colon (``''`` when the name is missing)."""
    m = _c(inputs_model)
    return F.coalesce(F.nullif(m, F.lit("")), after_first_colon(F.coalesce(_c(name), F.lit(""))))


def canonical_tokens(inputs, outputs, include_openai_names: bool = False):
    """(input_tokens, output_tokens): first non-null of
    ``outputs.input_tokens``, ``outputs.input``, ``inputs.input_tokens``
    (resp. ``output_tokens`` / ``output``) and, if asked for, of
    ``outputs.prompt_tokens`` (``completion_tokens``).  Zero is kept: the test is
    on null, not on truthiness.  Returned as BIGINT (text parsed, floats cut)."""
    more = ("prompt_tokens", "completion_tokens") if include_openai_names else ()
    o = fields(outputs, "input_tokens", "input", "output_tokens", "output", *more)
    i = fields(inputs, "input_tokens", "output_tokens")
    tin = to_long(F.coalesce(o["input_tokens"], o["input"], i["input_tokens"], *[o[n] for n in more[:1]]))
    tout = to_long(F.coalesce(o["output_tokens"], o["output"], i["output_tokens"], *[o[n] for n in more[1:]]))
    return tin, tout
