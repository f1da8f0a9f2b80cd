"""Building JSON text with column expressions (for the wire writer and the
exports): escaped strings, Python-style float text, compacted payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def json_string(col) -> Column:
    """JSON string literal of a text column (escaped), 'null' for null."""
    x = _c(col)
    lit = F.regexp_replace(F.to_json(F.struct(x.alias("v"))), r'^\{"v":|\}$', "")
    return F.when(x.isNull(), F.lit("null")).otherwise(lit)


def json_number(col) -> Column:
    """Text of a double the way Python's ``repr`` / ``json.dumps`` writes it
    ('1704067207.179575', '0.0001', '1e-05', '1e+16'); 'null' for null.

    The JVM writes large and small values with an exponent ('1.7E9'); the
    mantissa digits are re-placed following Python's rule: positional for
    exponents -4..15, scientific otherwise."""
    x = _c(col).cast("double")
    s = x.cast("string")
    pat = r"^(-?)([0-9])(?:\.([0-9]+))?E(-?[0-9]+)$"
    sign = F.regexp_extract(s, pat, 1)
    d0 = F.regexp_extract(s, pat, 2)
    frac = F.regexp_replace(F.regexp_extract(s, pat, 3), "0+$", "")
    e = F.regexp_extract(s, pat, 4).try_cast("int")
    digits = F.concat(d0, frac)
    n = F.length(digits)
    positional_big = F.when(
        n <= e + 1, F.concat(digits, F.repeat(F.lit("0"), e + 1 - n), F.lit(".0"))
    ).otherwise(F.concat(digits.substr(F.lit(1), e + 1), F.lit("."), digits.substr(e + 2, F.lit(1 << 20))))
    positional_small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    scientific = F.concat(d0, F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                          F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
                          F.lpad(F.abs(e).cast("string"), 2, "0"))
    conv = F.concat(sign, F.when((e >= 0) & (e < 16), positional_big)
                    .when((e < 0) & (e >= -4), positional_small).otherwise(scientific))
    return (F.when(x.isNull(), F.lit("null"))
            .when(F.isnan(x), F.lit("NaN"))
            .when(x == float("inf"), F.lit("Infinity")).when(x == float("-inf"), F.lit("-Infinity"))
            .when(s.contains("E"), conv).otherwise(s))


def json_compact(col, default: str = "{}") -> Column:
    """Re-serialise a JSON payload compactly, keeping key order, by reading
    it as the raw text of a string field; invalid or missing -> ``default``."""
    x = _c(col)
    wrapped = F.from_json(F.concat(F.lit('{"v":'), x, F.lit("}")), "v string")["v"]
    return F.coalesce(F.when(x.isNotNull(), wrapped), F.lit(default))
