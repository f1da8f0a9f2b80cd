"""The fixed dimension tables as SQL ``VALUES`` lists (for the oracles)."""

from __future__ import annotations

from .. import dims


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def values(rows, cols: list[str], name: str, with_priority: bool = False) -> str:
    """``name(cols) AS (VALUES ...)`` CTE item."""
    body = ", ".join(
        "(" + ", ".join(_lit(x) for x in (((i,) + tuple(r)) if with_priority else r)) + ")"
        for i, r in enumerate(rows))
    c = (["priority"] if with_priority else []) + cols
    return f"{name}({', '.join(c)}) AS (VALUES {body})"


PRICES = values(dims.PRICES, ["model", "in_per_m", "out_per_m", "provider"], "prices")
PRICE_DEFAULTS = values(dims.PRICE_DEFAULTS, ["provider", "model"], "price_defaults")
PROVIDERS = values(dims.PROVIDERS, ["label", "host_pattern", "name", "category", "strategy"],
                   "providers", with_priority=True)
PATH_HINTS = values(dims.PATH_HINTS, ["hint", "provider"], "path_hints", with_priority=True)
SURROGATES = values(dims.SURROGATES, ["family", "label"], "surrogates", with_priority=True)
SAE_ENTRIES = values(dims.SAE_ENTRIES, ["label", "model", "release", "sae_id"], "sae_entries",
                     with_priority=True)
