"""Registry of the named queries: a Spark callable and, where the operator is
expressible in SQL, an equivalent DuckDB oracle over the same tables.

Queries are registered by the ``q_*`` modules of this package.  Each Spark
callable receives a ``Fixtures`` builder over ``sf_dir``; each oracle is
the DuckDB ``WITH`` clause of the stand-in views it needs plus its body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialect import render
from .fixtures import Fixtures, cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, views: list[str] | None = None, sql: str | None = None):
    """Decorator: ``fn(fx) -> DataFrame`` becomes ``queries()[name]``.

    ``sql`` is the oracle body; it may refer to ``views`` (defined in a
    leading ``WITH``) and to the driver's base tables.  A body that needs
    CTEs of its own starts with ``, name AS (...)`` continuing that clause.
    """
    def deco(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            head = cte(views).rstrip() if views else ""
            if head:
                body = head + ("\n" if not body.startswith(",") else "") + body
            elif body.startswith(","):
                body = "WITH " + body[1:].lstrip()
            ORACLES[name] = render(body, "duckdb")
        return fn

    return deco


def load_all() -> None:
    """Import every ``q_*`` module so their queries are registered."""
    import importlib
    import pkgutil

    from .. import plans

    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{plans.__name__}.{m.name}")
