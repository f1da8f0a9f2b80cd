"""Driver contract: importable without a session, names consistent."""

import subprocess
import sys

REPO = __file__.rsplit("/tests/", 1)[0]


def test_oracles_load_without_a_spark_session():
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "q, o = E.queries(), E.oracle_sql(); "
            "assert set(o) <= set(q), set(o) - set(q); print(len(q), len(o))" % REPO)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n_queries, n_oracles = map(int, out.stdout.split())
    assert n_queries >= 150 and n_oracles >= 140


def test_every_query_has_a_docstring():
    import __spark_entry__ as E
    assert [k for k, f in E.queries().items() if not (f.__doc__ or "").strip()] == []
