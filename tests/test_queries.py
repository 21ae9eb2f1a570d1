"""Every registered query against DuckDB on the smallest tables, and the fold against a plain model."""

import os
import random

import duckdb
import pytest

from leafweave.operators import quality
from leafweave.plans import register

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(register.oracle_sql()))
def test_query(spark, duck, name):
    df = register.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[k] for k in cols)) for r in df.collect())
    r = duck.execute(register.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(x[names.index(k)] for k in cols)) for x in r.fetchall())


def model(states):
    out = list(states)
    for i, c in enumerate(states):
        prev = next((x for x in reversed(out[max(0, i - 5) : i]) if x in "NG"), "")
        nxt = next((x for x in out[i + 1 : i + 6] if x in "NG"), "")
        if c == "E":
            out[i] = "G" if (prev == "G" and nxt in ("G", "")) or (nxt == "G" and prev == "") else "N"
        elif c == "I" and "G" in (prev, nxt):
            out[i] = "G"
    return "".join(out)


def test_resolve_equals_model(spark):
    random.seed(4)
    docs = ["NEG", "GEG", "GE", "IG", "NIIN", "EEEEEE", "GEEEEEEN"] + ["".join(random.choice("NGEEII") for _ in range(random.randint(1, 30))) for _ in range(60)]
    rows = [(str(i), p, c) for i, d in enumerate(docs) for p, c in enumerate(d)]
    out = quality.resolve(spark.createDataFrame(rows, "doc string, page long, c string")).collect()
    got = {}
    for r in out:
        got.setdefault(int(r["doc"]), {})[r["page"]] = r["after"]
    assert ["".join(got[i][p] for p in range(len(d))) for i, d in enumerate(docs)] == [model(d) for d in docs]
