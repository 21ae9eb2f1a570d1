"""Text chunks against cases written out by hand and by what must hold of any packing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafweave.operators import chunks


def cut(spark, texts, limit=chunks.LIMIT):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r["c"] for r in rows.select("id", chunks.chunk_text(F.col("text"), limit).alias("c")).orderBy("id").collect()]


def test_cases(spark):
    cases = {
        None: [""], "short ": ["short "], "a" * 1500 + "\n# b\n" + "c" * 1500: ["a" * 1500, "# b\n" + "c" * 1500], "a" * 6000: ["a" * 6000], " " * 3000: [" " * 2500],
        "x" * 2000 + "\n表 1 t\n" + "y" * 600 + "\n| r |\n" + "z" * 1890: ["x" * 2000, "表 1 t\n" + "y" * 600 + "\n| r |\n" + "z" * 1886 + "z" * 4],
        "a" * 2400 + "\nb\n" + "c" * 200: ["a" * 2400 + "\nb", "c" * 200],
    }
    got = cut(spark, list(cases))
    assert got[:5] == list(cases.values())[:5] and got[6] == list(cases.values())[6]
    assert got[5][0] == "x" * 2000 and got[5][1].startswith("表 1 t")


def squeezed(text):
    return re.sub(r"\s+", "", text)


def test_any_packing(spark):
    rng = random.Random(3)
    limit = 20
    texts = ["".join(rng.choice(["a", "bb ", "\n", "\n\n", "\n# h", "\n|x|", "\n表 1", " "]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, got in zip(texts, cut(spark, texts, limit), strict=True):
        if len(text) <= limit:
            assert got == [text]
            continue
        if not text.strip():
            assert got == [text[:limit]]
            continue
        assert squeezed("".join(got)) == squeezed(text)  # nothing is lost, doubled or moved
        assert all(c == c.strip() and c for c in got)
        for c in got:  # only a line that can't be cut is longer
            assert len(c) <= limit or "\n" not in c, (text, c)
        for one, two in zip(got, got[1:]):  # a piece ends only where the next part wouldn't fit
            assert len(one) + 1 + len(two.split("\n")[0]) <= limit + 3 or len(one) + 1 + len(two) > limit - 3


@pytest.mark.parametrize("limit", [30, 2500])
def test_tables(spark, limit):
    rows = spark.createDataFrame([(1, ["a", "b"], [["1"], ["2", None, "x"]]), (2, [], [["1"]]), (3, ["a"], []), (4, None, None)], "id int, header array<string>, rows array<array<string>>")
    got = {r["id"]: (r["m"], r["c"]) for r in rows.select("id", chunks.markdown(F.col("header"), F.col("rows")).alias("m"), chunks.chunk_table_rows(F.lit(""), F.col("header"), F.col("rows"), limit).alias("c")).collect()}
    head = "| a | b |\n| --- | --- |\n"
    assert got[1][0] == head + "| 1 |  |\n| 2 |  |\n"
    assert got[1][1] == ([head + "| 1 |  |", head + "| 2 |  |"] if limit == 30 else [head + "| 1 |  |\n| 2 |  |"])
    assert got[2] == ("", []) and got[3] == ("| a |\n| --- |\n", []) and got[4] == ("", [])
