"""Ordered helpers: hot keys must give the rows a plain window gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reckon.functions.lists import duplicate_groups
from reckon.functions.ordered import global_row_number, running_sum, split_hot, with_previous


@pytest.fixture(scope="module")
def rows(spark):
    """Key 0 holds a third of all rows; times repeat."""
    rng = random.Random(7)
    data = [(0 if i % 3 == 0 else rng.randrange(1, 200), rng.randrange(50), i, rng.randrange(1, 90)) for i in range(6000)]
    return spark.createDataFrame(data, "k INT, t INT, id INT, v INT").repartition(5).persist()


@pytest.fixture
def many_ranges(settings):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="7")


def same(left, right):
    return sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.select(*left.columns).collect()), key=str)


@pytest.mark.parametrize("hot_rows", [100, 1000, 10**9, 0])
def test_running_sum(rows, many_ranges, hot_rows):
    order = [F.col("t").desc(), F.col("id").desc()]
    plain = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    expected = rows.withColumn("s", F.sum("v").over(plain))
    assert same(expected, running_sum(rows, ["k"], order, "v", "s", hot_rows))


@pytest.mark.parametrize("hot_rows", [100, 1000, 10**9, 0])
def test_with_previous(rows, many_ranges, hot_rows):
    plain = Window.partitionBy("k").orderBy("t", "id")
    expected = rows.withColumns({"pid": F.lag("id").over(plain), "pt": F.lag("t").over(plain)})
    found = with_previous(rows, ["k"], ["t", "id"], {"pid": "id", "pt": "t"}, hot_rows)
    assert same(expected, found)


def test_hot_keys_are_found_in_the_sample(rows):
    ordinary, hot = split_hot(rows, ["k"], 1000)
    assert [r["k"] for r in hot.select("k").distinct().collect()] == [0]
    assert ordinary.count() + hot.count() == 6000 and hot.count() == 2000
    assert split_hot(rows, ["k"], 5000)[1] is None


def test_hot_key_is_split_over_ranges(rows, many_ranges):
    from reckon.functions.ordered import _in_ranges

    ranged = _in_ranges(rows, ["k"], [F.col("t"), F.col("id")])
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2 * 6000 / 7


def test_global_row_number(rows, many_ranges):
    numbered = global_row_number(rows, [F.col("t"), F.col("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in numbered] == list(range(1, 6001))
    assert [(r["t"], r["id"]) for r in numbered] == sorted((r["t"], r["id"]) for r in numbered)


def test_global_row_number_of_nothing(rows):
    assert global_row_number(rows.filter("id < 0"), [F.col("id")], "n").count() == 0


@pytest.mark.parametrize("broadcast_groups, hot_rows", [(0, 5_000_000), (100_000, 300)])
def test_long_lists_come_in_numbered_parts(rows, broadcast_groups, hot_rows):
    found = duplicate_groups(
        rows, ["k"], "id", "n", "ids", {"vs": F.col("v")}, ids_per_row=50, broadcast_groups=broadcast_groups, hot_rows=hot_rows
    )
    expected = {r["k"]: sorted(r["ids"]) for r in rows.groupBy("k").agg(F.collect_list("id").alias("ids")).collect()}
    values = {r["id"]: r["v"] for r in rows.collect()}
    listed = {}
    for row in found.orderBy("k", "Part").collect():
        ids = [int(x) for x in row["ids"].split(", ")]
        own = expected[row["k"]]
        assert ids == own[(row["Part"] - 1) * 50 : row["Part"] * 50]
        assert [int(x) for x in row["vs"].split(", ")] == [values[i] for i in ids]
        assert (row["n"], row["Parts"]) == (len(own), -(-len(own) // 50))
        listed.setdefault(row["k"], []).extend(ids)
    assert listed == {k: ids for k, ids in expected.items() if len(ids) > 1}


@pytest.mark.parametrize("ids, listed", [([2, 10], "2, 10"), ([2, 10, 9], "2, 9, 10"), ([2], None)])
def test_lists_of_null_keys(spark, ids, listed):
    df = spark.createDataFrame([(None, i) for i in ids] + [("a", 3)], "k STRING, id INT")
    found = duplicate_groups(df, ["k"], "id", "n", "ids").select("k", "n", "ids").collect()
    assert [tuple(r) for r in found] == ([(None, len(ids), listed)] if listed else [])


def test_overdrawn_and_rapid_with_hot_keys(data):
    import datetime

    from reckon.operators.defects import overdrawn_transactions, rapid_duplicates

    assert same(overdrawn_transactions(data.ledger_amounts, data.wallets),
                overdrawn_transactions(data.ledger_amounts, data.wallets, hot_rows=5))
    year = datetime.timedelta(days=2000)
    assert same(rapid_duplicates(data.ledger_amounts, year), rapid_duplicates(data.ledger_amounts, year, hot_rows=1))


def test_last_before_with_hot_keys(rows, many_ranges):
    from reckon.functions.ordered import with_last_before

    sparse = rows.withColumn("w", F.when(F.col("id") % 3 == 0, F.col("v")))
    for hot_rows in (5_000_000, 300):
        last, expected = {}, {}
        for r in sorted(sparse.collect(), key=lambda r: (r["t"], r["id"])):
            expected[r["id"]] = last.get(r["k"])
            if r["w"] is not None:
                last[r["k"]] = r["w"]
        found = with_last_before(sparse, ["k"], ["t", "id"], "w", "before", hot_rows)
        assert {r["id"]: r["before"] for r in found.collect()} == expected


def test_binary_sums_do_not_depend_on_the_order(spark):
    """The same last digit for 1 and 200 partitions, and within a rounding of the exact sum."""
    import math
    import random
    from fractions import Fraction

    from reckon.functions.binary import binary_sums, parts

    rng = random.Random(3)
    values = [(k % 4, rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-30, 30)) for k in range(3000)]
    values += [(5, 0.0), (6, None), (7, 0.1), (7, 0.2), (7, 0.3), (None, 1e16), (None, 1.0), (None, -1e16), (8, 5e-324), (8, 2.0**1000), (8, -0.0)]
    df = spark.createDataFrame(values, "k INT, x DOUBLE")
    found = [
        {r["k"]: r["t"] for r in binary_sums(df.orderBy(F.rand(n)).repartition(n), ["k"], "x", "t").collect()} for n in (1, 200)
    ]
    assert found[0] == found[1]
    for key in {k for k, _ in values}:
        exact = sum((Fraction(x) for k, x in values if k == key and x is not None), Fraction(0))
        assert math.isclose(found[0][key], float(exact), rel_tol=1e-15)
    assert found[0][None] == 1.0 and found[0][7] == 0.6
    for _, x, out in df.withColumn("p", parts(F.col("x"))).filter("x <> 0").collect():
        assert sum(Fraction(p["part"]) * Fraction(2) ** (26 * p["level"]) for p in out) == Fraction(x)
        assert all(abs(p["part"]) < 2**26 for p in out)
