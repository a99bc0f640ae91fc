"""Blocked ordered operators against plain loops, with blocks far smaller than the keys."""

import random

from pyspark.sql import functions as F

from palimpsest.operators.ordered import exclusive_sums, last_known, line_levels, previous


def rows(seed=7, n=60):
    rng = random.Random(seed)
    out = []
    for key in ("a", "b"):
        lines = sorted(rng.sample(range(200), n))
        out += [(key, line, rng.randint(0, 9), rng.choice([None, line])) for line in lines]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "k string, line_index long, x long, y long").repartition(3)


def test_exclusive_sums_both_ways(spark):
    data = rows()
    for back in (False, True):
        got = exclusive_sums(
            frame(spark, data), ["k"], line_levels("line_index", 7, back), {"s": F.col("x"), "n": F.lit(1)}
        )
        for r in got.collect():
            mine = [d for d in data if d[0] == r.k and (d[1] > r.line_index if back else d[1] < r.line_index)]
            assert r.s == sum(d[2] for d in mine) and r.n == len(mine)


def test_exclusive_sums_three_levels(spark):
    data = rows(3)
    levels = [F.col("x"), F.floor(F.col("line_index") / 5).cast("long"), F.col("line_index")]
    for r in exclusive_sums(frame(spark, data), ["k"], levels, {"n": F.lit(1)}).collect():
        assert r.n == sum(1 for d in data if d[0] == r.k and (d[2], d[1]) < (r.x, r.line_index))


def test_previous_and_last_known(spark):
    data = rows(5)
    df = frame(spark, data)
    back = {(r.k, r.line_index): r.p for r in previous(df, ["k"], line_levels(size=4), {"p": F.col("line_index")}).collect()}
    known = {(r.k, r.line_index): r.q for r in last_known(df, ["k"], line_levels(size=4), {"q": F.col("y")}).collect()}
    for key in ("a", "b"):
        last, seen = None, None
        for _, line, _x, y in sorted(d for d in data if d[0] == key and True):
            assert back[key, line] == last
            seen = y if y is not None else seen
            assert known[key, line] == seen
            last = line
