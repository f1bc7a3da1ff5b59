"""Scans, intervals, normal functions and nearest neighbours against brute force."""

import math
import random
import re
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from introna.functions import normal
from introna.functions.checks import require_empty
from introna.operators import intervals, neighbors, scans


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_before_and_median(spark):
    rng = random.Random(1)
    values = [(i, rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(values, "k long, v long").repartition(7)
    got = {r["k"]: r["before"] for r in scans.running_before(df, ["k"], {"before": F.col("v")}).collect()}
    total = 0
    for k, v in values:
        assert got[k] == total
        total += v
    for size in (1, 2, 499, 500):
        part = df.filter(F.col("k") < size)
        assert part.select(scans.exact_median(part, "v")).first()[0] == float(np.median([v for _, v in values[:size]]))


def test_running_by_key_blocks_and_least(spark):
    rng = random.Random(2)
    data = [("a" if i % 3 else "b", i, rng.random()) for i in range(300)]
    df = spark.createDataFrame(data, "key string, i long, v double")
    one = scans.running_before_by(df, ["key"], ["i"], {"n": F.lit(1)})
    two = scans.running_in_blocks(df, ["key"], F.floor(F.col("i") / 17), ["i"], {"n": F.lit(1)})
    assert rows(one.select("key", "i", "n")) == rows(two.select("key", "i", "n"))
    assert one.filter("key = 'b'").agg(F.max("n")).first()[0] == 99
    least = scans.least_from_here(df, "i", F.col("v"), "m", block=13)
    values = [v for _, _, v in data]
    for r in least.collect():
        assert r["m"] == min(values[r["i"]:])


def test_following_crosses_stretches(spark):
    data = [("g", s, s + 5) for s in (1, 3, 900, 901, 5000)]
    got = scans.following(spark.createDataFrame(data, "g string, s long, e long"), ["g"], ["s", "e"], 100)
    assert {r["s"]: r["_next"] and r["_next"]["s"] for r in got.collect()} == {1: 3, 3: 900, 900: 901, 901: 5000, 5000: None}


@pytest.mark.parametrize("touching", [False, True])
def test_merge_intervals(spark, touching):
    rng = random.Random(3)
    data = [(f"g{rng.randint(0, 2)}", s, s + rng.randint(1, 40)) for s in (rng.randint(0, 2000) for _ in range(300))]
    want = []
    for g in sorted({d[0] for d in data}):
        current = None
        for s, e in sorted((s, e) for k, s, e in data if k == g):
            if current and (s <= current[1] if touching else s < current[1]):
                current[1] = max(current[1], e)
            else:
                current = [s, e]
                want.append((g, current))
    want = sorted((g, a, b) for g, (a, b) in want)
    df = spark.createDataFrame(data, "g string, start long, end long")
    for block in (8, 64, 1 << 20):
        assert rows(intervals.merge_intervals(df, ["g"], touching, block).select("g", "start", "end")) == want


@pytest.mark.parametrize("width", [4, 64])
def test_range_join(spark, width):
    rng = random.Random(4)
    sizes = [0, 3, 60, 700, 9000, 250_000_000]
    make = lambda n: [(f"c{rng.randint(0, 1)}", i, s, s + rng.randint(0, rng.choice(sizes[:5]))) for i, s in enumerate(rng.randint(-500, 8000) for _ in range(n))]
    a, b = make(80), [*make(80), ("c0", 80, -1000, sizes[5]), ("c1", 81, 5, 2), ("c1", 82, 7, None)]
    left = spark.createDataFrame([*a, ("c0", 80, 9, None)], "c string, i long, s long, e long")
    right = spark.createDataFrame(b, "c string, j long, s2 long, e2 long")
    got = rows(intervals.range_join(left, right, ["c"], ("s", "e"), ("s2", "e2"), width).select("i", "j"))
    assert got == sorted((x[1], y[1]) for x in a for y in b[:81] if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    # a stored interval has two rows at most, however long
    level = intervals.bin_level(F.col("s2"), F.col("e2"), width)
    spread = right.filter("s2 <= e2").select(F.size(intervals._bins(F.col("s2"), F.col("e2"), level, width)).alias("n"))
    assert spread.agg(F.max("n")).first()[0] <= 2
    none = right.filter("j < 0")
    assert intervals.range_join(left, none, ["c"], ("s", "e"), ("s2", "e2"), width).count() == 0


def test_normal_functions(spark):
    p = [1e-300, 1e-40, 1e-9, 0.001, 0.024, 0.03, 0.3, 0.5, 0.77, 0.98, 0.999]
    df = spark.createDataFrame([(v,) for v in p], "p double")
    for r in df.select("p", normal.normal_isf(F.col("p")).alias("z")).collect():
        if r["p"] > 1e-15:
            assert r["z"] == pytest.approx(-NormalDist().inv_cdf(r["p"]), abs=1e-7)
        assert 0.5 * math.erfc(r["z"] / math.sqrt(2)) == pytest.approx(r["p"], rel=1e-5)
    z = [-8.0, -3.0, -0.5, 0.0, 0.1, 1.96, 5.0, 7.5, 20.0, 37.0]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    for r in df.select("z", normal.normal_sf(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-6)
    edge = spark.createDataFrame([(0.0, 1.0, None)], "a double, b double, c double")
    a, b, c = edge.select(*[normal.normal_isf(F.col(x)) for x in "abc"]).first()
    assert a > 37 and b == float("-inf") and c is None


@pytest.mark.parametrize("kind", ["clusters", "copies", "strings"])
def test_nearest_neighbours(spark, kind):
    rng = np.random.default_rng(5)
    n, dim, k = 240, 5, 6
    x = rng.normal(size=(n, dim)) + rng.integers(0, 4, size=(n, 1)) * 6
    if kind == "copies":
        x[::3] = x[0]
    ids = [f"c{i:04d}" if kind == "strings" else i for i in range(n)]
    df = spark.createDataFrame([(ids[i], x[i].tolist()) for i in range(n)], f"cell_id {'string' if kind == 'strings' else 'long'}, x_z array<double>")
    got = {}
    # tiny blocks force many tiles and the bounds on candidates
    for r in neighbors.nearest_neighbours(df, k, block_rows=12).collect():
        got.setdefault(r["main_name"], []).append((r["distance"], r["neighbor"]))
    for i in range(n):
        want = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), ids[j]) for j in range(n))[:k]
        assert [b for _, b in sorted(got[ids[i]])] == [b for _, b in want]


def test_nearest_neighbours_prunes_in_64_dimensions(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 64)) * 4
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 64)) @ np.diag(np.linspace(1, 0.05, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, x_z array<double>")
    lists, report = neighbors.nearest_with_report(df, 8, block_rows=100)
    got = {}
    for r in lists.collect():
        got.setdefault(r["main_name"], []).append((r["distance"], r["neighbor"]))
    far = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    for i in range(len(x)):
        assert {b for _, b in got[i]} == set(np.lexsort((np.arange(len(x)), far[i]))[:8].tolist())
    row = report.first()
    assert row["computed"] < 0.3 * len(x) * (len(x) - 1) / 2 and row["computed"] <= row["met"]


def test_nearest_neighbours_of_few_and_none(spark):
    none = spark.createDataFrame([], "cell_id long, x_z array<double>")
    assert neighbors.nearest_neighbours(none).count() == 0
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [5.0, 1.0])], "cell_id long, x_z array<double>")
    got = sorted(tuple(r) for r in neighbors.nearest_neighbours(few, 10).collect())
    assert got == [(1, 1, 0.0), (1, 2, 0.0), (1, 4, 5.0), (2, 1, 0.0), (2, 2, 0.0), (2, 4, 5.0), (4, 1, 5.0), (4, 2, 5.0), (4, 4, 0.0)]


def test_require_empty_raises(spark):
    df = spark.range(3)
    assert require_empty(df, df.filter("id > 5"), "no").count() == 3
    with pytest.raises(Exception, match="too large"):
        require_empty(df, df.filter("id > 1"), "too large").collect()


def test_overlap_pairs_are_counted_where_they_are_found(spark, monkeypatch):
    from introna.operators import counts

    rng = random.Random(5)
    reads = [("c", rng.randint(1, 900), rng.choice(["50M", "20M30N20M", "10M5N10M60N10M", "30M400N5M"])) for _ in range(120)]
    places = [("c", s, s + rng.randint(0, 90), rng.choice("abcdef")) for s in (rng.randint(1, 1400) for _ in range(90))] + [("c", 300, 200, "a")]

    def covered(pos, cigar):
        for n, kind in re.findall(r"(\d+)([MN])", cigar):
            if kind == "M":
                yield pos, pos + int(n) - 1
            pos += int(n)

    want = {}
    for _, pos, cigar in reads:
        for gene in {g for _, s, e, g in places if any(b <= e and s <= t and s <= e for b, t in covered(pos, cigar))}:
            want[gene] = want.get(gene, 0) + 1
    rows, features = spark.createDataFrame(reads, "chrom string, pos long, cigar string"), spark.createDataFrame(places, "chrom string, start long, end long, gene_id string")
    for limit in (1 << 16, 100):
        monkeypatch.setattr(counts, "LONG_SPAN", limit)
        found = counts.overlap_counts(rows, features, ["gene_id"], width=64)
        assert {r["gene_id"]: r["count"] for r in found.collect()} == want
    monkeypatch.undo()
    plan = counts.overlap_counts(rows, features, ["gene_id"], width=64)._jdf.queryExecution().optimizedPlan().toString()
    # one aggregate sums up, one lists the levels; none makes the pairs distinct
    assert plan.split("Join")[0].count("Aggregate") == 1
