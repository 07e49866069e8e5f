import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import neighbours as N
from fieldspark.operators import sketches as SK
from fieldspark.operators.intervals import in_any_window


# --- nearest samplings


def brute_neighbours(rows, k):
    vec = collections.defaultdict(lambda: collections.defaultdict(float))
    for site, year, s, c in rows:
        if s is not None and c is not None:
            vec[site, year][s] += c
    vec = {i: {s: c for s, c in v.items() if c > 0} for i, v in vec.items()}
    vec = {i: v for i, v in vec.items() if v}
    out = {}
    for i, v in vec.items():
        near = []
        for j, w in vec.items():
            if i != j:
                shared = sum(min(c, w[s]) for s, c in sorted(v.items()) if s in w)
                if shared > 0:
                    near.append((-2 * shared / (sum(v.values()) + sum(w.values())), j))
        out[i] = [(n + 1, j, round(1 + d, 9)) for n, (d, j) in enumerate(sorted(near)[:k])]
    return {i: x for i, x in out.items() if x}


def found(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        assert r["jaccard"] == pytest.approx(2 * r["bray"] / (1 + r["bray"]))
        out[r["site"], r["Year"]].append((r["rank"], (r["near_site"], r["near_Year"]), round(r["bray"], 9)))
    return {i: sorted(x) for i, x in out.items()}


SCHEMA = "site int, Year int, species string, cover double"


def samplings(rng, n, hot=True):
    """Clusters of like samplings, one species almost everywhere, and many equal ones."""
    rows = []
    for i in range(n):
        cluster = i % 6
        for s in rng.sample(range(8), 5):
            rows.append((i, 2000 + i % 3, f"c{cluster}s{s}", float(rng.randint(1, 9))))
        if hot and i % 10:
            rows.append((i, 2000 + i % 3, "everywhere", float(rng.randint(1, 4))))
    for i in range(30):
        rows += [(1000 + i, 1999, "c0s1", 4.0), (1000 + i, 1999, "c0s2", 5.0)]
    for i in range(40):
        rows.append((2000 + i, 1999, "alone", 1.0 + i // 10))
    return rows


@pytest.mark.parametrize("block", [512, 4])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_samplings_equal_brute_force(spark, block, k):
    rng = random.Random(block + k)
    rows = samplings(rng, 90)
    rows += [(3000, 1, None, 2.0), (3001, 1, "c0s1", None), (3002, 1, "c0s1", 0.0), (3003, 1, "nobody", 3.0), (5, 2002, "c5s0", 1.0), (5, 2002, "c5s0", 2.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(N.nearest_samplings(df, ["site", "Year"], k, block=block)) == brute_neighbours(rows, k)


def test_bounds_leave_lists_out_and_pairs_uncompared(spark, monkeypatch):
    """A species that all share is not joined where clusters are close, and far fewer than all pairs are compared."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        cluster = i // 10
        rows += [(i, 1, f"k{cluster}s{s}", 10.0 + rng.random()) for s in range(6)] + [(i, 1, "everywhere", 1.0)]
    seen = []
    whole = N._compared

    def counted(pairs, classes):
        seen.append(pairs.count())
        return whole(pairs, classes)

    monkeypatch.setattr(N, "_compared", counted)
    got = found(N.nearest_samplings(spark.createDataFrame(rows, SCHEMA), ["site", "Year"], 3))
    assert got == brute_neighbours(rows, 3)
    # The species everywhere would give 89,700 pairs; the clusters have 2,700.
    assert seen[1] <= 2700


def test_many_equal_samplings_make_no_pairs(spark, monkeypatch):
    rows = [(i, 1, s, 2.0) for i in range(400) for s in ("a", "b")] + [(900, 1, "a", 1.0)]
    seen = []
    whole = N._compared
    monkeypatch.setattr(N, "_compared", lambda p, c: (seen.append(p.count()), whole(p, c))[1])
    got = found(N.nearest_samplings(spark.createDataFrame(rows, SCHEMA), ["site", "Year"], 2))
    assert got == brute_neighbours(rows, 2) and max(seen) <= 2


@pytest.mark.parametrize("numbers", [True, False])
def test_chunks_meet_without_a_row_per_pair(spark, monkeypatch, numbers):
    """Where lists are short no two samplings are laid side by side, and a task gives k rows per sampling, however many chunks there are."""
    rng = random.Random(7)
    rows = [(i, 1, s if numbers else f"s{s:02d}", rng.randint(1, 9) + rng.random()) for i in range(120) for s in rng.sample(range(40), 8)]
    monkeypatch.setattr(N, "CHUNK", 100)
    seen, met = [], []
    whole, meet = N._compared, N._met
    monkeypatch.setattr(N, "_compared", lambda p, c: (seen.append(p.count()), whole(p, c))[1])
    monkeypatch.setattr(N, "_met", lambda c, k: (met.append((c.count(), meet(c, k).count())), meet(c, k))[1])
    df = spark.createDataFrame(rows, "site int, Year int, species " + ("int" if numbers else "string") + ", cover double")
    assert found(N.nearest_samplings(df, ["site", "Year"], 2)) == brute_neighbours(rows, 2)
    chunks, out = met[0]
    assert sum(seen) == 0 and chunks >= 8 and out <= 120 * 2 * max(1, N.TASKS // chunks)


def test_nearest_samplings_of_nothing(spark):
    assert N.nearest_samplings(spark.createDataFrame([], SCHEMA), ["site", "Year"], 2).count() == 0


# --- windows


def test_readings_in_windows_once_each(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 3, 1)
    at = lambda hours: start + dt.timedelta(hours=hours)
    readings = [(rng.choice(["hot", "hot", "b", "c", None]), at(rng.randint(0, 300)), i) for i in range(800)]
    readings += [("b", None, -1), ("hot", at(24), -2), ("hot", at(48), -3), ("zero", at(5), -4)]
    windows = [(rng.choice(["hot", "b"]), at(a), at(a + rng.randint(0, 60))) for a in rng.choices(range(300), k=40)]
    windows += [("c", None, at(40)), ("c", at(250), None), (None, at(0), at(100)), ("hot", at(24), at(48)), ("b", at(90), at(80)), ("d", None, None)]
    r = spark.createDataFrame(readings, "ID string, date timestamp, n int")
    w = spark.createDataFrame(windows, "ID string, a timestamp, b timestamp")
    got = [x["n"] for x in in_any_window(r, w, ["ID"], "date", "a", "b").collect()]
    want = [n for i, t, n in readings if t and any(i == j and (a is None or t >= a) and (b is None or t <= b) and not (a and b and b < a) for j, a, b in windows)]
    assert sorted(got) == sorted(want) and len(got) == len(set(got))
    plan = in_any_window(r, w, ["ID"], "date", "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "__day" in plan and "Cartesian" not in plan
    assert in_any_window(r.filter("false"), w, ["ID"], "date", "a", "b").count() == 0
    assert in_any_window(r, w.filter("false"), ["ID"], "date", "a", "b").count() == 0


# --- sketches


def test_merged_quantile_sketches_are_within_the_bound(spark):
    rng = random.Random(1)
    rows = [(i % 40, i % 2, rng.choice([rng.gauss(0, 1), rng.expovariate(0.1), 3.0])) for i in range(60_000)] + [(0, 0, None), (0, 1, float("nan"))]
    days = SK.quantile_sketches(spark.createDataFrame(rows, "day int, site int, v double"), ["site", "day"], "v")
    probs = [0.01, 0.25, 0.5, 0.9, 0.999]
    out = SK.sketch_quantiles(SK.merged_sketches(days, ["site"]), probs).collect()
    assert len(out) == 10
    for r in out:
        values = sorted(v for _, s, v in rows if s == r["site"] and v is not None and v == v)
        assert r["n"] == len(values)
        below, upto = sum(v < r["quantile"] for v in values) / len(values), sum(v <= r["quantile"] for v in values) / len(values)
        assert below - SK.rank_error() <= r["prob"] <= upto + SK.rank_error()


def test_species_sets_are_exact_below_the_size_and_bounded_above(spark):
    rng = random.Random(2)
    rows = [(p, y, f"s{rng.randint(0, 60)}") for p in range(4) for y in range(6) for _ in range(20)] + [(9, 0, "x"), (8, 5, "y"), (0, 0, None)]
    years = SK.set_sketches(spark.createDataFrame(rows, "p int, y int, s string"), ["p", "y"], "s")
    for r in SK.compared_sets(years, ["p"], {"first": F.col("y") < 3, "second": F.col("y") >= 3}).collect():
        a, b = ({s for p, y, s in rows if p == r["p"] and s and (y < 3) == early} for early in (True, False))
        assert (r["n_first"], r["n_second"], r["n_both"], r["n_gained"], r["n_lost"], r["n_either"]) == (len(a), len(b), len(a & b), len(b - a), len(a - b), len(a | b))
    many = SK.set_sketches(spark.range(100_000).select(F.lit(1).alias("k"), "id"), ["k"], "id")
    n = SK.united_sketches(many, ["k"]).select(SK.set_size("sketch").alias("n")).first()["n"]
    assert abs(n / 100_000 - 1) <= SK.set_error()
