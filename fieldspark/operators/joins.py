"""Joins and comparisons between rows of one table.

Key equality is null-safe and stays an equi-join. No side is broadcast by hint: Spark decides from
table sizes at run time and splits skewed partitions, so a key that holds a third of the rows
neither overloads one task nor one executor.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = str | Sequence[str] | Mapping[str, str]


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def _pairs(by: Keys) -> list[tuple[str, str]]:
    if isinstance(by, str):
        return [(by, by)]
    if isinstance(by, Mapping):
        return list(by.items())
    return [(k, k) for k in by]


def r_join(
    left: DataFrame,
    right: DataFrame,
    by: Keys | None = None,
    how: str = "left",
    suffix: tuple[str, str] = ("", "_new"),
    na_matches: bool = True,
    hot_keys: bool = False,
) -> DataFrame:
    """Join in which missing keys match missing keys and key columns appear once.

    Without ``by`` all common columns are keys. Other columns with the same name get ``suffix``.
    A full join merges the keys of both sides. Spark cannot split a hot key in a full join;
    ``hot_keys`` runs it as an inner join and the two sets of unmatched rows, which it can split.
    """
    if how == "full" and hot_keys:
        return _split_full_join(left, right, by, suffix, na_matches)
    pairs = _pairs(common_columns(left, right) if by is None else by)
    if not pairs:
        raise ValueError("no common columns to join on")
    if how not in ("left", "inner", "full", "right", "left_semi", "left_anti"):
        raise ValueError(f"unknown join type {how}")
    lkeys = [p[0] for p in pairs]
    rkeys = {p[1]: f"__key{i}" for i, p in enumerate(pairs)}
    if how in ("left_semi", "left_anti"):
        right = right.select([F.col(r).alias(t) for r, t in rkeys.items()])
        clash: set[str] = set()
    else:
        clash = set(left.columns) & {c for c in right.columns if c not in rkeys}
    if clash & set(lkeys) and suffix[1] == "":
        raise ValueError("a key of the left side clashes with a column of the right side")
    left = left.select([F.col(c).alias(c + suffix[0]) if c in clash and c not in lkeys else F.col(c) for c in left.columns])
    if how not in ("left_semi", "left_anti"):
        right = right.select(
            [F.col(c).alias(rkeys[c]) if c in rkeys else F.col(c).alias(c + suffix[1] if c in clash else c) for c in right.columns]
        )
    tests = []
    for lk, rk in pairs:
        a, b = left[lk], right[rkeys[rk]]
        tests.append(a.eqNullSafe(b) if na_matches else a == b)
    joined = left.join(right, reduce(and_, tests), how)
    if how in ("left_semi", "left_anti"):
        return joined
    temps = list(rkeys.values())
    if how in ("full", "right"):
        merged = {lk: F.coalesce(F.col(rkeys[rk]), F.col(lk)) for lk, rk in pairs}
        joined = joined.withColumns(merged)
    return joined.drop(*temps)


def _split_full_join(left: DataFrame, right: DataFrame, by: Keys | None, suffix: tuple[str, str], na_matches: bool) -> DataFrame:
    pairs = _pairs(common_columns(left, right) if by is None else by)
    lkeys, rkeys = [a for a, _ in pairs], [b for _, b in pairs]
    both = r_join(left, right, dict(pairs), "inner", suffix, na_matches)
    only_left = r_join(left, right.select(*rkeys).distinct(), dict(pairs), "left_anti", na_matches=na_matches)
    only_right = r_join(right, left.select(*lkeys).distinct(), {b: a for a, b in pairs}, "left_anti", na_matches=na_matches)
    clash = (set(left.columns) - set(lkeys)) & (set(right.columns) - set(rkeys))
    only_left = only_left.withColumnsRenamed({c: c + suffix[0] for c in clash})
    only_right = only_right.withColumnsRenamed({**dict(zip(rkeys, lkeys)), **{c: c + suffix[1] for c in clash}})
    return both.unionByName(only_left, allowMissingColumns=True).unionByName(only_right, allowMissingColumns=True)


def semi(df: DataFrame, keys_df: DataFrame, by: Keys) -> DataFrame:
    """Rows whose key occurs in ``keys_df``."""
    return r_join(df, keys_df, by, "left_semi")


def anti(df: DataFrame, keys_df: DataFrame, by: Keys) -> DataFrame:
    """Rows whose key does not occur in ``keys_df``."""
    return r_join(df, keys_df, by, "left_anti")


def unique_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], what: str = "rows") -> DataFrame:
    """One row per key. A repeated key stops the query with an error, checked inside the plan."""
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in cols])
    message = F.concat(F.lit(f"{what} repeat for key "), F.to_json(F.struct(*keys)))
    ok = F.when(F.col("__n") <= 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return one.filter(ok).drop("__n")


def complete_with(df: DataFrame, frame: DataFrame, keys: Keys, fill: Mapping[str, object] | None = None) -> DataFrame:
    """All rows of ``frame`` with the data of ``df``; gaps get ``fill``."""
    pairs = _pairs(keys)
    out = r_join(frame, df, {f: d for d, f in pairs} if isinstance(keys, Mapping) else keys, "left")
    return out.fillna(dict(fill)) if fill else out


def overlay(df: DataFrame, upd: DataFrame, by: Keys, cols: Sequence[str]) -> DataFrame:
    """Replace ``cols`` of ``df`` by the values of ``upd`` where ``upd`` has them."""
    pairs = _pairs(by)
    slim = upd.select([F.col(r) for _, r in pairs] + [F.col(c).alias(f"__upd_{c}") for c in cols])
    out = r_join(df, slim, by, "left")
    out = out.withColumns({c: F.coalesce(F.col(f"__upd_{c}"), F.col(c)) for c in cols})
    return out.drop(*[f"__upd_{c}" for c in cols])


def anomaly_vs(
    df: DataFrame, ref: Column, on: Sequence[str], cols: Sequence[str], dedupe: bool = False, suffix: str = "_anom"
) -> DataFrame:
    """Value minus the value of the reference rows with the same ``on`` key (block and date).

    ``ref`` selects the reference rows. They must be unique per key; ``dedupe`` first drops exact
    repeats, which arise when the table was joined to several rows per plot before.
    """
    base = df.filter(ref).select(*on, *cols)
    if dedupe:
        base = base.distinct()
    base = unique_by(base, on, cols, "reference rows")
    base = base.select(*on, *[F.col(c).alias(f"{c}_ref") for c in cols])
    out = r_join(df, base, list(on), "left")
    return out.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"{c}_ref") for c in cols})


def paired_delta(
    df: DataFrame, treatment: str, treat: str, control: str, on: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Treatment minus control for each ``on`` key; a missing control gives NULL.

    Both values come from one aggregate, which also checks that neither row repeats.
    """
    t, c = F.col(treatment) == treat, F.col(treatment) == control
    aggs = [F.sum(t.cast("int")).alias("__t"), F.sum(c.cast("int")).alias("__c")]
    for col in cols:
        aggs += [F.max(F.when(t, F.col(col))).alias(col), F.max(F.when(c, F.col(col))).alias(f"{col}_control")]
    pairs = df.filter(F.col(treatment).isin(treat, control)).groupBy(*on).agg(*aggs)
    message = F.concat(F.lit("treatment or control rows repeat for key "), F.to_json(F.struct(*on)))
    once = F.when((F.col("__t") <= 1) & (F.col("__c") <= 1), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    pairs = pairs.filter(once).filter(F.col("__t") >= 1).drop("__t", "__c")
    return pairs.withColumns({f"delta_{col}": F.col(col) - F.col(f"{col}_control") for col in cols})


def baseline_delta(df: DataFrame, key: Sequence[str], time: str, t0: object, cols: Sequence[str], na_matches: bool = True) -> DataFrame:
    """Value minus the value of the same key at time ``t0``.

    Without ``na_matches`` rows with a missing key have no baseline, and a table saved by these keys is joined as it lies.
    """
    base = unique_by(df.filter(F.col(time) == t0), key, cols, "baseline rows")
    base = base.select(*key, *[F.col(c).alias(f"{c}_base") for c in cols])
    out = r_join(df, base, list(key), "left", na_matches=na_matches)
    return out.withColumns({f"delta_{c}": F.col(c) - F.col(f"{c}_base") for c in cols})


def adjacent(df: DataFrame, other: DataFrame, key: Sequence[str], idx: str, cols: Sequence[str], k: int = 1) -> DataFrame:
    """Pair rows of ``df`` with rows of ``other`` whose index differs by exactly ``k``.

    Each row looks up its two neighbour indexes, so this is an equi-join, not a range join.
    """
    look = df.withColumn("__idx", F.explode(F.array(F.col(idx) - k, F.col(idx) + k)))
    near = other.select(*key, F.col(idx).alias(f"{idx}_near"), *[F.col(c).alias(f"{c}_near") for c in cols])
    pairs = {**{c: c for c in key}, "__idx": f"{idx}_near"}
    return r_join(look, near, pairs, "inner").withColumnRenamed("__idx", f"{idx}_near")


def fill_from_alternative(df: DataFrame, pref: DataFrame, key: str, time: str, col: str, alternative: str = "alternative") -> DataFrame:
    """Fill a missing value from the preferred alternative key at the same time.

    ``pref`` holds one alternative per key.
    """
    one = unique_by(pref, [key], [alternative], "alternatives")
    alt = df.select(F.col(key).alias("__alt"), F.col(time).alias("__time"), F.col(col).alias("__value"))
    out = r_join(df, one, [key], "left")
    out = r_join(out, alt, {alternative: "__alt", time: "__time"}, "left")
    return out.withColumn(col, F.coalesce(F.col(col), F.col("__value"))).drop("__value", alternative)


def within_deployment(
    readings: DataFrame, deployment: DataFrame, by: Sequence[str], time: str, start: str, end: str, guard: Column | None = None
) -> DataFrame:
    """Keep readings taken between placement and removal, both ends included.

    A missing bound does not limit. ``guard`` limits the rule to some rows; the others pass.
    """
    out = r_join(readings, deployment, list(by), "left")
    early = F.coalesce(F.col(time) < F.col(start), F.lit(False))
    late = F.coalesce(F.col(time) > F.col(end), F.lit(False))
    bad = early | late
    if guard is not None:
        bad = bad & F.coalesce(guard, F.lit(False))
    return out.filter(~bad)


def grid(frame: DataFrame, axes: Mapping[str, Column]) -> DataFrame:
    """Every combination of axis values for each row of ``frame``.

    ``axes`` are array expressions over the columns of ``frame`` (``sequence``, ``array``), usually
    built from an aggregate. The grid grows in place by ``explode``.
    """
    for name, values in axes.items():
        frame = frame.withColumn(name, F.explode(values))
    return frame


def star(fact: DataFrame, *dimensions: tuple[DataFrame, Keys]) -> DataFrame:
    """Attach dimension tables by a chain of left joins."""
    for dim, by in dimensions:
        fact = r_join(fact, dim, by, "left")
    return fact


def build_community(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Join cover rows to turf, plot, block, site, environment and taxonomy.

    The sub-turf counts are reduced to one row per turf, year and species before the join.
    """
    key = ["turfID", "year", "species"]
    counts = tables["subTurfCommunity"].groupBy(*key).agg(F.count(F.lit(1)).alias("n_subturfs"))
    fact = r_join(counts, tables["turfCommunity"], key, "full")
    return star(
        fact,
        (tables["taxon"], "species"),
        (tables["turfs"], "turfID"),
        (tables["plots"], {"destinationPlotID": "plotID"}),
        (tables["blocks"], "blockID"),
        (tables["sites"], "siteID"),
        (tables["turfEnvironment"], ["turfID", "year"]),
    )
