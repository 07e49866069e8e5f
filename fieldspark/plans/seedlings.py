"""Seedling counts and survival."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import r_sum
from ..functions.dates import census_year
from ..functions.missing import ColumnLike, as_col, if_else, ratio, recode, row_sum
from ..functions.text import species_code
from ..operators.joins import complete_with
from ..operators.reshape import gather, spread

# Censuses in time order.
CENSUSES = ("aut_09", "spr_10", "aut_10", "spr_11", "aut_11", "spr_12")
# First letter of a status and what it counts.
STATUS = {"S": 1.0, "s": 1.0, "H": 1.0, "C": 1.0, "E": 1.0, "?": 0.0, "T": 0.0, "D": 0.0, "R": 0.0}
# Survival entries.
SURVIVAL = {"dead": 0.0, "alive": 1.0, "not found": 0.0, "1": 1.0, "dezd": 0.0}
# Graminoid names and parts of names.
GRAMINOIDS = ("G", "Ant.odo", "Ave.fle")
GRAMINOID_PARTS = "Agr|Car|Des|Fes|Poa|Luz"


def status_value(c: ColumnLike) -> Column:
    """1 alive, 0 not alive, NULL for other letters."""
    return recode(F.substring(as_col(c), 1, 1), STATUS, default="null")


def without_graminoids(df: DataFrame, col: str = "species") -> DataFrame:
    """Species names cleaned and graminoids dropped; a missing name is dropped with them only if it matches."""
    out = df.withColumn(col, species_code(col))
    s = F.col(col)
    bad = F.coalesce(s.isin(list(GRAMINOIDS)) | s.rlike(GRAMINOID_PARTS), F.lit(False))
    return out.filter(~bad).withColumn(col, F.regexp_replace(s, ".cf|.CF", ""))


def first_seen_only(
    df: DataFrame, keys: Sequence[str], season: str = "season", seed: str = "seed", censuses: Sequence[str] = CENSUSES, literal: bool = False
) -> DataFrame:
    """Count each seedling once: a census is 0 when an earlier census found it alive.

    ``literal`` makes the second census test itself instead of the first, so it is always 0 where
    positive. Returns the long table without missing entries.
    """
    wide = spread(df.select(*keys, season, seed), keys, season, seed, censuses)
    new: dict[str, Column] = {}
    for i, c in enumerate(censuses):
        earlier = list(censuses[:i])
        if literal and i == 1:
            earlier = [c]
        new[c] = if_else(row_sum(*earlier) > 0, F.lit(0.0), F.col(c)) if earlier else F.col(c)
    return gather(wide.select(*keys, *[e.alias(c) for c, e in new.items()]), list(censuses), season, seed, na_rm=True)


def census_history(df: DataFrame, censuses: Sequence[str] = CENSUSES, literal: bool = False) -> DataFrame:
    """Seedlings counted per turf and census.

    ``df`` is long: ``siteID, blockID, Treatment, ID, species, season, seed`` with status letters.
    """
    key = ["siteID", "blockID", "Treatment", "ID", "species"]
    rows = df.withColumn("seed", status_value("seed")).filter(F.col("ID").isNotNull()).select(*key, "season", "seed").distinct()
    once = first_seen_only(rows, key, censuses=censuses, literal=literal)
    turf = F.concat(F.substring("siteID", 1, 3), F.col("blockID").cast("string"), F.col("Treatment"))
    out = once.withColumns({"turfID": turf, "year": census_year("season"), "monthN": F.substring("season", 1, 3)})
    return out.groupBy("turfID", "siteID", "blockID", "Treatment", "year", "monthN").agg(r_sum("seed", na_rm=True).alias("seed"))


def abundance(seed: DataFrame, frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seedlings per plot and round; plots of the frame without any get 0."""
    counts = seed.groupBy(*keys).agg(F.count(F.lit(1)).alias("seed"))
    return complete_with(counts, frame, list(keys), {"seed": 0})


def survival(seed: DataFrame, frame: DataFrame, keys: Sequence[str], mapping: Mapping[str, float] = SURVIVAL) -> DataFrame:
    """Seedlings, survivors and percentage per plot, 0 where none was found. No entry means alive."""
    alive = recode(F.coalesce(F.col("survival"), F.lit("alive")), mapping, default="null")
    counts = (
        seed.withColumn("__a", alive)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("tot"), r_sum("__a").alias("totS"))
        .withColumn("survival", ratio("totS", "tot") * 100.0)
    )
    return complete_with(counts, frame, list(keys), {"tot": 0, "totS": 0.0, "survival": 0.0})
