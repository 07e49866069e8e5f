"""Species traits, specialism and turnover."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import r_sum
from ..functions.missing import case_when
from ..functions.text import species_code
from ..operators.grouping import community_summary
from ..operators.joins import baseline_delta, r_join

# Range zones from south to north and low to high.
ZONES = ("Nem", "BNem", "SBor", "MBor", "Nbor", "LAlp", "MAlp", "HAlp")
# Species whose predicted traits are unreliable.
UNRELIABLE = "Emp_|Ver_alp|Sil_vul"


def specialism(zones: DataFrame, species: str = "species", trait: str = "trait", value: str = "value") -> DataFrame:
    """Specialist class from range-zone flags in long form.

    Alpine: in the low alpine but not in lowland zones. Lowland: nemoral but in no alpine zone.
    Otherwise by the sum of all flags: generalist from 5.5 on.
    """
    flags = {z: F.max(F.when(F.col(trait) == z, F.col(value))) for z in ("Nem", "BNem", "SBor", "LAlp", "MAlp", "HAlp")}
    wide = zones.groupBy(species).agg(r_sum(value).alias("abundance"), *[e.alias(f"__{z}") for z, e in flags.items()])
    z = {k: F.col(f"__{k}") for k in flags}
    label = case_when(
        ((z["Nem"] == 0) & (z["BNem"] == 0) & (z["SBor"] == 0) & (z["LAlp"] == 1), "alpine"),
        ((z["HAlp"] == 0) & (z["MAlp"] == 0) & (z["LAlp"] == 0) & (z["Nem"] == 1), "lowland"),
        (F.col("abundance") >= 5.5, "generalist"),
        (F.col("abundance") < 5.5, "other"),
    )
    return wide.select(species, "abundance", label.alias("specialism"))


def trait_table(parts: Mapping[str, DataFrame], key: Sequence[str] = ("Site", "Species"), value: str = "predictValue", log_area: str = "logLA") -> DataFrame:
    """One row per site and species with a column per trait, joined on the key.

    The log leaf area becomes its square root, unreliable species are dropped.
    """
    out: DataFrame | None = None
    for name, part in parts.items():
        slim = part.select(*key, F.col(value).alias(name))
        out = slim if out is None else r_join(out, slim, list(key), "full")
    assert out is not None
    if log_area in parts:
        out = out.withColumn("sqrtLA", F.sqrt(F.exp(log_area))).drop(log_area)
    out = out.filter(~F.col(key[1]).rlike(UNRELIABLE))
    names = [c for c in out.columns if c not in key]
    out = out.select(F.col(key[0]).alias("siteID"), species_code(key[1]).alias("species"), *names)
    return out.withColumn("speciesID", F.concat_ws("_", "siteID", "species"))


def turnover(
    df: DataFrame, turf: Sequence[str], time: str, first: object, last: object, traits: Sequence[str] = (), species: str = "species"
) -> DataFrame:
    """Community summaries over species present in both census years, and their change since the first."""
    two = df.filter(F.col(time).isin(first, last))
    both = two.groupBy(*turf, species).agg(F.count_distinct(time).alias("__n")).filter(F.col("__n") == 2).drop("__n")
    kept = r_join(two, both, [*turf, species], "inner")
    summary = community_summary(kept, [*turf, time], traits, species=species)
    cols = ["richness", "diversity", "evenness", "sumcover", *[f"wmean_{t}" for t in traits]]
    return baseline_delta(summary, list(turf), time, first, cols)
