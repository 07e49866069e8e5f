"""From vegetation surveys to a clean composition table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import r_sum
from ..functions.missing import case_when, if_else, is_in, paste, ratio, recode, update_where
from ..functions.text import digits_only
from ..operators.grouping import attach
from ..operators.joins import adjacent, r_join
from ..operators.ordered import sampling_index
from ..session import cut_lineage

PLOT = ["siteID", "blockID", "Treatment", "turfID", "species", "Year"]


@dataclass(frozen=True)
class ObserverRule:
    """Correction of one recorder's covers.

    Without a bound the factor applies to the recorder's rows. With a bound on the ratio of the
    recorder's cover sum to the total vascular cover, it applies to the whole turf and year.
    """

    recorder: str
    factor: float
    below: float | None = None
    above: float | None = None


# Recorder, factor and ratio bound, applied in this order.
OBSERVER_RULES = (
    ObserverRule("PM", 1.2),
    ObserverRule("Siri", 1.3, below=1.35),
    ObserverRule("Owen", 1 / 1.5, above=1.5),
)

# Species without a usable entry in the trait table.
GRAMINOID_NAMES = ("Jun.sp", "Phl.sp", "Luz.tri")
FORB_NAMES = ("Ped.pal", "Pop.tre", "Ste.als", "Ste.sp", "Porub", "Arenaria", "Pilosella")

# Letter in a treatment code, cover column and group of the plants it removes.
REMOVED_COVER = {"F": "forbCov", "G": "graminoidCov", "B": "mossCov"}
REMOVED_GROUP = {"F": "forb", "G": "graminoid", "B": "bryophyte"}

# Removed groups as remaining groups.
REMAINING = {
    "FGB": "Gap", "C": "Intact", "GF": "B", "F": "GB", "FB": "G", "GB": "F", "B": "GF", "G": "FB",
}


def correct_observer_bias(
    df: DataFrame,
    rules: Sequence[ObserverRule] = OBSERVER_RULES,
    keys: Sequence[str] = ("turfID", "Year"),
    cover: str = "cover",
    total: str = "totalVascular",
    recorder: str = "recorder",
) -> DataFrame:
    """Apply the rules one after the other; later rules see the corrected covers.

    All rules need is one row of sums per key, so there is one aggregate and one join, whatever
    the number of rules. A factor on a whole key scales the sums that later rules compare.
    """
    known = F.when(F.col(total) != 0, F.col(total))
    bounded = [r for r in rules if r.below is not None or r.above is not None]
    aggs = []
    for i, rule in enumerate(bounded):
        own = F.col(recorder) == rule.recorder
        missing = F.max((own & F.col(cover).isNull()).cast("int")) == 1
        aggs.append(F.when(~missing, F.sum(F.when(own, F.col(cover)))).alias(f"__s{i}"))
        aggs.append(F.min(F.when(own, known)).alias(f"__lo{i}"))
        aggs.append(F.max(F.when(own, known)).alias(f"__hi{i}"))
    own_factor: dict[str, float] = {}
    key_factor = F.lit(1.0)
    i = 0
    for rule in rules:
        if rule not in bounded:
            own_factor[rule.recorder] = own_factor.get(rule.recorder, 1.0) * rule.factor
            continue
        current = F.col(f"__s{i}") * key_factor * own_factor.get(rule.recorder, 1.0)
        hit = F.lit(False)
        if rule.below is not None:
            hit = hit | (ratio(current, f"__hi{i}") < rule.below)
        if rule.above is not None:
            hit = hit | (ratio(current, f"__lo{i}") > rule.above)
        key_factor = key_factor * F.when(hit, F.lit(rule.factor)).otherwise(F.lit(1.0))
        i += 1
    factor = F.lit(1.0)
    for name, f in own_factor.items():
        factor = F.when(F.col(recorder) == name, F.lit(f)).otherwise(factor)
    if bounded:
        recorders = sorted({r.recorder for r in bounded})
        sums = df.filter(F.col(recorder).isin(recorders)).groupBy(*keys).agg(*aggs)
        factors = sums.select(*keys, key_factor.alias("__f")).filter(F.col("__f") != 1)
        df = r_join(df, factors, list(keys), "left")
        factor = factor * F.coalesce(F.col("__f"), F.lit(1.0))
    return df.withColumn(cover, F.col(cover) * factor).drop("__f")


def harmonise_units(df: DataFrame, cols: Sequence[str], year: str, years: Sequence[int], factor: float) -> DataFrame:
    """Multiply columns by a factor in the listed years."""
    hit = is_in(year, years)
    return df.withColumns({c: F.when(hit, F.col(c) * factor).otherwise(F.col(c)) for c in cols})


def impute_missing_cover(df: DataFrame, exclude_treatments: Sequence[str] = ("XC",)) -> DataFrame:
    """Covers for species that were recorded as present without a cover.

    Candidate (a) is the mean of the previous and the next sampling of the turf, both required;
    candidate (b) the mean of the species at the site in that year. (b) goes before (a), and (a)
    before the recorded value; rows that stay without a cover are dropped.
    """
    # Read five times below.
    df = cut_lineage(df)
    gap = F.col("presence").isNotNull() & F.col("cover").isNull()
    missing = df.filter(gap).select(*PLOT).distinct()
    # Neighbouring years come from the short list of samplings, so the covers are only probed.
    years = neighbour_times(df, ["turfID"], "Year")
    near = r_join(missing, years, ["turfID", "Year"]).withColumn("__near", F.explode(F.array("before", "after")))
    covers = df.filter(F.col("cover").isNotNull()).select("turfID", "species", F.col("Year").alias("__near"), F.col("cover").alias("__c"))
    by_time = (
        r_join(near, covers, ["turfID", "species", "__near"], "inner")
        .groupBy(*PLOT)
        .agg(F.count(F.lit(1)).alias("__n"), F.avg("__c").alias("__a"))
        .filter(F.col("__n") == 2)
        .drop("__n")
    )
    site_mean = df.groupBy("siteID", "species", "Year").agg(F.avg("cover").alias("__b"))
    fixes = r_join(r_join(missing, site_mean, ["siteID", "species", "Year"]), by_time, PLOT)
    own_site = F.when(~F.col("Treatment").isin(list(exclude_treatments)), F.col("__b"))
    fixes = fixes.select(*PLOT, F.coalesce(own_site, F.col("__a")).alias("__fix")).filter(F.col("__fix").isNotNull())
    out = r_join(df, fixes, PLOT)
    out = out.withColumn("cover", F.when(gap, F.col("__fix")).otherwise(F.col("cover"))).drop("__fix")
    return out.filter(F.col("cover").isNotNull())


def neighbour_times(df: DataFrame, key: Sequence[str], time: str) -> DataFrame:
    """Previous and next sampling time of each key and time."""
    times = df.select(*key, time).distinct()
    w = Window.partitionBy(*key).orderBy(time)
    return times.withColumns({"before": F.lag(time).over(w), "after": F.lead(time).over(w)})


def impute_group_cover(df: DataFrame, col: str, treatments: Sequence[str]) -> DataFrame:
    """Missing plot-level group covers as the mean of both neighbouring samplings.

    Returns the imputed plots only.
    """
    index = sampling_index(df, ["turfID"], "Year")
    plot = ["siteID", "blockID", "Treatment", "turfID", "Year"]
    plots = df.select(*plot, col).distinct()
    missing = r_join(plots.filter(F.col(col).isNull() & F.col("Treatment").isin(list(treatments))).drop(col), index, ["turfID", "Year"])
    known = r_join(plots.filter(F.col(col).isNotNull()).select("turfID", "Year", col), index, ["turfID", "Year"])
    near = adjacent(missing, known, ["turfID"], "sampling", [col])
    out = near.groupBy(*plot).agg(F.count(F.lit(1)).alias("__n"), F.avg(f"{col}_near").alias(col))
    return out.filter(F.col("__n") == 2).drop("__n")


def classify_groups(
    df: DataFrame,
    groups: DataFrame,
    graminoids: Sequence[str] = GRAMINOID_NAMES,
    forbs: Sequence[str] = FORB_NAMES,
    merge: Mapping[str, str] | None = None,
) -> DataFrame:
    """Functional group per species: trait table, woody and fern as forb, then name exceptions."""
    merge = merge or {"pteridophyte": "forb", "woody": "forb"}
    out = r_join(df, groups, "species", "left")
    fg = F.col("functionalGroup")
    for part, target in merge.items():
        fg = F.when(F.contains(fg, F.lit(part)), target).otherwise(fg)
    fg = F.when(is_in("species", graminoids), "graminoid").when(is_in("species", forbs), "forb").otherwise(fg)
    return out.withColumn("functionalGroup", fg)


def backfill_group_cover(
    df: DataFrame, totals: Mapping[str, str], keys: Sequence[str] = ("turfID", "Year"), match_group: bool = True
) -> DataFrame:
    """Fill missing plot totals (group → total column) from the species sums.

    With ``match_group=False`` a gap takes the sum of the row's own group, whatever the column.
    """
    if match_group:
        sums = {f"__{g}": F.sum(F.when(F.col("functionalGroup") == g, F.col("cover"))) for g in totals}
        out = attach(df, list(keys), **sums)
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{g}")) for g, c in totals.items()})
        return out.drop(*sums)
    out = attach(df, [*keys, "functionalGroup"], __own=r_sum("cover"))
    return out.withColumns({c: F.coalesce(F.col(c), F.col("__own")) for c in totals.values()}).drop("__own")


def mask_removed(
    df: DataFrame, columns: Mapping[str, str] = REMOVED_COVER, treatment: str = "Treatment", to: float | None = 0.0
) -> DataFrame:
    """Cover of removed groups as 0 or NULL, by the letters of the treatment code."""
    t = F.col(treatment)
    return df.withColumns({c: F.when(t.contains(letter), F.lit(to).cast("double")).otherwise(F.col(c)) for letter, c in columns.items()})


def drop_removed_rows(
    df: DataFrame, groups: Mapping[str, str] = REMOVED_GROUP, treatment: str = "Treatment", group: str = "functionalGroup"
) -> DataFrame:
    """Drop species rows of groups that the treatment removed."""
    bad = F.lit(False)
    for letter, name in groups.items():
        bad = bad | (F.col(treatment).contains(letter) & (F.col(group) == name))
    return df.filter(~bad)


def remaining_groups(c: Column | str, mapping: Mapping[str, str] = REMAINING) -> Column:
    """Treatment named by what remains instead of by what was removed."""
    return recode(c, mapping)


def correct_species(df: DataFrame, by_plot: DataFrame, by_name: DataFrame) -> DataFrame:
    """Rename species by plot and year (a corrected cover wins), then by name."""
    fix = by_plot.select("Year", "turfID", "siteID", F.col("old").alias("species"), F.col("new").alias("__new"), F.col("cover").alias("__cover"))
    out = r_join(df, fix, ["Year", "turfID", "siteID", "species"], "left")
    out = out.withColumns({"species": F.coalesce("__new", "species"), "cover": F.coalesce("__cover", "cover")}).drop("__new", "__cover")
    names = by_name.select(F.col("old").alias("species"), F.col("new").alias("__new"))
    out = r_join(out, names, ["species"], "left")
    return out.withColumn("species", F.coalesce("__new", "species")).drop("__new")


def apply_aliases(df: DataFrame, aliases: DataFrame, turf: str = "turfID", old: str = "TTtreat", new: str = "turfID") -> DataFrame:
    """Turf names of the older experiment as names of shared controls."""
    alias = aliases.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return r_join(df, alias, {turf: "__old"}, "left").withColumn(turf, F.coalesce("__new", turf)).drop("__new")


def repair_keys(df: DataFrame, rules: Sequence[tuple[Column, Mapping[str, object]]]) -> DataFrame:
    """Conditional key fixes, one after the other, from rows of (condition, new values)."""
    for cond, values in rules:
        df = df.withColumns({c: update_where(cond, v, c) for c, v in values.items()})
    return df


def block_number(c: Column | str) -> Column:
    """Digits of a block name that is longer than one character."""
    col = F.col(c) if isinstance(c, str) else c
    return if_else(F.length(col) > 1, digits_only(col), col)


def prefix_turf(turf: str = "turfID", site: str = "siteID", keep: str = "TTC") -> Column:
    """Site prefix of a turf name rebuilt from the site; names with ``keep`` only get the prefix."""
    t = F.col(turf)
    tail = if_else(t.contains(keep), t, F.substr(t, F.lit(4)))
    return paste(F.substring(F.col(site), 1, 3), tail)


def signed_cover(treatment: str = "Treatment", group: str = "functionalGroup", cover: str = "cover") -> Column:
    """Cover counted positive where its group was removed, negative where not; controls positive.

    A row of no removable group has a sign only in controls.
    """
    t, g = F.col(treatment), F.col(group)
    branches = []
    for letter, col in REMOVED_COVER.items():
        branches.append((t.contains(letter) & (g == col), F.lit(1.0)))
        branches.append((~t.contains(letter) & (g == col), F.lit(-1.0)))
    branches.append((t.contains("C"), F.lit(1.0)))
    return F.col(cover) * case_when(*branches)
