"""Inline dictionaries: site codes, site fallbacks and shared control turfs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Old code, upper-case code, lower-case code, site name.
SITES = [
    ("Arh", "ARH", "arh", "Arhelleren"),
    ("Ovs", "OVS", "ovs", "Ovstedal"),
    ("Ves", "VES", "ves", "Veskre"),
    ("Skj", "SKJ", "skj", "Skjellingahaugen"),
    ("Lav", "LAV", "lav", "Lavisdalen"),
    ("Gud", "GUD", "gud", "Gudmedalen"),
    ("Ulv", "ULV", "ulv", "Ulvhaugen"),
    ("Vik", "VIK", "vik", "Vikesland"),
    ("Hog", "HOG", "hog", "Hogsete"),
    ("Alr", "ALR", "alr", "Alrust"),
    ("Fau", "FAU", "fau", "Fauske"),
    ("Ram", "RAM", "ram", "Rambera"),
]

# Site, preference, site whose series may fill its gaps.
SITE_FALLBACK = [
    ("Arhelleren", 1, "Ovstedal"),
    ("Ovstedal", 1, "Arhelleren"),
    ("Veskre", 1, "Arhelleren"),
    ("Veskre", 2, "Ovstedal"),
    ("Skjellingahaugen", 1, "Rambera"),
    ("Skjellingahaugen", 2, "Arhelleren"),
    ("Rambera", 1, "Skjellingahaugen"),
    ("Gudmedalen", 1, "Vikesland"),
    ("Gudmedalen", 2, "Lavisdalen"),
    ("Lavisdalen", 1, "Vikesland"),
    ("Lavisdalen", 2, "Gudmedalen"),
    ("Vikesland", 1, "Hogsete"),
    ("Vikesland", 2, "Gudmedalen"),
    ("Hogsete", 1, "Vikesland"),
    ("Hogsete", 2, "Gudmedalen"),
    ("Alrust", 1, "Fauske"),
    ("Fauske", 1, "Alrust"),
    ("Ulvhaugen", 1, "Alrust"),
    ("Ulvhaugen", 2, "Fauske"),
]

# Turf name in the older experiment and its name as a shared control.
TURF_ALIASES = [
    ("51 TTC", "Fau1C"),
    ("57 TTC", "Fau2C"),
    ("68 TTC", "Fau4C"),
    ("73 TTC", "Fau5C"),
    ("29 TTC", "Alr1C"),
    ("31 TTC", "Alr2C"),
    ("37 TTC", "Alr3C"),
    ("134 TTC", "Vik2C"),
    ("140 TTC", "Vik3C"),
    ("141 TTC", "Vik4C"),
    ("146 TTC", "Vik5C"),
    ("101 TTC", "Hog1C"),
    ("110 TTC", "Hog2C"),
    ("115 TTC", "Hog3C"),
    ("286 TTC", "Ovs1C"),
    ("291 TTC", "Ovs2C"),
    ("297 TTC", "Ovs3C"),
    ("211 TTC", "Arh1C"),
    ("222 TTC", "Arh3C"),
    ("226 TTC", "Arh4C"),
    ("263 TTC", "Ves1C"),
    ("281 TTC", "Ves4C"),
    ("194 TTC", "Ram4C"),
    ("198 TTC", "Ram5C"),
    ("6 TTC", "Ulv2C"),
    ("11 TTC", "Ulv3C"),
    ("236 TTC", "Skj1C"),
    ("243 TTC", "Skj2C"),
    ("246 TTC", "Skj3C"),
    ("251 TTC", "Skj4C"),
    ("511 TTC", "Gud12C"),
]

# Site, precipitation level (mm), normals 1970-2010 of precipitation and temperature.
SITE_NORMALS = [
    ("Ulvhaugen", 600.0, 596.0, 6.17),
    ("Lavisdalen", 1200.0, 1321.0, 6.45),
    ("Gudmedalen", 2000.0, 1925.0, 5.87),
    ("Skjellingahaugen", 2700.0, 2725.0, 6.58),
    ("Alrust", 600.0, 789.0, 9.14),
    ("Hogsete", 1200.0, 1356.0, 9.17),
    ("Rambera", 2000.0, 1848.0, 8.77),
    ("Veskre", 2700.0, 3029.0, 8.67),
    ("Fauske", 600.0, 600.0, 10.3),
    ("Vikesland", 1200.0, 1161.0, 10.55),
    ("Arhelleren", 2000.0, 2044.0, 10.6),
    ("Ovstedal", 2700.0, 2923.0, 10.78),
]


def dictionaries(spark: SparkSession) -> dict[str, DataFrame]:
    """The inline tables as DataFrames (12 to 31 rows each)."""
    return {
        "sites": spark.createDataFrame(SITES, "old string, v2 string, v3 string, new string"),
        "site_fallback": spark.createDataFrame(SITE_FALLBACK, "siteID string, pref int, alternative string"),
        "turf_aliases": spark.createDataFrame(TURF_ALIASES, "TTtreat string, turfID string"),
        "site_normals": spark.createDataFrame(
            SITE_NORMALS, "siteID string, precipLevel double, precip7010 double, temp7010 double"
        ),
    }
