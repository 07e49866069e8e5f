"""Declared schemas of the core relations."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _schema(fields: str) -> T.StructType:
    pairs = [f.split() for f in fields.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


CORE: dict[str, T.StructType] = {
    "subTurfCommunity": _schema(
        "turfID string, subTurf int, year int, species string, seedlings int, juvenile int, fertile int, dominant int"
    ),
    "turfCommunity": _schema("turfID string, year int, species string, cover double"),
    "turfs": _schema("turfID string, TTtreat string, GRtreat string, originPlotID string, destinationPlotID string"),
    "plots": _schema("plotID string, blockID string"),
    "blocks": _schema("blockID string, siteID string"),
    "sites": _schema("siteID string, latitude double, longitude double, temperature_level int, precipitation_level int"),
    "turfEnvironment": _schema(
        "turfID string, year int, recorder string, totalVascular double, totalBryophytes double, vegetationHeight double, "
        "mossHeight double, litter double, pleuro double, acro double, liver double, lichen double, soil double, "
        "rock double, totalLichen double, comment string, date string"
    ),
    "subTurfEnvironment": _schema(
        "turfID string, subTurf int, year int, acro double, pleuro double, soil double, litter double, rock double, bad string"
    ),
    "character_traits": _schema("species string, trait string, value string"),
    "numeric_traits": _schema("species string, trait string, value double"),
    "composition": _schema(
        "siteID string, blockID string, Treatment string, turfID string, Year int, graminoidCov double, forbCov double, "
        "mossCov double, vegetationHeight double, mossHeight double, litter double, cover double, species string, "
        "functionalGroup string, sumcover double"
    ),
    "readings": _schema("ID string, siteID string, Date timestamp, Value double, Year int, Block string, Treatment string, turfID string"),
    "weather": _schema(
        "siteID string, precip0916 double, temp0916 double, tempLevel double, precipLevel double, temp7010 double, precip7010 double"
    ),
    "draws": _schema("chain int, draw int, param string, value double"),
}
