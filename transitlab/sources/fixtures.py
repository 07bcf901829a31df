"""Driver tables -> candidate tables of the reference's shape (FIXTURES.md B, C).

One candidate row per ``lineitem`` row; every value is a deterministic
function of that row, so the fixture is a narrow projection of the scan (only
the eleven lineitem columns it reads reach the Parquet reader).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINEITEM_COLUMNS = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(c: Column) -> Column:
    return c.cast("double")


def koi_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """The candidate fixture over a lineitem DataFrame."""
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    q, price, disc, tax = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    return lineitem.select(
        F.concat(
            F.lit("K"), ok.cast("string"), F.lit("."), ln.cast("string"), F.lit("-"),
            pk.cast("string"), F.lit("-"), sk.cast("string"),
        ).alias("object_id"),
        ok.alias("star_id"),
        _d(F.when(pk % 13 == 0, None).when(pk % 13 == 1, -q).otherwise(q * 0.4 * (1 + ln))).alias("koi_period"),
        _d(
            F.when(sk % 12 == 0, None).when(sk % 12 == 1, q).when(sk % 12 == 2, F.lit(-1.0)).otherwise(price / 8000)
        ).alias("koi_prad"),
        _d(F.when(sk % 5 == 0, 0.05 * q)).alias("koi_sma"),
        _d(F.when(pk % 7 == 0, None).otherwise(0.5 + tax * 10)).alias("koi_smass"),
        _d(F.when(pk % 17 == 0, None).when(pk % 17 == 1, F.lit(0.0)).otherwise(0.5 + disc * 10)).alias("koi_srad"),
        _d(F.when(pk % 19 == 0, None).otherwise(3.5 + tax * 20)).alias("koi_slogg"),
        _d(
            F.when(sk % 9 == 0, None).when(sk % 9 == 1, F.lit(1500.0)).when(sk % 9 == 2, F.lit(11000.0))
            .otherwise(3500 + q * 60)
        ).alias("koi_steff"),
        _d(F.when(ln.isin(1, 2), 50 + (50 - q) * 8)).alias("koi_teq"),
        _d(F.when(ln.isin(1, 4), q * 0.1)).alias("koi_insol"),
        _d(F.when(pk % 3 == 0, None).otherwise(q * 30)).alias("koi_duration"),
        _d(F.when(pk % 4 == 0, None).when(pk % 4 == 1, F.lit(1.2)).otherwise(disc * 5)).alias("koi_impact"),
        F.when((rf == "R") & (ls == "O"), "CONFIRMED")
        .when(rf == "R", "FALSE POSITIVE")
        .when((rf == "N") & (ls == "O"), "CANDIDATE")
        .when(rf == "N", " candidate ")
        .when(ls == "F", None)
        .otherwise("")
        .alias("koi_disposition"),
        F.when(ln % 5 == 0, "F").when(ln % 5 == 1, "G").when(ln % 5 == 2, "K").when(ln % 5 == 3, "M")
        .alias("stellar_type"),
        _d(F.when(pk % 6 == 0, None).otherwise(tax * 20 - 0.2)).alias("uncertainty"),
        F.col("l_shipdate").alias("discovery_date"),
    )


def koi_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``koi_fixture``: the candidate table at a scale-factor directory."""
    return koi_from_lineitem(table(spark, sf_dir, "lineitem").select(*LINEITEM_COLUMNS))


# Renames of the alias fixture (FIXTURES.md C, koi_alias).
ALIAS_RENAMES = {
    "object_id": "kepoi_name",
    "koi_period": "Orbital Period",
    "koi_prad": "pl_rade",
    "koi_teq": "TEQ",
    "koi_smass": "Stellar-Mass",
    "koi_disposition": "disposition",
}


def koi_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``koi_alias``: raw names, an id collision (``rowid``) and an unknown column."""
    k = koi_fixture(spark, sf_dir)
    cols = [F.col(c).alias(ALIAS_RENAMES.get(c, c)) for c in k.columns if c != "discovery_date"]
    return k.select(
        *cols,
        F.concat(F.lit("R"), F.col("star_id").cast("string")).alias("rowid"),
        (F.col("star_id") % 10).alias("my_extra"),
    )


def koi_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``koi_text``: numerics as strings, every tenth row's value replaced by a
    null token (it is NA for all) and some cells by ``abc``."""
    k = koi_fixture(spark, sf_dir).drop("discovery_date")
    # One remainder serves all columns, and a multiple of ten always has the first of the five tokens: with a
    # sum, a remainder and a look-up for each column the generated method passes HotSpot's limit of 8,000 bytes,
    # beyond which it is never compiled.
    tenth = F.pmod("star_id", F.lit(10))
    out = []
    for i, c in enumerate(k.columns):
        s = F.col(c).cast("string")
        if c in ("object_id", "koi_disposition", "stellar_type"):
            out.append(s.alias(c))
            continue
        v = (
            F.when(tenth == -i % 10, F.lit("NA"))
            .when((F.col("star_id") + F.lit(i)) % 97 == 3, F.lit("abc"))
            .otherwise(s)
        )
        out.append(v.alias(c))
    # quotes, separators and words that pandas takes for missing, each for some stars
    remark = (
        F.when(F.col("star_id") % 4 == 0, F.concat(F.lit('seen "twice", by '), F.col("object_id")))
        .when(F.col("star_id") % 4 == 1, F.lit("a;b|c\td,"))
        .when(F.col("star_id") % 4 == 2, F.lit("N/A"))
        .otherwise(F.lit('"'))
    )
    return k.select(*out, remark.alias("remark"))
