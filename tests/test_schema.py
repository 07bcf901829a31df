"""Name normalisation and mapping."""

from pyspark.sql import functions as F

from transitlab.operators.schema import (
    norm_name, norm_name_col, normalize_columns, resolve_mapping, suggest_mapping, with_ordinal_ids,
)


def test_norm_name():
    assert norm_name("  Orbital Period ") == "orbital_period"
    assert norm_name("Stellar-Mass") == "stellar_mass"
    assert norm_name("a.b/c") == "a_b_c"
    assert norm_name("__x__y__") == "x_y"
    assert norm_name("Teff (K)") == "teff_k"
    assert norm_name(None) == ""


def test_norm_name_column_matches_driver(spark):
    names = ["  Orbital Period ", "Stellar-Mass", "a.b/c", "__x__y__", "Teff (K)", "ÄÖ-x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(norm_name_col(F.col("n"))).collect()]
    assert got == [norm_name(n) for n in names]


def test_suggest_statuses():
    m = {r.detected: (r.mapped_to, r.status) for r in suggest_mapping(["kepid", "koi_period", "TEQ", "mystery", "KOI_DURATION"])}
    assert m["kepid"] == ("object_id", "alias")
    assert m["koi_period"] == ("koi_period", "ok")
    assert m["TEQ"] == ("koi_teq", "alias")
    assert m["mystery"] == ("mystery", "unknown")
    assert m["KOI_DURATION"] == ("koi_duration", "ok")  # D16


def test_collisions_resolved():
    rows = resolve_mapping(["rowid", "kepoi_name", "disposition", "koi_pdisposition", "koi_disposition"])
    m = {r.detected: (r.mapped_to, r.status) for r in rows}
    assert m["kepoi_name"] == ("object_id", "alias")
    assert m["rowid"] == ("rowid", "shadowed")
    assert m["koi_disposition"] == ("koi_disposition", "ok")
    assert m["disposition"][1] == "shadowed" and m["koi_pdisposition"][1] == "shadowed"


def test_normalize_adds_ids_and_disposition(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, None)], "period_days double, rp double")
    out, mapping = normalize_columns(df)
    assert set(out.columns) >= {"koi_period", "koi_prad", "object_id", "koi_disposition"}
    rows = out.collect()
    assert all(r["object_id"].startswith("OBJ-") for r in rows)
    assert rows[0]["object_id"] == rows[1]["object_id"]  # equal rows share a hash id (D13)
    assert dict(out.dtypes)["koi_disposition"] == "string"
    statuses = {m.mapped_to: m.status for m in mapping}
    assert statuses["object_id"] == "generated" and statuses["koi_disposition"] == "generated_empty"


def test_ordinal_ids(spark):
    df = spark.range(0, 1000, numPartitions=7).select(F.col("id").alias("v"))
    ids = [r["object_id"] for r in with_ordinal_ids(df).orderBy("v").collect()]
    assert ids == [f"OBJ-{i}" for i in range(1000)]
