"""Registered queries over sources, uploads, the feature store and browsing."""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureSpec
from ..operators import browse, features
from ..operators.schema import select_existing
from ..sinks import feature_store
from ..sinks.reports import ROWS_CODEC
from ..sources import readers
from ..sources.fixtures import koi_alias, table
from . import pipelines
from .queries import _enriched, _full_queue, _koi, _label_log, _report, _scratch, _text_csv, r6


# ----------------------------------------------------------------- uploads and formats
def _part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")


def _uploads(spark, sf) -> tuple[str, str, dict[str, str]]:
    """An upload folder with two tables, and an index that knows one of them and a file that isn't there."""
    folder = _scratch(spark, "uploads")
    _part(spark, sf).write.option("header", True).csv(f"{folder}/parts.csv")
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.parquet(f"{folder}/suppliers.parquet")
    index = {"f_20240101_000000_a": f"{folder}/parts.csv", "f_20240201_000000_b": f"{folder}/gone.csv"}
    spark.createDataFrame([(json.dumps(index),)], "value string").coalesce(1).write.text(f"{folder}-index")
    return folder, f"{folder}-index", index


def q_upload_resolution(spark, sf):
    """An id of the index, a path, a name without its extension; each loaded by its own format."""
    folder, index, _ = _uploads(spark, sf)
    refs = {"id": "f_20240101_000000_a", "path": f"{folder}/suppliers.parquet", "name": "suppliers"}
    found = None
    for kind, ref in refs.items():
        path = readers.locate_upload(spark, index, ref, folder)
        rows = readers.load(spark, path).agg(F.count(F.lit(1)).alias("rows"))
        own = rows.select(F.lit(kind).alias("ref"), F.lit(readers.suffix_of(path)).alias("format"), "rows")
        found = own if found is None else found.unionByName(own)
    return found


def q_upload_listing(spark, sf):
    """The index, newest id first, with whether the file may be uploaded and how many rows the indexed part table has."""
    _, index, _ = _uploads(spark, sf)
    listed = readers.upload_index(spark, index)
    own = F.element_at(F.split("path", "/"), -1)
    n = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("parts"))
    return listed.join(F.broadcast(n)).select("file_id", own.alias("name"), readers.allowed_file(own).alias("allowed"), "parts")


def q_scan_metadata(spark, sf):
    """What a scan says of a CSV with an unusual delimiter and of a Parquet file."""
    csv, parquet = _text_csv(spark, sf, "|"), _scratch(spark, "scan") + ".parquet"
    _koi(spark, sf).drop("koi_disposition").write.parquet(parquet)
    sep = readers.detect_delimiter(spark, csv)
    metas = [
        readers.scan_meta(readers.read_csv(spark, csv, sep=sep), f"{csv}/x.csv", sep),
        readers.scan_meta(readers.load(spark, parquet), parquet),
    ]
    preview = readers.preview_columns(spark, parquet)
    rows = [(m.format, m.rows, m.cols, m.delimiter, m.koi_disposition_present) for m in metas]
    rows.append(("preview", preview["rows"], len(preview["columns"]), None, "koi_disposition" in preview["columns"]))
    return spark.createDataFrame(rows, "format string, rows long, cols int, delimiter string, koi_disposition_present boolean")


def q_load_formats(spark, sf):
    """One table in every format that is read, by suffix and by name."""
    base, out = _scratch(spark, "formats"), None
    for fmt in ("csv", "json", "parquet", "orc"):
        path = f"{base}/t.{fmt}"
        writer = _part(spark, sf).write
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
        for given in (None, fmt):
            rows = readers.load(spark, path, fmt=given)
            own = rows.select(
                F.lit(fmt).alias("format"), F.lit(given is None).alias("by_suffix"),
                F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand",
            )
            out = own if out is None else out.unionByName(own)
    return out


def q_csv_encoding(spark, sf):
    """A CSV in Latin-1, found out from its bytes."""
    path = _scratch(spark, "latin")
    named = _part(spark, sf).select(F.col("p_partkey").cast("string").alias("p_partkey"), F.concat(F.lit("é"), "p_name", F.lit("ÿ")).alias("p_name"))
    named.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_csv(spark, path, encoding="auto")


def q_safe_filenames(spark, sf):
    """Names made safe, and whether their extension is allowed."""
    odd = F.concat(F.lit(" ._"), "s_name", F.lit("/ü#"), F.col("s_suppkey").cast("string"))
    ext = F.element_at(F.array(*map(F.lit, (".CSV", ".parquet", ".exe", "", ".csv. "))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    named = table(spark, sf, "supplier").select("s_suppkey", F.concat(odd, ext).alias("raw"))
    return named.select("s_suppkey", readers.safe_filename(F.col("raw")).alias("name"), readers.allowed_file(F.col("raw")).alias("allowed"))


# ----------------------------------------------------------------- feature store
def _store(spark, sf) -> str:
    """A dataset made from an upload with raw names; the folder of its manifests."""
    source, out = _scratch(spark, "source") + ".parquet", _scratch(spark, "store")
    koi_alias(spark, sf).write.option("compression", ROWS_CODEC).parquet(source)
    pipelines.make_dataset(spark, source, out)
    return f"{out}/manifests"


def _rounded(df: DataFrame) -> DataFrame:
    double = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[r6(F.col(c)).alias(c) if c in double else F.col(c) for c in df.columns])


def q_feature_store_page(spark, sf):
    """The second page of the ids that match a pattern, of some columns, with the total."""
    columns = ["object_id", "koi_period", "no such column", "koi_prad", "stellar_type_G"]
    page, total = feature_store.list_features(spark, _store(spark, sf), r"7\.1-", "ignored", 2, 30, columns)
    return _rounded(page).withColumn("total", F.lit(total).cast("long"))


def q_feature_store_replay(spark, sf):
    """The newest manifest's dataset, made again from what the manifest says."""
    manifests = _store(spark, sf)
    again = pipelines.replay_dataset(spark, manifests, _scratch(spark, "again"))
    return _rounded(spark.read.parquet(again["features_file"]))


def q_feature_store_lookup(spark, sf):
    """One object's features."""
    first = _koi(spark, sf).agg(F.min("object_id")).first()[0]
    return _rounded(feature_store.get_features(spark, _store(spark, sf), first))


def q_feature_manifest(spark, sf):
    """K6: the ten fields of the newest manifest that don't depend on the place and time of writing."""
    named = feature_store.newest(spark, _store(spark, sf))
    spec = FeatureSpec.load(json.loads(named["feature_specs"]))
    row = (
        named["feature_version"], named["engine_loaded"], named["rows_loaded"], named["albedo"], ",".join(named["feature_names"]),
        len(spec.features) + len(spec.derived), sum(m["status"] == "alias" for m in json.loads(named["schema_map"])),
    )
    kinds = "feature_version string, engine_loaded string, rows_loaded long, albedo double, feature_names string, numeric int, aliases int"
    return spark.createDataFrame([row], kinds)


def q_sparse_onehot(spark, sf):
    """E5: a sparse vector by the value's place; read back as place and size."""
    out, size = features.sparse_onehot(_koi(spark, sf).select("object_id", "stellar_type"), "stellar_type", fill="K")
    places = vector_to_array("stellar_type_vec")
    return out.select(
        "object_id", (F.array_position(places, 1.0) - 1).cast("int").alias("place"), F.size(places).alias("width"), F.lit(size).alias("values")
    )


# ----------------------------------------------------------------- browsing, labels
def q_ui_order(spark, sf):
    """The first 25 rows of the results page."""
    return browse.ui_order(_report(spark, sf))


def q_page_after(spark, sf):
    """The page after a row, by score and id."""
    last = _report(spark, sf).where("category = 'rocky_candidate'").agg(F.min("object_id")).first()[0]
    return browse.page_after(_report(spark, sf), "score", (0.6, last), 40)


def q_column_subset(spark, sf):
    """P10: the columns asked for that exist; all if none does."""
    rows = _report(spark, sf)
    some = select_existing(rows, ["category", "nothing", " object_id "])
    return some.withColumn("all_columns", F.lit(len(select_existing(rows, ["nothing"]).columns)))


def q_queue_counts(spark, sf):
    """A10: the queue's size before and after the labels."""
    queue = _full_queue(spark, sf)
    left = pipelines.apply_labels(queue, _label_log(spark, sf))
    return spark.createDataFrame([(browse.total_rows(queue), browse.total_rows(left))], "queued long, open long")


def q_label_append(spark, sf):
    """K8: two appends to a log, numbered one after the other, and the newest label of each object."""
    from ..operators.splits import latest_labels

    log = _scratch(spark, "label-log")
    events = _label_log(spark, sf)
    for number in (1, 2):
        pipelines.apply_label(spark, events.where(F.col("seq") == number).drop("seq"), log)
    return latest_labels(spark.read.parquet(log))


def source_registry() -> dict:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
