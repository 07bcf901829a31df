"""Feature store look-up, manifests that can be replayed, and upload resolution."""

import json

import pytest

from sample_paths import SF0001
from transitlab.config import FeatureSpec
from transitlab.plans import pipelines
from transitlab.sinks import feature_store
from transitlab.sources import readers
from transitlab.sources.fixtures import koi_fixture


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("store")
    source = str(base / "koi.parquet")
    koi_fixture(spark, SF0001).limit(300).write.parquet(source)
    spec = FeatureSpec.load({"features": [{"name": "koi_prad", "impute": "mean", "transform": "standardize"}], "categorical": [{"name": "stellar_type"}]})
    manifest = pipelines.make_dataset(spark, source, str(base / "fs"), spec, albedo=0.4, feature_version="v7")
    return str(base / "fs" / "manifests"), manifest, spec


def test_manifest_holds_what_made_it(spark, store):
    manifests, manifest, spec = store
    kept = feature_store.newest(spark, manifests)
    assert FeatureSpec.load(json.loads(kept["feature_specs"])) == FeatureSpec(
        features=spec.features, derived=spec.derived, categorical=spec.categorical, target=spec.target, version=spec.version
    )
    assert {"detected": "koi_prad", "mapped_to": "koi_prad", "status": "ok"} in json.loads(kept["schema_map"])
    meta = feature_store.feature_meta(spark, manifests).first()
    assert meta.feature_version == "v7" and meta.rows_loaded == 300 and meta.features_file == manifest["features_file"]


def test_replay_gives_the_same_rows(spark, store, tmp_path):
    manifests, manifest, _ = store
    again = pipelines.replay_dataset(spark, manifests, str(tmp_path / "again"))
    a, b = (spark.read.parquet(m["features_file"]) for m in (manifest, again))
    assert again["albedo"] == 0.4 and again["feature_version"] == "v7" and a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_dataset_is_compressed_and_builds_what_the_specification_reads(spark, store, tmp_path, monkeypatch):
    asked, enrich = [], pipelines.enrich

    def recorded(df, **how):
        asked.append(enrich(df, **how))
        return asked[-1]

    monkeypatch.setattr(pipelines, "enrich", recorded)
    manifest = pipelines.replay_dataset(spark, store[0], str(tmp_path / "again"))
    assert asked[0].columns == ["object_id", "koi_prad", "stellar_type"]
    parts = [name for name in readers.child_names(spark, manifest["features_file"]) if name.startswith("part-")]
    assert parts and all(name.endswith(".zstd.parquet") for name in parts)


def test_listing_and_lookup(spark, store):
    manifests = store[0]
    ids = sorted(r.object_id for r in feature_store.stored_features(spark, manifests).select("object_id").collect())
    page, total = feature_store.list_features(spark, manifests, page_no=2, page_size=20, columns=["object_id", "x"])
    assert total == 300 and page.columns == ["object_id"] and [r[0] for r in page.collect()] == ids[20:40]
    page, total = feature_store.list_features(spark, manifests, query="k.*-1", category="nothing has this column", page_size=0)
    assert total == sum("-1" in i for i in ids) and len(page.collect()) == min(50, total)
    assert feature_store.get_features(spark, manifests, ids[5], ["koi_prad"]).columns == ["koi_prad"]
    assert feature_store.get_features(spark, manifests, "nobody").count() == 0
    plan = feature_store.get_features(spark, manifests, ids[5], ["koi_prad"])._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(object_id,{ids[5]})" in plan


def test_no_manifest_is_an_error(spark, tmp_path):
    spark.createDataFrame([], "timestamp string, features_file string").write.json(str(tmp_path / "m"))
    with pytest.raises(Exception):
        feature_store.newest(spark, str(tmp_path / "m"))


def test_where_an_upload_is(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.csv").write_text("x\n1\n")
    (tmp_path / "up" / "b.parquet").write_text("")
    index = tmp_path / "index.json"
    index.write_text(json.dumps({"id1": str(tmp_path / "up" / "a.csv"), "b": str(tmp_path / "gone.csv")}))
    where = lambda ref: readers.locate_upload(spark, str(index), ref, str(tmp_path / "up")).rsplit("/", 1)[-1]
    assert where("id1") == "a.csv" and where("a") == "a.csv" and where("a.csv") == "a.csv" and where(str(tmp_path / "up" / "b.parquet")) == "b.parquet"
    assert where("b") == "b.parquet"  # the index names a file that is gone
    for ref in ("c", str(tmp_path / "no.csv")):
        with pytest.raises(FileNotFoundError):
            where(ref)
    assert readers.locate_upload(spark, str(tmp_path / "no index"), "a", str(tmp_path / "up")).endswith("a.csv")
