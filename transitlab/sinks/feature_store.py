"""The feature store (E9, K5, K6, S12): datasets with manifests that say all that made them, and look-up through the newest.

A manifest holds the feature specification and the column mapping themselves, as
JSON, so its dataset can be made again from its source. The newest manifest names
the features file; listing and look-up read that file alone, with filters and the
columns asked for pushed into the scan.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureSpec
from ..operators import browse
from ..operators.schema import MappingRow, select_existing
from .reports import latest_manifest


def spec_text(spec: FeatureSpec) -> str:
    """The specification in the form that ``FeatureSpec.load`` takes."""
    return json.dumps(
        {
            "version": spec.version,
            "target": {"name": spec.target} if spec.target else None,
            "features": list(spec.features),
            "derived": list(spec.derived),
            "categorical": list(spec.categorical),
        }
    )


def mapping_text(mapping: Sequence[MappingRow]) -> str:
    return json.dumps([asdict(m) if hasattr(m, "__dataclass_fields__") else list(m) for m in mapping])


def newest(spark: SparkSession, manifests_dir: str) -> dict:
    """The newest manifest; an error where there is none."""
    row = latest_manifest(spark, manifests_dir).first()
    if row is None:
        raise FileNotFoundError(f"no manifest under {manifests_dir}")
    return row.asDict()


def feature_meta(spark: SparkSession, manifests_dir: str) -> DataFrame:
    """What the store's front page says of the newest dataset: one row."""
    names = ("feature_version", "features_file", "rows_loaded", "feature_names", "timestamp", "source_file")
    return latest_manifest(spark, manifests_dir).select(*names)


def stored_features(spark: SparkSession, manifests_dir: str) -> DataFrame:
    return spark.read.parquet(newest(spark, manifests_dir)["features_file"])


def list_features(
    spark: SparkSession,
    manifests_dir: str,
    query: str | None = None,
    category: str | None = None,
    page_no: int = 1,
    page_size: int = 50,
    columns: Sequence[str] | None = None,
) -> tuple[DataFrame, int]:
    """A page of the features by id, and how many rows the filters leave.

    ``query`` is a pattern looked for in the id, whatever the case; ``category`` must
    be equal, and is ignored if the features have no such column. Of ``columns`` those
    that exist are kept; all if none does."""
    rows = browse.filter_category(browse.search_id_regex(stored_features(spark, manifests_dir), query), category)
    page = browse.page(rows, page_no, page_size, ["object_id"] if "object_id" in rows.columns else rows.columns)
    return select_existing(page, columns), rows.count()


def get_features(spark: SparkSession, manifests_dir: str, object_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The feature row of one object (none if it isn't there): the first one if the id repeats."""
    rows = stored_features(spark, manifests_dir)
    if "object_id" not in rows.columns:
        raise ValueError("the features have no column object_id")
    return select_existing(browse.lookup_object(rows, object_id), columns)
