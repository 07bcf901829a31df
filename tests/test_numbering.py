"""Row numbers are sound whatever Spark does with the plan around them."""

import pytest
from pyspark.sql import functions as F

from transitlab import session
from transitlab.operators.ordering import with_positions
from transitlab.operators.schema import with_ordinal_ids


@pytest.fixture(scope="module")
def wide(spark):
    """Shuffled rows, wide enough that the count and the rows would be coalesced differently."""
    cols = [F.sha2((F.col("id") + i).cast("string"), 512).alias(f"c{i}") for i in range(6)]
    return spark.range(60_000).select("id", (F.col("id") % 997).alias("k"), *cols).repartition("k")


def test_ordinal_ids_are_distinct(spark, wide):
    ids = with_ordinal_ids(wide)
    spark.catalog.clearCache()
    numbers = ids.select(F.substring("object_id", 5, 20).cast("long").alias("n"))
    assert numbers.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (60_000, 0, 59_999)


def test_positions_follow_the_order(spark, wide, tmp_path):
    ranked = with_positions(wide, [F.col("k").desc(), F.col("id").asc()], start=5)
    spark.catalog.clearCache()
    ranked.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("pos").select("pos", "k", "id").collect()
    assert [r.pos for r in rows] == list(range(5, 60_005))
    assert [(-r.k, r.id) for r in rows] == sorted((-r.k, r.id) for r in rows)
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_empty_input(spark):
    assert with_positions(spark.createDataFrame([], "a int"), [F.col("a")]).count() == 0


class Cluster:
    """A session on a cluster that names no shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"
        folder = None

        @classmethod
        def getCheckpointDir(cls):  # noqa: N802
            return cls.folder

        @classmethod
        def setCheckpointDir(cls, folder):  # noqa: N802
            cls.folder = folder

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_no_machine_local_scratch_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Cluster)
    assert session.checkpoint_dir(Cluster, "hdfs:///scratch") == "hdfs:///scratch"
