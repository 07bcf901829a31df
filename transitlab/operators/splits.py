"""Dataset splits declared by the split rules.

The plain assignment is a pure function of the group key (an md5 bucket), so it
needs no shuffle, is identical on every run and engine, and never puts one group
in two splits. The stratified one deals out the groups of each class by their rank
in the same bucket order. Class statistics are small group-bys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SplitConfig
from ..functions.rules import disposition_category
from ..functions.sampling import hash_bucket
from ..session import cut_lineage
from .ordering import PLACE_BITS

SPLITS = ("train", "val", "test")


def split_filter(df: DataFrame, cfg: SplitConfig | None = None, label_col: str = "label") -> DataFrame:
    """Required non-nulls, sanity ranges, excluded labels and dispositions."""
    cfg = cfg or SplitConfig.load()
    f = cfg["filters"]
    out = df
    for c in f.get("require_non_null", []):
        out = out.where(F.col(c).isNotNull())
    for c, (lo, hi) in (f.get("ranges") or {}).items():
        out = out.where(F.col(c).between(float(lo), float(hi)))
    ex = cfg["exclude"]
    if ex.get("labels") and label_col in df.columns:
        out = out.where(~F.coalesce(F.col(label_col), F.lit("")).isin(*ex["labels"]))
    if ex.get("dispositions") and "koi_disposition" in df.columns:
        out = out.where(~F.coalesce(disposition_category(F.col("koi_disposition")), F.lit("")).isin(*ex["dispositions"]))
    return out


def grouped_split(df: DataFrame, cfg: SplitConfig | None = None) -> DataFrame:
    """train/val/test by the group's bucket and the cumulative ratios."""
    cfg = cfg or SplitConfig.load()
    r = cfg["primary"]["ratios"]
    b = hash_bucket(F.col(cfg["group_col"]), cfg["seed"])
    t1 = float(r["train"])
    t2 = float(r["train"]) + float(r["val"])
    return df.withColumn("split", F.when(b < t1, "train").when(b < t2, "val").otherwise("test"))


def stratified_split(df: DataFrame, cfg: SplitConfig | None = None, label_col: str = "label") -> DataFrame:
    """Grouped and stratified: the groups of each class are dealt out by the ratios, whole.

    A group's class is its most frequent label (ties: the first by name). Within a
    class groups stand in the order of their buckets, and the split is decided by
    the share of the class' rows before a group: so each split gets its ratio of
    each class up to one group. The running sums are numbered over one stored
    table of groups (a row each), without a window over a whole class."""
    cfg = cfg or SplitConfig.load()
    group = cfg["group_col"]
    counts = df.groupBy(group, F.coalesce(F.col(label_col), F.lit("")).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy(group).agg(
        F.min(F.struct((-F.col("__n")).alias("n"), "__label"))["__label"].alias("__class"),
        F.sum("__n").alias("__rows"),
    )
    bucket = hash_bucket(F.col(group), cfg["seed"])
    dealt = running_share(totals, "__class", [bucket.asc(), F.col(group).asc()], "__rows", "__share")
    r = cfg["primary"]["ratios"]
    t1, t2 = float(r["train"]), float(r["train"]) + float(r["val"])
    named = dealt.select(
        group, F.when(F.col("__share") < t1, "train").when(F.col("__share") < t2, "val").otherwise("test").alias("split")
    )
    return df.join(named, group)


def running_share(df: DataFrame, key: str, order: list[Column], weight: str, name: str) -> DataFrame:
    """``name`` = share of the key's total ``weight`` that stands before the row, in ``order`` within the key.

    A sort by (key, order) is stored with its partitions; running sums inside a
    partition, plus the sums of the partitions before it (a row for each partition
    and key), replace a window over all rows of a key."""
    ranked = cut_lineage(df.orderBy(F.col(key).asc(), *order).withColumn("__at", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("__part", F.shiftright("__at", PLACE_BITS))
    parts = ranked.groupBy(key, "__part").agg(F.sum(weight).alias("__sum"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    parts = parts.withColumn("__total", F.sum("__sum").over(Window.partitionBy(key)))
    inside = Window.partitionBy(key, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    local = ranked.withColumn("__inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = local.join(parts.select(key, "__part", "__base", "__total"), [key, "__part"])
    return joined.withColumn(name, (F.col("__base") + F.col("__inside")) / F.col("__total")).drop(
        "__at", "__part", "__base", "__inside", "__total"
    )


def split_class_counts(split_df: DataFrame, label_col: str = "label", cfg: SplitConfig | None = None) -> DataFrame:
    """Rows per (split, class) with the configured minimum and a pass flag."""
    cfg = cfg or SplitConfig.load()
    mins = cfg["primary"]["min_per_class"]
    need = F.create_map(*[x for k, v in mins.items() for x in (F.lit(k), F.lit(int(v)))])
    return (
        split_df.groupBy("split", F.col(label_col).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("min_required", F.coalesce(F.try_element_at(need, F.col("split")), F.lit(0)))
        .withColumn("meets_min", F.col("n") >= F.col("min_required"))
    )


def kfold(df: DataFrame, cfg: SplitConfig | None = None) -> DataFrame:
    """Grouped k-fold index in [0, folds)."""
    cfg = cfg or SplitConfig.load()
    folds = int(cfg["cv"]["folds"])
    b = hash_bucket(F.col(cfg["group_col"]), cfg["seed"], "fold")
    return df.withColumn("fold", F.floor(b * F.lit(float(folds))).cast("int"))


def temporal_split(df: DataFrame, cfg: SplitConfig | None = None) -> DataFrame:
    """By date: <= train_until train, <= val_until val, else test."""
    cfg = cfg or SplitConfig.load()
    t = cfg["temporal"]
    d = F.col(t["time_col"]).cast("date")
    return df.withColumn(
        "split",
        F.when(d <= F.lit(t["train_until"]).cast("date"), "train")
        .when(d <= F.lit(t["val_until"]).cast("date"), "val")
        .otherwise("test"),
    )


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """G7: 'balanced' weights n / (k * n_class); k and n over the class table, a row for each class."""
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n_class"))
    every = Window.partitionBy()
    n, k = F.sum("n_class").over(every).cast("double"), F.count(F.lit(1)).over(every).cast("double")
    return counts.withColumn("weight", n / (k * F.col("n_class")))


def rare_classes(split_df: DataFrame, cfg: SplitConfig | None = None, label_col: str = "label") -> DataFrame:
    """What the strategy for rare classes says, with a ``copy`` index.

    ``keep_together``: all rows of a rare class go to train. ``oversample_train``:
    rare rows in train are repeated ``oversample_factor`` times. ``drop_if_too_small``:
    rare classes without the required minimum in some split go."""
    cfg = cfg or SplitConfig.load()
    rare = cfg["primary"]["rare_classes"]
    is_rare = F.coalesce(F.col(label_col).isin(*rare["names"]), F.lit(False))
    once = split_df.withColumn("copy", F.lit(0).cast("long"))
    strategy = rare.get("strategy", "keep_together")
    if strategy == "keep_together":
        return once.withColumn("split", F.when(is_rare, F.lit("train")).otherwise(F.col("split")))
    if strategy == "oversample_train":
        reps = F.when((F.col("split") == "train") & is_rare, int(rare.get("oversample_factor", 3))).otherwise(1)
        return split_df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), (reps - 1).cast("long"))))
    if strategy == "drop_if_too_small":
        met = split_class_counts(split_df.where(is_rare), label_col, cfg).where("meets_min").groupBy("label")
        whole = met.agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(SPLITS)).select(F.col("label").alias("__keep"))
        return once.join(F.broadcast(whole), F.col(label_col) == F.col("__keep"), "left").where(
            ~is_rare | F.col("__keep").isNotNull()
        ).drop("__keep")  # at most one row for each configured name
    raise ValueError(f"unknown strategy for rare classes: {strategy!r}")


def undersample(split_df: DataFrame, cfg: SplitConfig | None = None, label_col: str = "label", id_col: str = "object_id") -> DataFrame:
    """Train rows of larger classes thinned to the size of the smallest, never below the minimum share.

    A row stays if the bucket of its id is below its class' share, so the choice is
    the same on every run; val and test stay whole."""
    cfg = cfg or SplitConfig.load()
    least = float(cfg["class_balance"]["undersample_min_fraction"])
    counts = split_df.where("split = 'train'").groupBy(F.col(label_col).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    share = F.greatest(F.min("__n").over(Window.partitionBy()) / F.col("__n"), F.lit(least))
    shares = counts.select("__label", share.alias("__share"))
    joined = split_df.join(shares, F.col(label_col).eqNullSafe(F.col("__label")), "left")
    stays = hash_bucket(F.col(id_col), cfg["seed"], "under") < F.col("__share")
    return joined.where((F.col("split") != "train") | stays).drop("__label", "__share")


def balance(split_df: DataFrame, cfg: SplitConfig | None = None, label_col: str = "label") -> DataFrame:
    """The class balance that the rules ask for: none, a ``weight`` column, over- or undersampling."""
    cfg = cfg or SplitConfig.load()
    strategy = cfg["class_balance"]["strategy"]
    if strategy == "none":
        return split_df
    if strategy == "weight":
        weights = class_weights(split_df, label_col).select(F.col("label").alias("__label"), "weight")
        return split_df.join(weights, F.col(label_col).eqNullSafe(F.col("__label")), "left").drop("__label")
    if strategy == "undersample":
        return undersample(split_df, cfg, label_col)
    if strategy == "oversample":
        factor = int(cfg["class_balance"]["oversample_max_factor"])
        rare = cfg["primary"]["rare_classes"] | {"strategy": "oversample_train", "oversample_factor": factor}
        return rare_classes(split_df, SplitConfig(cfg.raw | {"primary": cfg["primary"] | {"rare_classes": rare}}), label_col)
    raise ValueError(f"unknown class balance: {strategy!r}")


def split_index(split_df: DataFrame, id_col: str = "object_id") -> DataFrame:
    """(split, object_id) of every row, the content of the index files."""
    return split_df.select("split", F.col(id_col).cast("string").alias("object_id"))


def write_split(split_df: DataFrame, out_dir: str, cfg: SplitConfig | None = None, id_col: str = "object_id", label_col: str = "label") -> DataFrame:
    """Index files (a folder of id lists for each split) and the manifest row, under the rules' tag."""
    cfg = cfg or SplitConfig.load()
    outputs, base = cfg["outputs"], out_dir.rstrip("/")
    spark = split_df.sparkSession
    index = f"{base}/splits_{outputs['tag']}.index"
    split_df.select("split", F.col(id_col).cast("string").alias("object_id"), F.col(label_col).alias("label")).write.mode(
        "overwrite"
    ).parquet(index)
    rows = spark.read.parquet(index)
    if outputs.get("save_index_files", True):
        rows.select("split", F.col("object_id").alias("value")).write.mode("overwrite").partitionBy("split").text(
            f"{base}/splits_{outputs['tag']}.ids"
        )
    counts = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    manifest = counts.agg(
        F.lit(outputs["tag"]).alias("tag"), F.lit(int(cfg["seed"])).alias("seed"), F.lit(index).alias("index"),
        F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("split", "label", "n"))).alias("counts"),
    )
    manifest.coalesce(1).write.mode("overwrite").json(f"{base}/splits_{outputs['tag']}.manifest")
    return rows


def habitability_flag(teq: Column) -> Column:
    """1 when 200 <= Teq <= 300 K, 0 otherwise (NULL stays NULL)."""
    return teq.between(200.0, 300.0).cast("int")


def latest_labels(label_log: DataFrame) -> DataFrame:
    """The newest label per object, one row each.

    The greatest ``seq`` of an id is a hash aggregate; its event is joined back. Two
    writers may have given one number twice: then the label that sorts last counts; the
    labels of one number are a set, which a hash aggregate holds."""
    newest = label_log.groupBy("object_id").agg(F.max("seq").alias("seq"))
    return label_log.join(newest, ["object_id", "seq"]).groupBy("object_id").agg(F.array_max(F.collect_set("label")).alias("label"))


def join_latest_labels(features: DataFrame, label_log: DataFrame, id_col: str = "object_id") -> DataFrame:
    """Features left-joined with the newest label per id.

    ``latest_labels`` has one row per id, so the join cannot fan out; AQE turns
    it into a broadcast join when the label table is small at runtime."""
    latest = latest_labels(label_log).withColumnRenamed("object_id", id_col)
    return features.join(latest, id_col, "left")
