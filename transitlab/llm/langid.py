"""Language identification by Bayesian fusion of what a document says about its language.

For each language: the text's likelihood under a model of byte trigrams, the
likelihood of the language that the markup or a catalogue declares, the likelihood
of the address suffix, and a prior from the host. The last three come from grouped
counts over all documents. The host's prior is smoothed hierarchically: a host's
counts lean on those of its domain, and these on the counts of all documents; a
document's own vote is left out of its host's and domain's counts. One more class,
``und``, stands for text in none of the languages: its model is uniform.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, stored, unused, without

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
BITS = 15

#: Neighbouring trigrams overlap, so each counts as this share of an independent one.
INDEPENDENT = 0.2

#: ASCII letters count in lower case and other ASCII as a space; bytes of other characters stand for themselves.
LETTERS = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def trigrams(text: str | None) -> np.ndarray:
    """The hashed byte trigrams of a text that hold a letter."""
    raw = LETTERS[np.frombuffer(f" {text or ''} ".lower().encode(), np.uint8)].astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    whole = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    whole = whole[whole != 0x202020]
    return (whole * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of each trigram (rows) in each language and, last, in ``und``."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    @property
    def classes(self) -> tuple[str, ...]:
        return (*self.languages, UNKNOWN)

    def scores(self, text: str | None) -> np.ndarray:
        found = trigrams(text)
        total = np.zeros(len(self.classes))
        for at in range(0, len(found), 1 << 18):
            total += self.log_p[found[at : at + (1 << 18)]].sum(axis=0, dtype=np.float64)
        return INDEPENDENT * total


def train(
    docs: DataFrame,
    label: Column,
    languages: tuple[str, ...] = LANGUAGES,
    train_rows: int = 20_000,
    alpha: float = 0.05,
) -> TextModel:
    """Trigram counts of labelled documents: all if there are ``train_rows`` or fewer, else about that many by a hash.

    That is the bound on the labelled sample. Counts are summed on the executors;
    the driver gets one number for each language and trigram at most.
    """
    labelled = docs.select(label.alias("label"), "text").where(F.col("label").isin(*languages) & F.col("text").isNotNull())
    share = train_rows / max(1, labelled.count())
    if share < 1:
        labelled = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))
    size = 1 << BITS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = {}
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(name, np.zeros(size, np.int64))
            counts[name] += np.bincount(trigrams(text), minlength=size)
        names = [name for name, c in counts.items() for _ in range(int((c > 0).sum()))]
        places = [np.flatnonzero(c) for c in counts.values()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array(np.concatenate(places) if places else [], pa.int64()),
                pa.array(np.concatenate([c[p] for c, p in zip(counts.values(), places)]) if places else [], pa.int64()),
            ],
            ["label", "bucket", "n"],
        )

    summed = map_slices(labelled, run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((size, len(languages)))
    for row in summed.collect():  # at most languages x 2 ** BITS rows
        table[row["bucket"], languages.index(row["label"])] = row["n"]
    smooth = (table + alpha) / (table.sum(axis=0) + alpha * size)
    return TextModel(languages, np.log(np.column_stack([smooth, np.full(size, 1 / size)])).astype(np.float32))


def _counts(classes: tuple[str, ...]) -> Column:
    """How many rows the text alone gives to each class."""
    return F.array(*(F.sum((F.col("vote") == i).cast("double")) for i in range(len(classes))))


def _lean(own: Column, vote: Column, weight: float, parent: Column) -> Column:
    """Shares of the classes from counts without the row's own vote, leaning on the parent's shares."""
    left = F.transform(own, lambda n, i: n - F.when(vote == i, 1.0).otherwise(0.0))
    total = F.aggregate(left, F.lit(0.0), lambda a, b: a + b)
    return F.transform(left, lambda n, i: (n + weight * F.get(parent, i)) / (total + weight))


def _matched(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    right = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(right, same, "left").drop(*(f"_{k}" for k in keys))


def identify(
    docs: DataFrame,
    model: TextModel,
    id_column: str = "doc_id",
    declared: Column | None = None,
    suffix: Column | None = None,
    domain: Column | None = None,
    host: Column | None = None,
    weight: float = 10.0,
    least_posterior: float = 0.5,
    prior_und: float = 0.01,
) -> DataFrame:
    """A row for each document: id, language, its posterior, what the text alone says, and ``kept``.

    Kept are documents whose best class is a language with at least
    ``least_posterior``. Evidence that is null or not given counts for nothing; a
    declaration outside the model's languages is a value of its own. A null or
    empty text, or one without letters, leaves the decision to the other evidence,
    and to the shares of all documents where there is none. Ties go to the class
    that comes first. Repeated rows count and are answered each; a null id is
    kept as null; an empty table gives no rows.
    """
    classes = model.classes
    absent = F.lit(None).cast("string")
    tag = F.lower(F.regexp_extract(F.trim((declared if declared is not None else absent).cast("string")), "^[A-Za-z]+", 0))
    known = F.when(tag.isin(*model.languages), tag).when(tag != "", F.lit("other"))
    given = {"declared": known, "suffix": suffix, "domain": domain, "host": host}

    names_out = ["id", *given, "scores", "vote"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.scores(text).tolist() for text in batch.column(1).to_pylist()]
        kept = [batch.column(i) for i in (0, 2, 3, 4, 5)]
        vote = [max(range(len(s)), key=s.__getitem__) if any(s) else None for s in scores]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(scores, pa.list_(pa.float64())), pa.array(vote, pa.int32())],
            names_out,
        )

    read = docs.select(
        docs[id_column].cast("long").alias("id"),
        F.col("text"),
        *((absent if c is None else c.cast("string")).alias(name) for name, c in given.items()),
    )
    rows = stored(
        map_slices(
            read,
            run,
            "id long, declared string, suffix string, domain string, host string, scores array<double>, vote int",
        )
    )
    k = len(classes)
    uniform = F.array(*(F.lit(1.0 / k) for _ in classes))
    overall = rows.where("vote is not null").agg(_counts(classes).alias("all"))
    joined = rows.crossJoin(F.broadcast(overall))  # one row
    zero = F.array(*(F.lit(0.0) for _ in classes))
    for name, keys in (("domain", ["domain"]), ("host", ["domain", "host"])):
        counted = rows.where(F.col("vote").isNotNull() & F.col(name).isNotNull()).groupBy(*keys).agg(_counts(classes).alias(f"n_{name}"))
        joined = _matched(joined, counted, *keys)
    for name in ("declared", "suffix"):
        counted = rows.where(F.col("vote").isNotNull() & F.col(name).isNotNull()).groupBy(name).agg(_counts(classes).alias(f"n_{name}"))
        joined = _matched(joined, counted, name)

    no_vote = F.coalesce("vote", F.lit(-1))
    everywhere = F.transform(F.coalesce("all", zero), lambda n, i: n + F.get(uniform, i))
    total = F.aggregate(everywhere, F.lit(0.0), lambda a, b: a + b)
    joined = joined.withColumn("shares", F.transform(everywhere, lambda n: n / total))
    joined = joined.withColumn(
        "prior",
        F.when(F.col("n_domain").isNotNull(), _lean(F.col("n_domain"), no_vote, weight, F.col("shares"))).otherwise(F.col("shares")),
    )
    joined = joined.withColumn(
        "prior", F.when(F.col("n_host").isNotNull(), _lean(F.col("n_host"), no_vote, weight, F.col("prior"))).otherwise(F.col("prior"))
    )
    # what each class declares, or has as suffix: its count with that value, without the row's own, over its count in all
    log_joint = F.zip_with("scores", F.transform("prior", lambda p, i: F.log(p * F.when(i == k - 1, prior_und).otherwise(1.0))), lambda a, b: a + b)
    for name in ("declared", "suffix"):
        said = F.transform(
            F.col(f"n_{name}"),
            lambda n, i: (n - F.when(no_vote == i, 1.0).otherwise(0.0) + 0.5) / (F.get(F.coalesce("all", zero), i) + 1.0),
        )
        log_joint = F.when(F.col(f"n_{name}").isNotNull(), F.zip_with(log_joint, F.transform(said, lambda p: F.log(p)), lambda a, b: a + b)).otherwise(log_joint)
    joined = joined.withColumn("joint", log_joint)
    best = F.array_max("joint")
    names = F.array(*(F.lit(c) for c in classes))
    decided = joined.select(
        "id",
        F.get(names, F.array_position("joint", best).cast("int") - 1).alias("language"),
        (1.0 / F.aggregate(F.transform("joint", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, b: a + b)).alias("posterior"),
        F.get(names, F.col("vote")).alias("text_language"),
    )
    return decided.withColumn(
        "kept", (F.col("language") != UNKNOWN) & (F.col("posterior") >= least_posterior)
    ).withColumnRenamed("id", id_column)


def of_documents(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Documents: the catalogue's language is the declaration, the source is the host; there is no address."""
    model = train(docs, F.lower(F.trim(F.col("lang"))), languages)
    return identify(docs, model, declared=F.col("lang"), host=F.col("source"))


def of_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """Pages: the language that the html element declares, the address's last label, its domain and its host."""
    address = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(address != "", address)
    parts = F.split(host, r"\.")
    plain = pages.select(
        F.col("page_id"),
        F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ").alias("text"),
        F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
        F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("suffix"),
        F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))).alias("domain"),
        host.alias("host"),
    )
    return identify(
        plain, model, "page_id", F.col("declared"), F.col("suffix"), F.col("domain"), F.col("host")
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, with all their columns.

    Rows are told apart by a hash of id, declared language, source and text, so rows that share an id are judged
    each by its own.
    """
    row = unused(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "lang", "source", "text"))
    model = train(docs, F.lower(F.trim(F.col("lang"))))
    judged = identify(keyed, model, row, declared=F.col("lang"), host=F.col("source"))
    return without(keyed, judged.where(~F.col("kept")), row).select(*docs.columns)
