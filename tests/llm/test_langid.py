import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlab.llm import langid
from transitlab.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(documents):
    return langid.train(documents.where("doc_id % 2 = 0"), F.col("lang"))


def test_held_out_accuracy(documents, model):
    """Trained on even ids, asked about odd ones by their text alone."""
    held = documents.where("doc_id % 2 = 1 and length(text) > 40")
    rows = {r.doc_id: r for r in langid.identify(held, model).collect()}
    truth = {r.doc_id: r.lang for r in held.collect()}
    assert sum(rows[i].language == lang for i, lang in truth.items()) >= 0.97 * len(truth)


def test_query_keeps_clean_documents(spark, small, documents):
    rows = {r.doc_id: r for r in QUERIES["op7_language_evidence"](spark, small).collect()}
    truth = {r.doc_id: r.lang for r in documents.collect()}
    assert set(rows) == set(truth)
    assert sum(rows[i].language == lang and rows[i].kept for i, lang in truth.items()) >= 0.98 * len(truth)


def slow_identify(rows, model, weight=10.0, prior_und=0.01):
    """rows: dicts with text, declared, suffix, domain, host; the posterior of each class by the formulas."""
    k = len(model.classes)
    scores = [model.scores(r["text"]) for r in rows]
    votes = [int(np.argmax(s)) if s.any() else None for s in scores]

    def counts(where):
        out = np.zeros(k)
        for r, v in zip(rows, votes):
            if v is not None and where(r):
                out[v] += 1
        return out

    every = counts(lambda r: True)
    shares = (every + 1 / k) / (every + 1 / k).sum()
    out = []
    for r, s, v in zip(rows, scores, votes):
        own = np.eye(k)[v] if v is not None else np.zeros(k)
        prior = shares
        for name, keys in (("domain", ("domain",)), ("host", ("domain", "host"))):
            if r[name] is not None:
                n = counts(lambda o: all(o[x] == r[x] for x in keys))
                if n.any():
                    n = n - own
                    prior = (n + weight * prior) / (n.sum() + weight)
        joint = s + np.log(prior * np.r_[np.ones(k - 1), prior_und])
        for name in ("declared", "suffix"):
            if r[name] is not None:
                n = counts(lambda o: o[name] == r[name])
                if n.any():
                    joint = joint + np.log((n - own + 0.5) / (every + 1.0))
        best = int(np.argmax(joint))
        out.append((model.classes[best], 1 / np.exp(joint - joint[best]).sum()))
    return out


def test_fusion_is_the_formula(spark, documents, model):
    base = [r.text for r in documents.where("length(text) < 400").orderBy("doc_id").limit(30).collect()]
    r = np.random.default_rng(3)
    rows = []
    for i, text in enumerate([t[: int(r.integers(3, 60))] for t in base] + [None, "", "123 456", "..."]):
        pick = lambda *values: values[int(r.integers(len(values)))]
        rows.append(
            {"text": text, "declared": pick("en", "fr", None), "suffix": pick("com", "de", None), "domain": pick("a.com", "b.de", None), "host": pick("x", "y", None)}
        )
    docs = spark.createDataFrame(
        [(i, *row.values()) for i, row in enumerate(rows)],
        "doc_id long, text string, declared string, suffix string, domain string, host string",
    ).repartition(3)
    named = {name: F.col(name) for name in ("declared", "suffix", "domain", "host")}
    found = {r.doc_id: r for r in langid.identify(docs, model, **named).collect()}
    for i, (language, posterior) in enumerate(slow_identify(rows, model)):
        assert found[i].language == language
        assert math.isclose(found[i].posterior, posterior, rel_tol=1e-9)


def test_evidence_decides_where_the_text_is_short(spark, model):
    rows = [(i, "der und die das mit von " * 5, "h.de", "de") for i in range(30)] + [(99, "ok", "h.de", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, declared string")
    alone = langid.identify(docs.where("doc_id = 99"), model).first()
    fused = langid.identify(docs, model, host=F.col("host"), declared=F.col("declared")).where("doc_id = 99").first()
    assert fused.language == "de" and fused.posterior > alone.posterior * 0.999


def test_junk_is_in_no_language(spark, model):
    r = np.random.default_rng(1)
    junk = " ".join("".join(r.choice(list("qxzjkvwy"), 8)) for _ in range(60))
    row = langid.identify(spark.createDataFrame([(1, junk)], "doc_id long, text string"), model).first()
    assert row.language == langid.UNKNOWN and not row.kept


def test_pages(spark, small):
    rows = QUERIES["language_of_pages"](spark, small).collect()
    declared = {
        r.page_id: r.lang
        for r in spark.read.parquet(f"{small}/pages.parquet")
        .select("page_id", F.regexp_extract("html", '<html lang="(..)"', 1).alias("lang"))
        .collect()
    }
    assert len(rows) == len(declared)
    assert sum(r.language == declared[r.page_id] for r in rows) >= 0.95 * len(rows)


def test_edges(edge, empty, clashing):
    assert langid.of_documents(edge).count() == edge.count()
    assert langid.of_documents(empty).count() == 0
    kept = langid.keep_identified(clashing)
    assert kept.columns == clashing.columns
    assert kept.where("doc_id = 1").count() == 1
    assert langid.keep_identified(empty).count() == 0
