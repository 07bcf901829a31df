"""Source divergence audit with late strings: how the words of each source differ from those of its language.

1. Terms. Each task counts the terms of its documents by language and source and
   writes them once, as columns: a 64-bit digest, the counts, and, once, the term.
   What follows reads the digest columns alone, so shuffles move fixed-width
   numbers; a term of any frequency has few rows for each task.
2. Kept terms: the digests that enough documents of a language have.
3. Collisions. Of the candidates' digests alone, the least and the greatest string
   are taken. Where they differ the digest is split: its terms are numbered in
   their order, and the number belongs to the key from then on.
4. Shares. Counts of kept terms by source, with each source's total, give the
   shares; all arithmetic is on whole numbers.
5. Pairs of sources. The sources of a language stand in blocks; each cell (two
   blocks and a share of the terms, of bounded size) adds up its part of the
   divergence matrix. Terms that neither source has are added as a product.
6. Text is joined back for the terms that can be among a source's first ones.
"""

from __future__ import annotations

from collections import Counter
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_small, slices, stored, tabled

#: Bytes between terms become spaces: all of ASCII but letters.
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
#: Different terms that a task holds before it writes them out.
HELD = 800_000
#: Sources in a block, and counts of kept terms in a cell.
BLOCK, CELL = 512, 250_000
#: Terms in a step of a cell.
STEP = 1_024

TERMS = "lang string, source string, digest long, n long, docs long, term string"


def terms(docs: DataFrame, bits: int = 64, held: int = HELD, every: bool = False) -> DataFrame:
    """(lang, source, digest, n, docs, term): occurrences and documents of each term that a task has met.

    Of a term's rows that are written together the first alone has the text, unless ``every`` row is to have it.
    """
    mask = (1 << bits) - 1

    def rows(groups: dict) -> Iterator[pa.RecordBatch]:
        written: set[bytes] = set()
        for (lang, source), (n, in_docs) in groups.items():
            words = list(n)
            texts = words if every else [None if w in written else w for w in words]
            written.update(words)
            digests = np.fromiter((xxhash.xxh3_64_intdigest(w) & mask for w in words), np.uint64, len(words))
            size = len(words)
            columns = [
                pa.array([lang] * size, pa.string()),
                pa.array([source] * size, pa.string()),
                pa.array(digests.view(np.int64)),
                pa.array(np.fromiter(n.values(), np.int64, size)),
                pa.array(np.fromiter(map(in_docs.__getitem__, words), np.int64, size)),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "digest", "n", "docs", "term"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = text.encode().lower().translate(LETTERS).split()
                    if words:
                        n, in_docs = groups.setdefault((lang, source), (Counter(), Counter()))
                        n.update(words)
                        in_docs.update(set(words))
                if sum(len(n) for n, _ in groups.values()) > held:
                    yield from rows(groups)
                    groups = {}
        yield from rows(groups)

    return docs.select("lang", "source", "text").mapInArrow(run, TERMS)


def collisions(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates' digests that stand for two terms or more: their least and greatest strings differ."""
    digests = stored(candidates.select("digest").distinct())
    texts = found.select("digest", "term").where("term is not null")
    strings = join_small(texts, digests, ["digest"], "left_semi", BROADCAST_ROWS)
    ends = strings.groupBy("digest").agg(F.min("term").alias("first"), F.max("term").alias("last"))
    return stored(ends.where("first != last").select("digest"))


def with_splits(found: DataFrame, collided: DataFrame) -> DataFrame:
    """The terms, all rows with their text, with a column ``split``: 0, or the term's number among those of its digest."""
    own = join_small(found.select("digest", "term"), collided, ["digest"], "left_semi").distinct()
    numbered = stored(own.withColumn("split", F.row_number().over(Window.partitionBy("digest").orderBy("term"))))
    return join_small(found, numbered, ["digest", "term"], "left").withColumn("split", F.coalesce("split", F.lit(0)))


def kept_terms(found: DataFrame, keys: list[str], least_docs: int) -> DataFrame:
    sums = found.groupBy("lang", *keys).agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    return stored(sums.where(F.col("docs") >= least_docs).drop("docs"))


def only_kept(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Without the terms whose digest no language keeps, if the kept digests can be broadcast; else all of them."""
    digests = stored(kept.select("digest").distinct())
    few = digests.count() <= BROADCAST_ROWS
    return found.join(F.broadcast(digests), "digest", "left_semi") if few else found


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 size)), exact for counts of any size."""
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return (F.call_function("div", above, (total + 2 * size).cast("decimal(20,0)")) + 1).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def by_group(df: DataFrame, groups: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """Joins the few columns of the (stored) groups: by a broadcast if they are counted few, else salted."""
    if groups.count() <= BROADCAST_ROWS // 10:
        return df.join(F.broadcast(groups), keys)
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int")).join(dealt, [*keys, "salt"]).drop("salt")


def cell_sums(part: pd.DataFrame, block: int, step: int) -> pd.DataFrame:
    """The divergence sums of one cell: a row for each ordered pair of its two blocks' sources.

    Rows of role 0 hold each source's share ``p`` for an absent term; those of the
    cell that counts absent terms have their number as ``size``, others 0. Rows of
    role 1 hold the share of a term that the source has.
    """
    lang, block_a, block_b = part[["lang", "a", "b"]].iloc[0]
    base, given = part[part["role"] == 0].sort_values("no"), part[part["role"] == 1]
    at, absent = base["no"].to_numpy(), base["p"].to_numpy()
    rows, columns = np.flatnonzero(at // block == block_a), np.flatnonzero(at // block == block_b)

    def apart(p, q):
        return (p - q) * (p - q) // np.maximum(p + q, 1)  # shares are 1 at least; 0 where a language keeps no term

    plain = apart(absent[rows][:, None], absent[columns][None, :])
    sums = plain * int(base["size"].iloc[0])
    term = given.groupby(["digest", "split"], sort=False).ngroup().to_numpy()
    order = np.argsort(term, kind="stable")
    term, place, p = term[order], np.searchsorted(at, given["no"].to_numpy()[order]), given["p"].to_numpy()[order]
    n_terms = int(term[-1]) + 1 if len(term) else 0
    for first in range(0, n_terms, step):
        last = min(first + step, n_terms)
        own = slice(*np.searchsorted(term, [first, last]))
        shares = np.tile(absent, (last - first, 1))
        shares[term[own] - first, place[own]] = p[own]
        other = shares[:, columns]
        for i, row in enumerate(rows):
            sums[i] += apart(shares[:, row][:, None], other).sum(axis=0)
        sums -= plain * (last - first)
    s, t = (x.ravel() for x in np.meshgrid(at[rows], at[columns], indexing="ij"))
    if block_a != block_b:
        s, t, sums = np.r_[s, t], np.r_[t, s], np.r_[sums.ravel(), sums.ravel()]
    other = s != t
    return pd.DataFrame({"lang": lang, "s": s[other], "t": t[other], "value": sums.ravel()[other]})


def pair_sums(shares: DataFrame, groups: DataFrame, block: int, cell: int) -> DataFrame:
    """(lang, s, t, value) for every two sources of a language, by their numbers.

    ``shares``: lang, digest, split, no, p. ``groups``: lang, no, sources, size, absent.
    """
    cells = shares.groupBy("lang").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells"))
    groups = stored(groups.join(cells, "lang", "left").withColumn("cells", F.coalesce("cells", F.lit(1))))
    per_lang = stored(groups.groupBy("lang").agg(F.max("sources").alias("sources"), F.max("cells").alias("cells")))

    def in_blocks(df: DataFrame) -> DataFrame:
        """Each row once for each pair of blocks that its source is in."""
        own, blocks = F.floor(F.col("no") / block).cast("int"), F.ceil(F.col("sources") / block).cast("int")
        return df.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns(
            {"a": F.least(own, "other"), "b": F.greatest(own, "other")}
        )

    shape = "lang a b cell role no p size digest split".split()
    base = in_blocks(groups).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    base = base.select(
        "lang", "a", "b", "cell", F.lit(0).alias("role"), "no", F.col("absent").alias("p"),
        F.when(F.col("cell") == 0, F.col("size")).otherwise(0).alias("size"),
        F.lit(0).cast("long").alias("digest"), F.lit(0).alias("split"),
    )
    given = in_blocks(by_group(shares, per_lang, ["lang"])).withColumns(
        {
            "cell": F.pmod(F.xxhash64("digest", "split"), F.col("cells")).cast("int"),
            "role": F.lit(1),
            "size": F.lit(0).cast("long"),
        }
    )
    cells = base.select(*shape).union(given.select(*shape)).groupBy("lang", "a", "b", "cell")
    sums = cells.applyInPandas(lambda part: cell_sums(part, block, min(STEP, cell)), "lang string, s long, t long, value long")
    return sums.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame,
    least_docs: int = 10,
    first: int = 10,
    bits: int = 64,
    held: int = HELD,
    block: int = BLOCK,
    cell: int = CELL,
) -> DataFrame:
    """For each language and source: its distance to each other source (`pair`) and its most typical terms (`term`).

    Terms are runs of letters (ASCII) and of all other characters beyond ASCII;
    only A-Z are lower-cased. A null text, language or source is ''. A language
    keeps the terms of at least ``least_docs`` of its documents (rows; a repeated
    row counts again). Value: floor((p - q)^2 / (p + q)) of shares in billionths,
    with 2 added to every count; summed over all kept terms for a pair, 0 where a
    language keeps none. Ranks go by falling value and then by the item's bytes; of
    terms only those to ``first`` are returned. A source alone in its language has
    no pair. Other columns are not read. An empty table gives no rows. ``bits`` is
    the width of the digests, ``held`` the number of terms that a task holds,
    ``block`` the sources in a block and ``cell`` the counts of kept terms in a cell.
    """
    plain = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = tabled(terms(plain, bits, held))
    kept = kept_terms(found, ["digest"], least_docs)
    collided = collisions(found, kept)
    if collided.isEmpty():
        found, kept = found.withColumn("split", F.lit(0)), kept.withColumn("split", F.lit(0))
    else:
        found = with_splits(tabled(terms(plain, bits, held, every=True)), collided)
        kept = kept_terms(found, ["digest", "split"], least_docs)
    key = ["lang", "digest", "split"]
    sums = only_kept(found, kept).groupBy(*key, "source").agg(F.sum("n").alias("n"))  # a term has a row a source from here
    counts = stored(join_small(sums, kept.drop("lang_n"), key))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.withColumns({c: F.coalesce(c, zero) for c in ("total", "size", "lang_total")}).withColumns(
        {
            "no": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1,
            "sources": F.count("*").over(Window.partitionBy("lang")),
            "absent": F.when(F.col("size") > 0, share(zero, F.col("total"), F.col("size"))).otherwise(0),
        }
    )
    groups = stored(groups)
    shares = stored(
        by_group(counts, groups, ["lang", "source"]).select(
            *key, "source", "no", share(F.col("n"), F.col("total"), F.col("size")).alias("p"), "size", "lang_total"
        )
    )
    return _pairs(shares, groups, block, cell).unionByName(_terms(shares, groups, kept, found, first))


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return df.withColumn("rank", F.row_number().over(order)).select("lang", "source", "part", "item", "value", "rank")


def _pairs(shares: DataFrame, groups: DataFrame, block: int, cell: int) -> DataFrame:
    own = shares.select("lang", "digest", "split", "no", "p")
    sums = pair_sums(own, groups.select("lang", "no", "sources", "size", "absent"), block, cell)
    names = groups.select("lang", "no", "source")
    found = join_small(sums, names.withColumnsRenamed({"no": "s"}), ["lang", "s"])
    found = join_small(found, names.withColumnsRenamed({"no": "t", "source": "item"}), ["lang", "t"])
    return _ranked(found.withColumn("part", F.lit("pair")))


def _terms(shares: DataFrame, groups: DataFrame, kept: DataFrame, found: DataFrame, first: int) -> DataFrame:
    key = ["lang", "digest", "split"]
    scored = join_small(shares, kept, key).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("size")))
    scored = stored(scored.where("p > q").select(*key, "source", distance(F.col("p"), F.col("q")).alias("value")))
    # what can be among the first: all that reach the value of the last of them, whatever their text
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    top = scored.withColumn("at", F.row_number().over(order)).where(F.col("at") <= first)
    least = stored(top.groupBy("lang", "source").agg(F.min("value").alias("least")))
    able = stored(by_group(scored, least, ["lang", "source"]).where("value >= least").drop("least"))
    texts = join_small(found.select("digest", "split", "term").where("term is not null"), stored(able.select("digest", "split").distinct()), ["digest", "split"], "left_semi")
    texts = texts.groupBy("digest", "split").agg(F.min("term").alias("item"))
    named = able.join(texts, ["digest", "split"]).withColumn("part", F.lit("term"))
    return _ranked(named).where(F.col("rank") <= first)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (
  SELECT row_no, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10
), counts AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
