"""Masked pseudo-likelihood: a window network predicts every token from the tokens on both sides of it.

1. Texts are tokenised once: words in lower case, as numbers in a dictionary of the
   task's part (a bounded run of documents). Tokens and dictionaries, with counts,
   are written to the shared folder.
2. Dictionaries add up to the counts of all words. The most frequent words have a
   code each; others share codes by a hash. Each dictionary is joined with the
   counts, a row a word and part, however often the word occurs, and goes back to
   its part: there tokens become codes, and each word has its share of its code.
3. The network adds up an embedding for each place in the window (two tokens before,
   two after), takes the hyperbolic tangent, and gives the code in three steps of
   sixteen, each a softmax that knows the steps before it. Without a context it
   starts out as the corpus' own frequencies.
4. Training is data-parallel in numpy: each task goes once over its documents by
   Adagrad from the same start, and the weights are averaged by the number of tokens
   trained on, block by block in a stream. Every token is a target (a ``stride`` over
   1 takes one in so many of each document; their contexts are whole). The driver
   gets the averaged network alone, whose size is fixed.
5. A document's score is the sum of the log-probabilities of all its words, each
   given the tokens around it: that of the word's code from the network, and that of
   the word within its code from the counts, which grow with the corpus.

The average depends on which documents a task trains on, so scores change a little
with the number of tasks and the order of documents; for one layout they are the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, tabled

DIGIT = 16
PREFIX = DIGIT * DIGIT
CODES = PREFIX * DIGIT
#: Codes of single words; the others are shared.
OWN = CODES // 2
#: What counts as seen of all words that a shared code may stand for and the corpus doesn't have.
UNSEEN = 0.5
EDGE = CODES  # beyond either end of a document
SIDES = (-2, -1, 1, 2)
REACH = max(map(abs, SIDES))
WIDTH = 16
BATCH = 8192
#: Weights in a row while they are averaged.
BLOCK = 4096
#: Words and tokens of a part.
PART_WORDS, PART_TOKENS = 400_000, 8_000_000

SHAPES = {
    "embed": (len(SIDES), CODES + 1, WIDTH),
    "out": (3, DIGIT, WIDTH),
    "bias_0": (DIGIT, 1),
    "bias_1": (DIGIT, DIGIT),
    "bias_2": (DIGIT, PREFIX),
    "given_1": (WIDTH, DIGIT),
    "given_2": (WIDTH, PREFIX),
}


def split_words(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


class Dictionary(dict):
    """Numbers the words of a part as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


WRITTEN = "part long, kind int, place int, doc_id long, tokens binary, word long, n long"
WORD, DOC = 0, 1


def tokens(docs: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Documents as the numbers of their words (kind DOC), and each part's dictionary (kind WORD: number, hash, times)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        words, ids, found, held = Dictionary(), [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal part, held
            digests = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
            times = np.bincount(np.concatenate(found), minlength=len(words)) if held else np.empty(0, np.int64)
            n_docs, n_words = len(ids), len(words)
            none, gap = [None] * n_words, [None] * n_docs
            columns = [
                pa.array([part] * (n_docs + n_words), pa.int64()),
                pa.array([WORD] * n_words + [DOC] * n_docs, pa.int32()),
                pa.array([*range(n_words), *range(n_docs)], pa.int32()),
                pa.array(none + ids, pa.int64()),
                pa.array(none + [x.tobytes() for x in found], pa.binary()),
                pa.array(digests.tolist() + gap, pa.int64()),
                pa.array(times.tolist() + gap, pa.int64()),
            ]
            part, held = part + 1, 0
            for kept in (words, ids, found):
                kept.clear()
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in WRITTEN.split(", ")])

        for batch in batches:
            for some in slices(batch):
                for doc_id, text in zip(*(column.to_pylist() for column in some.columns)):
                    own = split_words(text)
                    ids.append(doc_id)
                    found.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
                    held += len(own)
                if len(words) > part_words or held > PART_TOKENS:
                    yield flush()
        yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, WRITTEN)


def word_counts(written: DataFrame) -> DataFrame:
    """(word, n): how often each word, as its hash, occurs in all documents."""
    return written.where(F.col("kind") == WORD).groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[dict[int, int], np.ndarray]:
    """The codes of the most frequent words, by their hash, and how often each code occurs in all documents.

    Words that are equally frequent rank by their hash. The driver gets the most
    frequent words and one count for each shared code. ``counts`` is stored.
    """
    top = counts.orderBy(F.desc("n"), "word").limit(OWN).collect()
    own = {row["word"]: code for code, row in enumerate(top)}
    frequency = np.zeros(CODES)
    frequency[: len(top)] = [row["n"] for row in top]
    shared = counts.groupBy(F.pmod("word", F.lit(CODES - OWN)).alias("code")).agg(F.sum("n").alias("n")).collect()
    for row in shared:
        frequency[OWN + row["code"]] = row["n"]
    for row in top:
        frequency[OWN + row["word"] % (CODES - OWN)] -= row["n"]
    return own, frequency


def coded(written: DataFrame, counts: DataFrame, own: dict[int, int], frequency: np.ndarray) -> DataFrame:
    """(doc_id, codes, within): each document's codes, and its words' summed log-probabilities within their codes.

    A word with a code of its own has probability 1 in it. Of a shared code that
    occurs N times, a word that occurs n times has n / (N + UNSEEN), and UNSEEN /
    (N + UNSEEN) is left for all words that ``counts`` doesn't have.
    """
    spark, shared = written.sparkSession, CODES - OWN
    singles = spark.createDataFrame(list(own.items()), "word long, own int")
    totals = spark.createDataFrame([(OWN + i, float(frequency[OWN + i])) for i in range(shared)], "code int, total double")
    words = written.where(F.col("kind") == WORD).select("part", "place", "word")
    known = words.join(counts, "word", "left").join(F.broadcast(singles), "word", "left")
    code = F.coalesce("own", (F.pmod("word", F.lit(shared)) + OWN).cast("int"))
    share = F.log(F.coalesce("n", F.lit(UNSEEN)) / (F.col("total") + UNSEEN))
    known = known.withColumn("code", code).join(F.broadcast(totals), "code", "left")
    known = known.select(
        "part", F.lit(WORD).alias("kind"), "place", "code",
        F.when(F.col("own").isNull(), share).otherwise(0.0).cast("float").alias("share"),
    )
    docs = written.where(F.col("kind") == DOC).select("part", "kind", "place", "doc_id", "tokens")
    rows = known.unionByName(docs, allowMissingColumns=True).select("part", "kind", "place", "code", "share", "doc_id", "tokens")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, codes, shares, fresh = None, None, None, []
        for batch in batches:
            parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)]):
                if low == high:
                    continue
                if parts[low] != at:
                    at, fresh = parts[low], [(np.empty(0, np.int32), np.empty(0, np.float32))]
                some = batch.slice(low, high - low)
                if kinds[low] == WORD:  # in the order of their numbers, all before the documents
                    fresh.append((some.column(3).to_numpy(), some.column(4).to_numpy()))
                    continue
                if fresh:
                    codes, shares = (np.concatenate(x) for x in zip(*fresh))
                    fresh = []
                found = [np.frombuffer(x, np.int32) for x in some.column(6).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(5),
                        pa.array([codes[x].astype("<u2").tobytes() for x in found], pa.binary()),
                        pa.array([float(shares[x].sum(dtype=np.float64)) for x in found], pa.float64()),
                    ],
                    ["doc_id", "codes", "within"],
                )

    dealt = rows.repartition("part").sortWithinPartitions("part", "kind", "place")
    return dealt.mapInArrow(run, "doc_id long, codes binary, within double")


def exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In place, down the columns, each over that of the column's greatest; their sums, and the greatest."""
    top = logits.max(axis=0)
    logits -= top
    np.exp(logits, out=logits)
    return logits.sum(axis=0), top


def sums(values: np.ndarray, known: np.ndarray, size: int) -> np.ndarray:
    """Each row of values, in double precision, added up by what is known."""
    return np.stack([np.bincount(known, row, size) for row in values])


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @classmethod
    def start(cls, frequency: np.ndarray, seed: int = 1) -> "Network":
        """Small random embeddings, and biases that give each code its frequency in the corpus."""
        r = np.random.default_rng(seed)
        w = {name: r.normal(0, 0.1, shape).astype(np.float32) for name, shape in SHAPES.items()}
        part = (frequency + 0.1).astype(np.float64)
        for step in (2, 1, 0):
            part = part.reshape(-1, DIGIT)
            w[f"bias_{step}"] = np.ascontiguousarray(np.log(part / part.sum(axis=1, keepdims=True)).T).astype(np.float32)
            part = part.sum(axis=1)
        w["given_1"][:] = 0
        w["given_2"][:] = 0
        w["embed"][:, EDGE] = 0
        return cls(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[name].ravel() for name in SHAPES])

    @classmethod
    def of_flat(cls, flat: np.ndarray) -> "Network":
        cuts = np.cumsum([int(np.prod(shape)) for shape in SHAPES.values()])[:-1]
        return cls({name: x.reshape(shape).astype(np.float32) for (name, shape), x in zip(SHAPES.items(), np.split(flat, cuts))})

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """A row for each place. ``context``: a row for each side."""
        embed = self.weights["embed"]
        hidden = embed[0].take(context[0], axis=0)
        for side in range(1, len(SIDES)):
            hidden += embed[side].take(context[side], axis=0)
        return np.tanh(hidden, out=hidden)

    def steps(self, hidden: np.ndarray, code: np.ndarray) -> Iterator[tuple]:
        """For each step: what it sees, its logits, where in these (flat) the codes' digits are, and what it knows of the codes."""
        w, rows = self.weights, np.arange(len(code))
        code = code.astype(np.intp)
        prefix = code // DIGIT
        first = prefix // DIGIT
        digits = first, prefix % DIGIT, code % DIGIT
        for step, (digit, known) in enumerate(zip(digits, (None, first, prefix))):
            seen, bias = hidden, w[f"bias_{step}"]
            if step:
                seen = np.ascontiguousarray(w[f"given_{step}"].T).take(known, axis=0)
                seen += hidden
                bias = bias.take(known, axis=1)
            logits = w["out"][step] @ seen.T
            logits += bias
            yield seen, logits, digit * len(code) + rows, known

    def forward(self, context: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each code in its context, and the hidden layer. ``context``: a row for each side."""
        hidden = self.hidden(context)
        total = np.zeros(len(code), np.float32)
        for _, logits, at, _ in self.steps(hidden, code):
            total += logits.ravel().take(at)
            mass, top = exponentials(logits)
            total -= np.log(mass) + top
        return total, hidden

    def gradient(self, context: np.ndarray, code: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean negative log-probability."""
        w, n = self.weights, len(code)
        hidden = self.hidden(context)
        found, outs, back = {}, [], np.zeros(hidden.shape[::-1], np.float32)
        for step, (seen, soft, at, known) in enumerate(self.steps(hidden, code)):
            mass, _ = exponentials(soft)
            soft /= mass
            soft.ravel()[at] -= 1
            soft /= n
            outs.append(soft @ seen)
            through = w["out"][step].T @ soft
            back += through
            wide = soft.astype(np.float64)
            if step:
                size = SHAPES[f"bias_{step}"][1]
                found[f"bias_{step}"] = sums(wide, known, size).astype(np.float32)
                found[f"given_{step}"] = sums(through.astype(np.float64), known, size).astype(np.float32)
            else:
                found["bias_0"] = wide.sum(axis=1, keepdims=True).astype(np.float32)
        hidden *= hidden
        back *= np.subtract(1, hidden, out=hidden).T
        wide, embed = back.astype(np.float64), np.empty(SHAPES["embed"], np.float32)
        for own, side in zip(embed, context):
            own[:] = sums(wide, side, CODES + 1).T
        return found | {"embed": embed, "out": np.stack(outs)}


def contexts(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each side of the window: the codes beside the places ``at``, which have edges around them (see ``laid_out``)."""
    return np.stack([codes.take(at + side) for side in SIDES]).astype(np.intp)


def laid_out(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after the other with a gap of edges around each, and the places of their codes."""
    edge = np.full(REACH, EDGE, np.int32)
    whole = np.concatenate([edge, *(x for codes in found for x in (codes, edge))])
    return whole, np.flatnonzero(whole != EDGE)


def unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int32) for x in column.to_pylist()]


def train(rows: DataFrame, start: Network, stride: int, rate: float) -> Network:
    """The average of the networks that the tasks train, each once over its documents (rows with ``codes``)."""
    first = start.flat()
    blocks = -(-len(first) // BLOCK)

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, seen = Network.of_flat(first), 0
        squares = {name: np.full(shape, 1e-6, np.float32) for name, shape in SHAPES.items()}

        def step(waiting: list[np.ndarray]) -> None:
            nonlocal seen
            whole, places = laid_out(waiting)
            if stride > 1:  # one in so many of each document, from a place that its codes set
                ends = np.cumsum([len(x) for x in waiting])
                own = np.repeat(np.arange(len(waiting)), [len(x) for x in waiting])
                within = np.arange(len(places)) - np.r_[0, ends[:-1]][own]
                offset = np.array([int(x.sum()) % min(stride, max(1, len(x))) for x in waiting])
                places = places[within % stride == offset[own]]
            for at in range(0, len(places), BATCH):
                some = places[at : at + BATCH]
                for name, g in network.gradient(contexts(whole, some), whole[some]).items():
                    root = g * g
                    squares[name] += root
                    np.sqrt(squares[name], out=root)
                    g *= rate
                    g /= root
                    network.weights[name] -= g
                seen += len(some)

        waiting, held = [], 0
        for batch in batches:
            for some in slices(batch, "codes"):
                for codes in unpacked(some.column(0)):
                    waiting.append(codes)
                    held += len(codes)
                    if held >= 8 * BATCH:
                        step(waiting)
                        waiting, held = [], 0
        if held:
            step(waiting)
        if seen:
            flat = np.zeros(blocks * BLOCK)
            flat[: len(first)] = network.flat()
            flat *= seen
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(blocks), pa.int32()),
                    pa.array([seen] * blocks, pa.int64()),
                    pa.array([x.astype("<f4").tobytes() for x in flat.reshape(blocks, BLOCK)], pa.binary()),
                ],
                ["block", "seen", "sums"],
            )

    def average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for block, seen, sums in zip(*(c.to_pylist() for c in batch.columns)):
                own_total = totals.setdefault(block, [0, np.zeros(BLOCK)])
                own_total[0] += seen
                own_total[1] += np.frombuffer(sums, "<f4")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(totals), pa.int32()),
                pa.array([t[0] for t in totals.values()], pa.int64()),
                pa.array([(t[1] / t[0]).astype("<f4").tobytes() for t in totals.values()], pa.binary()),
            ],
            ["block", "seen", "sums"],
        )

    schema = "block int, seen long, sums binary"
    averaged = rows.select("codes").mapInArrow(learn, schema).repartition("block").mapInArrow(average, schema)
    found = sorted((row["block"], bytes(row["sums"])) for row in averaged.collect())  # the network, once
    if not found:
        return start
    return Network.of_flat(np.concatenate([np.frombuffer(x, "<f4") for _, x in found])[: len(first)])


def score(rows: DataFrame, network: Network) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token): the words' summed log-probabilities and their mean.

    ``rows``: doc_id, codes, within (see ``coded``)."""
    flat = network.flat()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.of_flat(flat)
        for batch in batches:
            for some in slices(batch, "codes"):
                found = unpacked(some.column(1))
                counts = np.array([len(x) for x in found], np.int64)
                whole, places = laid_out(found)
                logs = np.zeros(len(places))
                for at in range(0, len(places), BATCH):
                    step = places[at : at + BATCH]
                    logs[at : at + BATCH] = own.forward(contexts(whole, step), whole[step])[0]
                ends = np.cumsum(counts)
                sums = np.r_[0.0, np.cumsum(logs)]
                sums = sums[ends] - sums[ends - counts] + some.column(2).to_numpy()
                means = [s / n if n else None for s, n in zip(sums.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())],
                    ["doc_id", "n_tokens", "log_likelihood", "per_token"],
                )

    return rows.select("doc_id", "codes", "within").mapInArrow(
        run, "doc_id long, n_tokens long, log_likelihood double, per_token double"
    )


def pseudo_likelihood(docs: DataFrame, stride: int = 1, rate: float = 0.05) -> DataFrame:
    """Each document's score under a network trained on all documents: doc_id, n_tokens, log_likelihood, per_token.

    Null and empty texts have no tokens, a score of 0 and no mean. Repeated rows
    train and are scored each; a null id stays null; an empty table gives no rows.
    Other columns are not read. Scores depend a little on how rows are dealt to
    tasks, each of which trains alone before the average.
    """
    written = tabled(tokens(docs))
    counts = stored(word_counts(written))
    own, frequency = vocabulary(counts)
    rows = tabled(coded(written, counts, own, frequency))
    return score(rows, train(rows, Network.start(frequency), stride, rate))
