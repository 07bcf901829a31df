import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlab.llm import pseudo_likelihood as pl


@pytest.fixture(scope="module")
def network():
    r = np.random.default_rng(1)
    found = pl.Network.start(r.integers(1, 50, pl.CODES).astype(float))
    for name in ("given_1", "given_2"):
        found.weights[name][:] = r.normal(0, 0.1, pl.SHAPES[name])
    return found


def test_probabilities_add_up(network):
    context = np.array([[5], [pl.EDGE], [77], [4000]], np.int32)
    every = np.arange(pl.CODES, dtype=np.int32)
    logs = network.forward(np.repeat(context, pl.CODES, axis=1), every)[0]
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("name", list(pl.SHAPES))
def test_gradient(network, name):
    r = np.random.default_rng(2)
    context, code = r.integers(0, pl.CODES + 1, (4, 40)).astype(np.int32), r.integers(0, pl.CODES, 40).astype(np.int32)
    gradient, weights = network.gradient(context, code)[name], network.weights[name]
    at = np.unravel_index(np.abs(gradient).argmax(), weights.shape)
    kept, loss = weights[at], []
    for step in (0.01, -0.01):
        weights[at] = kept + step
        loss.append(-network.forward(context, code)[0].astype(float).mean())
    weights[at] = kept
    assert (loss[0] - loss[1]) / 0.02 == pytest.approx(gradient[at], rel=0.02, abs=1e-4)


def test_a_step_costs_by_its_places(network):
    """A batch reads the codes around its places, not all that are laid out; the network's sums are those of plain loops."""
    r = np.random.default_rng(3)
    docs = [r.integers(0, pl.CODES, n).astype(np.int32) for n in (0, 1, 7, 2_000_000)]
    whole, places = pl.laid_out(docs)
    assert (whole[places] == np.concatenate(docs)).all()
    tracemalloc.start()
    found = pl.contexts(whole, places[:50])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000
    flat = [[d[i + s] if 0 <= i + s < len(d) else pl.EDGE for s in pl.SIDES] for d in docs for i in range(min(50, len(d)))][:50]
    assert found.T.tolist() == flat

    code, w = whole[places[:50]], network.weights
    gradient = network.gradient(found, code)
    prefix = code // pl.DIGIT
    digits = prefix // pl.DIGIT, prefix % pl.DIGIT, code % pl.DIGIT
    hidden = np.tanh(sum(w["embed"][i][found[i]] for i in range(len(pl.SIDES))).astype(float))
    back, total = np.zeros_like(hidden), np.zeros(50)
    for step, known in enumerate((np.zeros(50, int), prefix // pl.DIGIT, prefix)):
        seen = hidden + (w[f"given_{step}"][:, known].T if step else 0)
        logits = seen @ w["out"][step].T + w[f"bias_{step}"][:, known].T
        soft = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        total += np.log(soft[np.arange(50), digits[step]])
        soft[np.arange(50), digits[step]] -= 1
        through = soft / 50 @ w["out"][step]
        back += through
        assert gradient["out"][step] == pytest.approx((soft / 50).T @ seen, abs=1e-6)
        for name, values in ((f"bias_{step}", soft / 50), (f"given_{step}", through))[: 1 + (step > 0)]:
            want = np.zeros(pl.SHAPES[name][::-1])
            np.add.at(want, known, values)
            assert gradient[name] == pytest.approx(want.T, abs=1e-6)
    want = np.zeros(pl.SHAPES["embed"])
    for i, side in enumerate(found):
        np.add.at(want[i], side, back * (1 - hidden * hidden))
    assert gradient["embed"] == pytest.approx(want, abs=1e-6)
    assert network.forward(found, code)[0] == pytest.approx(total, rel=1e-5)


def model(docs):
    """The stored tokens of the documents with all that their codes need."""
    written = pl.tabled(pl.tokens(docs))
    counts = pl.stored(pl.word_counts(written))
    return written, counts, *pl.vocabulary(counts)


def slow_codes(text, own):
    digests = [pl.xxhash.xxh3_64_intdigest(w) for w in pl.split_words(text)]
    signed = [d - (d >> 63 << 64) for d in digests]
    return [own.get(d, pl.OWN + d % (pl.CODES - pl.OWN)) for d in signed]


def slow_score(network, codes):
    total = 0.0
    for i, code in enumerate(codes):
        context = [[codes[i + s] if 0 <= i + s < len(codes) else pl.EDGE] for s in pl.SIDES]
        total += float(network.forward(np.array(context, np.int32), np.array([code], np.int32))[0][0])
    return total


def test_scores_are_token_by_token(spark, documents, network):
    _, counts, own, frequency = model(documents)
    docs = documents.where("doc_id % 20 = 0")
    n = {r.word: r.n for r in counts.collect()}
    rows = {r.doc_id: r for r in pl.score(pl.coded(pl.tabled(pl.tokens(docs, part_words=50)), counts, own, frequency), network).collect()}
    for r in docs.collect():
        want, within = slow_codes(r.text, own), 0.0
        for word, code in zip(pl.split_words(r.text), want):
            if code >= pl.OWN:
                digest = pl.xxhash.xxh3_64_intdigest(word)
                within += np.log(n[digest - (digest >> 63 << 64)] / (frequency[code] + pl.UNSEEN))
        assert rows[r.doc_id].n_tokens == len(want)
        assert rows[r.doc_id].log_likelihood == pytest.approx(slow_score(network, want) + within, rel=1e-4)


def test_vocabulary_counts_all_documents(documents):
    _, _, own, frequency = model(documents)
    want = np.zeros(pl.CODES)
    for r in documents.collect():
        np.add.at(want, slow_codes(r.text, own), 1)
    assert (frequency == want).all() and len(own) == pl.OWN


def test_trained_network_tells_order_from_disorder(spark):
    """Sentences of a small grammar: held-out ones score better than the same words shuffled."""
    r = np.random.default_rng(5)
    rows = [
        (i, " ".join(f"det{r.integers(3)} adj{r.integers(9)} noun{r.integers(9)} verb{r.integers(9)} end" for _ in range(60)))
        for i in range(400)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    written, counts, own, frequency = model(docs)
    network = pl.train(pl.coded(written, counts, own, frequency), pl.Network.start(frequency), stride=1, rate=0.05)
    held = " ".join(f"det{r.integers(3)} adj{r.integers(9)} noun{r.integers(9)} verb{r.integers(9)} end" for _ in range(60))
    mixed = " ".join(r.permutation(held.split()))
    test = spark.createDataFrame([(1, held), (2, mixed)], "doc_id long, text string")
    rows = pl.coded(pl.tabled(pl.tokens(test)), counts, own, frequency)
    good, bad = (row.per_token for row in pl.score(rows, network).orderBy("doc_id").collect())
    start, _ = (row.per_token for row in pl.score(rows, pl.Network.start(frequency)).orderBy("doc_id").collect())
    assert good > start + 0.5 and good > bad + 1.0


def test_every_token_trains_by_default(spark):
    """The query's own setting: equal to stride 1, and documents in order score better than shuffled ones beside them."""
    r = np.random.default_rng(6)
    text = lambda: " ".join(f"det{r.integers(3)} adj{r.integers(9)} noun{r.integers(9)} verb{r.integers(9)} end" for _ in range(60))
    rows = [(i, text()) for i in range(400)] + [(1000 + i, " ".join(r.permutation(text().split()))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {row.doc_id: row.per_token for row in pl.pseudo_likelihood(docs).collect()}
    every = {row.doc_id: row.per_token for row in pl.pseudo_likelihood(docs, stride=1).collect()}
    assert found == pytest.approx(every, rel=1e-3)
    assert min(v for k, v in found.items() if k < 1000) > max(v for k, v in found.items() if k >= 1000) + 0.5


def test_words_of_a_code_share_its_probability(spark):
    """Two rare words of one code, one seen often and one seen once: the texts differ by the logarithm of their counts."""
    common = [f"w{i}" for i in range(pl.OWN)]
    places, pair = {}, None
    for i in range(100_000):
        place = pl.xxhash.xxh3_64_intdigest(f"rare{i}".encode()) % (pl.CODES - pl.OWN)
        if place in places:
            pair = (places[place], f"rare{i}")
            break
        places[place] = f"rare{i}"
    lead = "w1 w2 w3 "
    rows = [(i, " ".join(common)) for i in range(10)] + [(100, lead + pair[0]), (101, lead + pair[1]), (102, lead + pair[0])]
    rows += [(200 + i, f"w4 {pair[0]}") for i in range(4)] + [(300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in pl.pseudo_likelihood(docs).collect()}
    assert len(found) == len(rows)
    assert found[100].log_likelihood == pytest.approx(found[102].log_likelihood)
    assert found[100].log_likelihood - found[101].log_likelihood == pytest.approx(np.log(6), abs=1e-3)
    assert found[300].log_likelihood == 0 and found[300].per_token is None
    # a word that the corpus doesn't have gets the mass left for all of these
    _, counts, own, frequency = model(docs)
    new = spark.createDataFrame([(1, f"{pair[0]} {pair[0]}"), (2, "neverseen")], "doc_id long, text string")
    total = lambda word: frequency[slow_codes(word, own)[0]]
    want = [2 * np.log(6 / (total(pair[0]) + pl.UNSEEN)), np.log(pl.UNSEEN / (total("neverseen") + pl.UNSEEN))]
    found = pl.coded(pl.tabled(pl.tokens(new)), counts, own, frequency).collect()
    assert sorted(r.within for r in found) == pytest.approx(sorted(want))


def test_edges(edge, empty, clashing):
    rows = pl.pseudo_likelihood(edge).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert (r.per_token is None) == (r.n_tokens == 0) and r.log_likelihood <= 0
    assert pl.pseudo_likelihood(clashing).count() == len(rows)
    assert pl.pseudo_likelihood(empty).count() == 0
