"""Quality, toxicity and language: held-out accuracy, and odd inputs."""

import zlib

import numpy as np
import pytest

from aerolith.llm import classify, features, language, quality, queries, toxicity

ODD = [(None, "null id text", None), (1, None, "en"), (2, "", "en"), (3, " \n\t ", "en"), (4, "123 !!! 456", "en"), (5, "x" * 200_000, "en"), (6, "same", "en"), (6, "same", "en")]
SCHEMA = "doc_id long, text string, lang string"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_bags_and_totals_agree():
    spec = features.Spec(pairs=True, bits=12)
    texts = [b"", b"one", b"one one two", "Größe größe ab".encode(), b"a " * 50, b"\n\t line\r\nbreaks  here "]
    weights = np.random.default_rng(1).random(1 << 12)
    total, _ = features.totals(texts, weights, spec)
    for (ids, _, count), row in zip(features.bags(texts, spec), total, strict=True):
        assert (weights[ids] * count).sum() == pytest.approx(row.sum())


def test_pieces_of_a_long_text_add_up():
    spec = features.Spec()
    text = b"some words of a text " * 3000
    weights = np.random.default_rng(2).random(1 << 18)
    whole = features.totals([text], weights, spec)
    old = features.packed.__defaults__
    features.packed.__defaults__ = (5000,)
    try:
        cut = features.totals([text], weights, spec)
    finally:
        features.packed.__defaults__ = old
    assert np.allclose(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])


def test_repeated_words_share_a_pair_bucket():
    spec = features.Spec(pairs=True)
    (a, _, _), (b, _, _) = features.bags([b"x x", b"longer longer"], spec)
    assert 0 in a and 0 in b


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    rows = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    return {r.doc_id: r for r in rows}


@pytest.mark.parametrize("name,label,least", [("op4_quality", "quality", 0.97), ("op10_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, labels, name, label, least):
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (fold(r.doc_id) == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]) >= 0.98


def test_odd_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = spark.createDataFrame(ODD, SCHEMA)
    q, t, m = quality.fit(docs, labels), toxicity.fit(docs, labels), language.fit(docs)
    for found in (quality.score(odd, q), toxicity.score(odd, t)):
        rows = found.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    rows = language.predict(odd, m).collect()
    assert len(rows) == len(ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 4)} == {"und"}


def test_training_without_data(spark):
    docs, empty = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")
    nothing = spark.createDataFrame([], SCHEMA)
    for labels in (empty, one):
        assert quality.score(docs, quality.fit(docs, labels)).count() == len(ODD)
        assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == len(ODD)
        assert quality.score(nothing, quality.fit(nothing, labels)).count() == 0
        assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(nothing)).collect()} == {"und"}


def test_words_are_runs_of_letters():
    assert language.words_of("Don't stop² ½x Ünï_code 漢字 a1b") == ["don", "t", "stop", "x", "ünï", "code", "漢字", "a", "b"]


def test_backoff_uses_longest_known_gram():
    grams = {"<": np.zeros(2), "xy": np.array([-1.0, -2.0]), "x": np.array([-7.0, -7.0])}
    assert language.backed_off("xyq", grams, 2).tolist() == [language.GRAM_WEIGHT * 2 * -1.0, language.GRAM_WEIGHT * 2 * -2.0]


def slow_language(training, texts):
    """Prediction by plain dictionaries."""
    from collections import Counter
    from math import exp, log

    words, grams = {}, {}
    for lang, text in training:
        for w in language.words_of(text):
            words.setdefault(w, Counter())[lang] += 1
            marked = f"<{w}>"
            for g in (marked[i : i + n] for n in range(1, 5) for i in range(len(marked) - n + 1)):
                grams.setdefault(g, Counter())[lang] += 1
    langs = sorted({x for x, _ in training})
    size = {t: {x: sum(c[x] for c in table.values()) + 0.5 * len(table) for x in langs} for t, table in (("w", words), ("g", grams))}
    everything = {x: sum(c[x] for c in words.values()) for x in langs}

    def word(w, x):
        if w in words:
            return log((words[w][x] + 0.5) / size["w"][x])
        marked, at, total = f"<{w}>", 0, 0.0
        while at < len(marked):
            n = next((n for n in range(min(4, len(marked) - at), 0, -1) if marked[at : at + n] in grams), 0)
            total += 0.25 * n * log((grams[marked[at : at + n]][x] + 0.5) / size["g"][x]) if n else 0
            at += n or 1
        return total

    for text in texts:
        found = language.words_of(text or "")
        totals = [sum(word(w, x) for w in found) + log(everything[x] / sum(everything.values())) for x in langs]
        best = max(totals)
        yield (langs[totals.index(best)], 1 / sum(exp(t - best) for t in totals)) if found else ("und", 0.0)


@pytest.mark.parametrize("top_words,top_grams", [(60_000, 250_000), (20, 250_000), (20, 0), (0, 0)])
def test_language_by_brute_force(spark, sf_dir, top_words, top_grams):
    """The bounds of what is sent out change nothing."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    training, asked = [r for r in rows if fold(r.doc_id)], rows
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang, "x") for r in rows], "doc_id long, text string, lang string, sums string")
    model = language.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"), top_words=top_words, top_grams=top_grams)
    assert (model.top_grams is None) == (top_grams == 0)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    expected = slow_language([(r.lang, r.text) for r in training if r.lang and r.text], [r.text for r in asked])
    for r, (lang, score) in zip(asked, expected, strict=True):
        assert found[r.doc_id] == (lang, pytest.approx(score, rel=1e-6))


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, round(r.score, 9)) for r in language.predict(docs, language.fit(docs)).collect()} == {("a", 0.5)}


def test_sample_is_bounded_and_leaves_out_fold_0(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(None, 1), (7, None)], "doc_id long, quality int")
    rows = classify.labelled_ids(labels, "quality", "doc_id", 100).collect()
    assert len(rows) == 100 and all(fold(r.doc_id) for r in rows)


def slow_sgd(bags, labels, dimensions, epochs, rate, seed):
    """quality.train in plain numbers, one feature at a time."""
    from math import exp

    random = np.random.default_rng(seed)
    first = [float(x) for x in random.normal(1, 0.3, dimensions).astype(np.float32)]
    output, bias, vectors = [[-x for x in first], list(first)], [0.0, 0.0], {}
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in random.permutation(len(bags)):
            step, done = rate * (1 - done / steps), done + 1
            hidden = [sum(s * vectors.get(f, [0.0] * dimensions)[d] for f, s in bags[i]) for d in range(dimensions)]
            z = [sum(o * h for o, h in zip(output[k], hidden, strict=True)) + bias[k] for k in (0, 1)]
            p = [exp(x - max(z)) for x in z]
            error = [x / sum(p) - (labels[i] == k) for k, x in enumerate(p)]
            back = [sum(output[k][d] * error[k] for k in (0, 1)) for d in range(dimensions)]
            for k in (0, 1):
                output[k] = [o - 0.1 * step * error[k] * h for o, h in zip(output[k], hidden, strict=True)]
                bias[k] -= 0.1 * step * error[k]
            for f, s in bags[i]:
                vectors[f] = [v - step * s * b for v, b in zip(vectors.get(f, [0.0] * dimensions), back, strict=True)]
    return {f: sum(v[d] * (output[1][d] - output[0][d]) for d in range(dimensions)) for f, v in vectors.items()}, bias[1] - bias[0]


def test_quality_training_against_plain_numbers():
    random, spec = np.random.default_rng(3), features.Spec(bits=8)
    bags = [(np.unique(random.integers(0, 256, 20)), None) for _ in range(12)]
    bags = [(ids, random.random(len(ids)).astype(np.float32)) for ids, _ in bags]
    labels = [int(x) for x in random.integers(0, 2, 12)]
    model = quality.train(bags, labels, spec, 3, 4, 2.0, 9)
    weights, bias = slow_sgd([list(zip(i.tolist(), s.tolist(), strict=True)) for i, s in bags], labels, 3, 4, 2.0, 9)
    assert model.bias == pytest.approx(bias, abs=1e-3)
    assert all(model.weights[f] == pytest.approx(w, abs=1e-3) for f, w in weights.items())
    assert not model.weights[[f for f in range(256) if f not in weights]].any()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_are_those_of_each_text_by_itself(spark, sf_dir, module):
    """Whole tables at once give what the features of one text after the other give."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = module.fit(docs, labels)
    found = {r.doc_id: r.score for r in module.score(docs.select("doc_id", "text"), model).collect()}
    for row in docs.select("doc_id", "text").collect():
        text = (row.text or "").encode()
        ((ids, share, count),) = features.bags([text], module.SPEC)
        if module is quality:
            z = float(share.astype(float) @ model.weights[ids].astype(float)) + model.bias
        else:
            z = float(count @ model.weights[ids].astype(float)) / max(1.0, len(text) / toxicity.UNIT_BYTES) ** 0.5 + model.bias
        assert found[row.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_risk_training_against_its_definition(monkeypatch):
    """Steps along the numerical slope of the corrected risk; where its second term is negative, the other way along that term."""
    for name, value in (("STEPS", 12), ("MOMENTUM", 0.0), ("DECAY", 0.0), ("RATE", 2.0)):
        monkeypatch.setattr(toxicity, name, value)
    random, prior, chosen = np.random.default_rng(4), 0.5, np.array([3, 8])
    docs = [(np.array([3, 8]), random.random(2) * 4, 100) for _ in range(5)], [(np.array([3, 8]), random.random(2), 5000) for _ in range(9)]
    positive, unlabelled = ([c / toxicity._scale(np.array([n]))[0] for _, c, n in part] for part in docs)
    loss = lambda z: float(np.logaddexp(0, z))

    def second(v):
        return np.mean([loss(x @ v[:2] + v[2]) for x in unlabelled]) - prior * np.mean([loss(x @ v[:2] + v[2]) for x in positive])

    def objective(v, sign):
        return prior * np.mean([loss(-(x @ v[:2] + v[2])) for x in positive]) + second(v) if sign else -second(v)

    v, seen = np.array([0.0, 0.0, np.log(prior / (1 - prior))]), set()
    for _ in range(12):
        sign = bool(second(v) >= 0)
        seen.add(sign)
        slope = [(objective(v + d, sign) - objective(v - d, sign)) / 2e-5 for d in np.eye(3) * 1e-5]
        v = v - 2.0 * np.array(slope)
    weights, bias = toxicity.train(*docs, chosen, prior)
    assert seen == {True, False}
    assert weights == pytest.approx(v[:2], abs=1e-3) and bias == pytest.approx(v[2], abs=1e-3)


def test_quality_training_is_bounded_by_bytes(spark):
    """Documents that do not fit what is left of the bound are passed over, in order of their hash."""
    docs = spark.createDataFrame([(i, "good text " * 5 if i % 2 else "bad words " * 5) for i in range(40)] + [(99, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1)], "doc_id long, quality int")
    some = quality.fit(docs, labels, most_bytes=1000)
    none = quality.fit(docs, labels, most_bytes=0)
    assert some.weights.any() and not none.weights.any() and none.bias == 0
