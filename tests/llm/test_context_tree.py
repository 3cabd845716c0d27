import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from aerolith.llm import context_tree


def slow_model(streams, order):
    """The weighted trees by recursion over plain dictionaries."""
    counts = defaultdict(lambda: [0, 0])
    for s in streams:
        data = b"\n" * order + s
        for i in range(order, len(data)):
            for d in range(order + 1):
                prefix = 1
                for k in range(7, -1, -1):
                    bit = data[i] >> k & 1
                    counts[data[i - d : i], prefix][bit] += 1
                    prefix = prefix * 2 + bit
    block = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = defaultdict(list)
    for context, prefix in counts:
        if context:
            children[context[1:], prefix].append((context, prefix))
    log = {}

    def weighted(node):
        if node not in log:
            own = block(*counts[node])
            log[node] = own if len(node[0]) == order else np.logaddexp(own, sum(weighted(c) for c in children[node])) - math.log(2)
        return log[node]

    def log10(s):
        data, total = b"\n" * order + s, 0.0
        for i in range(order, len(data)):
            prefix = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                path = []
                for d in range(order + 1):
                    node = data[i - d : i], prefix
                    if node not in counts or not sum(counts[node]):
                        break
                    path.append(node)
                p = 0.5
                for j, node in enumerate(reversed(path)):
                    a, b = counts[node]
                    own = (b + 0.5) / (a + b + 1)
                    w = 1.0 if len(node[0]) == order else math.exp(block(a, b) - math.log(2) - weighted(node))
                    p = own if j == 0 else w * own + (1 - w) * p
                total += math.log10(p if bit else 1 - p)
                prefix = prefix * 2 + bit
        return total

    return log10


@pytest.mark.parametrize("order,slots,run,nodes", [(2, 12, 1 << 17, 1 << 20), (3, 3, 50, 1 << 20), (5, 1, 7, 60)])
def test_against_recursion(spark, order, slots, run, nodes, monkeypatch):
    """With few slots most grams go by the join; short runs and several parts of short contexts change nothing."""
    monkeypatch.setattr(context_tree, "RUN", run)
    monkeypatch.setattr(context_tree, "NODES", nodes)
    texts = ["the cat sat on the mat", "the cat ate the rat", "a dog sat", "The  DOG\tate", None, "", "zebra qux", "the the the the"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in context_tree.score(docs, docs.where("doc_id < 5"), order=order, slots=slots, top_words=1).collect()}
    streams = [context_tree.stream((t or "").encode()) for t in texts]
    log10 = slow_model(streams[:5], order)
    for i, s in enumerate(streams):
        assert found[i].score == pytest.approx(log10(s), rel=1e-5)
    c = Counter()
    for s in streams[:5]:
        c.update(s.split())
        c[b"\n"] += 1
    n, v = sum(c.values()), len(c)
    for i, s in enumerate(streams):
        tokens = [*s.split(), b"\n"]
        assert found[i].train_tokens == n and found[i].n_tokens == len(tokens) and found[i].n_known == sum(c[t] > 0 for t in tokens)
        assert found[i].base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))


def test_whole_tables_against_recursion(spark, sf_dir):
    """All documents of the smallest tables with the query's own parameters, on a few documents of either kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    trains = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 5 != 1 for d in docs}
    log10 = slow_model([context_tree.stream((d.text or "").encode()) for d in docs if trains[d.doc_id]], context_tree.ORDER)
    found = {r.doc_id: r for r in context_tree.op8_lm_score(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    short = sorted(docs, key=lambda d: (len(d.text or ""), d.doc_id))
    for held in (True, False):
        for d in [d for d in short if trains[d.doc_id] != held][:12]:
            assert found[d.doc_id].score == pytest.approx(log10(context_tree.stream((d.text or "").encode())), rel=1e-5)


def test_probabilities_of_all_bytes_add_up():
    """All bytes that may follow a context that training has."""
    texts = ["some text", "other text here", "more"]
    low = sum(b << 8 * (3 - k) for k, b in enumerate(reversed(b"tex")))
    keys = np.array([low | b for b in range(256)], np.uint64)
    counts = context_tree.grams([context_tree.stream(t.encode()) for t in texts], 3)[0]
    trained, n = np.unique(counts, return_counts=True)
    every = np.union1d(trained, keys)
    counted = np.zeros(len(every))
    counted[np.searchsorted(every, trained)] = n
    mixture, (node, *totals) = context_tree.folded(every, counted, 3, 1)
    top = context_tree.Level.of(node, *totals)
    log = context_tree.log10_of(every, mixture, [top], 3)
    assert np.power(10, log[np.isin(every, keys)]).sum() == pytest.approx(1)


def test_grams():
    keys, starts = context_tree.grams([b"ab\n", b"\n", b"c\n"], 2)
    at = lambda a, b, c: b << 16 | a << 8 | c
    n = 10
    assert starts.tolist() == [0, 3, 4]
    assert keys.tolist() == [at(n, n, 97), at(n, 97, 98), at(97, 98, n), at(n, n, n), at(n, n, 99), at(n, 99, n)]


def test_no_training_and_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x", 1), (1, None, 1), (1, None, 1), (2, "y" * 50_000, 1)], "doc_id long, text string, score int")
    rows = context_tree.score(docs, docs.limit(0), slots=12).collect()
    assert len(rows) == 4 and all(r.train_tokens == 0 and r.base_score == 0 for r in rows)
    assert all(r.score == pytest.approx(-r.n_bytes * 8 * math.log10(2)) for r in rows)
    assert context_tree.score(docs.limit(0), docs, slots=12).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = context_tree.op8_lm_score(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert -sum(r.score for r in held) / math.log10(2) / sum(r.n_bytes for r in held) < 2.2


def test_a_seldom_bit_keeps_its_probability():
    """After 2e7 times of one byte in a context, the other's probability is small but not nought, also as it is stored."""
    keys = np.array([0x6161, 0x6162], np.uint64)  # the context byte a, then a or b
    mixture, (node, zeros, ones, log) = context_tree.folded(keys, np.array([20_000_000, 0]), 1, 1)
    stored = context_tree._own(keys, context_tree._own(keys, mixture).astype("<f4").astype(np.float64))
    level = context_tree.Level.of(node, zeros, ones, log)
    exact, found = (context_tree.log10_of(keys, m, [level], 1) for m in (mixture, stored))
    assert np.isfinite(found).all() and found[1] < -6
    np.testing.assert_allclose(found, exact, atol=1e-6)
