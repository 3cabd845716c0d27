import re

import numpy as np
import pytest

from aerolith.llm import golay, near_duplicates

xxhash = pytest.importorskip("xxhash")


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def slow_classes(fps):
    ids = list(fps)
    at = {i: i for i in ids}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in ids:
        for j in ids:
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints(spark, sf_dir):
    texts = [None, "", "one", "one two", "A b C", "ÀB c\x0bd\x0ce", "a a a a a"] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).collect()]
    rows = near_duplicates.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in rows} == {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert near_duplicates.fingerprint(b" \n ") == 0


def test_golay_code_has_distance_seven():
    words = [m << 11 | golay.remainder(m << 11) for m in range(1, 1 << 12)]
    assert min(bin(w).count("1") for w in words) == 7


def test_near_words_share_a_codeword():
    random = np.random.default_rng(5)
    a = random.integers(0, 1 << 23, 20_000)
    b = a ^ (1 << random.integers(0, 23, len(a))) ^ (1 << random.integers(0, 23, len(a)))
    (x, nx), (y, ny) = golay.near(a), golay.near(b)
    for i in range(len(a)):
        assert set(x[i, : nx[i]]) & set(y[i, : ny[i]])


def test_every_pair_within_two_bits_shares_a_key():
    random = np.random.default_rng(6)
    a = random.integers(0, 1 << 63, 3000, dtype=np.int64)
    for bits in (0, 1, 2):
        b = a.copy()
        for i in range(len(b)):
            for k in random.choice(64, bits, replace=False):
                b[i] ^= np.int64(np.uint64(1 << int(k)).view(np.int64))
        (ka, ia), (kb, ib) = near_duplicates.keys_of(a), near_duplicates.keys_of(b)
        left, right = {}, {}
        for k, i in zip(ka, ia):
            left.setdefault(i, set()).add(k)
        for k, i in zip(kb, ib):
            right.setdefault(i, set()).add(k)
        assert all(left[i] & right[i] for i in range(len(a)))


@pytest.mark.parametrize("few", [1, 12])
def test_components_by_brute_force(spark, few, monkeypatch):
    """few = 1 sends every shared key down the way for large groups."""
    monkeypatch.setattr(near_duplicates, "FEW", few)
    random = np.random.default_rng(7)
    fps = []
    for _ in range(12):
        fp = int(random.integers(0, 1 << 62))
        for _ in range(25):  # chains: each a bit or two from the last
            fps.append(fp)
            fp ^= 1 << int(random.integers(0, 64))
            if random.random() < 0.6:
                fp ^= 1 << int(random.integers(0, 64))
    fps += [int(x) for x in random.integers(0, 1 << 62, 60)]
    held = {i: f for i, f in enumerate(fps)}
    monkeypatch.setattr(near_duplicates, "fingerprints", lambda docs, *a: docs.selectExpr("*", "array(0L) as views"))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    docs = spark.createDataFrame([(i, signed(f)) for i, f in held.items()], "doc_id long, fp long")
    found = {r.doc_id: r.component_id for r in near_duplicates.classes(docs).collect()}
    assert found == slow_classes(held)


def test_odd_documents(spark):
    rows = [(5, None, 1), (3, "", 1), (9, "  \n", 1), (None, "only one of its kind here", 1), (4, "a few words of text", 1), (4, "a few words of text", 1), (2, "A FEW words of text", 1), (8, "x" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int")
    found = [(r.doc_id, r.component_id) for r in near_duplicates.classes(docs).collect()]
    assert sorted(found, key=str) == sorted([(5, 3), (3, 3), (9, 3), (None, None), (4, 2), (4, 2), (2, 2), (8, 8)], key=str)
    kept = near_duplicates.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, None, 2, 8], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates.classes(docs).count() == 0 and near_duplicates.representatives(docs).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = near_duplicates.op2_near_duplicates(spark, sf_dir).collect()
    fps = {d.doc_id: slow_fingerprint(d.text) for d in docs}
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in found} == slow_classes(fps)


def test_near_copies_of_similarity_080_are_linked(spark):
    random = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, groups = [], {}
    for g in range(25):
        words = list(random.choice(vocabulary, int(random.integers(120, 500))))
        for copy in range(4):
            changed = list(words)
            for k in random.choice(len(words), copy * len(words) // 150, replace=False):
                changed[k] = str(random.choice(vocabulary))
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(changed)))
    shingles = {i: set(near_duplicates.shingle_set(t.encode()).tolist()) for i, t in rows}
    found = {r.doc_id: r.component_id for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    pairs = [(a, b) for a in shingles for b in shingles if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert len(pairs) > 60
    assert np.mean([found[a] == found[b] for a, b in pairs]) >= 0.97
    assert all(groups[i] == groups[c] for i, c in found.items())


def test_shingle_sets():
    assert len(near_duplicates.shingle_set(b"a b c d e f")) == 2
    assert len(near_duplicates.shingle_set(b"a b")) == 1
    assert len(near_duplicates.shingle_set(b" ")) == 0


def linked(spark, rows):
    """Of the pairs of similarity 0.8 or more, by brute force: how many, and the share that has one component."""
    shingles = {i: set(near_duplicates.shingle_set(t.encode()).tolist()) for i, t in rows}
    found = {r.doc_id: r.component_id for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    pairs = [(a, b) for a in shingles for b in shingles if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    return len(pairs), np.mean([found[a] == found[b] for a, b in pairs])


def test_copies_with_a_block_cut_off_or_put_in_are_linked(spark):
    random = np.random.default_rng(9)
    rows = []
    for share in (0.82, 0.85, 0.9):
        for _ in range(15):
            words = list(random.choice([f"w{i}" for i in range(4000)], int(random.integers(100, 400))))
            block = list(random.choice([f"v{i}" for i in range(4000)], int(len(words) * (1 / share - 1)) - 6))
            for text in (words, words[: int(len(words) * share) + 2], words[:50] + block + words[50:]):
                rows.append((len(rows), " ".join(text)))
    pairs, share = linked(spark, rows)
    assert pairs >= 85 and share == 1


def test_prefixes_of_similar_sets_share_their_first_common_shingle():
    random = np.random.default_rng(10)
    none, some = (np.zeros(0, np.int64),) * 2, (np.arange(0, 1000, 3), np.arange(334) % 5 + 1)
    for last in (none, some):
        for _ in range(300):
            both = random.choice(1000, int(random.integers(1, 60)), replace=False)
            extra = random.integers(0, len(both) // 4 + 1)
            cut = random.integers(0, extra + 1)
            more = np.arange(1000, 1000 + extra)
            a, b = np.unique(np.append(both, more[:cut])), np.unique(np.append(both, more[cut:]))
            p, q = near_duplicates.prefix(a, last).tolist(), near_duplicates.prefix(b, last).tolist()
            shared = next(x for x in p if x in q)
            assert min(len(a) - p.index(shared), len(b) - q.index(shared)) >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-6
            x, y = (np.frombuffer(near_duplicates.sketch(s), np.uint8)[None] for s in (a, b))
            assert near_duplicates.most_shared(x, y)[0] >= len(both)


def test_copies_in_a_family_of_relatives_are_linked(spark, monkeypatch):
    """Without a sample of common shingles, the texts of a family share most keys, and the first of a key is a mere relative."""
    monkeypatch.setattr(near_duplicates, "OFTEN", 1 << 40, raising=False)
    random = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    template, rows = list(random.choice(vocabulary, 300)), []
    for _ in range(150):
        variant = list(template)
        for k in random.choice(300, 10, replace=False):
            variant[k] = str(random.choice(vocabulary))
        copy = list(variant)
        for k in random.choice(300, 5, replace=False):
            copy[k] = str(random.choice(vocabulary))
        rows += [(len(rows), " ".join(variant)), (len(rows) + 1, " ".join(copy))]
    pairs, share = linked(spark, rows)
    assert pairs >= 140 and share == 1


def test_texts_that_repeat_a_line_are_linked(spark):
    """The same set but for one line, met 60 times in one of the two: the fingerprints are far apart."""
    random, rows = np.random.default_rng(12), []
    for _ in range(20):
        words = list(random.choice([f"w{i}" for i in range(4000)], 300))
        line = list(random.choice([f"v{i}" for i in range(4000)], 12))
        rows += [(len(rows), " ".join(words + line)), (len(rows) + 1, " ".join(words + line * 60))]
    pairs, share = linked(spark, rows)
    assert pairs == 20 and share == 1


def test_sketches_bound_what_sets_share():
    random = np.random.default_rng(13)
    for size in (0, 1, 3, 300, 3000, 40_000):
        both, more = random.integers(-(1 << 62), 1 << 62, size), random.integers(0, 1 << 62, size // 5)
        x, y = (np.frombuffer(near_duplicates.sketch(np.unique(s)), np.uint8)[None] for s in (both, np.append(both, more)))
        assert size <= near_duplicates.most_shared(x, y)[0] <= size + len(more)
    full = np.full((1, 64), 255, np.uint8)
    assert near_duplicates.most_shared(full, full)[0] > 1 << 40


def test_texts_of_one_fingerprint_are_all_compared(spark):
    """Repeated words decide a fingerprint; texts that share it, but no set, hide no copy behind the one of least id."""
    random = np.random.default_rng(14)
    one, other, third = (" ".join(random.choice([f"w{i}" for i in range(4000)], 60)) for _ in range(3))
    rows = [(1, "spam " * 400 + one), (2, "spam " * 400 + other), (3, "spam " * 5 + other), (None, "spam " * 5 + one), (None, "spam " * 300 + third), (4, "spam " * 400 + third)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {near_duplicates.fingerprint(t.encode()) for i, t in rows if i in (1, 2, 4)}
    assert len(fps) == 1
    plain = {r.doc_id: r.component_id for r in near_duplicates.classes(docs).collect()}
    assert plain[1] == plain[2] == plain[4] == 1
    found = sorted(((r.doc_id, r.component_id) for r in near_duplicates.classes(docs, similarity=0.8).collect()), key=str)
    assert found == sorted([(1, 1), (2, 2), (3, 2), (None, 1), (None, 4), (4, 4)], key=str)
    assert sorted(r.doc_id for r in near_duplicates.representatives(docs).collect()) == [1, 2, 4]


def test_all_pairs_of_texts(spark, sf_dir):
    """On the given documents, components are exactly those of all pairs of texts of similarity 0.8 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shingles = {r.doc_id: set(near_duplicates.shingle_set((r.text or "").encode()).tolist()) for r in docs.collect()}
    root = {i: i for i in shingles}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(shingles):
        for b in sorted(shingles):
            if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component_id for r in near_duplicates.classes(docs, similarity=0.8).collect()} == {i: find(i) for i in shingles}
