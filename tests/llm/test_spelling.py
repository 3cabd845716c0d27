import random
import zlib
from collections import Counter

import pytest
import sql

from aerolith.llm import queries, spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(counts, length=6, occurrences=5, ratio=5):
    v = {w: n for w, n in counts.items() if len(w) >= length and n >= occurrences}
    form, out = {}, []
    near = {w: [x for x in v if is_near(w, x)] for w in v}
    for w, n in v.items():
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= ratio * n else None
    for w, n in v.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), v.get(form[w])))
    return sorted(out, key=str)


def grouped(spark, counts, **how):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sql.spark_rows(spelling.group(df, **how), COLUMNS)


def test_against_sql(spark, sf_dir):
    found = sql.spark_rows(queries.QUERIES["op12_spelling"](spark, sf_dir), COLUMNS)
    assert found == sql.rows(queries.ORACLES["op12_spelling"], sf_dir, COLUMNS)


@pytest.mark.parametrize("seed", range(3))
def test_by_brute_force(spark, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choice("aabÿ") for _ in range(rng.randint(5, 8))): rng.choice([1, 4, 5, 6, 25, 30, 31, 150, 800, 800]) for _ in range(300)}
    assert grouped(spark, counts) == slow(counts)


@pytest.mark.parametrize("spelled", [3, 6, 7])
def test_hashed_keys(spark, spelled, monkeypatch):
    """Words over the bound have hashed keys, which must meet those of words at the bound."""
    rng = random.Random(9)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(4, 9))): rng.randint(1, 900) for _ in range(200)}
    monkeypatch.setattr(spelling, "_SPELLED", spelled)
    words = sorted(counts)
    keys = {w: (set(spelling.keys_of(w)[0]), set(spelling.keys_of(w)[1]), spelling.own_key(w)) for w in words}
    for a in words:
        assert len(spelling.keys_of(a)[0]) == len(keys[a][0]) == len(a) and len(spelling.keys_of(a)[1]) == len(keys[a][1])
        for b in words:
            met = len(keys[a][0] & keys[b][0]) if a != b else 0
            assert met + (keys[a][2] in keys[b][1]) + (keys[b][2] in keys[a][1]) == is_near(a, b)


def test_long_words(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    counts = {long: 500, long[:1500] + long[1501:]: 60, long[:7] + "z" + long[8:]: 70, long[:64]: 99, long[:65]: 9, "short": 9, long[:-2]: 8}
    assert grouped(spark, counts) == slow(counts)


def test_words_of_documents(spark):
    rows = [(i, "Straße tHEREfore ÀBCDEFG therefore×÷ab 12therefore_therefore aéíóú éíóúab short " * (1 + i % 3)) for i in range(400)]
    rows += [(None, "nobody nobody nobody"), (7, None), (8, ""), (9, "x" * 100_000 + " " + "nobody " * 3)] + [(3, "repeat repeat")] * 3
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, word int, n int")
    want = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
                want[word] += len(word) >= 6
            run = ""
    found = {r.word: r.n for r in spelling.words(docs).collect()}
    assert found == {w: n for w, n in want.items() if n}
    assert sql.spark_rows(spelling.group(spelling.words(docs)), COLUMNS) == sql.rows(spelling.ORACLE, "", COLUMNS, documents=docs.select("doc_id", "text"))


def test_counts_are_handed_on(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"{'abcdef'[i % 6]}letters{'xyz'[k % 3]}" for k in range(50))) for i in range(30)], "doc_id long, text string")
    want = sorted(map(tuple, spelling.words(docs).collect()))
    monkeypatch.setattr(spelling, "_HELD", 3)
    assert sorted(map(tuple, spelling.words(docs).collect())) == want


def test_empty(spark):
    assert grouped(spark, {"seldom": 4}) == []
    docs = spark.createDataFrame([(None, None), (1, "none of six letters")], "doc_id long, text string")
    assert spelling.group(spelling.words(docs)).count() == 0
    assert spelling.group(spelling.words(docs.limit(0))).count() == 0
