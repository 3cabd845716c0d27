import random
import re
from itertools import permutations

import numpy as np
import pytest
import sql

from aerolith.llm import filter_audit, queries

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    shown = text.decode()
    return {"words": len(words), "distinct": len(set(words)), "capitals": len(re.findall("[A-Z]", shown)), "symbols": len(re.findall(r"[#$%&*|]", shown)), "code_points": len(shown)}


def packed(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def some_texts():
    rng = random.Random(5)
    words = ["a", "b", "Ab", "wörd", "漢字", "12345678", "123456789", "x" * 64, "x" * 65, "x" * 64 + "y", "#", "A" * 200, "A" * 199 + "B", "\x00", "\x00\x00", "é🙂"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\t", "\n\r", " \x0b\x0c "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return [t.encode() for t in ["", " ", "a", " a", "a ", *texts, "", "long" * 30_000]]


def test_scan(spark):
    texts = some_texts()
    found = filter_audit.scan(*packed(texts))
    for i, text in enumerate(texts):
        assert {k: v[i] for k, v in found.items()} == plain(text)


def test_colliding_hashes():
    """With few hashes words of one hash are many, and are compared."""
    texts = [t for t in some_texts() if t]
    data, at = packed(texts)
    found = [(m.start(), m.end(), i) for i, t in enumerate(texts) for m in [*re.finditer(rb"[^\x20\x09-\x0D]+", t)]]
    begin, end, row = (np.array(x) for x in zip(*((a + at[i], b + at[i], i) for a, b, i in found)))
    for few in (1, 2, 7):
        hashes = (end - begin).astype(np.uint64) % np.uint64(few)
        assert filter_audit.distinct(data, begin, end, row, len(texts), hashes).tolist() == [plain(t)["distinct"] for t in texts]


def test_against_sql(spark, sf_dir):
    found = sql.spark_rows(queries.QUERIES["op13_filter_audit"](spark, sf_dir), COLUMNS)
    assert found == sql.rows(queries.ORACLES["op13_filter_audit"], sf_dir, COLUMNS)
    assert len({r[0] for r in found}) * 600 == len(found)


def test_odd_rows(spark):
    rng = random.Random(6)
    body = lambda n, kinds: " ".join(rng.choice(kinds) for _ in range(n))
    rows = [(i, body(rng.choice([0, 20, 49, 50, 51, 80]), rng.choice([["a", "b"], [f"w{k}" for k in range(99)], ["AB", "c", "#d"], [f"É{k}" for k in range(99)]])), rng.choice(["x", "y", "", None])) for i in range(300)]
    rows += [(1000 + i, rows[i % 40][1], rng.choice(["x", None])) for i in range(100)]
    rows += [(None, rows[0][1], "x"), (None, rows[0][1], "x"), (None, None, None), (2000, None, "y"), (2001, "", "only"), (7, rows[7][1], "z"), (7, rows[7][1], "x"), (-5, rows[3][1], "x")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, mask int, quality int")
    labels = spark.createDataFrame([(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 2000, 2)] + [(4, 1, 0), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = sql.spark_rows(filter_audit.audit(filter_audit.masks(filter_audit.measured(docs), labels)), COLUMNS)
    assert found == sql.rows(filter_audit.ORACLE, "", COLUMNS, documents=docs, labels=labels)
    removed = {}
    for part, order, step, _, n, *_ in found:
        removed.setdefault((part, order[step - 1]), []).append(n)
    assert all(sum(removed[r[0], r[1][r[2] - 1]]) == r[-1] for r in found)
    assert {r[1] for r in found} == {"".join(p) for p in permutations("ABCDE")}


@pytest.mark.parametrize("parts", [1, 7])
def test_any_blocks(spark, parts):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t.decode(), "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(parts)
    found = {r.id: {k: r[k] for k in plain(b"")} for r in filter_audit.measured(docs).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.masks(filter_audit.measured(docs), labels)).count() == 0
