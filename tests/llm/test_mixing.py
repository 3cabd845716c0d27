import random

import pytest
import sql
from pyspark.sql import functions as F

from aerolith.llm import common, mixing, queries

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]
SCHEMA = "doc_id long, text string, source string, size int, target string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def water(sizes, weights, share, most):
    """Targets by halving the level at which sources are filled."""
    total, low, high = share * sum(sizes), 0.0, most * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * s, w * level) for s, w in zip(sizes, weights)) < total else (low, level)
    return [min(most * s, w * high) for s, w in zip(sizes, weights)]


def test_against_sql(spark, sf_dir):
    found = sql.spark_rows(queries.QUERIES["op11_mix"](spark, sf_dir), COLUMNS)
    assert found == sql.rows(queries.ORACLES["op11_mix"], sf_dir, COLUMNS)
    assert found == sql.spark_rows(queries.QUERIES["op11_mix"](spark, sf_dir), COLUMNS)


def test_odd_rows_against_sql(spark):
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(i % 7)), s) for i, s in enumerate(["hot"] * 60 + ["", None, "é", "z", "Z", None, "void"])]
    rows += [(5, "twice here", "hot")] * 3 + [(None, "nobody\tknows", "z"), (None, "nobody\tknows", "z"), (None, None, None), (900, None, "void"), (901, "  \n", "hot")]
    docs = table(spark, rows)
    assert sql.spark_rows(mixing.mix(docs), COLUMNS) == sql.rows(mixing.ORACLE, "", COLUMNS, documents=docs)


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 7, 90, 1000]) + rng.randrange(5) for _ in range(rng.randint(1, 30))]
    weights, share, most = rng.choice([((5, 2, 1), 1.5, 2.0), ((1,), 1.0, 3.0), ((8, 0.5), 2.5, 2.5), ((1, 2), 4.0, 2.0)])
    df = spark.createDataFrame([(f"{i:03}", s) for i, s in enumerate(sizes)], "label string, source_size long")
    found = {r.label: r.target for r in mixing.targets(df, weights, share, most).collect()}
    want = water(sizes, [weights[i % len(weights)] for i in range(len(sizes))], min(share, most), most)
    assert [found[f"{i:03}"] for i in range(len(sizes))] == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_taken_is_the_target(spark):
    rng = random.Random(1)
    docs = table(spark, [(i, "x " * rng.randint(0, 40), rng.choice("aaaaab") + "c") for i in range(500)])
    by = {}
    for r in mixing.mix(docs).collect():
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(want - got) <= 0.5 for want, got in by.values()) and len(by) == 2


def test_epochs_give_the_words_taken(spark):
    rng = random.Random(2)
    docs = table(spark, [(i, "".join(rng.choice(["wörd", "x", "\t", " ", "  \n", " "]) for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", None])) for i in range(200)])
    mixed = mixing.mix(docs, texts=True)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    words, whole = {}, {r.doc_id: r.text for r in docs.collect()}
    for r in mixing.epochs(mixed).collect():
        assert whole[r.doc_id].startswith(r.text) and len([w for w in r.text.replace(" ", "_").split()]) == r.words
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
    assert words == {k: v for k, v in taken.items() if v}


def test_empty_tables(spark):
    assert mixing.mix(table(spark, []).limit(0)).count() == 0
    rows = mixing.mix(table(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r.target, r.taken) for r in rows] == [(0.0, 0)] * 2
    assert mixing.epochs(mixing.mix(table(spark, [(1, None, None)]), texts=True)).count() == 0


def test_ranks(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS v", "1 AS part", "2 AS n").repartition(5)
    found = common.ranked(df, F.desc("v")).collect()
    assert len(found) == 1000 and all(r["rank"] == 999 - r.v and r.part == 1 and r.n == 2 for r in found)
