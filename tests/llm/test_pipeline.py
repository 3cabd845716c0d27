import importlib.util
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from aerolith.llm import common, decontaminate, near_duplicates, quality, toxicity  # noqa: E402

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(common.written(stage(spark, held[-1], SF)))
    return held


def test_stages(spark, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "decontamination", "encoding"]
    docs = stages[0]
    for before, after in zip(stages, stages[1:-1]):
        assert after.schema.names == docs.schema.names and 0 < after.count() < before.count()
        assert after.exceptAll(before).count() == 0
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"]
    assert stages[-1].count() == stages[-2].count()


def test_decisions(spark, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    good = [i for i in ids[0] if i in labels and labels[i].quality == 1]
    assert sum(i in ids[1] for i in good) >= 0.98 * len(good)
    clean = [i for i in ids[1] if i in labels and labels[i].toxic == 0]
    assert sum(i in ids[2] for i in clean) >= 0.97 * len(clean)
    classes = {r.doc_id: r.component_id for r in near_duplicates.classes(stages[2], similarity=0.8).collect()}
    assert ids[3] == set(classes.values())
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids[4] == ids[3] - {r.doc_id for r in decontaminate.contaminated(stages[3], bench).collect()}


def test_run_is_the_stages(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[-1].collect())


def test_odd_documents(spark):
    rows = [(1, None, "a", 1), (1, None, "a", 1), (2, "", "b", 2), (None, "a text of some words without an id", None, None), (3, "x" * 100_000, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, _score int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "score", "_score"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_thresholds():
    assert quality.THRESHOLD == 0.3 and toxicity.THRESHOLD == 0.5


def test_cluster_without_checkpoint_folder(tmp_path):
    """On a cluster where spark.checkpoint.dir is unset, tables go to the warehouse, which driver and executors share."""
    home = tmp_path / "home"
    for d in (home / "work", tmp_path / "conf"):
        d.mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map={{"spark.ui.enabled": "false", "spark.executor.memory": "800m", "spark.driver.host": "127.0.0.1",
    "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": "{tmp_path}/warehouse", "spark.local.dir": "{tmp_path}/local"}}).getOrCreate()
import corpus_pipeline
docs = spark.read.parquet("{SMALL}/documents.parquet")
kept = corpus_pipeline.toxicity_filter(spark, docs, "{SMALL}").count()
print("kept", kept, spark.conf.get("spark.checkpoint.dir", None), [x.name for x in __import__("pathlib").Path("{tmp_path}/warehouse").iterdir()])
"""
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_CONF_DIR": str(tmp_path / "conf"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYSPARK_DRIVER_PYTHON": sys.executable}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS", "SPARK_ENV_LOADED")}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = next((x for x in done.stdout.splitlines() if x.startswith("kept")), done.stderr[-2000:])
    assert re.fullmatch(r"kept [1-9]\d* None \['aerolith-\w+'\]", said), said
