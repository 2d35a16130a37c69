"""Executors need no copy of the package, and scratch folders don't stay."""

import os
import subprocess
import sys

from roadpulse.llm import common
from roadpulse.llm.mixing import mix
from roadpulse.llm.sharding import shard_documents

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's path alone
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
found = spark.range(1, numPartitions=1).mapInPandas(lambda it: (f.assign(id=int(__import__("importlib.util").util.find_spec("roadpulse") is not None)) for f in it), "id long").first()[0]
assert found == 0, "workers see the package"
from roadpulse.llm.embedding_dedup import near_duplicates
from roadpulse.llm.language_id import identify
from roadpulse.llm.topk import top_k
from roadpulse.llm.toxicity import toxicity, without_toxic

docs = spark.createDataFrame([(i, "good words here " * 3 if i % 2 else "bad idiot there " * 3, "a" if i % 2 else "b") for i in range(60)], "doc_id long, text string, lang string")
labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, toxic int")
vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(120)], "vec_id long, embedding array<float>")
print("ROWS", top_k(vectors).count(), near_duplicates(vectors).count(), identify(docs).count(), toxicity(docs, labels).count(), without_toxic(docs, labels).count())
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    said = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 15 120 60 60 60" in said.stdout, said.stderr[-3000:]


def test_scratch_is_deleted(spark):
    since = len(common.OPEN)
    scratch = common.Scratch(spark, "test")
    assert scratch.put(spark.range(3), "rows").count() == 3 and os.path.isdir(scratch.root)
    common.close_scratch(since)
    assert not os.path.exists(scratch.root) and len(common.OPEN) == since


def test_small_tables_start_no_python_workers(spark):
    """Lists given to createDataFrame are read by workers of another kind than those of mapInArrow, which stay idle."""
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('some words ', int(id % 7 + 1)) AS text", "IF(id % 3 = 0, NULL, concat('s', id % 3)) AS source")
    for found in (mix(docs), shard_documents(docs)):
        assert found.count() == 200 and "ExistingRDD" not in found._jdf.queryExecution().toString()
    rows = [(1, "a", 0.5), (None, None, None)]
    assert [tuple(r) for r in common.small(spark, rows, "a long, b string, c double").collect()] == rows
    assert common.small(spark, [], "a long").count() == 0
