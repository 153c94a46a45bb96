"""Scratch tables and the package on the workers."""
import os
import subprocess
import sys

from strainlens import session


def test_scratch_tables_are_deleted(spark):
    root = session.scratch_root(spark).removeprefix("file:")
    own = lambda folder: [x for x in os.listdir(folder) if x.startswith("test-") and x not in before]
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with session.scratch(spark):
        outer = session.cut_lineage(spark.range(3).toDF("a"), "test-outer")
        with session.scratch(spark):
            assert session.cut_lineage(outer.where("a > 0"), "test-inner").count() == 2
        assert [x[:10] for x in own(root)] == ["test-outer"]
        assert outer.count() == 3
    assert own(root) == []


def test_workers_get_the_package(tmp_path):
    """A driver that finds the package by itself, in another folder and without PYTHONPATH."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
print("rows", entry.queries()["a37_sign_flip_exact"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 21" in done.stdout, done.stderr[-2000:]
