"""Cluster listings and membership tables."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strainlens.functions import hashing
from strainlens.functions import ranking as rk
from strainlens.sources.fasta import _raw

MEMBERSHIP_SCHEMA = "class string, cluster_id bigint, cluster_size bigint, representative string, sequence_id string, is_representative int"
# members per block of a written listing
_BLOCK = 10_000


def read_listing(spark: SparkSession, path) -> DataFrame:
    """Members of a cluster listing: file, cluster id, member id, whether it is
    the representative.

    Lines are read as they are; a task carries the cluster id forward through
    its splits in the order of the scan, and only the last id of every split
    travels further.  A cluster of any size is thus many rows, never one value,
    and lines are neither sorted nor shuffled.
    """
    raw = _raw(spark, path, "\n").withColumn("line", F.trim("value"))
    number = F.regexp_extract("line", r"^>Cluster\s+(\d+)", 1)
    raw = raw.withColumn("_h", F.when(F.length(number) > 0, number.cast("bigint")))
    last = raw.groupBy("file_path", "block").agg(F.max(F.when(F.col("_h").isNotNull(), F.struct("at", "_h")))["_h"].alias("_last"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("file_path", "block", F.last("_last", True).over(before).alias("_carry"))
    member = F.substring_index(F.regexp_extract("line", r"^[^>]*>(.*)$", 1), "...", 1)
    is_member = F.col("_h").isNull() & F.col("line").contains(">") & F.col("line").contains("...")
    lines = raw.select("file", "file_path", "block", "_h", F.when(is_member, member).alias("sequence_id"), F.col("line").endswith("*").alias("is_representative"))
    rows = lines.mapInArrow(_carried, "file string, file_path string, block bigint, _in bigint, sequence_id string, is_representative boolean")
    rows = rows.join(carry, ["file_path", "block"])
    return rows.select("file", "file_path", F.coalesce("_in", "_carry").alias("cluster_id"), "sequence_id", "is_representative")


def _carried(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member lines with the last heading above them in their split, null where the split began inside a cluster."""
    split, held = None, None
    for part in parts:
        heading = part.column("_h")
        path, block = part.column("file_path").dictionary_encode(), part.column("block").to_numpy()
        code = path.indices.to_numpy()
        n = len(block)
        # runs of one split
        first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])))) if n else np.zeros(0, int)
        at = np.where(heading.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1)
        known = np.full(n, -1)
        for i, j in zip(first, [*first[1:], n], strict=True):
            known[i:j] = np.maximum.accumulate(at[i:j])
        found = heading.take(pa.array(np.maximum(known, 0), mask=known < 0)) if n else heading
        if n:
            now = (path.dictionary[int(code[0])].as_py(), int(block[0]))
            if now == split and held is not None:
                end = int(first[1]) if len(first) > 1 else n
                open_ = pa.array((np.arange(n) < end) & (known < 0))
                found = pc.if_else(open_, pa.scalar(held, pa.int64()), found)
            split = (path.dictionary[int(code[-1])].as_py(), int(block[-1]))
            held = found[n - 1].as_py()
        out = pa.RecordBatch.from_arrays([part.column("file"), part.column("file_path"), part.column("block"), found, part.column("sequence_id"), part.column("is_representative")], names=["file", "file_path", "block", "_in", "sequence_id", "is_representative"])
        yield out.filter(out.column("sequence_id").is_valid())


def listing_summary(members: DataFrame, keys=("class",)) -> DataFrame:
    """Size and representative per cluster."""
    return members.groupBy(*keys, "cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.when(F.col("is_representative"), F.col("sequence_id"))).alias("representative"))


def write_listing(members: DataFrame, path: str, cluster: str = "cluster_id", member: str = "sequence_id", partition: str = "class", parts: int | None = None) -> None:
    """Cluster listing text.  A large cluster is written in several blocks with
    the same heading, so no file or task has to hold a whole cluster."""
    # representative first, then in seeded order of the member id
    digest = hashing.seeded_digest(0, member)
    work = members.withColumn("_digest", F.when(F.col("is_representative"), F.lit("0" * 32)).otherwise(digest))
    numbered = rk.with_row_number(work, [partition, cluster], [F.col("_digest"), F.col(member)], "_no")
    numbered = numbered.withColumn("_no", F.col("_no") - 1).withColumn("_chunk", F.expr(f"_no div {_BLOCK}"))
    star = F.when(F.col("is_representative"), F.lit("*")).otherwise(F.lit("at +/99.00%"))
    line = F.concat(F.col("_no").cast("string"), F.lit("\t10nt, >"), F.col(member), F.lit("... "), star)
    body = numbered.select(partition, cluster, "_chunk", F.col("_no").alias("_line"), line.alias("value"))
    heads = numbered.select(partition, cluster, "_chunk").distinct().select(
        partition, cluster, "_chunk", F.lit(-1).cast("bigint").alias("_line"), F.concat(F.lit(">Cluster "), F.col(cluster).cast("string")).alias("value"))
    n = parts or int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = body.unionByName(heads).repartitionByRange(n, partition, cluster, "_chunk").sortWithinPartitions(partition, cluster, "_chunk", "_line")
    rows.select("value", partition).write.mode("overwrite").partitionBy(partition).text(path)


def write_membership(members: DataFrame, path: str) -> None:
    members.select("class", "cluster_id", "cluster_size", "representative", "sequence_id", F.col("is_representative").cast("int")).write.mode(
        "overwrite").option("sep", "\t").option("header", True).csv(path)


def read_membership(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(MEMBERSHIP_SCHEMA).option("sep", "\t").option("header", True).csv(path)

