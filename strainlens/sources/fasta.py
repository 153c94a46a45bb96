"""FASTA scan and sink, class-per-file collections with a global index."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strainlens.functions.sequence import wrap_fasta
from strainlens.functions.text import first_word, strip
from strainlens.session import cut_lineage

# so many splits (a path and a few numbers each) are sent to all tasks; a larger table is joined as any other
_BROADCAST_SPLITS = 100_000


def _raw(spark: SparkSession, path, separator: str) -> DataFrame:
    """Text rows with their place: file, split offset, order inside the split."""
    return spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def read_fasta(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    """One row per record: header without ``>``, sequence without white space
    in upper case, record id (first word), and the row's place.

    Records are text rows separated by ``\\n>``, so a file is read in splits.
    With ``strict``, a file that has data before its first header, or no record
    at all, raises before anything is returned, for one more pass over the files.
    """
    raw = _raw(spark, path, "\n>")
    # only the first row of a file keeps its ">"; every other row had it cut off
    text = F.regexp_replace("value", "^>", "")
    lines = F.split(text, "\n", 2)
    out = raw.withColumn("header", strip(F.get(lines, F.lit(0)))).withColumn(
        "sequence", F.upper(F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s+", "")))
    out = out.withColumn("record_id", first_word(F.col("header"))).filter(F.length(strip(F.col("value"))) > 0)
    if strict:
        early = [r["file_path"] for r in fasta_problems(out).orderBy("file_path").limit(20).collect()]
        if early:
            raise ValueError(f"data before the first header: {early}")
        none = [r["file_path"] for r in empty_files(spark, path, out).orderBy("file_path").limit(20).collect()]
        if none:
            raise ValueError(f"no FASTA records: {none}")
    return out


def fasta_problems(records: DataFrame) -> DataFrame:
    """Files whose first row has no ``>``: data before the first header."""
    head = F.substring(F.ltrim("value"), 1, 80)
    first = records.filter(F.col("block") == 0).groupBy("file_path").agg(F.min_by(head, "at").alias("starts_with"))
    return first.filter(~F.col("starts_with").startswith(">"))


def empty_files(spark: SparkSession, path, records: DataFrame) -> DataFrame:
    """Files under the path that hold no record; the list is the one by which Spark plans the scan."""
    listed = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file_path string")
    # both sides name files by their address, one with an empty authority
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return listed.join(records.select(plain("file_path").alias("_f")).distinct(), plain("file_path") == F.col("_f"), "left_anti")


def with_global_index(records: DataFrame, files: Sequence[tuple[str, str]], by: str = "file", missing: str = "error",
                      name: str = "index") -> DataFrame:
    """Class from the file and a contiguous 0-based index over the collection.

    ``files`` lists (file, class) in order.  Rows of a split are numbered by
    their place in the scan, so the index is the offset of the split plus the
    place less that of the split's first record: two passes and a prefix sum
    over splits (one row per 128 MB); records are neither ordered nor grouped.
    Where blank rows left gaps, those of the split before a record are counted.
    """
    spark = records.sparkSession
    dim = spark.createDataFrame([(f, c, i) for i, (f, c) in enumerate(files)], f"{by} string, class string, file_order int")
    rows = records.join(F.broadcast(dim), by)  # literal list of files
    split = ["file_path", "block"]
    per = rows.groupBy("file_order", *split).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("_first"), F.max("at").alias("_last"))
    per = cut_lineage(per, "splits")
    if missing == "error":
        found = [r[0] for r in per.select("file_order").distinct().collect()]
        gone = [f for i, (f, _) in enumerate(files) if i not in found]
        if gone:
            raise FileNotFoundError(f"missing FASTA files: {gone}")
    order = Window.orderBy("file_order", *split).rowsBetween(Window.unboundedPreceding, -1)
    sparse = per.filter(F.col("_last") - F.col("_first") + 1 > F.col("n")).select(*split, "_first", "_last")
    # bounded by the rows of a split
    kept = rows.select(*split, "at").join(sparse, split).groupBy(*split, "_first", "_last").agg(F.collect_list("at").alias("_at"))
    gaps = kept.select(*split, F.array_except(F.sequence("_first", "_last"), "_at").alias("_gaps"))
    offsets = per.select(*split, (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("_first")).alias("_off")).join(gaps, split, "left")
    offsets = cut_lineage(offsets, "split-offsets")
    if per.count() <= _BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    before = F.size(F.filter("_gaps", lambda g: g < F.col("at")))
    place = F.col("at") + F.col("_off") - F.when(F.col("_gaps").isNull(), 0).otherwise(before)
    return rows.join(offsets, split).withColumn(name, place).drop("_off", "_gaps")


def write_fasta(df: DataFrame, path: str, header: str = "header", sequence: str = "sequence", partition: str | None = None, width: int = 80) -> None:
    """Records wrapped at ``width`` columns, one folder per partition value."""
    text = wrap_fasta(F.col(header), F.col(sequence), width).alias("value")
    if partition is None:
        df.select(text).write.mode("overwrite").text(path)
    else:
        df.select(text, partition).write.mode("overwrite").partitionBy(partition).text(path)
