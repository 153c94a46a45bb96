"""Split tables: long CSV, wide CSV and JSON read into (fold, index, split)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strainlens.functions import ranking as rk

# Accepted split names and column aliases.
SPLIT_NAMES = {"train": "train", "training": "train", "tr": "train", "val": "val", "valid": "val", "validation": "val", "dev": "val",
               "test": "test", "te": "test"}
INDEX_ALIASES = ["index", "idx", "sample_idx", "sample_index"]
SPLIT_ALIASES = ["split", "set", "partition"]
FOLD_ALIASES = ["fold", "fold_id", "cv_fold"]
WIDE_ALIASES = {"train": ["train_idx", "train_indices"], "val": ["val_idx", "valid_idx", "validation_idx"], "test": ["test_idx", "test_indices"]}


def normalise_split(col: Column, strict: bool = True) -> Column:
    """train, val or test from any accepted spelling."""
    key = F.lower(F.trim(col))
    names = F.create_map(*[F.lit(x) for kv in SPLIT_NAMES.items() for x in kv])
    found = F.try_element_at(names, key)
    if not strict:
        return found
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown split value "), F.coalesce(col, F.lit("null")))))


def parse_indices(cell: Column) -> Column:
    """Indices in a cell: a scalar, a list literal, or integers separated by
    commas, semicolons or spaces."""
    bare = F.regexp_replace(F.coalesce(cell.cast("string"), F.lit("")), r"[\[\]()]", " ")
    parts = F.filter(F.split(bare, r"[,;\s]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.coalesce(x.try_cast("bigint"), x.cast("double").cast("bigint")))


def _column(df: DataFrame, names: list[str]) -> str | None:
    lower = {c.strip().lower(): c for c in df.columns}
    return next((lower[n] for n in names if n in lower), None)


def canonical(df: DataFrame) -> DataFrame:
    """(fold, index, split) from a long or wide table under any known aliases."""
    fold, split, index = _column(df, FOLD_ALIASES), _column(df, SPLIT_ALIASES), _column(df, INDEX_ALIASES)
    name = F.col(f"`{fold}`").cast("string") if fold else F.lit("holdout")
    if split and index:
        return df.select(name.alias("fold"), normalise_split(F.col(f"`{split}`")).alias("split"), F.explode(parse_indices(F.col(f"`{index}`"))).alias("index")).select(
            "fold", "index", "split")
    cells = {s: _column(df, names) for s, names in WIDE_ALIASES.items()}
    if cells["train"] and cells["val"]:
        parts = [F.struct(F.lit(s).alias("split"), (parse_indices(F.col(f"`{c}`")) if not df.schema[c].dataType.typeName() == "array"
                                                    else F.col(f"`{c}`").cast("array<bigint>")).alias("cell")) for s, c in cells.items() if c]
        rows = df.select(name.alias("fold"), F.explode(F.array(*parts)).alias("p"))
        return rows.select("fold", F.explode("p.cell").alias("index"), F.col("p.split").alias("split"))
    raise ValueError("expected long columns (index, split[, fold]) or wide columns (train_idx, val_idx[, test_idx])")


def read_split_csv(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    return canonical(spark.read.option("header", True).option("sep", sep).csv(path))


_LISTS = "train_idx array<bigint>, val_idx array<bigint>, test_idx array<bigint>"
# most indices of one cell of a written split table
CELL = 10_000


def read_split_json(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """A JSON list of folds, an object with ``folds``, or one fold object.

    With ``lines`` every line is a fold object, or a piece of one, as
    :func:`write_split_json` writes them; a file is then read in splits.  The
    other forms are one value per file, which one task has to hold.
    """
    fold = f"fold string, fold_id string, {_LISTS}"
    if lines:
        rows = spark.read.schema(fold).json(path)
    else:
        inner = "fold: string, fold_id: string, train_idx: array<bigint>, val_idx: array<bigint>, test_idx: array<bigint>"
        raw = spark.read.option("multiLine", True).schema(f"{fold}, folds array<struct<{inner}>>").json(path)
        own = F.array(F.struct("fold", "fold_id", "train_idx", "val_idx", "test_idx"))
        rows = raw.select(F.explode(F.coalesce("folds", own)).alias("f")).select("f.*")
    return canonical(rows.withColumn("fold", F.coalesce("fold", "fold_id")).drop("fold_id"))


def write_split_json(splits: DataFrame, path: str, cell: int = CELL) -> None:
    """(fold, index, split) as JSON lines: a line holds at most ``cell`` indices of one fold.

    Rows are numbered inside their fold, so a fold of any size becomes many
    lines and no task holds one.
    """
    numbered = rk.with_row_number(splits.select("fold", "index", "split"), ["fold"], [F.col("index"), F.col("split")], "_no")
    cells = [F.sort_array(F.collect_list(F.when(F.col("split") == s, F.col("index")))).alias(f"{s}_idx") for s in ("train", "val", "test")]
    chunk = F.expr(f"(_no - 1) div {int(cell)}").alias("_chunk")
    numbered.groupBy("fold", chunk).agg(*cells).drop("_chunk").write.mode("overwrite").json(path)
