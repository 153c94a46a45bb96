"""Prefix trie of conversations, by collapsing whole sequences.

A conversation is rebuilt from the opening of another one and its own later
turns.  Equal rebuilt conversations collapse to one weighted sequence with the
list of conversations that end there.  A sequence that is a proper prefix of
another one is no leaf (anti-join with the prefixes).  Nodes are the distinct
prefixes of the distinct sequences, aggregated with the sequences' weights, so
all counts come from partial sums and neither the root nor a common first turn
gathers its members anywhere.

Sums over subtrees need no walk.  Every node belongs to the sequence of its
smallest member, and what belongs to a sequence is the lower end of its path.
The words of a subtree's nodes are then what belongs to the sequences below,
less the part of the owner's path above the node.  All steps are linear in the
turns, however deep a conversation is.

Prefixes are told apart by 128 bits: the exclusive or of hashes of (place,
role, digest of the text), which runs along a conversation.  Turns are ordered
in runs of 512 turn numbers and places hashed in runs of 512 turns, so a long
conversation is not one window; only turns that share a run's numbers are sorted
together.  End lists are joined in chunks of 1024 ids, and one pass over the
chunks of a sequence, in order, feeds the digest: SHA-256 is serial, but it
holds no list.

Defined results: rows without conv_id belong to no conversation and are left
out; a null turn comes first, a null role or text is empty; rows of equal turn
are ordered by role, then by the md5 of the text; repeated rows are turns of
their own; a conversation without turns is a member of the root alone; an empty
table has no node, not even the root; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from strainlens import session

WORD = r"[^\x20\x09-\x0D]+"
# conversations c - c % FAMILY .. share the opening of the first; openings have fewer than OPENING turns
FAMILY, OPENING = 20, 4
# binary logarithms of a run of turns and of a chunk of ids
RUN_BITS, CHUNK_BITS = 9, 10
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "key_a", "key_b"]

ENDS = T.StructType([T.StructField("depth", T.LongType()), T.StructField("key_a", T.LongType()), T.StructField("key_b", T.LongType()), T.StructField("ends_sha256", T.StringType())])


def opening_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(OPENING))


def _run(number: Column) -> Column:
    """Run of a turn number or place; runs are in the numbers' order, null before all."""
    return F.coalesce(F.shiftright(number, RUN_BITS), F.lit(-(1 << 62)))


def _before(rows: DataFrame, by: str, run: str, sums: dict[str, Column]) -> DataFrame:
    """Aggregates of all earlier runs of the same ``by``, one row per run."""
    per_run = rows.groupBy(by, run).agg(*[c.alias(f"own_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(by).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    total = {n: F.bit_xor(f"own_{n}") if n.startswith("key") else F.sum(f"own_{n}") for n in sums}
    return per_run.select(by, run, *[F.coalesce(t.over(earlier), F.lit(0)).alias(f"past_{n}") for n, t in total.items()])


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place from 1, role, digest of the text and its words, in order of turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _run(F.col("turn").cast("long")).alias("run"), role.alias("role"), F.md5(text.cast("binary")).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    past = _before(turns, "conv_id", "run", {"n": F.count("*")})
    order = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return turns.join(past, ["conv_id", "run"]).select("conv_id", (F.col("past_n") + F.row_number().over(order)).cast("long").alias("place"), "role", "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All turns of the rebuilt conversations (conv_id, depth, length, role, digest, words), and conv_id with its length."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = sizes.select("conv_id", "n", opening_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first_id"))
    first = sizes.select(F.col("conv_id").alias("first_id"), F.col("n").alias("first_n"))
    heads = heads.join(first, "first_id", "left").select("conv_id", "first_id", "h", F.least("h", F.coalesce("first_n", F.lit(0))).alias("taken"), "n")
    heads = heads.select("conv_id", "first_id", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    heads = session.cut_lineage(heads, "heads")
    own = turns.join(heads, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "length", "role", "digest", "words")
    opening = turns.where(F.col("place") < OPENING).withColumnRenamed("conv_id", "first_id")
    taken = heads.join(opening, "first_id").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "length", "role", "digest", "words")
    return own.unionByName(taken), heads.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn the key of the prefix that ends there and of the one before, its words and the words before."""
    one = [F.xxhash64(F.lit(seed), "depth", "role", "digest").alias(f"turn_{k}") for seed, k in ((0x1F0C3, "a"), (0x7A55B, "b"))]
    rows = turns.select("conv_id", "depth", "length", "words", _run(F.col("depth")).alias("run"), *one)
    past = _before(rows, "conv_id", "run", {"key_a": F.bit_xor("turn_a"), "key_b": F.bit_xor("turn_b"), "words": F.sum("words")})
    here = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(past, ["conv_id", "run"])
    keys = [F.col(f"past_key_{k}").bitwiseXOR(F.bit_xor(f"turn_{k}").over(here)).alias(f"key_{k}") for k in "ab"]
    rows = rows.select("conv_id", "depth", "length", "words", (F.col("past_words") + F.sum("words").over(here) - F.col("words")).alias("words_before"), "turn_a", "turn_b", *keys)
    return rows.select("conv_id", *NODE, "length", "words", "words_before", *[F.col(f"key_{k}").bitwiseXOR(F.col(f"turn_{k}")).alias(f"up_{k}") for k in "ab"])


def _digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of key and place to one digest per key; only the running digest is held."""
    arrow = to_arrow_schema(ENDS)
    key, running = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], pa.array([running.hexdigest()])], schema=arrow)

    for part in parts:
        for *now, ids in zip(*[part[c].to_pylist() for c in (*NODE, "ids")], strict=True):
            if now != key:
                if key is not None:
                    yield row()
                key, running = now, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
    if key is not None:
        yield row()


def end_lists(ends: DataFrame) -> DataFrame:
    """Digest of the ascending, comma-joined conv_ids that end at each node."""
    chunks = ends.groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select(*NODE, "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids").mapInArrow(_digest, ENDS)


def trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Intermediate tables are written while the query is built.
    """
    turns, lengths = rebuilt(session.cut_lineage(numbered(conversations), "turns"))
    paths = session.cut_lineage(prefixes(turns), "paths")

    last = paths.where("depth = length").select("conv_id", *NODE, (F.col("words_before") + F.col("words")).alias("total"))
    none = lengths.where("length = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in (*NODE, "total")])
    ends = session.cut_lineage(last.unionByName(none), "ends")
    sequences = session.cut_lineage(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("total").alias("total")), "sequences")
    smallest = sequences.agg(F.min("conv_id")).first()[0]

    # prefixes of the distinct sequences, the root as one of depth 0
    kept = sequences.select("conv_id", "weight", "total")
    root = sequences.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in NODE], F.col("depth").alias("length"), *[F.lit(0).cast("long").alias(c) for c in ("words", "words_before", "up_a", "up_b")], "weight", "total")
    weighted = session.cut_lineage(paths.join(kept, "conv_id").unionByName(root), "weighted")
    nodes = weighted.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * F.col("total")).alias("member_words"),
        *[F.max(c).alias(c) for c in ("words", "words_before", "up_a", "up_b")], F.max(F.col("length") > F.col("depth")).alias("inner"))
    nodes = session.cut_lineage(nodes, "nodes")

    leaves = sequences.join(nodes.where("inner"), NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    owned = nodes.groupBy("conv_id").agg(F.sum("words").alias("owned"))
    known = sequences.select("conv_id", "total").join(owned, "conv_id", "left").join(leaves, "conv_id", "left").select("conv_id", "total", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    known = session.cut_lineage(known, "owners")
    below = weighted.select("conv_id", *NODE).join(known, "conv_id").select(*NODE, "owned", "leaf", F.lit(0).alias("child"))
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("key_a"), F.col("up_b").alias("key_b"), F.lit(0).alias("owned"), F.lit(0).alias("leaf"), F.lit(1).alias("child"))
    sums = below.unionByName(children).groupBy(*NODE).agg(F.sum("owned").alias("below_owned"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children"))

    out = nodes.join(sums, NODE).join(end_lists(ends), NODE, "left").join(known.select("conv_id", "owned", "total"), "conv_id")
    tokens = F.col("member_words") - F.col("n_convs") * F.col("words_before")
    distinct_words = F.col("below_owned") - F.col("owned") + F.col("total") - F.col("words_before")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key_a").alias("up_a"), F.col("key_b").alias("up_b"), F.col("conv_id").alias("parent")).where("depth > 1")
    out = out.select("conv_id", "depth", "up_a", "up_b", "n_convs", "n_children", "n_leaves", (tokens - distinct_words).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    # every first turn has the root as its parent, whose smallest member is that of the table
    parent = F.when(F.col("depth") == 1, F.lit(smallest).cast("long")).otherwise(F.col("parent"))
    out = session.cut_lineage(out, "sums").join(parents, ["depth", "up_a", "up_b"], "left")
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
