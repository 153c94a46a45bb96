"""Language-model scores from a hashed maximum-entropy model.

Every token is one of 512 symbols: the most frequent words have their own, the
others share groups by hash.  A symbol is a class and a member of it, and the
model is a softmax over classes times a softmax over the members of the class
(class-factored).  Features are the previous word, the two previous words, the
word before the previous one (a skip) and a constant, hashed into rows of
weights.  Inside a group, words follow their smoothed counts, and one unknown
word has a place, so probabilities of all words sum to one.

Training starts from the shares of the symbols.  In each round every task
starts from the shared weights, takes mini-batch gradient steps over all its
training texts, and returns the change of each row of weights it touched; the change of a row is the mean over the
tasks that touched it, taken by an ordinary aggregation.  The model's size is
fixed (2 x 65 536 rows), so it may be broadcast.  Changes are shuffled as packed blocks
of rows, one record per task and block.

Counts cover all training texts.  Words with more than 2^-20 of all tokens, at
most 2^20 by arithmetic, are broadcast with their counts; the rarer ones meet
their counts in a join in which no key can be hot.

Defined results: null and empty texts are the end token alone; a null id
counts as training; rows are scored one by one, also repeated ones; empty
tables give none; other columns are not read.  Words are told apart by 64-bit
hashes.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strainlens import session
from strainlens.llm import batches

CLASSES, MEMBERS, GROUPS = 16, 32, 32
OWN = CLASSES * MEMBERS - GROUPS
ROWS = 1 << 16
FEATURES = 4
STEP = 0.25
BATCH = 2048
ROUNDS = 1
HEAD_BITS = 20
# rows of weights in one packed record of changes
BLOCK = 1024
SMOOTHING = 0.1
END = np.uint64(0x5D0F3A6C91E7B248)

COUNT = T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])
DELTA = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("rows", T.BinaryType()), T.StructField("values", T.BinaryType())])
PARTIAL = T.StructType([T.StructField(n, t) for n, t in (
    ("row_no", T.LongType()), ("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("word", T.LongType()), ("n", T.LongType()),
    ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("model", T.DoubleType()))])


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text followed by the end token, and the text of each."""
    w = batches.words(batches.pack(texts), lower=True)
    code = np.insert(w.code, w.first[1:], END)
    return code, np.insert(w.text, w.first[1:], np.arange(len(texts)))


# ------------------------------------------------------------------ counts

def count_words(rows: DataFrame) -> DataFrame:
    """``word``, ``n`` over training texts."""
    arrow = to_arrow_schema(COUNT)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            word = np.concatenate([x[0] for x in held])
            n = np.concatenate([x[1] for x in held])
            word, at = np.unique(word, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(batches.as_long(word)), pa.array(np.bincount(at, weights=n).astype(np.int64))], schema=arrow)

        for whole in parts:
            for part, texts in batches.slices(whole, "text"):
                keep = [x for d, x in zip(part.column("doc_id").to_pylist(), texts, strict=True) if not held_out(d)]
                if keep:
                    held.append(np.unique(tokens(keep)[0], return_counts=True))
                    size += len(held[-1][0])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(run, COUNT).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Totals, the head words in order of hash with their counts and symbols, and the sizes of groups."""

    total: int
    distinct: int
    word: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    group_tokens: np.ndarray
    group_words: np.ndarray

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 outside the head) and symbol of words."""
        if not len(self.word):
            return np.zeros(len(words), np.int64), OWN + _group(words)
        at = np.minimum(np.searchsorted(self.word, words), len(self.word) - 1)
        ok = self.word[at] == words
        return np.where(ok, self.count[at], 0), np.where(ok, self.symbol[at], OWN + _group(words))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + SMOOTHING) / (self.total + SMOOTHING * (self.distinct + 1)))

    def leaf_norm(self, symbol: np.ndarray) -> np.ndarray:
        """log10 of the smoothed size of a group; 0 for words with a symbol of their own."""
        g = np.maximum(symbol - OWN, 0)
        return np.where(symbol >= OWN, np.log10(self.group_tokens[g] + SMOOTHING * (self.group_words[g] + 1)), 0.0)


def _group(words: np.ndarray) -> np.ndarray:
    return (batches.mix(words) % np.uint64(GROUPS)).astype(np.int64)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From a stored count table: totals and the head, at most 2^20 words whatever the corpus."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = counts.where(F.col("n") * F.lit(float(1 << HEAD_BITS)) > F.lit(float(total))).toArrow()
    word = head["word"].to_numpy().astype(np.int64).view(np.uint64)
    n = head["n"].to_numpy().astype(np.int64)
    order = np.lexsort((word, -n))
    symbol = OWN + _group(word)
    # frequent words are dealt to classes in turn, so that classes weigh about the same
    symbol[order[:OWN]] = np.arange(min(OWN, len(order)))
    by = np.argsort(word)
    word, n, symbol = word[by], n[by], symbol[by]
    # groups: every word, less those with a symbol of their own
    def size(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        g = _group(part.column("word").to_numpy().view(np.uint64))
        return np.bincount(g, weights=part.column("n").to_numpy(), minlength=GROUPS), np.bincount(g, minlength=GROUPS)

    def sizes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_, words_ = np.zeros(GROUPS), np.zeros(GROUPS, np.int64)
        for part in parts:
            t, w = size(part)
            tokens_, words_ = tokens_ + t, words_ + w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS)), pa.array(tokens_.astype(np.int64)), pa.array(words_)], names=["g", "t", "w"])

    group_tokens, group_words = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for r in counts.select("word", "n").mapInArrow(sizes, "g long, t long, w long").groupBy("g").agg(F.sum("t").alias("t"), F.sum("w").alias("w")).collect():
        group_tokens[r.g], group_words[r.g] = r.t, r.w
    own = symbol < OWN
    group_tokens -= np.bincount(_group(word[own]), weights=n[own], minlength=GROUPS).astype(np.int64)
    group_words -= np.bincount(_group(word[own]), minlength=GROUPS)
    return Vocabulary(int(total), int(distinct), word, n, symbol, group_tokens, group_words)


# ------------------------------------------------------------------- model

def feature_rows(code: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows of weights of each token's features; words before the text's first are END."""
    def back(k: int) -> np.ndarray:
        out = np.full(len(code), END)
        out[k:] = np.where(text[k:] == text[:len(text) - k], code[:len(code) - k], END) if len(code) > k else out[k:]
        return out

    one, two = back(1), back(2)
    rows = np.empty((FEATURES, len(code)), np.int64)
    for i, h in enumerate((one, one * np.uint64(0x9E3779B97F4A7C15) + two, two + np.uint64(0x51ED270B7F4A7C15))):
        rows[i] = (batches.mix(h + np.uint64(i)) % np.uint64(ROWS - 1)).astype(np.int64)
    rows[3] = ROWS - 1
    return rows


def _class_rows(rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Rows of the second softmax: one for each feature and class, hashed; the constant has one per class."""
    hashed = (batches.mix(rows.astype(np.uint64) * np.uint64(CLASSES) + cls.astype(np.uint64) + np.uint64(7 << 40)) % np.uint64(ROWS - CLASSES)).astype(np.int64)
    hashed[3] = ROWS - CLASSES + cls
    return hashed


def _sums(weights: np.ndarray, rows: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Sum of the hashed features' weights and the constant's, less the greatest of each token."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:-1]:
        z += weights.take(r, axis=0)
    z += constant
    z -= z.max(axis=1, keepdims=True)
    return z


def split_symbol(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return symbol % CLASSES, symbol // CLASSES


def _halves(first: np.ndarray, second: np.ndarray, rows: np.ndarray, symbol: np.ndarray):
    """Weights, rows, constant and target of both softmaxes."""
    cls, member = split_symbol(symbol)
    return (first, rows, first[ROWS - 1], cls), (second, _class_rows(rows, cls), second[ROWS - CLASSES:].take(cls, axis=0), member)


def log10_symbols(first: np.ndarray, second: np.ndarray, rows: np.ndarray, symbol: np.ndarray, block: int = 4096) -> np.ndarray:
    """log10 P(class) + log10 P(member of the class)."""
    out = np.zeros(len(symbol))
    for i in range(0, len(symbol), block):
        at = np.arange(len(symbol[i:i + block]))
        for weights, r, constant, target in _halves(first, second, rows[:, i:i + block], symbol[i:i + block]):
            z = _sums(weights, r, constant)
            own = z[at, target]
            out[i:i + block] += own - np.log(np.exp(z, out=z).sum(axis=1))
    return out / math.log(10)


def _by_row(at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of weights and the sum of the tokens' gradients over each."""
    flat = at.ravel().astype(np.uint16)  # row numbers have 16 bits, which sort by radix
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    begin = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    times = np.diff(begin, append=len(flat))
    each = p.take(order % len(p), axis=0)
    gradient = each.take(begin, axis=0)
    more = times > 1
    if more.any():
        size = times[more]
        gradient[more] = np.add.reduceat(each[np.repeat(more, times)], np.cumsum(size) - size, axis=0)
    return flat[begin].astype(np.int64), gradient


def _step(weights: np.ndarray, seen: np.ndarray, row: np.ndarray, gradient: np.ndarray) -> None:
    squares = seen.take(row) + np.einsum("ij,ij->i", gradient, gradient)
    seen[row] = squares
    weights[row] = weights.take(row, axis=0) - (STEP / np.sqrt(squares + np.float32(1e-6)))[:, None] * gradient


def learn(first: np.ndarray, second: np.ndarray, squares: tuple[np.ndarray, np.ndarray], rows: np.ndarray, symbol: np.ndarray) -> None:
    """Gradient steps over mini-batches, in place; a row's step falls with the squares it has seen."""
    for i in range(0, len(symbol), BATCH):
        for (weights, r, constant, target), seen in zip(_halves(first, second, rows[:, i:i + BATCH], symbol[i:i + BATCH]), squares, strict=True):
            p = np.exp(_sums(weights, r, constant))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), target] -= 1
            # the constant has one row, or one per class, and is summed by itself
            row = np.unique(r[-1])
            constant = (row[:, None] == r[-1]).astype(np.float32) @ p
            for at, gradient in (_by_row(r[:-1], p), (row, constant)):
                _step(weights, seen, at, gradient)


def prior(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the constant feature alone, which give every symbol its share of the training tokens."""
    seen = np.full(CLASSES * MEMBERS, SMOOTHING)
    own = v.symbol < OWN
    seen[v.symbol[own]] += v.count[own]
    seen[OWN:] += v.group_tokens
    cls, member = split_symbol(np.arange(len(seen)))
    first, second = np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, MEMBERS), np.float32)
    first[ROWS - 1] = np.log(np.bincount(cls, weights=seen))
    second[ROWS - CLASSES + cls, member] = np.log(seen)
    return first, second


def packed(base: int, row: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    """Changes of rows, in order, as one record per block of ``BLOCK`` rows."""
    at = row + base
    edge = np.flatnonzero(np.diff(at // BLOCK)) + 1
    parts = list(zip(np.split(at.astype(np.int32), edge), np.split(change.astype(np.float32), edge), strict=True))
    arrow = to_arrow_schema(DELTA)
    return pa.RecordBatch.from_arrays([
        pa.array([int(a[0]) // BLOCK for a, _ in parts], pa.int32()), pa.array([a.tobytes() for a, _ in parts], pa.binary()),
        pa.array([c.tobytes() for _, c in parts], pa.binary())], schema=arrow)


def mean_changes(deltas: DataFrame) -> DataFrame:
    """Packed blocks again, each row's change the mean over the records that hold it."""
    def mean(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, times, block = None, np.zeros(BLOCK, np.int64), 0
        for part in group:
            for block, at, change in zip(part["block"].to_pylist(), part["rows"].to_pylist(), part["values"].to_pylist(), strict=True):
                at = np.frombuffer(at, np.int32) % BLOCK
                change = np.frombuffer(change, np.float32).reshape(len(at), -1)
                total = np.zeros((BLOCK, change.shape[1])) if total is None else total
                total[at] += change
                times[at] += 1
        held = np.flatnonzero(times)
        yield packed(block * BLOCK, held, total[held] / times[held][:, None])

    return deltas.groupBy("block").applyInArrow(mean, DELTA)


def train(rows: DataFrame, vocab, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both softmaxes after rounds of distributed gradient steps."""
    weights = prior(vocab.value)
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        start = context.broadcast(weights)

        def run(parts: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            first, second = (w.copy() for w in start.value)
            squares = (np.zeros(ROWS, np.float32), np.zeros(ROWS, np.float32))
            for whole in parts:
                for part, texts in batches.slices(whole, "text"):
                    keep = [x for d, x in zip(part.column("doc_id").to_pylist(), texts, strict=True) if not held_out(d)]
                    if keep:
                        code, text = tokens(keep)
                        learn(first, second, squares, feature_rows(code, text), vocab.value.find(code)[1])
            for base, now, old, seen in ((0, first, start.value[0], squares[0]), (ROWS, second, start.value[1], squares[1])):
                touched = np.flatnonzero(seen)
                if len(touched):
                    yield packed(base, touched, now[touched] - old[touched])

        for r in mean_changes(rows.mapInArrow(run, DELTA)).toLocalIterator():
            at = np.frombuffer(r["rows"], np.int32)
            table = weights[0] if r["block"] * BLOCK < ROWS else weights[1]
            table[at % ROWS] += np.frombuffer(r["values"], np.float32).reshape(len(at), -1)
        start.unpersist()
    return weights


# ------------------------------------------------------------------ scores

def _score(vocab, weights):
    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        v, (first, second) = vocab.value, weights.value
        ids = part.column("doc_id").to_pylist()
        code, text = tokens(texts)
        n = len(texts)
        distinct, at = np.unique(code, return_inverse=True)
        head_count, head_symbol = v.find(distinct)
        count, symbol = head_count[at], head_symbol[at]
        known = count > 0
        leaf = np.where((symbol >= OWN) & known, np.log10(count + SMOOTHING), 0.0) - v.leaf_norm(head_symbol)[at]
        add = lambda x: np.bincount(text, weights=x, minlength=n)
        base = add(np.where(known, v.base(head_count)[at], 0.0))
        model = add(log10_symbols(first, second, feature_rows(code, text), symbol) + leaf)
        # rarer words meet their counts in a join
        rare = np.flatnonzero(~known)
        order = rare[np.lexsort((code[rare], text[rare]))]
        new = np.flatnonzero(np.concatenate(([True], (code[order][1:] != code[order][:-1]) | (text[order][1:] != text[order][:-1])))) if len(order) else order
        times = np.diff(np.concatenate((new, [len(order)]))) if len(order) else order
        who, m = text[order][new], len(new)
        row_no = part.column("row_no").to_numpy()
        pad = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])
        tail = lambda x, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array(x, kind)])
        return {
            "row_no": np.concatenate((row_no, row_no[who])), "doc_id": pad(ids, pa.int64()), "held_out": pad([held_out(d) for d in ids], pa.bool_()),
            "word": tail(batches.as_long(code[order][new]), pa.int64()), "n": tail(times, pa.int64()), "n_tokens": pad(np.bincount(text, minlength=n), pa.int64()),
            "n_known": pad(add(known).astype(np.int64), pa.int64()), "base": pad(base, pa.float64()), "model": pad(model, pa.float64()),
        }

    return work


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counts = session.cut_lineage(count_words(rows), "counts")
    found = vocabulary(counts)
    vocab = context.broadcast(found)
    weights = context.broadcast(train(rows, vocab, rounds))
    numbered = rows.withColumn("row_no", F.monotonically_increasing_id())
    partial = session.cut_lineage(batches.map_slices(numbered, "text", PARTIAL, _score(vocab, weights)), "partial")
    # an unknown word has count 0; the head's words never come here
    tail = partial.where("word IS NOT NULL").select("row_no", "word", "n").join(counts.withColumnRenamed("n", "c"), "word", "left").select("row_no", "n", F.coalesce("c", F.lit(0)).alias("c"))
    norm = found.total + SMOOTHING * (found.distinct + 1)
    tail = tail.groupBy("row_no").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + SMOOTHING)).alias("logs"), F.sum("n").alias("rare"))
    out = partial.where("word IS NULL").join(tail, "row_no", "left")
    logs, rare = F.coalesce("logs", F.lit(0.0)), F.coalesce("rare", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(found.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - rare * math.log10(norm) if norm else F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))
