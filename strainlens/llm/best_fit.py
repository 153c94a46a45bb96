"""Packing of token pieces into sequences by bounded-space online best fit.

Texts become token ids with an end id; longer ones are cut into pieces of the
capacity from the back, so that only the first piece may be shorter.  The
table of pieces (no ids) is written once, dealt into groups by a hash, and
each group is packed as a stream: a fixed number of bins is open, a bitset
has one bit per free space, and a piece goes to the bin with the least free
space that holds it.  When too many bins are open the fullest closes.

Each group costs at most its open bins at the end, and groups hold a fixed
number of pieces, so the loss does not grow with the input.  Defined results:
a null or empty text is the end id alone; rows with the same id are packed one
by one; tables without rows give none; other columns are not read.
"""
from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strainlens import session
from strainlens.llm import batches

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 1024
GROUP_PIECES = 100_000
CACHE_ENTRIES = 400_000

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "row_no")] + [T.StructField("piece", T.IntegerType())]
                      + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")])
PACKED = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

# fixed values: the token that byte_bpe_50k adds to its ranks; it is found in texts as it stands
ADDED = {"<|endoftext|>": 50256}

# a space that does not begin a word: such texts are encoded whole
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


class Encoder(dict):
    """Ids of a text as little-endian 32-bit bytes.

    The vocabulary never joins text across a space that begins a word, so a
    text is cut there and the ids of each part are kept in this dictionary,
    which starts anew when it is full.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] = ADDED):
        import tiktoken

        self.added = {text: np.array([number], "<u4").tobytes() for text, number in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self.whole(" " + part)
        if len(part) <= 40:
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            return b"".join(self.added.get(part) or self.plain(part) for part in self.cut.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        return self.whole(head) + b"".join(map(self.__getitem__, rest))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, a number of the input row, place and length in its text's ids, crc32 of the ids."""
    tail = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        encoder = _encoder(ranks_path, pattern)
        out = defaultdict(list)
        for doc, row, raw in zip(part.column("doc_id").to_pylist(), part.column("row_no").to_pylist(), texts, strict=True):
            ids = (encoder.ids(raw.decode()) if raw else b"") + tail
            cut = len(ids) % width or min(width, len(ids))
            lo, hi, k = 0, cut, 0
            while lo < len(ids):
                for name, value in (("doc_id", doc), ("row_no", row), ("piece", k), ("start", lo // 4), ("length", (hi - lo) // 4), ("ids_crc32", zlib.crc32(ids[lo:hi]))):
                    out[name].append(value)
                lo, hi, k = hi, hi + width, k + 1
        return out

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.col(text).alias("text"))
    return batches.map_slices(rows, "text", PIECES, work)


def pack_stream(lengths: Iterator[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """Bin number and offset of each length, in order."""
    bits, by_free, n_open, made = 0, [deque() for _ in range(capacity + 1)], 0, 0
    for length in lengths:
        fits = bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_no = by_free[free].popleft()
            if not by_free[free]:
                bits ^= 1 << free
            n_open -= 1
        else:
            bin_no, free, made = made, capacity, made + 1
        yield bin_no, capacity - free
        free -= length
        if free:
            by_free[free].append(bin_no)
            bits |= 1 << free
            n_open += 1
            if n_open > open_bins:
                fullest = (bits & -bits).bit_length() - 1
                by_free[fullest].popleft()
                if not by_free[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1


def pack_table(table: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A stored table of pieces with the sequence and offset of each."""
    groups = max(1, -(-table.count() // group_pieces))
    arrow = to_arrow_schema(PACKED)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packed, lengths = None, None, deque()
        for part in parts:
            own = part.column("pack_group").to_pylist()
            sizes = part.column("length").to_pylist()
            found = []
            for g, size in zip(own, sizes, strict=True):
                if g != group:
                    group, lengths = g, deque()
                    packed = pack_stream(iter(lengths.popleft, None), capacity, open_bins)
                lengths.append(size)
                bin_no, offset = next(packed)
                found.append(((group << 32) + bin_no, offset))
            columns = [part.column(f.name) for f in PIECES] + [pa.array([x[i] for x in found], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    order = F.xxhash64("doc_id", "row_no", "piece")
    dealt = table.withColumn("pack_group", F.pmod(order, F.lit(groups)).cast("long")).withColumn("pack_order", F.xxhash64(order, F.lit(1)))
    return dealt.repartition(groups, "pack_group").sortWithinPartitions("pack_group", "pack_order", "doc_id", "row_no", "piece").mapInArrow(run, PACKED)


def pack(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces of all texts with ``sequence_id`` and ``offset``.

    Ids are made once: the table of pieces is written to the shared folder.
    """
    return pack_table(session.cut_lineage(pieces(docs, ranks_path, pattern, text, doc_id, capacity, end_id), "pieces"), capacity, open_bins)
