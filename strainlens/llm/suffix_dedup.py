"""Removal of repeated byte strings by suffix sorting in two stages.

A byte goes when it lies in a string of ``length`` bytes that also starts in a
text with a smaller id.  Every window of that length belongs to its smallest
24-byte gram (by hash, leftmost on ties), so equal windows belong to equal
grams.  A text becomes fragments, runs of windows with one gram.  Texts are
dealt to groups by a hash, and:

1. each group tells, as 48-bit codes, which grams it holds; a bucket of codes
   answers with one bit per code, whether another group or text has the gram
   too.  Fragments of other grams need not be looked at further;
2. the rest is dealt to buckets by gram.  In a bucket, distinct fragments form
   one text.  Suffixes smaller than their successor are sorted directly, the
   others induced by scanning the buckets of first bytes in order; adjacent
   common prefixes then give the groups of equal windows, and each group its
   smallest id;
3. an occurrence is covered where that id is smaller than its own.  Covered
   ranges return to the groups of texts.

The groups of texts are shuffled once and read three times.  Hot fragments are
combined before the shuffle: within a group of texts only the smallest id of
equal fragments is sent, as the others are covered already.  Fragments travel
as compressed blocks, one per group and bucket.

Defined results: null and empty texts have no bytes; texts shorter than
``length`` keep all; rows with one id never cover each other; a null id covers
nothing and loses nothing; empty tables give none; other columns are not read.
Fragments count as equal when length and 64-bit hash are.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strainlens.llm import batches

LENGTH = 50
GRAM = 24
_CHUNK = 1_500_000
_SORT_BYTES = 4_000_000
_POSITION = np.uint64((1 << 24) - 1)

BLOCK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("covers", T.BooleanType()), T.StructField("block", T.BinaryType())])
RESULT = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.BinaryType()))])
_ARROW_BLOCK = to_arrow_schema(BLOCK)


# ---------------------------------------------------------------- fragments

def fragments(t: batches.Texts, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and place of the gram of every fragment, in order."""
    size = len(t.data)
    steps = np.zeros(size + 1, np.int8)
    long = t.last - t.first >= length
    np.add.at(steps, t.first[long], 1)
    np.add.at(steps, t.last[long] - length + 1, -1)
    valid = np.cumsum(steps[:-1], dtype=np.int8) > 0
    span = length - GRAM + 1
    starts, ends, grams = [], [], []
    for origin in range(0, size, _CHUNK):
        n = min(_CHUNK, size - origin - length + 1)
        if n <= 0:
            break
        data = t.data[origin:origin + n + length - 1]
        up, down = batches._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(batches._BYTE[data] * up[:len(data)], out=sums[1:])
        key = (sums[GRAM:] - sums[:-GRAM]) * down[:len(sums) - GRAM]
        key = batches.mix(key) & ~_POSITION | np.arange(len(key), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if span > width:
            key = np.minimum(key[:len(key) - (span - width)], key[span - width:])
        gram = (key & _POSITION).astype(np.int64)
        ok = valid[origin:origin + n]
        edge = np.ones(n, bool)
        edge[1:] = (gram[1:n] != gram[:n - 1]) | ~ok[:-1]
        at = np.flatnonzero(edge & ok)
        # a fragment ends before the next one begins, or where windows stop being valid
        stop = np.flatnonzero(np.concatenate((edge[1:] | ~ok[1:], [True])) & ok)
        starts.append(at + origin)
        ends.append(stop + origin + length)
        grams.append(gram[at] + origin)
    if not starts:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(grams)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of the spans, one after the other."""
    offset = np.cumsum(size) - size
    return data[np.repeat(start - offset, size) + np.arange(int(size.sum()))]


def _merge(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges per row."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    # rows are shifted apart, so that one running maximum serves all
    number = np.concatenate(([0], np.cumsum(row[1:] != row[:-1])))
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * wide)
    new = np.concatenate(([True], (start + number * wide)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(row)])) - 1
    return row[first], start[first], reach[last] - number[first] * wide


_CODEC = pa.Codec("zstd", compression_level=3)


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [np.array([len(arrays)] + [len(a) for a in arrays], "<i8").tobytes(), "".join(a.dtype.char for a in arrays).encode()]
    raw = b"".join(parts + [np.ascontiguousarray(a).tobytes() for a in arrays])
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(block: bytes) -> list[np.ndarray]:
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    at, out = 8 + 8 * n + n, []
    for kind, size in zip(raw[8 + 8 * n:at].decode(), sizes, strict=True):
        out.append(np.frombuffer(raw, np.dtype(kind), int(size), at))
        at += out[-1].nbytes
    return out


def _range_blocks(row: np.ndarray, start: np.ndarray, end: np.ndarray, n_texts: int) -> Iterator[tuple[int, bool, bytes]]:
    row, start, end = _merge(row, start, end)
    place = (row % n_texts).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cut = np.flatnonzero(np.diff(place[order])) + 1
    for part in np.split(order, cut) if len(order) else ():
        yield int(place[part[0]]), True, _pack(row[part], start[part], end[part] - start[part])


@dataclass
class _Group:
    """The fragments of one group of texts and the codes of their grams."""

    t: batches.Texts
    ids: np.ndarray
    keys: np.ndarray
    start: np.ndarray
    end: np.ndarray
    gram: np.ndarray
    owner: np.ndarray
    bucket: np.ndarray
    code: np.ndarray


def _group(table: pa.Table, length: int, n_buckets: int) -> _Group:
    table = table.filter(pa.compute.is_valid(table.column("doc_id")))
    t = batches.pack([x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()])
    start, end, gram = fragments(t, length)
    hashes = batches.span_hashes(t.data, gram, gram + GRAM)
    ids, keys = (table.column(c).to_numpy() for c in ("doc_id", "row_key"))
    return _Group(t, ids, keys, start, end, gram, t.owner(start), (hashes % np.uint64(n_buckets)).astype(np.int64), hashes >> np.uint64(16))


def _catalogue(g: _Group) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes by bucket: bucket, code, whether several ids have it; and the entry of each fragment."""
    order = np.argsort(g.code, kind="stable")
    order = order[np.argsort(g.bucket[order].astype(np.uint16 if g.bucket.max() < 65536 else np.int64), kind="stable")]
    bucket, code, ids = g.bucket[order], g.code[order], g.ids[g.owner[order]]
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])))
    begin = np.flatnonzero(new)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return bucket[begin], code[begin], np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin), entry


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    edge = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(edge, edge[1:], strict=False):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def _block_table(blocks: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*blocks, strict=True), _ARROW_BLOCK, strict=True)] if blocks else [pa.array([], f.type) for f in _ARROW_BLOCK], schema=_ARROW_BLOCK)


def _tell(length: int, n_buckets: int):
    """Step 1: the grams of a group of texts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        g = _group(table, length, n_buckets)
        blocks = []
        if len(g.start):
            bucket, code, many, _ = _catalogue(g)
            for b, at in _by_bucket(bucket):
                # differences of sorted codes, byte by byte, since their upper bytes are zero
                step = np.diff(code[at], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                blocks.append((b, False, _pack(np.array([key[0].as_py()]), np.ascontiguousarray(step.T).ravel(), np.packbits(many[at]))))
        return _block_table(blocks)

    return run


def _answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: one bit per gram of every group, whether it is shared."""
    for bucket, held in _buckets(parts):
        cols = [_unpack(b) for b in held]
        codes, flags, sizes = [], [], []
        for c in cols:
            step = np.zeros((len(c[1]) // 6, 8), np.uint8)
            step[:, :6] = c[1].reshape(6, -1).T
            codes.append(np.cumsum(step.view("<u8").ravel(), dtype=np.uint64))
            sizes.append(len(codes[-1]))
            flags.append(np.unpackbits(c[2], count=sizes[-1]).astype(bool))
        code, many = np.concatenate(codes), np.concatenate(flags)
        order = np.argsort(code, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
        size = np.diff(np.concatenate((begin, [len(order)])))
        shared = np.empty(len(code), bool)
        shared[order] = np.repeat((size > 1) | np.logical_or.reduceat(many[order], begin), size)
        blocks = [(int(c[0][0]), False, _pack(np.array([bucket]), np.packbits(part))) for c, part in zip(cols, np.split(shared, np.cumsum(sizes)[:-1]), strict=True)]
        yield from _block_table(blocks).to_batches()


def _send(length: int, n_buckets: int, n_texts: int):
    """Step 2: blocks of shared fragments by bucket, and of ranges covered within the group."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        g = _group(table, length, n_buckets)
        if not len(g.start):
            return _block_table([])
        bucket, _, _, entry = _catalogue(g)
        shared = np.zeros(len(bucket), bool)
        place = dict(_by_bucket(bucket))
        for block in answers.column("block"):
            b, bits = _unpack(block.as_py())
            at = place[int(b[0])]
            shared[at] = np.unpackbits(bits, count=at.stop - at.start).astype(bool)
        keep = shared[entry]
        start, end, gram, owner, bucket = (x[keep] for x in (g.start, g.end, g.gram, g.owner, g.bucket))
        if not len(start):
            return _block_table([])
        same = batches.span_hashes(g.t.data, start, end)
        order = np.lexsort((g.ids[owner], same))
        lead = np.concatenate(([True], same[order][1:] != same[order][:-1]))
        least = np.empty(len(start), np.int64)
        least[order] = g.ids[owner][order][lead][np.cumsum(lead) - 1]
        inside = least < g.ids[owner]
        first = g.t.first[owner]
        blocks = list(_range_blocks(g.keys[owner[inside]], (start - first)[inside], (end - first)[inside], n_texts))
        order = np.flatnonzero(~inside)
        order = order[np.argsort(bucket[order], kind="stable")]
        for b, at in _by_bucket(bucket[order]):
            one = order[at]
            rows, row = np.unique(owner[one], return_inverse=True)
            size = end[one] - start[one]
            step = np.diff((start - first)[one], prepend=0)
            blocks.append((b, False, _pack(g.ids[rows], g.keys[rows], row.astype(np.uint16 if len(rows) < 65536 else np.uint32), step.astype(np.int64 if len(g.t.data) > 1 << 30 else np.int32), size.astype(np.uint8), (gram[one] - start[one]).astype(np.uint8), _gather(g.t.data, start[one], size))))
        return _block_table(blocks)

    return run


def _buckets(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of each bucket from rows in order of bucket."""
    bucket, held = None, []
    for part in parts:
        for b, block in zip(part.column("bucket").to_pylist(), part.column("block"), strict=True):
            if b != bucket and held:
                yield bucket, held
                held = []
            bucket = b
            held.append(block.as_py())
    if held:
        yield bucket, held


# ------------------------------------------------------- suffix sorting

def _keys8(text: np.ndarray) -> np.ndarray:
    """Eight bytes from every place as one number, zero beyond the end."""
    wide = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | wide[j:j + len(text)]
    return out


def suffix_order(text: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least."""
    n = len(text)
    # type: smaller than the successor, decided where a run of one byte ends
    differs = np.concatenate((text[1:] != text[:-1], [True]))
    place = np.where(differs, np.arange(n), n - 1)
    run_end = np.minimum.accumulate(place[::-1])[::-1]
    after = np.concatenate((text, [0]))[run_end + 1]
    small = (text < after) & (run_end < n - 1)

    # stage 1: direct sort, eight bytes at a time, only among ties
    direct = np.flatnonzero(small)
    direct = direct[np.argsort(key[direct], kind="stable")]
    group = np.concatenate(([0], np.cumsum(key[direct][1:] != key[direct][:-1]))) if len(direct) else direct
    done = 8
    padded = np.concatenate((key, np.zeros(depth + 8, np.uint64)))
    while done < depth and len(direct):
        tied = np.concatenate((group[1:] == group[:-1], [False]))
        tied[1:] |= tied[:-1].copy()
        at = np.flatnonzero(tied)
        if not len(at):
            break
        k = padded[direct[at] + done]
        order = np.lexsort((k, group[at]))
        direct[at] = direct[at][order]
        k = k[order]
        new = np.zeros(len(direct), np.int64)
        new[at[1:]] = (k[1:] != k[:-1]) & (group[at][1:] == group[at][:-1])
        group = group * 1 + np.cumsum(new)
        done += 8

    # stage 2: the others, induced bucket by bucket of the first byte
    ends = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    if n and not small[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))

    def place_before(found: np.ndarray, c: int) -> np.ndarray:
        """Hands the larger predecessors to their buckets; returns those in this one."""
        before = found[found > 0] - 1
        first = text[before]
        larger = before[first > c]
        byte = text[larger]
        order = np.argsort(byte, kind="stable")
        for one in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1) if len(order) else ():
            induced[byte[one[0]]].append(larger[one])
        return before[first == c]

    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = place_before(wave, c)
        own = direct[ends[c]:ends[c + 1]]
        if len(own):
            out.append(own)
            place_before(own, c)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def window_minima(parts: np.ndarray, size: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every fragment: the fragment, and the smallest id of equal windows.

    ``parts`` holds the fragments one after the other, ``least`` an id for each.
    """
    n = len(size)
    text = np.full(len(parts) + n, 255, np.uint8)  # 255 occurs in no UTF-8 text and ends each fragment
    first = np.cumsum(size + 1) - size - 1
    text[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(parts))] = parts
    key = _keys8(text)
    order = suffix_order(text, key, length + 6)
    count = size - length + 1
    part = np.repeat(np.arange(n), count)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    window = np.full(len(text), -1, np.int64)
    window[at] = np.arange(len(at))
    order = order[window[order] >= 0]
    equal = np.ones(max(len(order) - 1, 0), bool)
    for step in [*range(0, length - 8, 8), length - 8]:
        still = np.flatnonzero(equal)
        equal[still] = key[order[still] + step] == key[order[still + 1] + step]
    begin = np.concatenate(([0], np.flatnonzero(~equal) + 1))
    ids = least[part[window[order]]]
    smallest = np.minimum.reduceat(ids, begin)
    out = np.empty(len(at), np.int64)
    out[window[order]] = np.repeat(smallest, np.diff(np.concatenate((begin, [len(order)]))))
    return part, out


def _shared(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Entries whose hash occurs with two ids or more."""
    order = np.argsort(hashes, kind="stable")
    begin = np.concatenate(([0], np.flatnonzero(np.diff(hashes[order])) + 1))
    many = np.minimum.reduceat(ids[order], begin) < np.maximum.reduceat(ids[order], begin)
    out = np.empty(len(ids), bool)
    out[order] = np.repeat(many, np.diff(np.concatenate((begin, [len(ids)]))))
    return out


def decide(blocks: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered ranges (row key, first byte, end) of a bucket's fragments."""
    cols = [_unpack(b) for b in blocks]
    ids = np.concatenate([c[0][c[2]] for c in cols])
    rows = np.concatenate([c[1][c[2]] for c in cols])
    start = np.concatenate([np.cumsum(c[3], dtype=np.int64) for c in cols])
    size, gram = (np.concatenate([c[i] for c in cols]).astype(np.int64) for i in (4, 5))
    data = np.concatenate([c[6] for c in cols])
    del cols
    first = np.cumsum(size) - size
    half = (length - GRAM + 1) // 2
    keep = np.zeros(len(ids), bool)
    for low, high, there in ((first + gram - half, first + gram + GRAM, gram >= half), (first + gram, first + gram + GRAM + half, gram + GRAM + half <= size)):
        at = np.flatnonzero(there)
        if len(at):
            keep[at[_shared(batches.span_hashes(data, low[at], high[at]), ids[at])]] = True
    at = np.flatnonzero(keep)
    none = (np.empty(0, np.int64),) * 3
    if not len(at):
        return none
    anchor = batches.span_hashes(data, first[at] + gram[at], first[at] + gram[at] + GRAM)
    same = batches.span_hashes(data, first[at], first[at] + size[at])
    order = np.lexsort((ids[at], same, anchor))
    at, anchor, same = at[order], anchor[order], same[order]
    lead = np.concatenate(([True], (same[1:] != same[:-1]) | (anchor[1:] != anchor[:-1])))
    number = np.cumsum(lead) - 1
    one = at[lead]
    # grams never match across parts, so the sort takes whole grams up to a size
    fresh = np.flatnonzero(np.concatenate(([True], anchor[lead][1:] != anchor[lead][:-1])))
    total = np.concatenate(([0], np.cumsum(size[one])))
    lows, minima = 0, []
    while lows < len(one):
        far = np.searchsorted(total[fresh], total[lows] + _SORT_BYTES)
        nexts = int(fresh[far]) if far < len(fresh) else len(one)
        pick = one[lows:nexts]
        part, least = window_minima(_gather(data, first[pick], size[pick]), size[pick], ids[pick], length)
        minima.append((part + lows, least))
        lows = nexts
    part, least = (np.concatenate([m[i] for m in minima]) for i in range(2))
    count = size[one] - length + 1
    begin = np.cumsum(count) - count
    # occurrences times their windows
    times = count[number]
    entry = np.repeat(np.arange(len(at)), times)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
    hit = least[begin[number[entry]] + place] < ids[at][entry]
    entry, place = entry[hit], place[hit]
    if not len(entry):
        return none
    edge = np.concatenate(([0], np.flatnonzero(np.diff(entry)) + 1))
    entry_, low, high = entry[edge], place[edge], place[np.concatenate((edge[1:], [len(entry)])) - 1]
    # covered windows of one fragment overlap, so they are one range
    return rows[at[entry_]], start[at[entry_]] + low, start[at[entry_]] + high + length


def _judge(length: int, n_texts: int):
    """Step 3: ranges by group of texts; blocks of ranges pass through."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []

        def open_() -> Iterator[pa.RecordBatch]:
            for part in parts:
                ready.append(part.filter(part.column("covers")))
                yield part.filter(pa.compute.invert(part.column("covers")))

        for _, held in _buckets(open_()):
            yield from _block_table(list(_range_blocks(*decide(held, length), n_texts))).to_batches()
            yield from ready
            ready.clear()
        yield from ready

    return run


# --------------------------------------------------------------- results

def _apply(left: pa.Table, right: pa.Table) -> pa.Table:
    """Texts of one group with the ranges to remove."""
    out = {f.name: [] for f in RESULT}
    ranges = [_unpack(b.as_py()) for b in right.column("block")]
    key, start, size = (np.concatenate([r[i] for r in ranges]) for i in range(3)) if ranges else (np.empty(0, np.int64),) * 3
    key, start, end = _merge(key, start, start + size)
    for doc, row, raw in zip(left.column("doc_id").to_pylist(), left.column("row_key").to_pylist(), left.column("text").cast(pa.binary()).to_pylist(), strict=True):
        raw = raw or b""
        a, b = (np.searchsorted(key, row, side) for side in ("left", "right")) if doc is not None else (0, 0)
        last, kept = 0, []
        for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True):
            kept.append(raw[last:s])
            last = e
        rest = b"".join([*kept, raw[last:]])
        for name, value in zip(out, (doc, len(raw), len(raw) - len(rest), int(b - a), hashlib.sha256(rest).hexdigest(), rest), strict=True):
            out[name].append(value)
    return pa.Table.from_pydict(out, schema=to_arrow_schema(RESULT))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, partitions: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes.

    ``partitions`` (default: the session's shuffle partitions) sets how many
    buckets of fragments and groups of texts there are; both grow with it.
    """
    if not GRAM + 8 <= length <= 120:
        raise ValueError("length must be 32 to 120")
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets, n_texts = n, 2 * n
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    groups = rows.withColumn("bucket", F.expr(f"CAST(pmod(row_key, {n_texts}) AS INT)")).groupBy("bucket")
    answers = groups.applyInArrow(_tell(length, n_buckets), BLOCK).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, BLOCK)
    send = _send(length, n_buckets, n_texts)
    sent = groups.cogroup(answers.groupBy("bucket")).applyInArrow(lambda a, b: send(a, b), BLOCK)
    # blocks of fragments meet by bucket; blocks of ranges pass through with them
    ranges = sent.repartition("covers", "bucket").sortWithinPartitions("covers", "bucket").mapInArrow(_judge(length, n_texts), BLOCK)
    return groups.cogroup(ranges.groupBy("bucket")).applyInArrow(lambda a, b: _apply(a, b), RESULT)
