"""Secret scans by fixed patterns and character Markov models, in Spark expressions only.

Three patterns give the base spans.  Beyond them, every token of 6 or more
letters, digits and +/_=- is scored by two first-order character models, one of
random strings and one of ordinary tokens; a token whose log-likelihood ratio
per transition is above a margin, and in total above the prior odds, is a
further span.  The models are trained from labelled samples by counting
transitions; rare ones fall back on the shares of single characters, to whose
counts one is added.  Ordinary tokens are those outside base spans, with their
digits, underscores, slashes and hyphens, and a fixed set of numbers; a
transition from or to a separator never speaks for a random string.

Spans come from ``split`` and ``regexp_extract_all``: the pieces between the
matches and the matches themselves give places in code points.  One pass
without a shuffle; the trained model is a table of fixed size (69 x 69).

Defined results: null and empty texts have no spans; repeated rows are scanned
one by one; other columns pass through, and a clash with the added struct's
name is an error; without any labelled row both models are uniform and nothing
is added by ``train``.
"""
from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6
KINDS = ("assign", "access", "hex", "markov")

# tokens that the models score
CANDIDATE = r"[A-Za-z0-9+/_=-]{6,}"
# ordinary tokens of the labelled sample: the same characters
ORDINARY = r"[A-Za-z0-9+/_=-]{3,}"
MARGIN = 0.5
# least log-likelihood ratio of a whole token: one random token in a million is expected beforehand
EVIDENCE = math.log(1e6)
# weight of the shares of single characters in a row of transitions
BACKOFF = 10.0
# labelled rows come from about this many documents, spread over the table by a hash
SAMPLE_DOCS = 20_000

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
_STATES = len(_ALPHABET) + 1
_JOINTS = {_ALPHABET.index(c) + 1 for c in "+/_.=-"}


# entries of an array that one inner pass handles; running values are taken in two levels
BLOCK = 128


def _blocks(rows: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` entries."""
    starts = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.transform(starts, lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))


def _running(blocks: Column, zero: Column, step) -> Column:
    """Value before each block of a running ``step(value, entry)``."""
    def add(acc: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, acc["at"], step).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    return F.aggregate(blocks, F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out")), add, lambda acc: acc["out"])


def _flat_zip(blocks: Column, before: Column, zero_out: Column, step) -> Column:
    """One array of what ``step`` collects in each block; ``step`` takes and returns a struct of ``at`` and ``out``."""
    return F.flatten(F.zip_with(blocks, before, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), zero_out.alias("out")), step, lambda acc: acc["out"])))


_NO_SPANS = "CAST(array() AS array<struct<start:int,kind:int,end:int,value:string>>)"


def _located(df: DataFrame, text: str, name: str, wanted: list[tuple], keep=None) -> DataFrame:
    """``df`` with a column ``{name}_k`` of spans (start, kind, end, value) for the k-th of ``wanted``: kind, pattern, group, least length.

    The pieces between matches and the matches give places.  Every step is a
    column of its own that the next one uses more than once, so that nothing is
    computed again for each match.  ``keep`` judges a value before it is a span.
    """
    plain, t = list(df.columns), F.col(text)
    empty = F.expr("CAST(array() AS array<string>)")
    tag = lambda x, k: f"{name}_{x}{k}"
    for_each = list(enumerate(wanted))
    df = df.select("*", *[F.when(t.rlike(p), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(empty).alias(tag("whole", k)) for k, (_, p, _, _) in for_each])

    def steps(k: int, pattern: str, group: int | None) -> Column:
        whole = F.col(tag("whole", k))
        value = whole if group is None else F.when(F.size(whole) > 0, F.regexp_extract_all(t, F.lit(pattern), F.lit(group))).otherwise(empty)
        pieces = F.when(F.size(whole) > 0, F.split(t, pattern, -1)).otherwise(empty)
        rows = F.arrays_zip(pieces.alias("piece"), whole.alias("found"), value.alias("value"))
        return F.transform(F.slice(rows, 1, F.size(whole)), lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.length(x["found"]).alias("size"), x["value"].alias("value")))

    df = df.select("*", *[steps(k, p, g).alias(tag("steps", k)) for k, (_, p, g, _) in for_each])
    df = df.select("*", *[_blocks(F.col(tag("steps", k))).alias(tag("blocks", k)) for k, _ in for_each])
    df = df.select("*", *[_running(F.col(tag("blocks", k)), F.lit(0), lambda at, x: at + x["gap"] + x["size"]).alias(tag("before", k)) for k, _ in for_each])

    def spans(k: int, kind: str, least: int) -> Column:
        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + x["size"]).alias("end"), x["value"].alias("value"))
            good = F.length(x["value"]) >= least if keep is None else keep(x["value"])
            return F.struct((start + x["size"]).alias("at"), F.when(good, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.coalesce(_flat_zip(F.col(tag("blocks", k)), F.col(tag("before", k)), F.expr(_NO_SPANS), add), F.expr(_NO_SPANS))

    return df.select(*[F.col(f"`{c}`") for c in plain], *[spans(k, kind, least).alias(f"{name}_{k}") for k, (kind, _, _, least) in for_each])


_BASE = [("assign", ASSIGN, 2, ASSIGN_MIN), ("access", ACCESS, None, 0), ("hex", HEX, None, 0)]


def _free(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` begins with, in any case."""
    taken = [c.lower() for c in df.columns]
    return [next(x for x in (f"{n}{'_' * i}" for i in range(1, len(taken) + 2)) if not any(t.startswith(x) for t in taken)) for n in names]


def base_spans(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the base spans of all kinds, by start, then kind."""
    held, = _free(df, "base")
    plain = [F.col(f"`{c}`") for c in df.columns]
    found = _located(df.select("*", F.coalesce(text, F.lit("")).alias(f"{held}text")), f"{held}text", held, _BASE)
    return found.select(*plain, F.array_sort(F.concat(*[F.col(f"{held}_{k}") for k in range(len(_BASE))])).alias(out))


def labelled_sample(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled tokens of a hashed sample of rows, equal texts once: values of base spans are random, tokens outside them are ordinary."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.where(F.pmod(F.xxhash64(t), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select(t.alias("text")).distinct()
    random = base_spans(rows, F.col("text"), "found").select(F.explode("found").alias("one")).select(F.col("one.value").alias("token"), F.lit(True).alias("secret"))
    outside = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        outside = F.regexp_replace(outside, pattern, " ")
    plain = rows.select(F.explode(F.regexp_extract_all(outside, F.lit(ORDINARY), F.lit(0))).alias("token"), F.lit(False).alias("secret"))
    # numbers, so that a corpus without any does not make every digit look random
    numbers = docs.sparkSession.range(1000, 10_000, 7).select(F.col("id").cast("string").alias("token"), F.lit(False).alias("secret"))
    return random.unionByName(plain).unionByName(numbers)


def _code(token: Column, i: Column) -> Column:
    return F.instr(F.lit(_ALPHABET), F.substring(token, i, F.lit(1)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every transition, random against ordinary, row by row."""
    steps = F.expr("CASE WHEN length(token) > 1 THEN sequence(1, length(token) - 1) ELSE array() END")
    moves = samples.where("token IS NOT NULL AND secret IS NOT NULL").select("secret", "token", F.explode(steps).alias("i"))
    cells = moves.groupBy("secret", _code(F.col("token"), F.col("i")).alias("a"), _code(F.col("token"), F.col("i") + 1).alias("b")).agg(F.count("*").alias("n")).collect()
    count = {s: [[0.0] * _STATES for _ in range(_STATES)] for s in (True, False)}
    for r in cells:
        count[r.secret][r.a][r.b] += r.n
    logs = {}
    for s, table in count.items():
        second = [1.0 + sum(row[b] for row in table) for b in range(_STATES)]
        share = [x / sum(second) for x in second]
        logs[s] = [[math.log((n + BACKOFF * p) / (sum(row) + BACKOFF)) for n, p in zip(row, share, strict=True)] for row in table]
    ratio = [[x - y for x, y in zip(*rows, strict=True)] for rows in zip(logs[True], logs[False], strict=True)]
    # words are told by what lies between separators: these speak against randomness only
    return [min(0.0, ratio[a][b]) if {a, b} & _JOINTS else ratio[a][b] for a in range(_STATES) for b in range(_STATES)]


# characters are few and ASCII: a table by pairs of their numbers; longer tokens are taken apart once instead of from the start at every step
_ASCII = 128
_SHORT = 128


def _by_ascii(model: list[float]) -> list[float]:
    code = [_ALPHABET.find(chr(i)) + 1 for i in range(_ASCII)]
    return [model[code[a] * _STATES + code[b]] for a in range(_ASCII) for b in range(_ASCII)]


def _ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of the whole token."""
    def step(a: Column, b: Column) -> Column:
        return F.element_at(table, a * _ASCII + b + 1)

    def add(acc: Column, char: Column) -> Column:
        return F.struct(F.ascii(char).alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(step(acc["last"], F.ascii(char)))).alias("sum"))

    at = lambda i: F.ascii(F.substring(token, i, F.lit(1)))
    short = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + step(at(i), at(i + 1)))
    long = F.aggregate(F.split(token, ""), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), add, lambda acc: acc["sum"])
    return F.when(F.length(token) <= _SHORT, short).otherwise(long)


def scan(docs: DataFrame, model: list[float], text: str = "text", out: str = "secrets", margin: float = MARGIN) -> DataFrame:
    """``docs`` with an array ``out`` of (start, kind number, end, value) by start, then kind; further spans do not touch base spans."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out!r} exists already; choose another name")
    table = F.from_json(F.lit(json.dumps(_by_ascii(model))), "array<double>")
    plain = [F.col(f"`{c}`") for c in docs.columns]
    base, more, all_ = _free(docs, "base_spans", "markov", "merged")

    def random(token: Column) -> Column:
        return _ratio(token, table) > F.greatest(F.lit(EVIDENCE), (F.length(token) - 1) * F.lit(margin))

    found = base_spans(docs, F.col(f"`{text}`"), base)
    found = found.select("*", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(f"{more}text"))
    found = _located(found, f"{more}text", more, [("markov", CANDIDATE, None, 0)], random)
    # tokens meet the base spans in order of start: what began before reaches to a running maximum, what begins inside comes next
    found = found.select(*plain, F.array_sort(F.concat(base, f"{more}_0")).alias(all_))
    found = found.select("*", _blocks(F.col(all_)).alias(f"{all_}blocks"))
    reach = lambda at, s: F.when(s["kind"] < 3, F.greatest(at, s["end"])).otherwise(at)
    found = found.select("*", _running(F.col(f"{all_}blocks"), F.lit(0), reach).alias(f"{all_}before"))

    def add(acc: Column, s: Column) -> Column:
        return F.struct(reach(acc["at"], s).alias("at"), F.array_append(acc["out"], (s["kind"] < 3) | (acc["at"] <= s["start"])).alias("out"))

    clear = _flat_zip(F.col(f"{all_}blocks"), F.col(f"{all_}before"), F.expr("CAST(array() AS array<boolean>)"), add)
    nothing = F.lit(1 << 30)
    entries = F.arrays_zip(F.col(all_).alias("span"), F.slice(F.col(all_), 2, F.size(all_)).alias("next"), clear.alias("clear"))
    kept = F.filter(entries, lambda x: (x["span"]["kind"] < 3) | (x["clear"] & (F.when(x["next"]["kind"] < 3, x["next"]["start"]).otherwise(nothing) >= x["span"]["end"])))
    return found.select(*plain, F.transform(F.slice(kept, 1, F.size(all_)), lambda x: x["span"]).alias(out))


def listed(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], text: str = "text", mark: str = "[SECRET]", margin: float = MARGIN) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; touching or overlapping spans become one."""
    spans, t = _free(docs, "spans")[0], F.col(f"`{text}`")
    found = scan(docs, model, text, spans, margin)
    found = found.select("*", _blocks(F.col(spans)).alias(f"{spans}blocks"))
    # a block's spans are cut from the block's own part of the text, so a character is not passed once per span
    found = found.select("*", _running(F.col(f"{spans}blocks"), F.lit(0), lambda at, s: F.greatest(at, s["end"])).alias(f"{spans}from"))

    def block(spans_: Column, start: Column) -> Column:
        part = F.substring(t, start + 1, F.aggregate(spans_, start, lambda at, s: F.greatest(at, s["end"])) - start)

        def cut(acc: Column, s: Column) -> Column:
            fresh = F.concat(acc["out"], F.substring(acc["part"], acc["at"] - start + 1, s["start"] - acc["at"]), F.lit(mark))
            return F.struct(acc["part"].alias("part"), F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

        return F.aggregate(spans_, F.struct(part.alias("part"), start.alias("at"), F.lit("").alias("out")), cut, lambda acc: acc["out"])

    end = F.array_max(F.transform(F.col(spans), lambda s: s["end"]))
    clean = F.concat(F.array_join(F.zip_with(F.col(f"{spans}blocks"), F.col(f"{spans}from"), block), ""), F.substring(t, end + 1, F.length(t)))
    return found.select(*[F.when(F.size(spans) > 0, clean).otherwise(t).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
