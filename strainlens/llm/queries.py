"""Registered queries of the ten operators, and their SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainlens.llm import bbit_minhash, best_fit, html_text, jaccard_tiles, licence_scan, maxent, prefix_trie, repetition, secret_scan, suffix_dedup, tiling, tool_calls, whitening

# words of the shingles that op8_near_duplicates is asked for
OP8_SHINGLE_WORDS = 4
# shingles and similarity that op12_jaccard_tiles is asked for
OP12_SHINGLE_WORDS, OP12_PERCENT = 3, 90
# schema of the tool that op3 makes of a user's turn
REPLY_SCHEMA = '{"type":"object","required":["text","turn"],"additionalProperties":false,"properties":{"text":{"type":"string","minLength":1},"turn":{"type":"integer","minimum":0},"after":{"type":["null","object"]}}}'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file() -> tuple[str, str]:
    """Ranks of the byte-level vocabulary of ``byte_bpe_50k.json`` and its split pattern; the default of a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages).select("page_id", "url", "main.text", "main.n_chars")


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")


# how many turns later the call stands that a user's turn names, by (conv_id + turn / 2) mod 5: later ones, chains of later ones, earlier ones, none
AFTER = {0: 2, 2: 4, 3: -2, 4: 2}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """User turns as calls of the tool "reply", the next assistant turn as the result; four of five calls name another call of the conversation."""
    call = F.col("role") == "user"
    at = F.when(call, F.col("turn")).when(F.col("role") == "assistant", F.col("turn") - 1)
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    rest, step = F.pmod(F.col("conv_id") + F.expr("turn div 2"), F.lit(5)), F.lit(None).cast("long")
    for k, n in AFTER.items():
        step = F.when(rest == k, F.lit(n).cast("long")).otherwise(step)
    after = F.when(step.isNotNull(), F.struct(name(F.col("turn") + step).alias("$ref")))
    return conversations.select(
        "conv_id", "turn", F.when(call, "call").when(F.col("role") == "assistant", "result").otherwise("message").alias("kind"), name(at).alias("call_id"), F.when(call, "reply").alias("name"),
        F.when(call, F.to_json(F.struct("text", "turn", after.alias("after")), {"ignoreNullFields": "false"})).otherwise(F.col("text")).alias("body"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame([("reply", REPLY_SCHEMA)], "name string, schema string")
    out = tool_calls.format_calls(tool_messages(table(spark, sf_dir, "conversations")), schemas)
    return out.select("conv_id", "turn", "kind", "call_id", "order_turn", "order_depth", "status", F.size("errors").cast("long").alias("n_errors"), F.md5(F.col("json").cast("binary")).alias("json_md5"))


def op4_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.matches(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=OP8_SHINGLE_WORDS)


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary_file()).drop("row_no")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_sample(docs)))
    # one argument only: Spark would fill a second one with the place in the array
    of_kind = lambda k: F.filter("secrets", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)]
    base = secret_scan.listed(F.filter("secrets", lambda s: s["kind"] < 3))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tiles.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), size=OP12_SHINGLE_WORDS, percent=OP12_PERCENT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_main_text, op2_repetition, op3_tool_calls, op4_tiling, op5_suffix_dedup, op6_maxent, op7_licences, op8_near_duplicates, op9_best_fit, op10_secrets, op11_prefix_trie, op12_jaccard_tiles, op13_whitening, pipeline)}

_WORD = r"[^\x20\x09-\x0D]+"


def _op2_sql() -> str:
    parts = []
    for n in repetition.NGRAM_LIMITS:
        parts.append(f"""g{n} AS (
  SELECT c.doc_id, sum(length(x.w))::BIGINT AS chars, count(*)::BIGINT AS n_words
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS twins FROM (
      SELECT doc_id, i, array_to_string(list_slice(l, i, i + {n - 1}), chr(32)) AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - {n - 2})) AS i FROM lists)))
    WHERE twins > 1) c JOIN words x ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY c.doc_id)""")
    shares = ", ".join(f"coalesce(g{n}.chars, 0)" for n in repetition.NGRAM_LIMITS)
    joins = " ".join(f"LEFT JOIN g{n} USING (doc_id)" for n in repetition.NGRAM_LIMITS)
    bad = " OR ".join(f"100 * ngram_chars[{i + 1}] > {limit} * word_chars" for i, limit in enumerate(repetition.NGRAM_LIMITS.values()))
    return f"""
WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS l FROM documents),
words AS (SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM lists),
lines AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END)::BIGINT AS n_dup_lines, sum(CASE WHEN k > 1 THEN chars ELSE 0 END)::BIGINT AS dup_line_chars
  FROM (SELECT doc_id, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k
        FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
        WHERE regexp_matches(line, '{_WORD}'))
  GROUP BY doc_id),
{", ".join(parts)},
base AS (
  SELECT d.doc_id, len(t.l)::BIGINT AS n_words, coalesce(length(array_to_string(t.l, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, coalesce(g5.n_words, 0)::BIGINT AS n_repeat_words, [{shares}]::BIGINT[] AS ngram_chars
  FROM documents d JOIN lists t USING (doc_id) LEFT JOIN lines USING (doc_id) {joins})
SELECT *, (n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.BASE_LIMIT} * n_words) AS base_failed,
  NOT (n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.BASE_LIMIT} * n_words)
  AND NOT (100 * n_dup_lines > {repetition.LINE_LIMIT} * n_lines OR 100 * dup_line_chars > {repetition.LINE_CHAR_LIMIT} * word_chars OR {bad}) AS kept
FROM base"""


_OP3_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN 'c' || conv_id || '-' || turn WHEN 'assistant' THEN 'c' || conv_id || '-' || (turn - 1) END AS call_id,
    CASE WHEN role = 'user' THEN 'c' || conv_id || '-' || (turn + CASE (conv_id + turn // 2) % 5 WHEN 0 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN -2 WHEN 4 THEN 2 END) END AS ref
  FROM conversations),
i AS (SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS c, min(turn) FILTER (kind = 'result') AS r FROM m WHERE call_id IS NOT NULL GROUP BY ALL),
e AS (SELECT conv_id, r AS node, c AS need FROM i WHERE r IS NOT NULL AND c IS NOT NULL UNION SELECT m.conv_id, m.turn, coalesce(i.r, i.c) FROM m JOIN i ON i.conv_id = m.conv_id AND i.call_id = m.ref),
reach AS (SELECT * FROM e UNION SELECT reach.conv_id, reach.node, e.need FROM reach JOIN e ON e.conv_id = reach.conv_id AND e.node = reach.need),
w AS (SELECT conv_id, node, max(need) AS wait FROM reach GROUP BY ALL HAVING max(need) >= node),
inside AS (SELECT e.conv_id, e.node, e.need FROM e JOIN w a ON a.conv_id = e.conv_id AND a.node = e.node JOIN w b ON b.conv_id = e.conv_id AND b.node = e.need AND a.wait = b.wait),
layer AS (SELECT conv_id, node, 1 AS depth FROM w UNION SELECT l.conv_id, x.node, l.depth + 1 FROM layer l JOIN inside x ON x.conv_id = l.conv_id AND x.need = l.node),
o AS (SELECT w.conv_id, w.node, wait, max(depth) AS depth FROM w JOIN layer l ON l.conv_id = w.conv_id AND l.node = w.node GROUP BY ALL),
n AS (
  SELECT m.*, i.c IS NOT NULL AS called, i.r IS NOT NULL AS answered, m.ref IS NOT NULL AND t.c IS NULL AS lost, o.wait, o.depth
  FROM m LEFT JOIN i ON i.conv_id = m.conv_id AND i.call_id = m.call_id LEFT JOIN i t ON t.conv_id = m.conv_id AND t.call_id = m.ref LEFT JOIN o ON o.conv_id = m.conv_id AND o.node = m.turn)
SELECT conv_id, turn, kind, call_id, coalesce(wait, turn) AS order_turn, coalesce(depth, 0) AS order_depth,
  CASE WHEN kind = 'message' THEN 'message' WHEN kind = 'result' AND NOT called THEN 'orphan' WHEN kind = 'call' AND text = '' THEN 'invalid' WHEN lost THEN 'unknown_reference'
    WHEN kind = 'call' AND NOT answered THEN 'unanswered' ELSE 'linked' END AS status,
  CASE WHEN kind = 'call' AND text = '' THEN 1 ELSE 0 END::BIGINT AS n_errors,
  md5(CASE kind WHEN 'call' THEN '{"arguments":{"after":' || CASE WHEN ref IS NULL THEN 'null' ELSE '{"$ref":"' || ref || '"}' END || ',"text":' || to_json(text)::VARCHAR || ',"turn":' || turn || '},"id":"' || call_id || '","name":"reply","type":"call"}'
    WHEN 'result' THEN '{"content":' || to_json(text)::VARCHAR || ',"id":"' || call_id || '","type":"result"}'
    ELSE '{"content":' || to_json(text)::VARCHAR || ',"type":"message"}' END) AS json_md5
FROM n"""

_OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49)) AS i FROM d)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
  SELECT doc_id, i, sum(CASE WHEN i - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS p FROM c)) GROUP BY doc_id, k),
g AS (SELECT doc_id, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed FROM r GROUP BY doc_id),
k AS (SELECT r.doc_id, a AS pos, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))::BIGINT) AS s FROM r JOIN d ON d.doc_id = r.doc_id
  UNION ALL SELECT d.doc_id, d.n_bytes + 1, substr(h, 2 * coalesce(e.b, 0) + 1) FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM r GROUP BY doc_id) e ON e.doc_id = d.doc_id)
SELECT d.doc_id, d.n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(x.s)) AS kept_sha256
FROM d JOIN (SELECT doc_id, string_agg(s, '' ORDER BY pos) AS s FROM k GROUP BY doc_id) x ON x.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id"""

def _groups_sql(size: int, percent: int, last: str) -> str:
    """Components of the documents linked by their sets of shingles."""
    return rf"""
WITH RECURSIVE lists AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS l FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(l, i, i + {size - 1}), chr(32)) AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - {size - 2}, CASE WHEN len(l) > 0 THEN 2 ELSE 1 END))) AS i FROM lists)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * k >= {percent} * (na.n + nb.n - k)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id{last}
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id"""


# CRC-32 of the decimal id, bit by bit
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda k, i: xor(k >> 1, 3988292384 * (k & 1)))), 4294967295)"

_OP11_SQL = rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos,
    md5(coalesce(role, '')) || md5(coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '{prefix_trie.WORD}')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, count(*) AS n, {_CRC} % {prefix_trie.OPENING} AS h, conv_id - conv_id % {prefix_trie.FAMILY} AS f FROM t GROUP BY conv_id),
r AS (
  SELECT h.conv_id, t.pos AS d, t.k, t.words FROM h JOIN t ON t.conv_id = h.f AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, t.pos - h.h + least(h.h, coalesce(g.n, 0)), t.k, t.words FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h LEFT JOIN h g ON g.conv_id = h.f),
l AS (SELECT conv_id, list(k ORDER BY d) AS ks, list(words ORDER BY d) AS ws FROM r GROUP BY conv_id),
c AS (SELECT h.conv_id, coalesce(len(ks), 0) AS n, ks, ws FROM h LEFT JOIN l USING (conv_id)),
p AS (SELECT conv_id, n, d, coalesce(array_to_string(list_slice(ks, 1, d), ''), '') AS key, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM c)),
e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM p WHERE d = n GROUP BY key),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY key, d),
ch AS (SELECT left(key, length(key) - 64) AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch USING (key)),
s AS (SELECT a.key, sum((b.n_convs - 1) * b.words) AS saved, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM x a JOIN x b ON starts_with(b.key, a.key) GROUP BY a.key)
SELECT x.conv_id, x.d::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM x JOIN s USING (key) LEFT JOIN e USING (key) LEFT JOIN n u ON x.d > 0 AND u.key = left(x.key, length(x.key) - 64)"""


def _op7_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(name)}, {quote(text)})" for i, (name, text) in enumerate(licence_scan.TEMPLATES))
    t = licence_scan.THRESHOLD
    words = lambda x: f"[w FOR w IN string_split({x}, ' ') IF w <> '']"
    grams = "list_distinct([l[i] || ' ' || l[i + 1] FOR i IN range(1, len(l))])"
    piece = r"regexp_replace(text, '([.;:])[ \t]+', '\1' || chr(10), 'g')"
    norm = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9\\n]+', ' ', 'g')"
    return f"""
WITH t AS (SELECT template, licence, {grams} AS g FROM (SELECT template, licence, {words("replace(" + norm("text") + ", chr(10), ' ')")} AS l FROM (VALUES {values}) v(template, licence, text))),
n AS (SELECT doc_id, text, {norm("text")} AS s FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 'whole' AS unit, 0 AS line, -1 AS own, replace(s, chr(10), ' ') AS s FROM n
  UNION ALL SELECT doc_id, 'line', unnest(range(1, len(x) + 1)), -1, unnest(x) FROM (SELECT doc_id, string_split(s, chr(10)) AS x FROM n WHERE contains(s, chr(10)))),
tg AS (SELECT template, licence, len(g) AS k, unnest(g) AS gram FROM t),
pc AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS s FROM (SELECT doc_id, string_split({norm(piece)}, chr(10)) AS x FROM n)),
pg AS (SELECT doc_id, i, s, {grams} AS g FROM (SELECT doc_id, i, s, {words("s")} AS l FROM pc)),
hit AS (SELECT doc_id, i, s, template FROM (SELECT doc_id, i, s, len(g) AS k, unnest(g) AS gram FROM pg) x JOIN tg ON tg.gram = x.gram GROUP BY doc_id, i, s, template, x.k HAVING 2 * count(*) >= x.k),
runs AS (SELECT doc_id, template, min(i) AS line, string_agg(s, ' ' ORDER BY i) AS s FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, template ORDER BY i) AS r FROM hit) GROUP BY doc_id, template, r),
au AS (SELECT * FROM u UNION ALL SELECT doc_id, 'passage', line, template, s FROM runs),
b AS (SELECT doc_id, unit, line, own, {grams} AS g FROM (SELECT doc_id, unit, line, own, {words("s")} AS l FROM au)),
bg AS (SELECT doc_id, unit, line, own, len(g) AS k, unnest(g) AS gram FROM b),
c AS (SELECT bg.doc_id, bg.unit, bg.line, tg.template, tg.licence, count(*) AS n_shared, 2.0::DOUBLE * count(*) / (any_value(bg.k) + any_value(tg.k)) AS dice
  FROM bg JOIN tg ON bg.gram = tg.gram WHERE bg.own IN (-1, tg.template) GROUP BY bg.doc_id, bg.unit, bg.line, bg.own, tg.template, tg.licence)
SELECT doc_id, unit, line::INTEGER AS line, licence, n_shared, dice FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit, line ORDER BY dice DESC, licence, template) AS r FROM c WHERE dice >= {t}) WHERE r = 1"""


ORACLE = {"op2_repetition": _op2_sql(), "op3_tool_calls": _OP3_SQL, "op5_suffix_dedup": _OP5_SQL, "op7_licences": _op7_sql(), "op8_near_duplicates": _groups_sql(OP8_SHINGLE_WORDS, bbit_minhash.SIMILARITY_PERCENT, ", r.c = d.doc_id AS kept"), "op11_prefix_trie": _OP11_SQL,
          "op12_jaccard_tiles": _groups_sql(OP12_SHINGLE_WORDS, OP12_PERCENT, "")}
