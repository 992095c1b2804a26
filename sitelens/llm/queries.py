"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, divergence, embedding_dedup, jaccard_join, license_scan, line_dedup, packing, pii, piece_viterbi, quality_knn, quality_rules, sharding
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return put


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents WHERE text IS NOT NULL)),
worded AS (
  SELECT doc_id, pos, line, row_number() OVER w - 1 AS k,
         lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(pos) OVER w AS p2, lead(pos, 2) OVER w AS p3
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
found AS (
  SELECT *, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, k) AS nth FROM worded WHERE l3 IS NOT NULL),
cut AS (
  SELECT DISTINCT doc_id, unnest([pos, p2, p3]) AS pos FROM found WHERE nth > 1),
left_over AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS text,
         count(*) FILTER (regexp_matches(l.line, '[^\\x20\\x09-\\x0D]')) AS n_lines, count(c.pos) AS n_removed
  FROM lines l LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text,
       coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN left_over o ON o.doc_id = d.doc_id
"""


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op4_sql() -> str:
    words = "regexp_extract_all({}, '[0-9a-z\\x{{0080}}-\\x{{10FFFF}}]+')"
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS first, '{label}' AS label FROM w, unnest(range(1, len(ws) - {len(p.split()) - 2})) t(i) WHERE ws[i:i + {len(p.split()) - 1}] = {p.split()}"
        for p, label in license_scan.PHRASES.items())
    templates = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))})" for k, (label, t) in enumerate(license_scan.TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, {LOWER_SQL.replace('text', "coalesce(text, '')")} AS low FROM documents),
w AS (SELECT doc_id, {words.format('low')} AS ws FROM d),
p AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(first) AS lo, max(first) AS hi, list(DISTINCT label) AS labels FROM p GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(low, chr(10))) AS line FROM d),
b AS (SELECT doc_id, list_distinct({words.format('line')}) AS block FROM l),
t(k, label, ts) AS (VALUES {templates}),
m AS (SELECT doc_id, label, len(list_intersect(block, ts)) / len(ts) AS share FROM b, t
      WHERE len(list_intersect(block, ts)) >= ceil({license_scan.THRESHOLD} * len(ts) - 1e-9)),
every AS (SELECT doc_id, label, 1.0 AS share FROM p UNION ALL SELECT * FROM m),
found AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM every GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels, coalesce(found.labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


COMPONENTS_SQL = """
reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b),
component AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
nodes AS (SELECT doc_id AS id FROM documents), {COMPONENTS_SQL}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN component c ON c.id = d.doc_id"""

OP9_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
nodes AS (SELECT vec_id AS id FROM embeddings), {COMPONENTS_SQL}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c ON c.id = e.vec_id"""


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({LOWER_SQL.replace('text', "coalesce(text, '')")}, '[a-z\\x{{0080}}-\\x{{10FFFF}}]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_size FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS size FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
        1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // CAST(s.size + v.v AS HUGEINT) AS p,
        1 + CAST(1000000000 AS HUGEINT) * (k.total + 1) // CAST(v.lang_size + v.v AS HUGEINT) AS q
      FROM sizes s JOIN kept k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
divergent AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN divergent x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER_SQL.replace('text', "coalesce(text, '')")}, '[0-9a-z\\x{{0080}}-\\x{{10FFFF}}]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER_SQL.replace('text', "coalesce(text, '')")}, '[0-9a-z\\x{{0080}}-\\x{{10FFFF}}]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(ws[k:k + n - 1], ' ') AS w FROM (
  SELECT item, ws, least(len(ws), {decontaminate.WINDOW}) AS n, unnest(range(1, greatest(len(ws) - {decontaminate.WINDOW - 1}, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
places AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (
  SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hits AS (SELECT p.r, p.i, p.n, win.item FROM places p JOIN win ON win.n = p.n AND win.w = p.w),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN items ON items.r = d.r"""


def _op13_sql() -> str:
    """Least (cost, audit) of each grammar state, turn by turn: cost in 8 digits before the audit, states 0 to 3 (none, system, user, whole pairs)."""
    def put(state: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST({state}[1:8] AS BIGINT) + {cost} AS VARCHAR), 8, '0') || {state}[9:] || '{letter}'"

    def emit(state: str, symbol: str) -> str:
        return f"CASE WHEN fault < 2 THEN CASE WHEN initial = '{symbol}' THEN {put(state, '5 * fault', 'K')} ELSE {put(state, '5 * fault + 1', 'R')} END END"

    two = f"least(s2, {put('s0', '5', 'I')}, {put('s1', '5', 'I')}, {put('s3', '5', 'I')})"
    three = f"least(s3, {put('s2', '5', 'I')}, {put('s0', '10', 'II')}, {put('s1', '10', 'II')})"
    state = {k: f"least({put(x, '2', 'D')}, {more})" for k, x, more in (
        ("s0", "s0", "NULL"), ("s1", "s1", f"CASE WHEN fault < 2 AND initial = 's' THEN {put('s0', '5 * fault', 'K')} END"),
        ("s2", "t2", ", ".join(emit(x, "u") for x in ("s0", "s1", "t3"))), ("s3", "t3", emit("t2", "a")))}
    return f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
  list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(place, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) % 20 AS kind FROM named),
after_damage AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM after_damage)),
turns AS (SELECT conv_id, turn, role, text, i, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 3 WHEN nth > 1 THEN 2
       WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM placed),
counts AS (SELECT c.conv_id, count(t.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
states AS (SELECT conv_id, n, 0 AS i, '00000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM counts
  UNION ALL SELECT conv_id, n, i, {state['s0']}, {state['s1']}, {state['s2']}, {state['s3']}
  FROM (SELECT s.conv_id, s.n, t.i, s0, s1, s3, {two} AS t2, {three} AS t3, fault, initial
        FROM states s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i + 1)),
ended AS (SELECT conv_id, least(s0, {three}) AS best FROM states WHERE i = n),
letters AS (SELECT conv_id, k, best[8 + k] AS letter,
  k - length(replace(replace(replace(best[9:8 + k], 'D', ''), 'K', ''), 'R', '')) AS i,
  length(replace(best[9:7 + k], 'D', '')) AS given FROM (SELECT conv_id, best, unnest(range(1, length(best) - 7)) AS k FROM ended)),
kept AS (SELECT l.conv_id, l.k, letter, given, role, text, max(CASE WHEN given = 0 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
  FROM letters l LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i AND letter <> 'I' WHERE letter <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (given - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS whole
  FROM kept GROUP BY conv_id)
SELECT c.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(best[1:8] AS BIGINT) AS cost, best[9:] AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM counts c JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op1_line_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents")).drop("ids", "place")


@query("op5_jaccard_join", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source", "frac")


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op3_piece_viterbi")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_viterbi.encode_documents(read(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "n_words", F.round("score", 3).alias("score"), "round_trip")


@query("op4_license_scan", _op4_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(read(spark, sf_dir, "documents")))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_embedding_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(read(spark, sf_dir, "embeddings"))


@query("op11_source_divergence", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read(spark, sf_dir, "documents"))


@query("op12_decontaminate", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


@query("op13_conversation_repair", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return conversation_repair.audit_and_hash(conversation_repair.damaged(conversations), conversations).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
