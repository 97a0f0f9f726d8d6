"""The operators bound to the given tables."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.lineage import cut
from . import centroid_clusters, conversation_repair, fingerprints, language_id, license_scan, near_dedup, packing, quality_classifier, quality_rules, shingle_join, subwords, toxicity, warc

QUERIES, ORACLE = {}, {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def crc_of(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


@_query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.notices(table(spark, folder, "documents"))


@_query
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    measured = cut(quality_classifier.measure(table(spark, folder, "documents")), "statistics")
    model = quality_classifier.fit(measured, table(spark, folder, "labels"), crc_of("doc_id", 3) != 1)
    held_out = F.coalesce(crc_of("doc_id", 3) == 1, F.lit(False))
    return quality_classifier.with_score(measured, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).drop("url")


ORACLE["op3_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""


@_query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels").where(crc_of("doc_id", 3) != 1))
    held_out = F.coalesce(crc_of("doc_id", 3) == 1, F.lit(False))
    return toxicity.with_score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op6_subwords(spark: SparkSession, folder: str) -> DataFrame:
    drawn = subwords.sample(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return drawn.select("doc_id", "sample", (F.octet_length("pieces") / 4).cast("long").alias("n_pieces"), F.crc32("pieces").alias("ids_crc32"),
                        "log_probability", "perturbed", "log_inclusion", "round_trip")


@_query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(quality_rules.measure_documents(table(spark, folder, "documents")))
    return judged.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
                         "base_failed", "kept")


@_query
def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    classes, _ = near_dedup.near_classes(table(spark, folder, "documents"))
    return classes.select("doc_id", "class_id")


@_query
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.neighbour_likeness(table(spark, folder, "documents"))


@_query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(crc_of("doc_id", 4) != 2))
    return language_id.with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(crc_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        "language.score", "language.ambiguous")


@_query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversation_repair.repair_report(conversation_repair.damage(rows), rows)


def _repair_sql() -> str:
    """The program as a fold over the rows of a conversation; every cell holds cost, audit and repaired lines, so least() breaks ties.

    CRC-32 is folded bit by bit with its polynomial.
    """
    none = "{'c': 1000000000, 'a': '', 'r': ''}"

    def add(cell: str, cost: str, edit: str, line: str = "''") -> str:
        return f"{{'c': {cell}.c + {cost}, 'a': {cell}.a || '{edit}', 'r': {cell}.r || {line}}}"

    def put(cell: str, role: str) -> str:
        return add(cell, "2", "I", f"chr(10) || '{role}:'")

    def keep(cell: str, initial: str) -> str:
        return f"CASE WHEN x.f < 2 AND x.i = '{initial}' THEN {add(cell, 'x.f', 'K', 'chr(10) || x.role || chr(58) || x.text')} ELSE {none} END"

    def rerole(cell: str, role: str) -> str:
        return f"CASE WHEN x.f < 2 THEN {add(cell, '2 + x.f', 'R', f"chr(10) || '{role}:' || x.text")} ELSE {none} END"

    def inserted(base: str) -> str:
        once = f"least({base}.u, {put(f'{base}.n', 'user')}, {put(f'{base}.s', 'user')})"
        return (f"list_transform([{{'b': {base}, 'u': {once}}}], lambda z: {{'n': z.b.n, 's': z.b.s, "
                f"'u': least(z.u, {put('z.b.a', 'user')}), 'a': least(z.b.a, {put('z.u', 'assistant')})}})[1]")

    rows = {"n": add("y.n", "3", "D"),
            "s": f"least({add('y.s', '3', 'D')}, {keep('y.n', 's')})",
            "u": f"least({add('y.u', '3', 'D')}, {', '.join(f(c, w) for c in ('y.n', 'y.s', 'y.a') for f, w in ((keep, 'u'), (rerole, 'user')))})",
            "a": f"least({add('y.a', '3', 'D')}, {keep('y.u', 'a')}, {rerole('y.u', 'assistant')})"}
    step = "list_transform([{" + ", ".join(f"'{c}': {v}" for c, v in rows.items()) + f"}}], lambda b: {inserted('b')})[1]"
    empty = "{'c': 0, 'a': '', 'r': ''}"
    start = f"list_transform([{{'n': {empty}, 's': {none}, 'u': {none}, 'a': {none}}}], lambda b: {inserted('b')})[1]"
    crc = """xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
  lambda ch: CAST(ascii(ch) AS BIGINT)), lambda h, byte: list_reduce(range(8), lambda v, bit: xor(v >> 1, 3988292384 * (v & 1)), xor(h, byte)),
  4294967295), 4294967295)"""
    gap = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS draw FROM conversations),
damaged AS (SELECT conv_id, turn, copy, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
  CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, range(2) t(copy) WHERE draw <> 0 AND (copy = 0 OR draw = 3)),
flagged AS (SELECT *, substr(role, 1, 1) AS i, rtrim(text, {gap}) AS body,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
turns AS (SELECT *, CASE WHEN body = '' THEN 2 WHEN nth > 1 THEN 3 WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS f,
  lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM flagged),
per AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 2) AS blank,
  count(*) FILTER (f = 3) AS duplicate, count(*) FILTER (f = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list_reduce(list({{'i': i, 'f': f, 'role': role, 'text': text}} ORDER BY pos), lambda y, x: {step}, {start}) AS cells FROM turns GROUP BY conv_id),
ends AS (SELECT *, least(cells.n, cells.a) AS best FROM per)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE["op11_conversation_repair"] = _repair_sql()


@_query
def op12_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.join_documents(table(spark, folder, "documents"))[0]


ORACLE["op12_shingle_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
s AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY ALL)
  WHERE 100 * c >= 80 * (na + nb - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, len(d.s) AS n_shingles, r.component_id FROM sets d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id"""


@_query
def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters.cluster_table(table(spark, folder, "embeddings"))


def _clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Every round as two common tables: who is nearest, and where the centroids move."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v AS c FROM v
QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, first(v) AS v, min({{'d': d, 'k': k}}) AS best FROM (
SELECT vec_id, v, k, list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS d FROM v, c{r}) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
SELECT k, list(s ORDER BY i) AS c FROM (SELECT best.k AS k, i, floor(sum(v[i]) / count(*)) AS s FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL)
GROUP BY k) m ON m.k = c{r}.k)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = best.k"""


ORACLE["op13_centroid_clusters"] = _clusters_sql()
