"""One query per corpus operator, over the whole of its table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.llm import chat, decontaminate, jaccard, lines, merkle, minhash, mixing, quality, render, resampling, secrets, toxicity, warc
from geoledger.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), base=[quality.FEW_WORDS, quality.REPEATED])


ORACLES["op1_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
f AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(coalesce(text, ''), '[ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(coalesce(text, ''), '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(coalesce(text, ''), '[^!?]+', '', 'g')) AS BIGINT) AS n_marks,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN covered c ON c.doc_id = t.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 10 * word_chars < 25 * n_words OR word_chars > 12 * n_words
            OR 2 * n_upper > word_chars OR 2 * n_marks > n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM b"""


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n_lines, n_dropped = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op3_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) FILTER (WHERE f.owner <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL OR f.owner = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key GROUP BY k.doc_id"""


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


ORACLES["op6_ngram_jaccard"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = t.doc_id) AS component_id,
       (SELECT count(*) FROM e WHERE e.a = t.doc_id) AS n_links
FROM t LEFT JOIN n ON n.doc_id = t.doc_id"""


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    question, answer = decontaminate.split_item(F.col("text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", question.alias("question"), answer.alias("answer"), "text")
    return decontaminate.matches(table(spark, sf_dir, "documents"), items)


@query
def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(rows))


ORACLES["op8_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + length(text) + length(regexp_replace(text, '\\|###|</turn>', '\\\0', 'g')) - length(text) + 8)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        rank = secrets.KINDS.index(kind)
        return F.size(F.filter("base" if kind != "entropy" else "entropy", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    spans = F.sort_array(F.concat("base", "entropy"))
    return found.select(
        "doc_id", *[count(k) for k in secrets.KINDS], F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(spans).alias("spans"))


ORACLES["op2_warc_archive"] = r"""
WITH t AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS first_id FROM t)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d"""


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_pages(table(spark, sf_dir, "pages"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 of a text in SQL: a lambda over its bytes, with the table of the polynomial.
SQL_CRC = r"""
crc AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_concat([i], range(0, 8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(0, 256)) AS i)))"""


def sql_crc(text: str) -> str:
    """SQL for the checksum of `text`, beside the table `crc`."""
    size = f"octet_length(encode({text}))"
    data = f"list_transform(range(0, {size}), lambda j: CAST('0x' || substr(hex(encode({text})), 2 * j + 1, 2) AS BIGINT))"
    step = "xor(a >> 8, crc[1 + (xor(a, b) & 255)])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {data}), lambda a, b: {step}), 4294967295)"


ORACLES["op11_importance_resampling"] = rf"""
WITH {SQL_CRC},
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
dw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
bw AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
b AS MATERIALIZED (SELECT w, {sql_crc("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN b USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN b USING (w) GROUP BY b),
g AS (
  SELECT s.b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
                                  / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON t.b = s.b),
f AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g ON g.b = b.b GROUP BY doc_id),
x AS (
  SELECT d.doc_id, coalesce(f.n, 0) AS n_features, coalesce(f.weight, 0) AS weight,
         coalesce(f.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN f ON f.doc_id = d.doc_id),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, 10 * count(*) OVER () // 100 AS n FROM x WHERE n_features >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN k <= n THEN k END AS rank FROM x LEFT JOIN r ON r.doc_id = x.doc_id"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = merkle.row_digest([F.col(f) for f in fields[:-1]] + [lowered])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed)
    found = merkle.manifest(docs, "doc_id", "lang", fields, own=tampered)
    folded = merkle.fold(F.coalesce("own", "leaf"), F.col("path"))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLES["op12_merkle_manifest"] = rf"""
WITH RECURSIVE {SQL_CRC},
v AS (
  SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
         {sql_crc("doc_id::VARCHAR")} % 3 = 0 AS tampered
  FROM documents, crc),
f AS (
  SELECT doc_id, lang, tampered, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(lowered)) || ':' || lowered, '-')) AS changed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM v),
low AS (
  SELECT lang, 0 AS level, i, leaf AS h, n FROM f
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM low WHERE n > 1 GROUP BY lang, level, i // 8),
sub AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (
  SELECT 0 AS level, i, h, n FROM sub
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, i // 8),
lowp AS (
  SELECT f.doc_id, k.level, coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (WHERE k.i < f.i // CAST(pow(8, k.level) AS BIGINT)), '') AS l,
         coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (WHERE k.i > f.i // CAST(pow(8, k.level) AS BIGINT)), '') AS r
  FROM f JOIN low k ON k.lang IS NOT DISTINCT FROM f.lang AND k.n > 1 AND k.i // 8 = f.i // CAST(pow(8, k.level + 1) AS BIGINT)
  GROUP BY f.doc_id, k.level),
topp AS (
  SELECT sub.lang, k.level, coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (WHERE k.i < sub.i // CAST(pow(8, k.level) AS BIGINT)), '') AS l,
         coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (WHERE k.i > sub.i // CAST(pow(8, k.level) AS BIGINT)), '') AS r
  FROM sub JOIN top k ON k.n > 1 AND k.i // 8 = sub.i // CAST(pow(8, k.level + 1) AS BIGINT)
  GROUP BY sub.lang, k.level),
p AS (
  SELECT doc_id, list(l || '|' || r ORDER BY level) AS path FROM (
    SELECT doc_id, level, l, r FROM lowp
    UNION ALL SELECT f.doc_id, 1000 + level, l, r FROM f JOIN topp ON topp.lang IS NOT DISTINCT FROM f.lang)
  GROUP BY doc_id),
o AS (
  SELECT f.doc_id, leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
         sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
         list_reduce(list_concat([CASE WHEN tampered THEN changed ELSE leaf END], coalesce(path, [])),
                     lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM f JOIN sub ON sub.lang IS NOT DISTINCT FROM f.lang LEFT JOIN p ON p.doc_id = f.doc_id)
SELECT *, folded_root = root AS verified FROM o"""


@query
def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op13_minhash_dedup"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
o AS (SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = t.doc_id) AS component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id)
SELECT *, doc_id = component_id AS kept FROM o"""
