"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chat_format, decontam, divergence, filter_audit, lang_crf, license_scan, line_dedup, near_dup, packing, resample, scratch, sharding, token_files, vamana

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vamana_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vamana.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan_licenses(docs).drop("text")
    return found.select(
        "doc_id", "license.n_words", "license.n_base", "license.first_word", "license.last_word",
        F.array_join("license.base_labels", ",").alias("base_labels"), F.array_join("license.labels", ",").alias("labels"),
        "license.score", F.size("license.matches").cast("long").alias("n_matches"),
    )


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn; those left out are rejected."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample.resample(docs, _table(spark, sf_dir, "labels"))
    return drawn.filter("kept").select("doc_id", "importance", "gumbel_key")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "token-files")
    token_files.write_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    digest = T.StructType([T.StructField("ids_crc32", T.LongType())])
    return token_files.read_files(spark, path, zlib.crc32, digest).withColumnRenamed("id", "doc_id")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its class, the smallest doc_id in it."""
    classes = near_dup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "class_size", "links")


def op6_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda ids, start, length: F.crc32(F.substring(ids, (4 * start + 1).cast("int"), (4 * length).cast("int")))
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024, payload=digest)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.col("payload").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset"
    )


def op7_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_records(_table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.benchmark_hits(docs, _table(spark, sf_dir, "benchmark")).drop("text")
    hits = F.col("hits")
    ids = F.array_join(F.array_sort(hits["items"]), ",")
    return marked.select(
        "doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), decontam.contaminated(hits).alias("contaminated"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lang_crf.identify(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(same).alias("text"))
    made = chat_format.format_chains(rows.unionByName(more))
    template = chat_format.CHATML
    turns = F.transform(template.pieces(F.col("formatted")), template.read)
    read = made.select(F.col("tree").alias("conv_id"), turns.alias("read"), "formatted", template.learnt(F.col("formatted"), F.col("turns")).alias("learnt"))
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.all_orders(filter_audit.failed_filters(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vamana_neighbours": op1_vamana_neighbours,
    "op2_license_scan": op2_license_scan,
    "op3_importance_resampling": op3_importance_resampling,
    "op4_token_files": op4_token_files,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_histogram_packing": op6_histogram_packing,
    "op7_slot_sharding": op7_slot_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_crf": op10_language_crf,
    "op11_source_divergence": op11_source_divergence,
    "op12_chat_format": op12_chat_format,
    "op13_filter_audit": op13_filter_audit,
}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
m AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""

#: The columns of op2 that don't depend on the fuzzy search.
OP2_BASE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
phrases(phrase, label) AS (VALUES {", ".join(f"('{p}', '{label}')" for p, label in license_scan.BASE.items())}),
p AS (SELECT phrase, label, len(string_split(phrase, ' ')) AS n FROM phrases),
m AS (SELECT rid, i - 1 AS place, label FROM (SELECT rid, w, p.*, unnest(range(1, len(w) - n + 2)) AS i FROM d, p WHERE len(w) >= n) WHERE array_to_string(w[i : i + n - 1], ' ') = phrase),
g AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g USING (rid)
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (
  SELECT rid, doc_id, i, parts[i] AS line,
         translate(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)
),
keys AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT rid) >= 3),
kept AS (SELECT l.rid, l.i, l.line, keys.k IS NOT NULL AND l.doc_id IS DISTINCT FROM keys.top AS gone FROM l LEFT JOIN keys ON l.k = keys.k)
SELECT d.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM kept JOIN d USING (rid) GROUP BY d.rid, d.doc_id
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
o AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept USING (lang) GROUP BY ALL),
n AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (SELECT g.lang, source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM cell JOIN v USING (lang)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cell GROUP BY ALL) JOIN v USING (lang)
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 200
"""

OP12_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(t)
),
e AS (
  SELECT *, regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), p, '\1\2\\\3', 'g') AS er, regexp_replace(text, p, '\1\2\\\3', 'g') AS et
  FROM rows, (SELECT '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)' AS p)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(er) + 1 + length(et) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS g, bool_or(toxic = 1) AS x FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (
  SELECT part, coalesce(g, false) AS good, coalesce(x, false) AS toxic,
         [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS f
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
),
c AS (SELECT part, good, toxic, f, count(*) AS n FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a),
orders AS (
  SELECT [a.a, b.a, c.a, d.a, e.a] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.a, b.a, c.a, d.a, e.a])) = 5
),
steps AS (SELECT array_to_string(o, '') AS filter_order, s::INT AS step, o[s] AS letter, o[: s - 1] AS before FROM orders, range(1, 6) AS r(s)),
r AS (
  SELECT part, filter_order, step, letter, n, good, toxic,
         f[instr('ABCDE', letter)] AS fails, len(list_filter(before, lambda x: f[instr('ABCDE', x)])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS k
  FROM c, steps
),
g AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails AND k = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (WHERE fails AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g
"""

ORACLE_SQL: dict[str, str] = {"op8_decontamination": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_chat_format": OP12_SQL, "op13_filter_audit": OP13_SQL}
