"""The corpus operators as queries with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, class_lm, fim, html_text, langid, line_quality, mixing, nearest, ngram_join, paragraphs, sharding, spelling, warc
from folioflow.llm.common import cut, remove_path, shared_path

TOKENIZER = "byte_bpe_50k.json"


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_quality.quality(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", *line_quality.BASE, "base_failed", "kept")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), ["page_id"])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path, with_payload=False).where("kind = 'record'")
    out = cut(records.select(
        warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("refers_to")
    ))
    remove_path(spark, path)
    return out


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path(), ["doc_id"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), 16, keep_text=False)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a passage of another: where, how much, the smallest document found to hold it, and the cluster's, which keeps its text."""
    out = paragraphs.dedup(table(spark, sf_dir, "documents")).where("spans is not null")
    part = lambda name: F.transform("spans", lambda s: s[name]).alias(f"{name}s")
    return out.select("doc_id", F.col("removed_words").cast("long").alias("removed_words"), part("start"), part("stop"), part("owner"), part("cluster"), F.sha2("clean_text", 256).alias("clean_sha256"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"), ["doc_id"])


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_line_frequency, op2_html_text, op3_mixing, op4_ngram_jaccard, op5_warc, op6_bpe, op7_sharding, op8_language_id, op9_paragraph_dedup, op10_nearest,
    op11_fim, op12_class_lm, op13_spelling,
)}

_WORDS_SQL = "CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT)"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD_LIST = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

ORACLES = {
    "op1_line_frequency": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source, {_WORD_LIST.format("coalesce(text, '')")} AS ws FROM documents),
l AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT rid, source, text, line, len({_WORD_LIST.format('line')}) AS n, {_LOWER.format(f"array_to_string({_WORD_LIST.format('line')}, ' ')")} AS norm FROM l),
t AS (SELECT * FROM n WHERE n > 0),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY 1),
f AS (SELECT source, norm, count(DISTINCT text) AS k FROM t GROUP BY 1, 2),
common AS (SELECT f.source, norm FROM f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE k > greatest(10, least(docs * 0.002::DOUBLE, 1000))),
lost AS (SELECT rid, sum(n) AS lost FROM t JOIN common c ON t.source IS NOT DISTINCT FROM c.source AND t.norm = c.norm GROUP BY 1),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS dup FROM t GROUP BY 1),
g AS (SELECT rid, i, ws[i:i + 7] AS gram FROM d, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 8),
again AS (SELECT rid, gram FROM g GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS rep FROM (SELECT g.rid, unnest(range(i, i + 8)) AS p FROM g JOIN again a ON g.rid = a.rid AND g.gram = a.gram) GROUP BY 1),
s AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - lost >= 0.5 * n_words AS kept FROM b
""",
    "op5_warc": """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN r THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN r THEN last END AS refers_to
FROM (SELECT *, coalesce(octet_length(encode(h)) >= 1000 AND page_id <> last, FALSE) AS r FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages))
""",
    "op3_mixing": f"""
WITH d AS (SELECT doc_id, text, source, {_WORDS_SQL} AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((rn - 1) % 3 + 1 AS INT)] AS w, source_size * 2.0::DOUBLE AS most FROM s),
r AS (SELECT *, most / w AS full_at, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget, sum(w) OVER () AS all_w FROM w),
l AS (SELECT *, (budget - coalesce(sum(most) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY full_at, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, rn LIMIT 1) AS level),
t AS (SELECT source, source_size, CASE WHEN c.level IS NULL OR full_at < c.level THEN most ELSE c.level * w END AS target FROM l, c),
e AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
      CAST(CAST('0x' || substr(md5('mix:0:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || coalesce(d.text, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM e
""",
    "op11_fim": r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
d AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
""",
}
