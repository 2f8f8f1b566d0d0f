"""The document corpus that the queries run over, derived from the given tables: in Spark, and as SQL for the oracles.

Works are the sources of `documents`. Their chunks are a forest: H1 a source, H2 a language of it, H3 a document
with its whole text, and a leaf per non-empty line. `embeddings` gives the vectors of H3 chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import vectorindex
from folioflow.sources.files import scratch

LANGS = {"en": 0, "fr": 1, "de": 2, "es": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang, source, work_id, lang_no) of documents with a source and a language."""
    d = table(spark, sf_dir, "documents").where("source is not null and lang is not null and text is not null")
    lang = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in LANGS.items()], F.lit(9))
    named = F.when(F.col("source").rlike(r"^src\d{1,9}$"), F.expr("try_cast(substring(source, 4) as long)"))
    return d.withColumns({"work_id": F.coalesce(named, (1 << 30) + F.conv(F.substring(F.md5("source"), 1, 8), 16, 10).cast("long")), "lang_no": lang})


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per work: 20 or so rows at any scale, so joins may broadcast it if Spark's size check agrees."""
    d = documents(spark, sf_dir)
    return d.groupBy("work_id").agg(F.min("source").alias("title"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs")).select(
        "work_id", "title", F.concat(F.lit("Author "), (F.col("work_id") % 7).cast("string")).alias("authors"), (F.lit(1990) + F.col("work_id")).cast("int").alias("year"), "first_doc", "n_docs")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, work_id, lang, source, lang_no, line_no from 1, line) of the non-empty lines."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", "work_id", "lang", "source", "lang_no", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.col("line") != "").withColumn("line_no", F.col("p") + 1).drop("p")


_FIELDS = ["id", "parent_id", "work_id", "level", "content", "heading_breadcrumbs", "start_line", "end_line"]


def _h1(work):
    """Ids of H1 and H2 chunks are negative, those of documents and lines positive, so they never meet."""
    return (-1 - work * 100).cast("long")


def _h2(work, lang_no):
    return (-2 - work * 100 - lang_no).cast("long")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    h1 = d.groupBy("work_id").agg(F.min("source").alias("s")).select(
        _h1(F.col("work_id")).alias("id"), F.lit(None).cast("long").alias("parent_id"), "work_id", F.lit("H1").alias("level"), F.concat(F.lit("# "), "s").alias("content"),
        F.col("s").alias("heading_breadcrumbs"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    h2 = d.groupBy("work_id", "lang_no").agg(F.min("source").alias("s"), F.min("lang").alias("l")).select(
        _h2(F.col("work_id"), F.col("lang_no")).alias("id"), _h1(F.col("work_id")).alias("parent_id"), "work_id", F.lit("H2").alias("level"),
        F.concat(F.lit("## "), "s", F.lit(" "), "l").alias("content"), F.concat_ws(" > ", "s", "l").alias("heading_breadcrumbs"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    h3 = d.select(
        (F.col("doc_id") + 10000).alias("id"), _h2(F.col("work_id"), F.col("lang_no")).alias("parent_id"), "work_id", F.lit("H3").alias("level"),
        F.concat(F.lit("### Document "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("content"),
        F.concat_ws(" > ", "source", "lang", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).alias("heading_breadcrumbs"),
        F.lit(1).alias("start_line"), (F.size(F.split("text", "\n")) + 1).alias("end_line"))
    return h1.unionAll(h2).unionAll(h3)


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir)
    return x.select(
        (1_000_000_000 + F.col("doc_id") * 100_000_000 + F.col("line_no")).alias("id"), (F.col("doc_id") + 10000).alias("parent_id"), "work_id", F.lit("H3-chunk").alias("level"),
        F.col("line").alias("content"), F.concat_ws(" > ", "source", "lang", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).alias("heading_breadcrumbs"),
        (F.col("line_no") + 1).alias("start_line"), (F.col("line_no") + 1).alias("end_line"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole forest with embedding, vector_status, dense_lexical_use and sentence_count."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 10000).alias("_id"), "embedding")
    h = headings(spark, sf_dir)
    h = h.join(e, h["id"] == e["_id"], "left").drop("_id")
    all_ = h.unionByName(leaves(spark, sf_dir), allowMissingColumns=True)
    return all_.withColumns({
        "vector_status": F.when(F.col("embedding").isNotNull(), "vec").when(F.col("level") == "H3-chunk", "to_vec").otherwise("no_vec"),
        "dense_lexical_use": F.col("level").isin("H3", "H3-chunk"),
        "sentence_count": F.size(X.split_sentences(F.col("content"))),
    })


def _stored(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Where an index is that is written once a session for the documents and embeddings as they are (names, sizes and times of their files)."""
    files = [f for t in ("documents", "embeddings") for f in sorted(table(spark, sf_dir, t).inputFiles())]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    state = [name]
    for f in files:
        p = jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        state.append((f, s.getLen(), s.getModificationTime()))
    known = spark.__dict__.setdefault("_folioflow_indexes", {})
    if tuple(state) not in known:
        path = scratch(spark, name)
        write(path)
        known[tuple(state)] = path
    return known[tuple(state)]


def texts(spark: SparkSession, sf_dir: str, lines_too: bool = False) -> DataFrame:
    """(id, content, usable, heading) of the headings, and of the lines too, as full-text searches take them; all chunks with vectors are headings.

    A query here is one batch over a table, so its texts are searched where they are; a stored index of them pays for many batches.
    """
    c = headings(spark, sf_dir)
    c = c.unionByName(leaves(spark, sf_dir)) if lines_too else c
    return c.select("id", "content", F.col("level").isin("H3", "H3-chunk").alias("usable"), F.col("level").isin("H1", "H2", "H3", "H4", "H5").alias("heading"))


def with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the chunks that have a vector."""
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select((F.col("vec_id") + 10000).alias("id"))


def vector_index(spark: SparkSession, sf_dir: str) -> str:
    """The path of the stored index of all chunks with vectors."""
    fields = ("id", "embedding", "dense_lexical_use", "sentence_count")
    return _stored(spark, sf_dir, "vectors", lambda path: vectorindex.write_index(chunks(spark, sf_dir).select(*fields), path))


#: The same as common table expressions: docs, works, headings, leaves, chunks.
SQL = r"""
docs AS (SELECT doc_id, text, lang, source, CASE WHEN regexp_matches(source, '^src\d{1,9}$') THEN CAST(substr(source, 4) AS BIGINT) ELSE 1073741824 + CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) END AS work_id,
  CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE 9 END AS lang_no
  FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL),
works AS (SELECT work_id, min(source) AS title, 'Author ' || CAST(work_id % 7 AS VARCHAR) AS authors, CAST(1990 + work_id AS INT) AS year,
  min(doc_id) AS first_doc, count(*) AS n_docs FROM docs GROUP BY work_id),
doc_lines AS (SELECT doc_id, work_id, lang, source, lang_no, i AS line_no, l[i] AS line
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM docs), unnest(range(1, len(l) + 1)) AS u(i) WHERE l[i] <> ''),
headings AS (
  SELECT -1 - work_id * 100 AS id, CAST(NULL AS BIGINT) AS parent_id, work_id, 'H1' AS level, '# ' || min(source) AS content, min(source) AS heading_breadcrumbs, 0 AS start_line, 0 AS end_line FROM docs GROUP BY work_id
  UNION ALL SELECT -2 - work_id * 100 - lang_no, -1 - work_id * 100, work_id, 'H2', '## ' || min(source) || ' ' || min(lang), min(source) || ' > ' || min(lang), 0, 0 FROM docs GROUP BY work_id, lang_no
  UNION ALL SELECT doc_id + 10000, -2 - work_id * 100 - lang_no, work_id, 'H3', '### Document ' || doc_id || chr(10) || text, source || ' > ' || lang || ' > Document ' || doc_id, 1, CAST(len(string_split(text, chr(10))) + 1 AS INT) FROM docs),
leaves AS (SELECT 1000000000 + doc_id * 100000000 + line_no AS id, doc_id + 10000 AS parent_id, work_id, 'H3-chunk' AS level, line AS content,
  source || ' > ' || lang || ' > Document ' || doc_id AS heading_breadcrumbs, CAST(line_no + 1 AS INT) AS start_line, CAST(line_no + 1 AS INT) AS end_line FROM doc_lines),
chunks0 AS (SELECT h.*, e.embedding FROM headings h LEFT JOIN embeddings e ON h.id = e.vec_id + 10000 UNION ALL SELECT l.*, NULL FROM leaves l),
chunks AS (SELECT *, CASE WHEN embedding IS NOT NULL THEN 'vec' WHEN level = 'H3-chunk' THEN 'to_vec' ELSE 'no_vec' END AS vector_status,
  level IN ('H3', 'H3-chunk') AS dense_lexical_use FROM chunks0)
"""


def sql(body: str, *more: str) -> str:
    """Oracle SQL: the corpus tables, further tables, then the body."""
    return "WITH " + ",\n".join([SQL.strip(), *more]) + "\n" + body


def queries_sql() -> str:
    """Query vectors, a stated set: embeddings whose vec_id is divisible by 100."""
    return "qv AS (SELECT vec_id AS query_id, embedding AS qe, label FROM embeddings WHERE vec_id % 100 = 0)"


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"), "label")


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, q): the first three words of every benchmark item."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(X.lexemes(F.col("text")), 1, 3), " ").alias("q"))


TEXTS_SQL = r"qt AS (SELECT item_id AS query_id, array_to_string(list_slice(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1, 3), ' ') AS q FROM benchmark)"
