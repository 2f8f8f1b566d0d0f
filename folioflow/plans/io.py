"""Queries of scans, sources and sinks (S1-S26). Sinks write to shared scratch space and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import chunking as CH
from folioflow.operators import rewriting as R
from folioflow.operators import structure as S
from folioflow.plans import corpus as C
from folioflow.plans.hierarchy import MD_SQL, md_lines
from folioflow.plans.predicates import docs, events, orders, part
from folioflow.registry import query
from folioflow.sources import files as IO
from folioflow.sources import navigation as NAV
from folioflow.streaming import ingest, queue


@query("s1_table_scan", "SELECT * FROM nation")
def s1(spark, sf_dir):
    return C.table(spark, sf_dir, "nation")


@query("s2_point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def s2(spark, sf_dir):
    return orders(spark, sf_dir).where("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("s3_in_list", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def s3(spark, sf_dir):
    ids = C.table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"))
    return docs(spark, sf_dir).join(ids, "doc_id", "left_semi").select("doc_id", "n_chars")


_FM = "'---' || chr(10) || 'title: ' || title || chr(10) || 'author: ' || authors || chr(10) || 'year: ' || year || chr(10) || '---' || chr(10) || chr(10)"


def exports(spark, sf_dir):
    w = C.works(spark, sf_dir)
    return w.select("work_id", IO.export_name(F.col("title")).alias("name"), F.concat(IO.front_matter(F.col("title"), F.col("authors"), F.col("year")), F.lit("# "), "title").alias("value"))


@query("s4_markdown_scan", C.sql("SELECT title || '.md' AS name, md5('# ' || title) AS content FROM works"))
def s4(spark, sf_dir):
    """Exports are written as files; their folder is listed and read."""
    path = IO.scratch(spark, "markdown")
    IO.write_named_files(C.works(spark, sf_dir).select(F.concat("title", F.lit(".md")).alias("name"), F.concat(F.lit("# "), "title").alias("value")), path, "name", "value")
    return IO.read_markdown(spark, path).select("name", F.md5(F.trim("content", F.lit("\n")).cast("binary")).alias("content"))


@query("s5_import_sanitized", C.sql("SELECT title, authors AS author, year, sha256('# ' || title || chr(10) || chr(10) || 'text of ' || title || '.') AS content_hash, 'small' AS size_class, NULL::VARCHAR AS error, 1 AS chunks FROM works"))
def s5(spark, sf_dir):
    """Written files are read back, checked, front matter is taken off and parsed, the body hashed and cut into chunks."""
    path = IO.scratch(spark, "import")
    body = F.concat(IO.front_matter(F.col("title"), F.col("authors"), F.col("year")), F.lit("# "), "title", F.lit("\n\ntext of "), "title", F.lit("."))
    IO.write_named_files(C.works(spark, sf_dir).select(F.concat("title", F.lit(".md")).alias("name"), body.alias("value")), path, "name", "value")
    got = IO.import_markdown(IO.read_markdown(spark, path))
    lines = got.where("error is null").select(F.col("title").alias("doc_id"), F.posexplode(F.split("content", "\n")).alias("p", "text")).withColumn("line", F.col("p") + 1)
    chunks = CH.paragraph_chunks(S.blocks(lines).where("kind = 'paragraph'").select("doc_id", "start_line", "end_line", "content")).groupBy(F.col("doc_id").alias("title")).agg(F.count(F.lit(1)).cast("int").alias("chunks"))
    return got.join(chunks, "title", "left").select("title", "author", "year", "content_hash", "size_class", "error", "chunks")


@query("s6_import_routing", r"SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\S') THEN NULL ELSE sha256(trim(text, chr(10))) END AS content_hash, CASE WHEN NOT regexp_matches(text, '\S') THEN NULL WHEN CAST(trunc(len(regexp_extract_all(text, '[^\s]+')) / 0.75) AS INT) < 1000 THEN 'small' ELSE 'large' END AS route, CASE WHEN NOT regexp_matches(text, '\S') THEN 'empty file' END AS error FROM documents")
def s6(spark, sf_dir):
    """The same for texts that were not sanitised: by their size they go one way or the other."""
    files = docs(spark, sf_dir).select(F.col("doc_id").alias("path"), F.lit("x.md").alias("name"), F.col("text").alias("content"))
    return IO.import_markdown(files, small_tokens=1000).select(F.col("path").alias("doc_id"), "content_hash", F.col("size_class").alias("route"), "error")


@query("s7_front_matter", C.sql("SELECT work_id, title, authors AS author, '# ' || title AS body FROM works"))
def s7(spark, sf_dir):
    e = exports(spark, sf_dir)
    v = F.col("value")
    return e.select("work_id", R.front_matter_field(v, "title").alias("title"), R.front_matter_field(v, "author").alias("author"), F.trim(R.strip_front_matter(v), F.lit("\n")).alias("body"))


@query("s8_duplicates_by_hash", "SELECT doc_id FROM documents d WHERE doc_id >= 500 AND EXISTS (SELECT 1 FROM documents o WHERE o.doc_id < 500 AND o.text = d.text)")
def s8(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text")
    return IO.duplicates_by_hash(d.where("doc_id >= 500"), d.where("doc_id < 500")).select("doc_id")


@query("s9_duplicates_by_title", C.sql("SELECT d.doc_id AS id, w.work_id FROM documents d JOIN works w ON lower(w.title) = lower(upper(d.source)) AND contains(lower(w.authors), 'author ' || d.doc_id % 7)"))
def s9(spark, sf_dir):
    new = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.upper("source").alias("title"), F.concat(F.lit("AUTHOR "), (F.col("doc_id") % 7).cast("string")).alias("author"))
    return IO.duplicates_by_title(new, C.works(spark, sf_dir))


@query("s11_html_to_markdown")
def s11(spark, sf_dir):
    return IO.html_to_markdown(C.table(spark, sf_dir, "pages")).select("page_id", "markdown")


_NAV = """nav AS (SELECT work_id, 0 AS pos, 1 AS level, title, title || '.xhtml' AS document, CAST(NULL AS VARCHAR) AS fragment FROM works
  UNION ALL SELECT DISTINCT work_id, 1 + lang_no, 2, source || ' ' || lang, source || '.xhtml', 'l' || lang_no FROM docs)"""


def languages(spark, sf_dir):
    """(work_id, title, langs): the languages of each work in order, as chapters of a book."""
    c = C.documents(spark, sf_dir).groupBy("work_id", "lang_no").agg(F.min("source").alias("source"), F.min("lang").alias("lang"))
    return c.groupBy("work_id").agg(F.min("source").alias("title"), F.array_sort(F.collect_list(F.struct("lang_no", "lang"))).alias("langs"))


def _book(title, one, before, after):
    parts = F.array_join(F.transform("langs", one), "")
    return F.concat(F.lit(before[0]), F.col("title"), F.lit(before[1]), F.col("title"), F.lit(before[2]), parts, F.lit(after))


def nav_documents(spark, sf_dir):
    one = lambda l: F.concat(F.lit('<li><a href="text/'), F.col("title"), F.lit(".xhtml#l"), l["lang_no"].cast("string"), F.lit('"> '), F.col("title"), F.lit(" <b>"), l["lang"], F.lit("</b></a></li>"))
    return languages(spark, sf_dir).select("work_id", _book("title", one, ('<html><body><nav epub:type="toc"><h1>Contents</h1><ol><li><a href="', '.xhtml">', "</a><ol>"), "</ol></li></ol></nav><nav><ol><li><a href='x'>other</a></li></ol></nav></body></html>").alias("nav"))


def ncx_documents(spark, sf_dir):
    one = lambda l: F.concat(F.lit("<navPoint><navLabel><text>"), F.col("title"), F.lit(" "), l["lang"], F.lit('</text></navLabel><content src="text/'), F.col("title"), F.lit(".xhtml#l"), l["lang_no"].cast("string"), F.lit('"/></navPoint>'))
    return languages(spark, sf_dir).select("work_id", _book("title", one, ('<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>', '</text></navLabel><content src="', '.xhtml"/>'), "</navPoint></navMap></ncx>").alias("ncx"))


@query("s12_nav_hierarchy", C.sql("SELECT work_id, CAST(row_number() OVER (PARTITION BY work_id ORDER BY pos) - 1 AS INT) AS pos, CAST(level AS INT) AS level, title, document, fragment FROM nav", _NAV))
def s12(spark, sf_dir):
    """The nested lists of EPUB 3 navigation documents."""
    e = NAV.with_entries(nav_documents(spark, sf_dir), "nav", "nav")
    return e.select("work_id", F.posexplode("entries").alias("pos", "e")).select("work_id", "pos", "e.*")


@query("s14_ncx_toc", C.sql("SELECT work_id, string_agg(repeat('#', level) || ' ' || title, chr(10) || chr(10) ORDER BY pos) AS toc FROM nav GROUP BY 1", _NAV))
def s14(spark, sf_dir):
    """The nested points of EPUB 2 navigation as Markdown headings."""
    return NAV.with_entries(ncx_documents(spark, sf_dir), "ncx", "ncx").select("work_id", NAV.toc_markdown(F.col("entries")).alias("toc"))


@query("s16_json_config", "SELECT CAST(count(*) AS INT) AS token_threshold, 15000 AS wrong, 15000 AS missing FROM documents")
def s16(spark, sf_dir):
    """A configuration made from what is there (as many tokens as documents), written as JSON and read back; wrong and missing values give the default."""
    path = IO.scratch(spark, "config")
    docs(spark, sf_dir).agg(F.to_json(F.struct(F.struct(F.count(F.lit(1)).alias("token_threshold"), F.lit("x").alias("wrong")).alias("conversion"))).alias("value")).coalesce(1).write.text(path)
    config = IO.read_config(spark, path)
    keys = ("token_threshold", "wrong", "missing")
    return spark.createDataFrame([tuple(IO.setting(config, "conversion", k, default=15000) for k in keys)], ", ".join(f"{k} int" for k in keys))


@query("s15_csv_mapping", "SELECT p_name AS old, p_brand AS new FROM part")
def s15(spark, sf_dir):
    path = IO.scratch(spark, "mapping")
    part(spark, sf_dir).select(F.col("p_name").alias("old"), F.col("p_brand").alias("new")).write.option("header", True).csv(path)
    return spark.read.schema("old string, new string").option("header", True).csv(path)


@query("s17_folder_sync", "SELECT coalesce(a.k, b.k) AS path, CASE WHEN b.k IS NULL THEN 'insert' WHEN a.k IS NULL THEN 'delete' ELSE 'touch' END AS action FROM (SELECT 'f' || doc_id AS k FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT 'f' || doc_id AS k FROM documents WHERE doc_id % 3 = 0) b ON a.k = b.k")
def s17(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"))
    return IO.sync_plan(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"))


@query("s18_group_variants", "SELECT 'b' || doc_id // 3 AS base, string_agg(CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'md' WHEN 1 THEN 'pdf' ELSE 'san.md' END, ',' ORDER BY doc_id % 3) AS variants FROM documents GROUP BY 1")
def s18(spark, sf_dir):
    ext = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".pdf").otherwise(".san.md")
    return IO.group_variants(docs(spark, sf_dir).select(F.concat(F.lit("b"), F.floor(F.col("doc_id") / 3).cast("string"), ext).alias("name")))


@query("s19_csv_export", "SELECT doc_id AS prompt, quality, toxic FROM labels")
def s19(spark, sf_dir):
    long = C.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("prompt"), F.expr("inline(array(struct('quality' as d, quality as v), struct('toxic' as d, toxic as v)))"))
    path = IO.scratch(spark, "export")
    long.groupBy("prompt").pivot("d", ["quality", "toxic"]).agg(F.first("v")).write.option("header", True).csv(path)
    return spark.read.schema("prompt long, quality int, toxic int").option("header", True).csv(path)


@query("s20_jsonl_export", "SELECT conv_id, turn, role, text FROM conversations")
def s20(spark, sf_dir):
    path = IO.scratch(spark, "jsonl")
    c = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c.select(F.to_json(F.struct(*c.columns)).alias("value")).write.text(path)
    return spark.read.schema(c.schema).json(path)


@query("s21_markdown_export", C.sql(f"SELECT work_id, title || '.md' AS name, {_FM} || '# ' || title AS value FROM works"))
def s21(spark, sf_dir):
    return exports(spark, sf_dir)


@query("s22_source_precedence", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'table' WHEN doc_id % 3 = 0 THEN 'file' ELSE 'missing' END AS origin, CASE WHEN doc_id % 2 = 0 THEN text WHEN doc_id % 3 = 0 THEN upper(text) END AS content FROM documents WHERE lang = 'en'")
def s22(spark, sf_dir):
    d = docs(spark, sf_dir).where("lang = 'en'")
    a = d.where("doc_id % 2 = 0").select("doc_id", F.col("text").alias("a"))
    b = d.where("doc_id % 3 = 0").select("doc_id", X.upper(F.col("text")).alias("b"))
    j = d.select("doc_id").join(a.withColumn("in_a", F.lit(True)), "doc_id", "left").join(b.withColumn("in_b", F.lit(True)), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("in_a"), "table").when(F.col("in_b"), "file").otherwise("missing").alias("origin"), F.when(F.col("in_a"), F.col("a")).otherwise(F.col("b")).alias("content"))


@query("s23_stage_log", "SELECT event_type AS stage, count(*) AS n FROM events GROUP BY 1")
def s23(spark, sf_dir):
    path = IO.scratch(spark, "log")
    events(spark, sf_dir).groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n")).write.json(path)
    return spark.read.schema("stage string, n long").json(path)


@query("s24_upsert", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN quality + 10 ELSE quality END AS quality FROM labels")
def s24(spark, sf_dir):
    old = C.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return IO.upsert(old, old.where("doc_id % 4 = 0").withColumn("quality", F.col("quality") + 10), ["doc_id"])


@query("s25_cascade_delete", C.sql("SELECT id FROM headings WHERE id <> -1 AND parent_id IS DISTINCT FROM -1 AND (parent_id IS NULL OR parent_id NOT IN (SELECT id FROM headings WHERE parent_id = -1))"))
def s25(spark, sf_dir):
    """Chunk -1, the first work's, and all below it go, at any depth."""
    h = C.headings(spark, sf_dir)
    gone = S.ancestors(h).where("ancestor_id = -1").select("id").unionAll(h.where("id = -1").select("id"))
    return h.join(gone, "id", "left_anti").select("id")


@query("s26_delete_work", C.sql("SELECT id FROM headings WHERE work_id <> 3"))
def s26(spark, sf_dir):
    gone = C.works(spark, sf_dir).where("work_id = 3").select("work_id")
    return C.headings(spark, sf_dir).join(gone, "work_id", "left_anti").select("id")


@query("streaming_ingest", C.sql("SELECT doc_id, count(*) AS n_headings FROM hd GROUP BY 1", MD_SQL.strip()))
def streaming_ingest(spark, sf_dir):
    """New documents as a stream, chunked as they come and appended; a batch query reads what the stream has written."""
    return ingest.headings_of_new_documents(spark, md_lines(spark, sf_dir))


@query("streaming_vectorisation", C.sql(r"SELECT id, CASE WHEN regexp_matches(content, '\S') THEN 'vec' ELSE 'vec_err' END AS vector_status, CASE WHEN regexp_matches(content, '\S') THEN 64 END AS dimensions FROM chunks WHERE vector_status = 'to_vec' AND parent_id IS NOT NULL AND embedding IS NULL"))
def streaming_vectorisation(spark, sf_dir):
    """Every chunk of the corpus comes to the queue; those that wait for a vector get one."""
    from folioflow.operators.external import hashing_embedder
    got = queue.vectorised(C.chunks(spark, sf_dir), hashing_embedder)
    return got.select("id", "vector_status", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimensions"))


@query("streaming_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_event_windows(spark, sf_dir):
    return ingest.event_windows(spark, events(spark, sf_dir), "1 hour")
