"""Queries of document structure and hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import structure as S
from folioflow.plans import corpus as C
from folioflow.registry import query

#: documents have no Markdown headings, so some of their lines are made into headings, tables and figures by position.
MD_SQL = r"""
raw AS (SELECT doc_id, i AS line, l[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs), unnest(range(1, len(l) + 1)) AS u(i)),
md AS (SELECT doc_id, line, CASE WHEN line % 4 = 1 THEN repeat('#', CAST(1 + (line * 7 + doc_id) % 5 AS INT)) || ' ' || trim(substr(t, 1, 20)) || '.' WHEN line % 11 = 6 THEN '| a | b |' WHEN line % 13 = 7 THEN '![fig](x.png)' ELSE t END AS text FROM raw),
hd AS (SELECT doc_id, line, len(regexp_extract(text, '^(#+)\s+', 1)) AS level, trim(regexp_extract(text, '^#+\s+(.*)$', 1)) AS title FROM md WHERE regexp_matches(text, '^#{1,5}\s+')),
tot AS (SELECT doc_id, max(line) AS total_lines FROM md GROUP BY 1),
sec AS (SELECT h.*, coalesce((SELECT min(n.line) - 1 FROM hd n WHERE n.doc_id = h.doc_id AND n.line > h.line AND n.level <= h.level), tot.total_lines) AS end_line FROM hd h JOIN tot USING (doc_id))
"""


def md_lines(spark, sf_dir):
    """(doc_id, line, text) of documents rendered as Markdown."""
    d = C.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).withColumn("line", F.col("p") + 1)
    mark = F.expr("repeat('#', cast(1 + (line * 7 + doc_id) % 5 as int))")
    text = F.when(F.col("line") % 4 == 1, F.concat(mark, F.lit(" "), F.trim(F.substring("t", 1, 20)), F.lit("."))).when(F.col("line") % 11 == 6, "| a | b |").when(F.col("line") % 13 == 7, "![fig](x.png)").otherwise(F.col("t"))
    return d.select("doc_id", "line", text.alias("text"))


def totals(lines):
    return lines.groupBy("doc_id").agg(F.max("line").alias("total_lines"))


def sql(body: str) -> str:
    return C.sql(body, MD_SQL.strip())


@query("t1_parse_headings", sql("SELECT doc_id, CAST(line AS INT) AS line, CAST(level AS INT) AS level, title FROM hd"))
def t1(spark, sf_dir):
    return S.parse_headings(md_lines(spark, sf_dir))


@query("w3_section_ends", sql("SELECT doc_id, CAST(line AS INT) AS line, CAST(level AS INT) AS level, CAST(end_line AS INT) AS end_line FROM sec"))
def w3(spark, sf_dir):
    x = md_lines(spark, sf_dir)
    return S.section_ends(S.parse_headings(x), totals(x)).select("doc_id", "line", "level", "end_line")


@query("w4_heading_parents", sql("SELECT doc_id, CAST(line AS INT) AS line, CAST((SELECT max(p.line) FROM hd p WHERE p.doc_id = h.doc_id AND p.line < h.line AND p.level < h.level) AS INT) AS parent_line FROM hd h"))
def w4(spark, sf_dir):
    return S.parents(S.parse_headings(md_lines(spark, sf_dir))).select("doc_id", "line", "parent_line")


_CRUMB = """SELECT h.doc_id, CAST(h.line AS INT) AS line, (SELECT string_agg(a.title, ' > ' ORDER BY a.line) FROM hd a WHERE a.doc_id = h.doc_id AND (a.line = h.line OR (a.line < h.line AND a.level < h.level
  AND NOT EXISTS (SELECT 1 FROM hd k WHERE k.doc_id = h.doc_id AND k.line > a.line AND k.line <= h.line AND k.level <= a.level)
  AND NOT EXISTS (SELECT 1 FROM hd k WHERE k.doc_id = h.doc_id AND k.line > a.line AND k.line < h.line AND k.level < a.level)))) AS breadcrumb FROM hd h"""


@query("w5_breadcrumb_stack", sql(_CRUMB))
def w5(spark, sf_dir):
    return S.breadcrumbs(S.parse_headings(md_lines(spark, sf_dir))).select("doc_id", "line", "breadcrumb")


@query("w6_heading_of_line", sql("SELECT doc_id, CAST(line AS INT) AS line, CAST(max(CASE WHEN regexp_matches(text, '^#{1,5}\\s+') THEN line END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT) AS heading_line FROM md"))
def w6(spark, sf_dir):
    return S.heading_of_lines(md_lines(spark, sf_dir)).select("doc_id", "line", "heading_line")


_PICK = "l AS (SELECT id, parent_id, work_id, content, start_line, end_line FROM leaves WHERE id % 3 <> 0)"
_ISL = _PICK + ", i AS (SELECT *, sum(CASE WHEN start_line - p > 2 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY parent_id ORDER BY start_line, end_line, id) AS island FROM (SELECT *, lag(end_line) OVER (PARTITION BY parent_id ORDER BY start_line, end_line, id) AS p FROM l))"


@query("w7_gap_merge", C.sql("SELECT parent_id, CAST(min(start_line) AS INT) AS start_line, CAST(max(end_line) AS INT) AS end_line, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM i GROUP BY parent_id, island", _ISL))
def w7(spark, sf_dir):
    x = S.islands(C.leaves(spark, sf_dir).where("id % 3 != 0"), ["parent_id"], gap=2)
    return x.groupBy("parent_id", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids")).drop("island")


@query("w8_adjacent_headings", sql("SELECT doc_id, count(*) AS n_adjacent FROM (SELECT doc_id, lead(line) OVER (PARTITION BY doc_id ORDER BY line) - line AS d FROM hd) WHERE d <= 4 GROUP BY 1"))
def w8(spark, sf_dir):
    from pyspark.sql import Window
    h = S.parse_headings(md_lines(spark, sf_dir))
    return h.withColumn("d", F.lead("line").over(Window.partitionBy("doc_id").orderBy("line")) - F.col("line")).where("d <= 4").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_adjacent"))


_KIND = r"CASE WHEN regexp_matches(text, '^#{1,5}\s+') THEN 'heading' WHEN regexp_matches(text, '^\s*\|') THEN 'table' WHEN regexp_matches(text, '^!\[.*\]\(.*\)') THEN 'figure' WHEN trim(text) = '' THEN 'blank' ELSE 'paragraph' END"
_BLOCKS = f"""k AS (SELECT *, {_KIND} AS kind FROM md), b AS (SELECT *, sum(CASE WHEN kind <> coalesce(p, '') OR kind IN ('heading','figure') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM k)),
blk AS (SELECT doc_id, block, kind, min(line) AS start_line, max(line) AS end_line, string_agg(text, chr(10) ORDER BY line) AS content FROM b WHERE kind <> 'blank' GROUP BY 1, 2, 3)"""


@query("t2_blocks", C.sql("SELECT doc_id, kind, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, content FROM blk", MD_SQL.strip(), _BLOCKS))
def t2(spark, sf_dir):
    return S.blocks(md_lines(spark, sf_dir)).drop("block")


@query("t7_table_figure_chunks", C.sql("SELECT doc_id, CAST(start_line AS INT) AS start_line, CASE kind WHEN 'table' THEN 'tbl' ELSE 'fig' END AS vector_status, content FROM blk WHERE kind IN ('table', 'figure')", MD_SQL.strip(), _BLOCKS))
def t7(spark, sf_dir):
    b = S.blocks(md_lines(spark, sf_dir)).where(F.col("kind").isin("table", "figure"))
    return b.select("doc_id", "start_line", F.when(F.col("kind") == "table", "tbl").otherwise("fig").alias("vector_status"), "content")


_CONTENT = "SELECT s.doc_id, CAST(s.line AS INT) AS line, CAST(s.end_line AS INT) AS end_line, (SELECT string_agg(m.text, chr(10) ORDER BY m.line) FROM md m WHERE m.doc_id = s.doc_id AND m.line BETWEEN s.line AND s.end_line) AS content FROM sec s"


@query("t5_heading_chunks", sql(_CONTENT))
def t5(spark, sf_dir):
    x = md_lines(spark, sf_dir)
    return S.section_contents(S.section_ends(S.parse_headings(x), totals(x)), x).select("doc_id", "line", "end_line", "content")


@query("t4_heading_chunks_decided", sql(_CONTENT + " WHERE (s.doc_id + s.line) % 3 <> 0"))
def t4(spark, sf_dir):
    """Only headings whose decision is VECTORIZE (here: two of three)."""
    x = md_lines(spark, sf_dir)
    chosen = S.section_ends(S.parse_headings(x), totals(x)).where("(doc_id + line) % 3 != 0")
    return S.section_contents(chosen, x).select("doc_id", "line", "end_line", "content")


@query("t9_content_chunks", C.sql("SELECT b.doc_id, CAST(b.start_line AS INT) AS start_line, 'H' || h.level || '-chunk' AS level, CAST(h.line AS INT) AS parent_line FROM blk b JOIN hd h ON h.doc_id = b.doc_id AND h.line = (SELECT max(x.line) FROM hd x WHERE x.doc_id = b.doc_id AND x.line < b.start_line) WHERE b.kind = 'paragraph'", MD_SQL.strip(), _BLOCKS))
def t9(spark, sf_dir):
    """Paragraphs under a heading; those before the first heading have no parent and are left out."""
    x = md_lines(spark, sf_dir)
    of = S.heading_of_lines(x).where("heading_line is not null").select("doc_id", F.col("line").alias("start_line"), F.col("heading_line").alias("parent_line"))
    lv = S.parse_headings(x).select("doc_id", F.col("line").alias("parent_line"), "level")
    p = S.blocks(x).where("kind = 'paragraph'").join(of, ["doc_id", "start_line"]).join(lv, ["doc_id", "parent_line"])
    return p.select("doc_id", "start_line", F.concat(F.lit("H"), F.col("level").cast("string"), F.lit("-chunk")).alias("level"), "parent_line")


@query("t25_extract_titles", sql("SELECT doc_id, string_agg(line || ': ' || repeat('#', CAST(level AS INT)) || ' ' || title, chr(10) ORDER BY line) AS titles FROM hd GROUP BY 1"))
def t25(spark, sf_dir):
    h = S.parse_headings(md_lines(spark, sf_dir))
    row = F.concat(F.col("line").cast("string"), F.lit(": "), F.expr("repeat('#', level)"), F.lit(" "), "title")
    return h.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", row.alias("r")))), lambda s: s["r"]), "\n").alias("titles"))


@query("t26_toc", sql("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS entry, CAST(level AS INT) AS level, title, CAST(line AS INT) AS line FROM hd"))
def t26(spark, sf_dir):
    """The table of contents of each document: its headings in order."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    return S.parse_headings(md_lines(spark, sf_dir)).select("doc_id", order.alias("entry"), "level", "title", "line")


ANC = "up(id, depth, anc) AS (SELECT id, 1, parent_id FROM chunks WHERE parent_id IS NOT NULL UNION ALL SELECT up.id, up.depth + 1, c.parent_id FROM up JOIN chunks c ON c.id = up.anc WHERE c.parent_id IS NOT NULL AND up.depth < 10)"


def _rec(body: str) -> str:
    return C.sql(body, ANC).replace("WITH ", "WITH RECURSIVE ", 1)


@query("h1_breadcrumb_walk", _rec("SELECT c.id, coalesce((SELECT string_agg(regexp_replace(split_part(p.content, chr(10), 1), '^#+ *', ''), ' > ' ORDER BY u.depth DESC) FROM up u JOIN headings p ON p.id = u.anc WHERE u.id = c.id), '[No heading]') AS breadcrumb FROM headings c"))
def h1(spark, sf_dir):
    """Walk to the root over headings: titles from the root down; none gives [No heading]."""
    h = C.headings(spark, sf_dir)
    return S.breadcrumb_walk(h, h)


_WC = r"len(regexp_extract_all(content, '[^\s]+'))"


@query("h2_parent_enrichment", _rec(f"""SELECT c.id, coalesce(e.anc, c.id) AS enriched_id, CAST(coalesce(e.depth, 0) AS INT) AS depth, coalesce(e.w, c.w) AS words
    FROM (SELECT id, {_WC} AS w FROM leaves) c LEFT JOIN (SELECT id, anc, depth, w FROM (SELECT u.id, u.anc, u.depth, p.w, row_number() OVER (PARTITION BY u.id ORDER BY (p.w >= 150) DESC, CASE WHEN p.w >= 150 THEN u.depth ELSE -u.depth END) AS rn
      FROM up u JOIN (SELECT id, {_WC} AS w FROM chunks) p ON p.id = u.anc) WHERE rn = 1) e ON e.id = c.id AND c.w < 150"""))
def h2(spark, sf_dir):
    """Short leaves climb to the first ancestor with 150 words, else to the topmost."""
    h = C.headings(spark, sf_dir)
    leaves = C.leaves(spark, sf_dir).withColumn("w", X.count_words(F.col("content")).cast("long"))
    p = h.select(F.col("id").alias("ancestor_id"), X.count_words(F.col("content")).cast("long").alias("pw"))
    a = S.ancestors_of(leaves.where("w < 150"), S.ancestors(h)).join(p, "ancestor_id")
    enough = F.min_by(F.when(F.col("pw") >= 150, F.struct("ancestor_id", "depth", "pw")), F.when(F.col("pw") >= 150, F.col("depth")))
    best = a.groupBy("id").agg(F.coalesce(enough, F.max_by(F.struct("ancestor_id", "depth", "pw"), "depth")).alias("e"))
    return leaves.join(best, "id", "left").select("id", F.coalesce("e.ancestor_id", "id").alias("enriched_id"), F.coalesce("e.depth", F.lit(0)).alias("depth"), F.coalesce("e.pw", "w").alias("words"))


@query("h4_descendants", _rec("SELECT anc AS id, count(*) AS n_descendants FROM up WHERE anc IN (SELECT id FROM headings) GROUP BY 1"))
def h4(spark, sf_dir):
    """How many stand below each heading: headings by their ancestors, leaves counted by parent first."""
    h = C.headings(spark, sf_dir)
    above = S.ancestors(h)
    below = C.leaves(spark, sf_dir).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    up = below.select(F.col("parent_id").alias("id"), "n").join(above, "id").select("ancestor_id", "n")
    rows = above.select("ancestor_id", F.lit(1).cast("long").alias("n")).unionAll(up).unionAll(below.select("parent_id", "n"))
    return rows.groupBy(F.col("ancestor_id").alias("id")).agg(F.sum("n").alias("n_descendants"))


@query("h5_ancestor_closure", _rec("SELECT DISTINCT anc AS id FROM up WHERE id % 17 = 0 AND id > 1000000000"))
def h5(spark, sf_dir):
    leaves = C.leaves(spark, sf_dir).where("id % 17 = 0").select("parent_id").distinct().withColumn("id", F.col("parent_id"))
    return S.ancestors_of(leaves, S.ancestors(C.headings(spark, sf_dir))).select(F.col("ancestor_id").alias("id")).distinct()


@query("h6_nearest_heading_ancestor", _rec("SELECT u.id, split_part(p.content, chr(10), 1) AS heading FROM up u JOIN headings p ON p.id = u.anc WHERE u.id > 1000000000 QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY u.depth) = 1"))
def h6(spark, sf_dir):
    h = C.headings(spark, sf_dir)
    first = h.select(F.col("id").alias("ancestor_id"), F.split_part("content", F.lit("\n"), F.lit(1)).alias("t")).where(F.col("t").startswith("#"))
    a = S.ancestors_of(C.leaves(spark, sf_dir), S.ancestors(h)).join(first, "ancestor_id")
    return a.groupBy("id").agg(F.min_by("t", "depth").alias("heading"))


@query("h7_heading_chain", C.sql("SELECT id, len(list_filter(string_split(heading_breadcrumbs, ' > '), lambda x: x <> '')) AS depth, split_part(heading_breadcrumbs, ' > ', -1) AS last FROM headings"))
def h7(spark, sf_dir):
    chain = F.filter(F.split("heading_breadcrumbs", " > "), lambda x: x != "")
    return C.headings(spark, sf_dir).select("id", F.size(chain).cast("long").alias("depth"), F.element_at(chain, -1).alias("last"))
