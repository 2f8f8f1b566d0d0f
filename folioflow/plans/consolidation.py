"""Queries of consolidation and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import consolidation as K
from folioflow.operators import retrieval as RT
from folioflow.operators import structure as S
from folioflow.plans import corpus as C
from folioflow.plans.predicates import LINKS, docs, events, items_with_links, orders
from folioflow.registry import query

#: Items: the leaves on two of three lines, for queries by work.
_ITEMS = "items AS (SELECT work_id AS query_id, id, parent_id, content, start_line, end_line, round((id % 97) / 97.0::DOUBLE, 6) AS score FROM leaves WHERE id % 3 <> 0)"
_COV = "cov AS (SELECT query_id, i.parent_id, round(coalesce(sum(length(i.content))::DOUBLE / nullif(length(any_value(h.content)), 0), 0), 6) AS coverage FROM items i LEFT JOIN headings h ON h.id = i.parent_id GROUP BY 1, 2)"
_ISL = "isl AS (SELECT *, sum(CASE WHEN p IS NULL OR start_line - p > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, parent_id ORDER BY start_line, end_line, id) AS island FROM (SELECT *, lag(end_line) OVER (PARTITION BY query_id, parent_id ORDER BY start_line, end_line, id) AS p FROM items))"


def items(spark, sf_dir):
    return C.leaves(spark, sf_dir).where("id % 3 != 0").select(F.col("work_id").alias("query_id"), "id", "parent_id", "content", "start_line", "end_line", F.round((F.col("id") % 97) / F.lit(97.0), 6).alias("score"))


@query("c2_coverage", C.sql("SELECT query_id, parent_id, coverage FROM cov", _ITEMS, _COV))
def c2(spark, sf_dir):
    return K.coverage(items(spark, sf_dir), C.headings(spark, sf_dir))


@query("c1_consolidate_once", C.sql("""SELECT query_id, i.parent_id AS node_id, CAST(any_value(h.start_line) AS INT) AS start_line, CAST(any_value(h.end_line) AS INT) AS end_line, max(score) AS score, TRUE AS replaced FROM items i JOIN cov USING (query_id, parent_id) JOIN headings h ON h.id = i.parent_id WHERE coverage >= 0.6 GROUP BY 1, 2
  UNION ALL SELECT query_id, parent_id, CAST(min(start_line) AS INT), CAST(max(end_line) AS INT), max(score), FALSE FROM isl JOIN cov USING (query_id, parent_id) WHERE coverage < 0.6 GROUP BY query_id, parent_id, island""", _ITEMS, _COV, _ISL))
def c1(spark, sf_dir):
    return K.consolidate_once(items(spark, sf_dir), C.headings(spark, sf_dir), 0.6, 1)


def _rounds(n: int) -> list[str]:
    """SQL of n rounds of consolidation from `items` on: s0 .. sn. A round over what doesn't change any more changes nothing."""
    out = ["nodes AS (SELECT id, parent_id, content, start_line, end_line FROM headings)", "s0 AS (SELECT query_id, parent_id, start_line, end_line, score, content, [id] AS ids, CAST(NULL AS BIGINT) AS node_id, 0 AS up FROM items)"]
    for k in range(n):
        out.append(f"""c{k} AS (SELECT s.*, n.parent_id AS np, n.content AS nc, n.start_line AS ns, n.end_line AS ne, coalesce(sum(length(s.content)) OVER (PARTITION BY query_id, s.parent_id)::DOUBLE / nullif(length(n.content), 0), 0) >= 0.6 AS covered FROM s{k} s LEFT JOIN nodes n ON n.id = s.parent_id),
i{k} AS (SELECT *, sum(CASE WHEN p IS NULL OR start_line - p > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, parent_id ORDER BY start_line, end_line, ids[1]) AS island FROM (SELECT *, lag(end_line) OVER (PARTITION BY query_id, parent_id ORDER BY start_line, end_line, ids[1]) AS p FROM c{k} WHERE NOT covered)),
s{k + 1} AS (SELECT query_id, any_value(np) AS parent_id, any_value(ns) AS start_line, any_value(ne) AS end_line, max(score) AS score, any_value(nc) AS content, list_sort(flatten(list(ids))) AS ids, parent_id AS node_id, max(up) + 1 AS up FROM c{k} WHERE covered GROUP BY query_id, c{k}.parent_id
  UNION ALL SELECT query_id, parent_id, min(start_line), max(end_line), max(score), string_agg(content, chr(10) || chr(10) ORDER BY start_line, end_line, ids[1]) FILTER (content <> ''), list_sort(flatten(list(ids))), CASE WHEN count(*) = 1 THEN any_value(node_id) END, max(up) FROM i{k} GROUP BY query_id, parent_id, island)""")
    return out


@query("c1_consolidate", C.sql("SELECT query_id, list_aggregate(ids, 'string_agg', ',') AS ids, parent_id, node_id, CAST(up AS INT) AS level_up, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, score, md5(content) AS content FROM s7", _ITEMS, *_rounds(7)))
def c1_all(spark, sf_dir):
    out = K.consolidate(items(spark, sf_dir).withColumn("work_id", F.col("query_id")), C.headings(spark, sf_dir), 0.6, 1)
    return out.select("query_id", F.array_join("ids", ",").alias("ids"), "parent_id", "node_id", "level_up", "start_line", "end_line", "score", F.md5(F.col("content").cast("binary")).alias("content"))


@query("c3_lines_of_parent", C.sql("SELECT l.id, list_aggregate(string_split(h.content, chr(10))[l.start_line : l.start_line + 1], 'string_agg', chr(10)) AS excerpt FROM leaves l JOIN headings h ON h.id = l.parent_id"))
def c3(spark, sf_dir):
    h = C.headings(spark, sf_dir).select(F.col("id").alias("parent_id"), F.col("content").alias("pc"), F.col("start_line").alias("ps"))
    return C.leaves(spark, sf_dir).join(h, "parent_id").select("id", K.lines_of(F.col("pc"), F.col("start_line"), F.col("start_line") + 1, F.col("ps")).alias("excerpt"))


@query("c4_finalise_groups", C.sql("SELECT query_id, parent_id, CAST(min(start_line) AS INT) AS start_line, CAST(max(end_line) AS INT) AS end_line, max(score) AS score, string_agg(CAST(id AS VARCHAR), ',' ORDER BY start_line, id) AS ids, string_agg(content, chr(10) || chr(10) ORDER BY start_line, id) AS content FROM isl GROUP BY query_id, parent_id, island", _ITEMS, _ISL))
def c4(spark, sf_dir):
    return K.merged_groups(items(spark, sf_dir), 1)


_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM items)"


@query("c5_context_blocks", C.sql("SELECT query_id, string_agg('[S' || pos || '] Source: src' || query_id || ' | (work_id=' || query_id || ', start-line=' || start_line || ', end-line=' || end_line || ')' || chr(10) || 'Text:' || chr(10) || content, chr(10) || chr(10) ORDER BY pos) AS blocks FROM top WHERE pos <= 5 GROUP BY 1", _ITEMS, _TOP))
def c5(spark, sf_dir):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    t = items(spark, sf_dir).withColumn("pos", F.row_number().over(w)).where("pos <= 5")
    return K.context_blocks(t.withColumns({"work_id": F.col("query_id"), "title": F.concat(F.lit("src"), F.col("query_id").cast("string"))}))


@query("c6_augmented_prompt", C.sql("SELECT query_id, 'Intent: MECHANISM' || chr(10) || 'Entities: src' || query_id || ', lines' || chr(10) || '[S1] Source: src' || query_id || ' | (work_id=' || query_id || ', start-line=' || start_line || ', end-line=' || end_line || ')' || chr(10) || 'Text:' || chr(10) || content || chr(10) || 'Question: what of ' || query_id AS prompt FROM top WHERE pos = 1", _ITEMS, _TOP))
def c6(spark, sf_dir):
    """The template's intent, entities, context blocks and question filled in."""
    i = items(spark, sf_dir).withColumns({"work_id": F.col("query_id"), "ids": F.array("id")})
    asked = i.select("query_id").distinct().select("query_id", F.concat(F.lit("what of "), F.col("query_id").cast("string")).alias("q"), F.lit("MECHANISM").alias("intent"), F.array(F.concat(F.lit("src"), F.col("query_id").cast("string")), F.lit("lines")).alias("entities"))
    return RT.augmented_prompts(asked, i, C.works(spark, sf_dir), "Intent: {intent}\nEntities: {entities}\n{context}\nQuestion: {question}", 1)


_SEC = "SELECT o_custkey, o_orderkey, 'see [S1] and [S' || (1 + o_orderkey % 3) || ']' AS body, CAST(1 + o_orderkey % 3 AS INT) AS n FROM orders"


@query("c9_combine_sections", f"WITH s AS ({_SEC}), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s) SELECT o_orderkey, 'see [S' || (1 + off) || '] and [S' || (n + off) || ']' AS body FROM o")
def c9(spark, sf_dir):
    """References of each section move on by the number of sources before it."""
    n = 1 + F.col("o_orderkey") % 3
    s = orders(spark, sf_dir).select("o_custkey", "o_orderkey", F.concat(F.lit("see [S1] and [S"), n.cast("string"), F.lit("]")).alias("body"), n.alias("n"))
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).select("o_orderkey", K.renumber(F.col("body"), F.col("off")).alias("body"))


@query("c10_source_references", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '1,' || (1 + o_orderkey % 3) END AS refs FROM orders")
def c10(spark, sf_dir):
    body = F.concat(F.lit("x [S1] y [S"), (1 + F.col("o_orderkey") % 3).cast("string"), F.lit("] [S1]"))
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\[S(\d+)\]"), F.lit(1)).cast("array<int>")))
    return orders(spark, sf_dir).select("o_orderkey", F.array_join(refs.cast("array<string>"), ",").alias("refs"))


_EXC = """it AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 50 = 7 THEN work_id + 1000 ELSE work_id END AS work_id, doc_id * 100000000 + 3 AS s, (doc_id + doc_id % 4) * 100000000 + CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 6 END AS e FROM docs),
pc AS (SELECT id, work_id, (parent_id - 10000) * 100000000 + start_line AS a, (parent_id - 10000) * 100000000 + end_line AS b, content, heading_breadcrumbs FROM leaves
  UNION ALL SELECT id, work_id, (id - 10000) * 100000000 + start_line, (id - 10000) * 100000000 + end_line, content, heading_breadcrumbs FROM headings WHERE level = 'H3')"""


@query("c11_excerpt_range", C.sql("""SELECT item_id, CASE WHEN max(w.work_id) IS NULL THEN 'Source work deleted.' WHEN count(pc.id) = 0 THEN 'Excerpt content not found.' ELSE string_agg(content, chr(10) || chr(10) ORDER BY a, id) END AS content,
  CASE WHEN max(w.work_id) IS NOT NULL THEN arg_min(heading_breadcrumbs, (a, id)) END AS heading_breadcrumbs, CASE WHEN max(w.work_id) IS NOT NULL THEN left(string_agg(content, chr(10) || chr(10) ORDER BY a, id), 2000) END AS preview
  FROM it LEFT JOIN works w USING (work_id) LEFT JOIN pc ON pc.work_id = it.work_id AND a >= s AND b <= e GROUP BY 1""", _EXC))
def c11(spark, sf_dir):
    """Excerpt links of collections, ranges of lines of a work: the rest of a document, up to three further ones with it, and works that are gone. A document's lines follow those of all with smaller ids."""
    far = 100_000_000
    d = C.documents(spark, sf_dir)
    items = d.select(
        F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 50 == 7, F.col("work_id") + 1000).otherwise(F.col("work_id")).alias("work_id"), (F.col("doc_id") * far + 3).alias("range_start"),
        ((F.col("doc_id") + F.col("doc_id") % 4) * far + F.when(F.col("doc_id") % 9 == 0, 2).otherwise(6)).alias("range_end"))
    at = lambda df, doc: df.withColumns({c: doc * far + F.col(c) for c in ("start_line", "end_line")}).select("id", "work_id", "start_line", "end_line", "content", "heading_breadcrumbs")
    pieces = at(C.leaves(spark, sf_dir), F.col("parent_id") - 10000).unionAll(at(C.headings(spark, sf_dir).where("level = 'H3'"), F.col("id") - 10000))
    return S.excerpts(items, C.works(spark, sf_dir), pieces, width=far)


@query("c12_containment_dedup")
def c12(spark, sf_dir):
    """The turns of each conversation (a few dozen at most)."""
    return K.without_contained(C.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("id"), F.col("text").alias("content")).where("content is not null"))


@query("c13_token_limit", r"SELECT doc_id, CASE WHEN len(w) <= 150 THEN text ELSE array_to_string(w[1:150], ' ') END AS text FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)")
def c13(spark, sf_dir):
    """Texts cut to 200 tokens by the words-based estimate (three words are four tokens)."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return docs(spark, sf_dir).select("doc_id", F.when(F.size(w) <= 150, F.col("text")).otherwise(F.array_join(F.slice(w, 1, 150), " ")).alias("text"))


@query("c14_source_attribution", C.sql("SELECT id, title || ' (' || year || ')' AS source FROM headings JOIN works USING (work_id)"))
def c14(spark, sf_dir):
    return C.headings(spark, sf_dir).join(C.works(spark, sf_dir), "work_id").select("id", F.concat("title", F.lit(" ("), F.col("year").cast("string"), F.lit(")")).alias("source"))


_ITEM = r"""it AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'excerpt' WHEN 1 THEN 'research_result' ELSE 'research_query' END AS kind, CASE WHEN event_id % 3 = 0 THEN event_id % 100 END AS work, CASE WHEN event_id % 3 = 1 AND user_id % 2 = 0 THEN user_id END AS result, CASE WHEN event_id % 3 = 2 THEN event_id END AS query, user_id FROM events),
found AS (SELECT it.*, coalesce(w.title, r.text, q.text) AS content FROM it LEFT JOIN works w ON w.work_id = it.work LEFT JOIN documents r ON r.doc_id = it.result LEFT JOIN benchmark q ON q.item_id = it.query),
words AS (SELECT *, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS ws FROM found)"""


def items_found(spark, sf_dir):
    """Collection items with what their links lead to: a work's title, a document, a question; null where it is gone."""
    x = parsed_links(spark, sf_dir)
    w = C.works(spark, sf_dir).select(F.col("work_id").alias("_w"), "title")
    r = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_r"), F.col("text").alias("_rt"))
    q = C.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("_q"), F.col("text").alias("_qt"))
    x = x.join(w, F.col("work") == F.col("_w"), "left").join(r, F.col("result") == F.col("_r"), "left").join(q, (F.col("query") == F.col("_q")) & (F.col("kind") == "research_query"), "left")
    return x.withColumn("content", F.coalesce("title", "_rt", "_qt"))


@query("c15_item_metadata", C.sql("SELECT event_id, kind, CASE WHEN content IS NULL THEN 'Source Deleted' WHEN len(ws) <= 75 THEN content ELSE array_to_string(ws[1:75], ' ') || '...' END AS preview FROM words", _ITEM))
def c15(spark, sf_dir):
    return items_found(spark, sf_dir).select("event_id", "kind", F.coalesce(X.truncate_words(F.col("content"), 75), F.lit("Source Deleted")).alias("preview"))


@query("c16_collection_analysis", C.sql("SELECT user_id, kind, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS items, md5(string_agg(coalesce(substr(content, 1, 2000), 'deleted'), chr(10) ORDER BY event_id)) AS previews FROM found GROUP BY 1, 2", _ITEM))
def c16(spark, sf_dir):
    """Per collection (a user's items) and type: how many, which in order, and the first 2000 characters of each."""
    p = F.array_sort(F.collect_list(F.struct("event_id", F.coalesce(F.substring("content", 1, 2000), F.lit("deleted")).alias("t"))))
    g = items_found(spark, sf_dir).groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("n"), p.alias("p"))
    return g.select("user_id", "kind", "n", F.array_join(F.transform("p", lambda s: s["event_id"].cast("string")), ",").alias("items"), F.md5(F.array_join(F.transform("p", lambda s: s["t"]), "\n").cast("binary")).alias("previews"))


@query("c17_parse_links", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 100 END AS work, CASE WHEN event_id % 3 = 0 THEN user_id END AS start_line, CASE WHEN event_id % 3 = 0 THEN user_id + 5 END AS end_line, CASE WHEN event_id % 3 = 1 AND user_id % 2 = 0 OR event_id % 3 = 2 THEN event_id END AS query, CASE WHEN event_id % 3 = 1 AND user_id % 2 = 0 THEN user_id END AS result FROM events")
def c17(spark, sf_dir):
    return parsed_links(spark, sf_dir).select("event_id", "work", "start_line", "end_line", "query", "result")


def parsed_links(spark, sf_dir):
    """Excerpts to (work, start_line, end_line), results to (query, result), queries to (query); nulls where the link hasn't its type's shape."""
    part = lambda kind, i: F.when(F.col("kind") == kind, F.nullif(F.regexp_extract("link", LINKS[kind], i), F.lit("")).cast("long"))
    return items_with_links(spark, sf_dir).select(
        "event_id", "user_id", "kind", part("excerpt", 1).alias("work"), part("excerpt", 2).alias("start_line"), part("excerpt", 3).alias("end_line"),
        F.coalesce(part("research_result", 1), part("research_query", 1)).alias("query"), part("research_result", 2).alias("result"))


@query("h3_truncate_around")
def h3(spark, sf_dir):
    """A window of 120 words around characters 60 to 140 of each document."""
    return docs(spark, sf_dir).where("text is not null").select("doc_id", K.truncate_around(F.col("text"), F.lit(60), F.lit(140), F.lit(120)).alias("text"))
