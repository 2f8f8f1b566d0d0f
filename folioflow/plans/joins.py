"""Queries of every join kind and of the set operations (J1-J17, 2.10). Spark chooses the physical join; sizes decide broadcasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import structure as S
from folioflow.operators import patterns, search
from folioflow.plans import corpus as C
from folioflow.plans.hierarchy import MD_SQL, md_lines
from folioflow.plans.predicates import customer, docs, events, lineitem, orders, part
from folioflow.registry import query

def _n():
    return F.count(F.lit(1))


@query("j1_chunk_work", C.sql("SELECT id, title, year FROM headings JOIN works USING (work_id)"))
def j1(spark, sf_dir):
    return C.headings(spark, sf_dir).join(C.works(spark, sf_dir), "work_id").select("id", "title", "year")


@query("j2_three_way", "SELECT c_mktsegment, l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def j2(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_custkey").join(customer(spark, sf_dir).select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    j = lineitem(spark, sf_dir).select("l_orderkey", "l_returnflag", "l_extendedprice").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("c_mktsegment", "l_returnflag").agg(_n().alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("j3_summary_chunk", C.sql("SELECT h.id, d.doc_id, d.n_chars FROM headings h JOIN documents d ON h.id = d.doc_id + 10000 ORDER BY h.id"))
def j3(spark, sf_dir):
    h = C.headings(spark, sf_dir).select("id")
    return h.join(docs(spark, sf_dir), F.col("id") == F.col("doc_id") + 10000).select("id", "doc_id", "n_chars").orderBy("id")


@query("j4_left_coalesce", "SELECT c_custkey, coalesce(o_orderstatus, 'Unspecified') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def j4(spark, sf_dir):
    return customer(spark, sf_dir).join(orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderstatus", F.lit("Unspecified")).alias("status"))


@query("j5_left_chain", "SELECT r_name, count(n_nationkey) AS nations, count(c_custkey) AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def j5(spark, sf_dir):
    t = lambda n: C.table(spark, sf_dir, n)
    j = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("r_name").agg(F.count("n_nationkey").alias("nations"), F.count("c_custkey").alias("customers"))


@query("j6_exists_flag", "SELECT d.doc_id, l.doc_id IS NOT NULL AS evaluated FROM documents d LEFT JOIN labels l USING (doc_id)")
def j6(spark, sf_dir):
    lab = C.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")).distinct()
    return docs(spark, sf_dir).join(lab, F.col("doc_id") == F.col("k"), "left").select("doc_id", F.col("k").isNotNull().alias("evaluated"))


@query("j7_eager_load", "SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j7(spark, sf_dir):
    items = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("string")), ",").alias("parts"))
    return orders(spark, sf_dir).join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "parts")


@query("j8_semi", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j8(spark, sf_dir):
    return part(spark, sf_dir).join(lineitem(spark, sf_dir).where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("j9_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j9(spark, sf_dir):
    return customer(spark, sf_dir).join(orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j10_full_outer", "SELECT coalesce(d.doc_id, e.vec_id) AS id, d.doc_id IS NOT NULL AS has_text, e.vec_id IS NOT NULL AS has_vector FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d FULL JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) e ON d.doc_id = e.vec_id")
def j10(spark, sf_dir):
    d = docs(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id")
    e = C.table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select("vec_id")
    return d.join(e, F.col("doc_id") == F.col("vec_id"), "full").select(F.coalesce("doc_id", "vec_id").alias("id"), F.col("doc_id").isNotNull().alias("has_text"), F.col("vec_id").isNotNull().alias("has_vector"))


@query("j11_parent_self_join", C.sql("SELECT c.id, p.id AS parent, g.id AS grandparent FROM headings c JOIN headings p ON c.parent_id = p.id LEFT JOIN headings g ON p.parent_id = g.id"))
def j11(spark, sf_dir):
    h = C.headings(spark, sf_dir).select("id", "parent_id")
    p, g = h.toDF("parent", "pp"), h.select(F.col("id").alias("grandparent"))
    return h.join(p, F.col("parent_id") == F.col("parent")).join(g, F.col("pp") == F.col("grandparent"), "left").select("id", "parent", "grandparent")


@query("j12_range_join", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber BETWEEN a.l_linenumber - 1 AND a.l_linenumber + 1 GROUP BY 1, 2")
def j12(spark, sf_dir):
    x = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber")
    y = x.toDF("k", "n2")
    return x.join(y, (F.col("l_orderkey") == F.col("k")) & F.col("n2").between(F.col("l_linenumber") - 1, F.col("l_linenumber") + 1)).groupBy("l_orderkey", "l_linenumber").agg(_n().alias("n"))


@query("j13_as_of", C.sql("SELECT m.doc_id, CAST(m.line AS INT) AS line, h.title FROM md m ASOF JOIN hd h ON m.doc_id = h.doc_id AND m.line > h.line", MD_SQL.strip()))
def j13(spark, sf_dir):
    x = md_lines(spark, sf_dir)
    h = S.parse_headings(x).select("doc_id", F.col("line").alias("heading_line"), "title")
    return S.heading_of_lines(x).join(h, ["doc_id", "heading_line"]).select("doc_id", "line", "title")


_COS = "round(coalesce(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 0), 6)"


@query("j14_theta_similarity", f"WITH {C.queries_sql()} SELECT query_id, vec_id, {_COS} AS similarity FROM qv JOIN embeddings ON query_id <> vec_id AND {_COS} > 0.85")
def j14(spark, sf_dir):
    """Queries and vectors with a cosine over .85: the stated queries against all."""
    e = C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.above(C.query_vectors(spark, sf_dir), e, 0.85).where("query_id != id").select("query_id", F.col("id").alias("vec_id"), "similarity")


@query("j15_queries_by_chunks", C.sql(f"SELECT query_id, id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rank FROM (SELECT query_id, id, {_COS} AS similarity FROM qv, chunks WHERE embedding IS NOT NULL) QUALIFY rank <= 3", C.queries_sql()))
def j15(spark, sf_dir):
    """Every query with every chunk, the three best kept where they are met."""
    return search.nearest(C.query_vectors(spark, sf_dir), C.chunks(spark, sf_dir).where("embedding is not null"), 3).select("query_id", "id", "similarity", "rank")


@query("j16_containment", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def j16(spark, sf_dir):
    """All needles (the benchmark) against all texts, each read once."""
    needles = C.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    return patterns.containments(docs(spark, sf_dir).select("doc_id", "text"), needles).select(F.col("needle_id").alias("item_id"), "doc_id")


@query("j17_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j17(spark, sf_dir):
    t = lambda n: C.table(spark, sf_dir, n)
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return customer(spark, sf_dir).select(F.col("c_nationkey").alias("k")).union(C.table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").subtract(C.table(spark, sf_dir, "labels").select("doc_id"))


@query("set_intersection", "SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def set_intersection(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").intersect(C.table(spark, sf_dir, "embeddings").select("vec_id"))


@query("set_union_all", "SELECT event_type AS k, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT role FROM conversations) GROUP BY 1")
def set_union_all(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_type").alias("k")).unionAll(C.table(spark, sf_dir, "conversations").select("role")).groupBy("k").agg(_n().alias("n"))


@query("set_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def set_distinct(spark, sf_dir):
    return lineitem(spark, sf_dir).select("l_returnflag", "l_linestatus").distinct()
