"""Queries of projections, filters and derived flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.plans import corpus as C
from folioflow.registry import query


def _t(name):
    return lambda spark, sf_dir: C.table(spark, sf_dir, name)


docs, events, part, orders, customer, lineitem = map(_t, ("documents", "events", "part", "orders", "customer", "lineitem"))


@query("f1_level_in", C.sql("SELECT id, level FROM chunks WHERE level IN ('H1','H2','H3','H4','H5')"))
def f1(spark, sf_dir):
    return C.chunks(spark, sf_dir).where(F.col("level").isin("H1", "H2", "H3", "H4", "H5")).select("id", "level")


@query("f2_not_chunk_level", C.sql("SELECT id, level FROM chunks WHERE level NOT LIKE '%-chunk%'"))
def f2(spark, sf_dir):
    return C.chunks(spark, sf_dir).where(~F.col("level").contains("-chunk")).select("id", "level")


@query("f3_backfill_use_flag", C.sql("SELECT id, level LIKE '%chunk%' OR dense_lexical_use AS dense_lexical_use FROM chunks"))
def f3(spark, sf_dir):
    return C.chunks(spark, sf_dir).select("id", F.when(F.col("level").like("%chunk%"), True).otherwise(F.col("dense_lexical_use")).alias("dense_lexical_use"))


@query("f4_minimum_length", r"SELECT doc_id, length(text) >= 250 AND len(regexp_extract_all(text, '[^\s]+')) >= 150 AS long_enough FROM documents")
def f4(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", ((F.length("text") >= 250) & (X.count_words(F.col("text")) >= 150)).alias("long_enough"))


@query("f5_vectorisation_eligible", C.sql("SELECT id FROM chunks WHERE vector_status = 'to_vec' AND parent_id IS NOT NULL AND embedding IS NULL"))
def f5(spark, sf_dir):
    return C.chunks(spark, sf_dir).where("vector_status = 'to_vec' and parent_id is not null and embedding is null").select("id")


@query("f6_corpus_membership", "SELECT o_orderkey, o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice > 100000 AND o_custkey % 2 = 0) AS in_corpus FROM orders")
def f6(spark, sf_dir):
    """Complete, or content and heading steps completed and a sanitized file there: a map of statuses looked up by key."""
    status = F.create_map(F.lit("step"), F.when(F.col("o_orderstatus") == "F", "complete"), F.lit("content"), F.when(F.col("o_orderstatus") == "O", "completed"), F.lit("heading"), F.when(F.col("o_totalprice") > 100000, "completed"))
    files = F.when(F.col("o_custkey") % 2 == 0, F.create_map(F.lit("sanitized"), F.lit("path"))).otherwise(F.create_map(F.lit("original"), F.lit("path")))
    o = orders(spark, sf_dir).select("o_orderkey", status.alias("s"), files.alias("f"))
    done = lambda k, v: F.coalesce(F.col("s")[k] == v, F.lit(False))
    return o.select("o_orderkey", (done("step", "complete") | (done("content", "completed") & done("heading", "completed") & F.map_contains_key("f", "sanitized"))).alias("in_corpus"))


@query("f7_ilike_any", "SELECT p_partkey FROM part WHERE p_name ILIKE 'COLD%' OR p_type ILIKE '%promo%'")
def f7(spark, sf_dir):
    return part(spark, sf_dir).where(F.col("p_name").ilike("COLD%") | F.col("p_type").ilike("%promo%")).select("p_partkey")


@query("f8_json_key_exists", "SELECT event_id FROM events WHERE list_contains(json_keys(props), 'k')")
def f8(spark, sf_dir):
    return events(spark, sf_dir).where(F.array_contains(F.json_object_keys("props"), "k")).select("event_id")


@query("f9_array_contains", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'cold') OR list_contains(string_split(p_name, ' '), 'bolt')")
def f9(spark, sf_dir):
    tags = F.split("p_name", " ")
    return part(spark, sf_dir).where(F.array_contains(tags, "cold") | F.array_contains(tags, "bolt")).select("p_partkey")


@query("f10_heading_word_filter", C.sql(r"SELECT id, CAST(len(regexp_extract_all(content, '[^\s]+')) AS INT) AS words FROM headings WHERE len(regexp_extract_all(content, '[^\s]+')) >= 500"))
def f10(spark, sf_dir):
    return C.headings(spark, sf_dir).select("id", X.count_words(F.col("content")).alias("words")).where("words >= 500")


@query("f11_quality_filter", "SELECT vec_id, CASE WHEN vec_id % 100 > 90 THEN 'high' WHEN vec_id % 100 > 75 THEN 'good' ELSE 'low' END AS band FROM embeddings")
def f11(spark, sf_dir):
    q = F.col("vec_id") % 100
    return C.table(spark, sf_dir, "embeddings").select("vec_id", F.when(q > 90, "high").when(q > 75, "good").otherwise("low").alias("band"))


@query("f12_query_status", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'needs_embeddings' WHEN value < 20 THEN 'needs_retrieval' WHEN value < 50 THEN 'needs_consolidation' ELSE 'ready' END AS status FROM events")
def f12(spark, sf_dir):
    s = F.when(F.col("event_type") == "view", "needs_embeddings").when(F.col("value") < 20, "needs_retrieval").when(F.col("value") < 50, "needs_consolidation").otherwise("ready")
    return events(spark, sf_dir).select("event_id", s.alias("status"))


@query("f13_history_status", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value IS NULL THEN 'pending' ELSE 'complete' END AS status, CASE WHEN event_type = 'error' THEN coalesce(props, 'unknown') END AS error FROM events")
def f13(spark, sf_dir):
    err = F.col("event_type") == "error"
    return events(spark, sf_dir).select("event_id", F.when(err, "failed").when(F.col("value").isNull(), "pending").otherwise("complete").alias("status"), F.when(err, F.coalesce("props", F.lit("unknown"))).alias("error"))


#: The links of collection items by type.
LINKS = {"excerpt": r"^/search/result/(\d+)/(\d+)/(\d+)$", "research_result": r"^/rag/(\d+)/results/(\d+)$", "research_query": r"^/rag/(\d+)$"}


def valid_link(item_type, link):
    """Column: does the link have its type's shape?"""
    out = F.lit(False)
    for kind, pattern in LINKS.items():
        out = F.when(item_type == kind, link.rlike(pattern)).otherwise(out)
    return out


def items_with_links(spark, sf_dir):
    """(event_id, user_id, kind, link): collection items of all three types, some with a wrong link."""
    e, s = events(spark, sf_dir), lambda c: c.cast("string")
    n, u = s(F.col("event_id")), s(F.col("user_id"))
    kind = F.when(F.col("event_id") % 3 == 0, "excerpt").when(F.col("event_id") % 3 == 1, "research_result").otherwise("research_query")
    link = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/search/result/"), s(F.col("event_id") % 100), F.lit("/"), u, F.lit("/"), s(F.col("user_id") + 5)))
    link = link.when(F.col("event_id") % 3 == 1, F.concat(F.lit("/rag/"), n, F.when(F.col("user_id") % 2 == 0, "/results/").otherwise("/result/"), u)).otherwise(F.concat(F.lit("/rag/"), n))
    return e.select("event_id", "user_id", kind.alias("kind"), link.alias("link"))


@query("f14_link_validation", "SELECT event_id, event_id % 3 = 1 AND user_id % 2 = 0 OR event_id % 3 <> 1 AS valid FROM events")
def f14(spark, sf_dir):
    return items_with_links(spark, sf_dir).select("event_id", valid_link(F.col("kind"), F.col("link")).alias("valid"))


@query("f15_score_validation", "SELECT doc_id, quality * 12 - 6 AS score, abs(quality * 12 - 6) <= 10 AS in_range, toxic = 0 AS complete FROM labels")
def f15(spark, sf_dir):
    """A score must be in -10..10 and every wanted dimension there, no other."""
    want = F.array(F.lit("completeness"), F.lit("coherence"))
    have = F.when(F.col("toxic") == 0, want).otherwise(F.array(F.lit("completeness"), F.lit("style")))
    bad = (F.size(F.array_except(want, have)) > 0) | (F.size(F.array_except(have, want)) > 0)
    s = F.col("quality") * 12 - 6
    return C.table(spark, sf_dir, "labels").select("doc_id", s.alias("score"), (F.abs(s) <= 10).alias("in_range"), (~bad).alias("complete"))


@query("f16_classify_document", r"SELECT doc_id, CASE WHEN CAST(trunc(len(regexp_extract_all(text, '[^\s]+')) / 0.75) AS INT) < 1500 THEN 'small' ELSE 'large' END AS size_class FROM documents")
def f16(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.when(X.tokens_by_ratio(X.count_words(F.col("text"))) < 1500, "small").otherwise("large").alias("size_class"))


@query("f17_work_label", C.sql("SELECT work_id, CASE WHEN n_docs > 50 THEN 'Automatic' ELSE 'Standard' END AS label FROM works"))
def f17(spark, sf_dir):
    return C.works(spark, sf_dir).select("work_id", F.when(F.col("n_docs") > 50, "Automatic").otherwise("Standard").alias("label"))


#: Retrieval and consolidation defaults of the standard preset.
PRESET = {
    "retrieval": {"dense_limit": 19, "lexical_limit": 5, "rrf_k": 50, "top_k_rrf": 75, "top_n_final": 17, "entity_boost": 0.05, "min_word_count": 150, "max_word_count": 750, "mmr_lambda": 0.7},
    "consolidation": {"coverage_threshold": 0.5, "line_gap": 7, "min_content_length": 350},
    "augmentation": {"top_n_contexts": 5},
}


def resolve(section: str, key: str, argument=None, config: dict | None = None, deprecated=None, default=None):
    """A parameter: argument, else configuration, else its deprecated name's value, else the default (the preset's)."""
    for v in (argument, (config or {}).get(section, {}).get(key), deprecated, default, PRESET.get(section, {}).get(key)):
        if v is not None:
            return v
    return None


@query("f18_parameter_resolution", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey WHEN o_orderkey % 3 = 0 THEN 7 WHEN o_orderkey % 5 = 0 THEN length(o_orderpriority) ELSE 50 END AS rrf_k FROM orders")
def f18(spark, sf_dir):
    """A parameter for every row: its own argument, else the configuration that its requester has, else the deprecated name's value, else the preset's."""
    k = F.col("o_orderkey")
    mine, deprecated = F.when(k % 2 == 0, F.col("o_custkey")), F.when(k % 5 == 0, F.length("o_orderpriority"))
    config = F.when(k % 3 == 0, resolve("retrieval", "rrf_k", config={"retrieval": {"rrf_k": 7}}))
    return orders(spark, sf_dir).select("o_orderkey", F.coalesce(mine, config, deprecated, F.lit(resolve("retrieval", "rrf_k"))).alias("rrf_k"))


@query("f19_chunk_title", C.sql(r"SELECT id, coalesce(nullif(trim(regexp_replace(split_part(content, chr(10), 1), '^#+', '')), ''), 'Untitled') AS title FROM chunks WHERE level <> 'H2'"))
def f19(spark, sf_dir):
    """Last breadcrumb if stored as JSON, else the first line without marks, else Untitled."""
    from_json = F.element_at(F.from_json("heading_breadcrumbs", "array<string>"), -1)
    first = F.nullif(F.trim(F.regexp_replace(F.split_part("content", F.lit("\n"), F.lit(1)), "^#+", "")), F.lit(""))
    return C.chunks(spark, sf_dir).where("level != 'H2'").select("id", F.coalesce(from_json, first, F.lit("Untitled")).alias("title"))


@query("f20_summary_heading", C.sql(r"SELECT id, CASE WHEN content LIKE '#%' THEN trim(regexp_replace(split_part(content, chr(10), 1), '^#+', '')) ELSE split_part(heading_breadcrumbs, ' > ', -1) END AS heading FROM chunks"))
def f20(spark, sf_dir):
    first = F.trim(F.regexp_replace(F.split_part("content", F.lit("\n"), F.lit(1)), "^#+", ""))
    return C.chunks(spark, sf_dir).select("id", F.when(F.col("content").startswith("#"), first).otherwise(F.split_part("heading_breadcrumbs", F.lit(" > "), F.lit(-1))).alias("heading"))


@query("f21_works_with_file", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey")
def f21(spark, sf_dir):
    files = F.when(F.col("o_custkey") % 2 == 0, F.create_map(F.lit("sanitized"), F.lit("p"))).otherwise(F.create_map(F.lit("original"), F.lit("p")))
    return orders(spark, sf_dir).withColumn("files", files).where(F.map_contains_key("files", "sanitized")).orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate")


@query("f22_file_status", "SELECT d.doc_id, CASE WHEN o.doc_id IS NULL THEN 'missing' WHEN o.text = d.text THEN 'match' ELSE 'changed' END AS status FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' ' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0) o USING (doc_id)")
def f22(spark, sf_dir):
    d = docs(spark, sf_dir)
    disk = d.where("doc_id % 5 != 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("now"))
    j = d.select("doc_id", F.sha2("text", 256).alias("stored")).join(disk, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("stored"), "match").otherwise("changed").alias("status"))
