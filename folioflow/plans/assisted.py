"""Queries of what models do (T41, T42, T48, T49, T54), with offline stand-ins, and of the whole retrieval pipeline (R, G, H, M, C in one plan; C7, C8)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from folioflow.operators import external, retrieval, suggestions
from folioflow.operators import structure as S
from folioflow.plans import corpus as C
from folioflow.plans.hierarchy import MD_SQL, md_lines
from folioflow.plans.predicates import docs, part
from folioflow.registry import query

TEMPLATE = "Intent: {intent}\nEntities: {entities}\nSources:\n{context}\nQuestion: {question}"


def questions(spark, sf_dir):
    return C.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.trim("text").alias("q"))


def expanded(spark, sf_dir):
    return retrieval.expand_queries(questions(spark, sf_dir), external.offline_expander)


@query("t42_query_expansion", r"""WITH w AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY length(word) DESC, word) AS rn FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[^\s]+')) AS word FROM benchmark))
SELECT item_id AS query_id, 2 AS n, 'what is ' || trim(text) AS first, trim(text) || ' is described here.' AS hyde_answer, 'DEFINITION' AS intent, string_agg(word, ',' ORDER BY rn) AS entities, NULL::VARCHAR AS error FROM benchmark JOIN w USING (item_id) WHERE rn <= 2 GROUP BY item_id, text""")
def t42(spark, sf_dir):
    return expanded(spark, sf_dir).select("query_id", F.size("queries").alias("n"), F.get("queries", F.lit(0)).alias("first"), "hyde_answer", "intent", F.array_join("entities", ",").alias("entities"), "error")


@query("t41_query_vectors", "SELECT item_id AS query_id, CAST(i AS INT) AS list_id, CASE i WHEN 0 THEN 'original' WHEN 3 THEN 'hyde' ELSE 'mqe' END AS kind, CASE i WHEN 0 THEN trim(text) WHEN 1 THEN 'what is ' || trim(text) WHEN 2 THEN 'how does ' || trim(text) || ' work' ELSE trim(text) || ' is described here.' END AS text, 64 AS size, 'vec' AS vector_status FROM benchmark, range(4) AS r(i)")
def t41(spark, sf_dir):
    v = retrieval.vectorise_queries(expanded(spark, sf_dir), external.hashing_embedder)
    return v.select("query_id", "list_id", "kind", "text", F.size("embedding").alias("size"), "vector_status")


def offline_citation(prompts: list[str]) -> list[str]:
    """Reads `Author. (year). Title.`"""
    out = []
    for p in prompts:
        author, _, rest = p.rsplit("Citation: ", 1)[-1].partition(". (")
        year, _, title = rest.partition("). ")
        out.append(f"Here it is:\n```json\n{json.dumps({'title': title.rstrip('.'), 'authors': [author], 'year': int(year), 'work_type': 'book'})}\n```" if year.isdigit() else "I can't.")
    return out


@query("t48_citations", "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_size >= 10 THEN p_name END AS title, CASE WHEN p_partkey % 5 <> 0 AND p_size >= 10 THEN p_brand END AS author, CASE WHEN p_partkey % 5 <> 0 AND p_size >= 10 THEN 100 * p_size END AS year, CASE WHEN p_partkey % 5 = 0 THEN 'unknown format' WHEN p_size < 10 THEN 'year out of range' END AS error FROM part")
def t48(spark, sf_dir):
    text = F.concat("p_brand", F.lit(". ("), (F.col("p_size") * 100).cast("string"), F.lit("). "), "p_name", F.lit("."))
    asked = part(spark, sf_dir).select("p_partkey", text.alias("citation"), F.when(F.col("p_partkey") % 5 == 0, "Harvard").otherwise("APA").alias("format"))
    return suggestions.citations(asked, offline_citation).select("p_partkey", "title", F.get("authors", F.lit(0)).alias("author"), "year", "error")


def offline_toc(prompts: list[str]) -> list[str]:
    """The first three lines, one level deeper each."""
    lines = [p.split("---\n", 1)[1].split("\n")[:3] for p in prompts]
    return [json.dumps([{"level": i + 1, "title": t} for i, t in enumerate(x)], ensure_ascii=False) for x in lines]


@query("t48_table_of_contents", "SELECT doc_id, CAST(i - 1 AS INT) AS pos, CAST(i AS INT) AS level, trim(l[i]) AS title FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, 4)) AS u(i) WHERE i <= len(l) AND trim(l[i]) <> ''")
def t48_toc(spark, sf_dir):
    return suggestions.tables_of_contents(docs(spark, sf_dir).where("text is not null"), offline_toc)


def offline_changes(prompts: list[str]) -> list[str]:
    """Headings of even lines become level 2, others go; one line too many."""
    out = []
    for p in prompts:
        said = ["9999999 : H1 : no such line", "some remark"]
        for x in p.split("Headings:\n", 1)[1].split("\n"):
            n, _, title = x.partition(": ")
            said.append(f"{n} : H2 : {title.lstrip('#').strip()}" if int(n) % 2 == 0 else f"{n} : REMOVE : ")
        out.append("```\n" + "\n".join(said) + "\n```")
    return out


@query("t49_heading_changes", C.sql("SELECT doc_id, CAST(line AS INT) AS line, CASE WHEN line % 2 = 0 THEN 'H2' ELSE 'REMOVE' END AS action, CASE WHEN line % 2 = 0 THEN title ELSE '' END AS title FROM hd", MD_SQL.strip()))
def t49(spark, sf_dir):
    h = S.parse_headings(md_lines(spark, sf_dir))
    return suggestions.heading_changes(h, offline_changes, h.select("doc_id", F.col("line").alias("pos"), "level", "title").where("level <= 2"))


def offline_rewrite(prompts: list[str]) -> list[str]:
    texts = [p.split("---\n", 1)[1] for p in prompts]
    return [json.dumps({"bibliographic": {"title": f"T{len(t)}", "authors": ["A", "B"], "year": 2001}, "sanitized_markdown": t + "\nend", "toc": [{"level": 1, "title": "x"}]}, ensure_ascii=False) for t in texts]


@query("t54_rewrite", "SELECT doc_id, CASE WHEN short THEN 'T' || length(text) END AS title, CASE WHEN short THEN 'A, B' END AS authors, CASE WHEN short THEN 2001 END AS year, CASE WHEN short THEN 1 ELSE 0 END AS entries, sha256(CASE WHEN short THEN text || chr(10) || 'end' ELSE text END) AS content_hash, CASE WHEN NOT short THEN 'too many lines' END AS error FROM (SELECT *, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) <= 12 AS short FROM documents)")
def t54(spark, sf_dir):
    out = suggestions.rewritten(docs(spark, sf_dir).where("text is not null"), offline_rewrite, most_lines=12)
    return out.select("doc_id", "title", "authors", "year", F.size("toc").alias("entries"), "content_hash", "error")


def embedded(spark, sf_dir):
    """Documents as chunks with the embedding that the queries get too, and the headings above them."""
    c = C.headings(spark, sf_dir).withColumn("dense_lexical_use", F.col("level") == "H3")  # without the join of given vectors, which would move all texts
    return external.with_embedding(c, "content", external.hashing_embedder)


@query("retrieval_pipeline")
def retrieval_pipeline(spark, sf_dir):
    """Questions to prompts: expansion, dense and lexical lists, fusion, enrichment, reranking, boosts, diversity, consolidation, context blocks."""
    asked, chunks = expanded(spark, sf_dir), embedded(spark, sf_dir)
    found = retrieval.consolidated(retrieval.retrieve(asked, chunks), chunks)
    works = C.works(spark, sf_dir)
    return retrieval.augmented_prompts(asked, found, works, TEMPLATE)


@query("c7_section_contexts")
def c7(spark, sf_dir):
    """Sections of longer answers, each retrieved for and consolidated by itself."""
    sections = questions(spark, sf_dir).select(F.col("query_id").alias("section_id"), F.concat(F.lit("background of "), "q").alias("prompt"))
    out = retrieval.sections_of(sections, embedded(spark, sf_dir), external.offline_expander)
    return out.select("section_id", F.array_join("ids", ",").alias("ids"), "work_id", "level_up", "start_line", "end_line", "score")
