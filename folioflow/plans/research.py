"""Queries of research scoring and structure scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import research as R
from folioflow.operators import structure as S
from folioflow.plans import corpus as C
from folioflow.plans.hierarchy import MD_SQL, md_lines, totals
from folioflow.plans.predicates import docs
from folioflow.registry import query
from folioflow.sources import files as IO

#: Sections: documents with citations put in by their number.
_SEC_SQL = r"""sec0 AS (SELECT doc_id, text || repeat(' [Smith 2001]', CAST(doc_id % 4 AS INT)) || repeat(' [Jones et al. 2010]', CAST(doc_id % 3 AS INT)) || CASE WHEN doc_id % 5 = 0 THEN ' [Brown 4567]' ELSE '' END AS text FROM documents),
sec1 AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^\s]+')) AS words, regexp_extract_all(text, '\[[A-Za-z\s]+(?:\set\sal\.)?\s\d{4}\]') AS c FROM sec0)"""


def sections(spark, sf_dir):
    t = F.concat("text", F.expr("repeat(' [Smith 2001]', cast(doc_id % 4 as int))"), F.expr("repeat(' [Jones et al. 2010]', cast(doc_id % 3 as int))"), F.when(F.col("doc_id") % 5 == 0, " [Brown 4567]").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", t.alias("text"))


_CL = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {}))"
_DENS, _COMP, _DIV = _CL.format("coalesce(len(c) * 50.0::DOUBLE / nullif(words, 0), 0)"), _CL.format("words / 1000.0::DOUBLE"), _CL.format("len(list_distinct(c)) / 5.0::DOUBLE")


@query("g11_quality_score", f"WITH {_SEC_SQL} SELECT doc_id, CASE WHEN words = 0 THEN 0 ELSE round(0.4::DOUBLE * {_DENS} + 0.2::DOUBLE * {_CL.format('1 - (doc_id % 200) / 180.0::DOUBLE')} + 0.15::DOUBLE * {_COMP} + 0.15::DOUBLE * {_DIV} + 0.1::DOUBLE * CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.5 END, 6) END AS quality FROM sec1")
def g11(spark, sf_dir):
    as_of = F.lit("2025-01-01").cast("date")
    made = F.date_sub(as_of, (F.col("doc_id") % 200).cast("int"))
    return sections(spark, sf_dir).select("doc_id", R.quality_score(F.col("text"), made, F.when(F.col("doc_id") % 2 == 0, "GPT-4-turbo").otherwise("tiny"), as_of).alias("quality"))


@query("g12_reuse_strategy", "WITH m AS (SELECT label AS k, vec_id % 37 AS q, (vec_id % 100) / 100.0::DOUBLE AS similarity, ((vec_id * 7) % 100) / 100.0::DOUBLE AS quality FROM embeddings), g AS (SELECT k, q, count(CASE WHEN quality > 0.75 THEN 1 END) AS n, max(CASE WHEN quality > 0.75 THEN similarity END) AS s FROM m GROUP BY 1, 2) SELECT k * 100 + q AS question, CASE n WHEN 0 THEN 'new_generation' WHEN 1 THEN CASE WHEN s > 0.9 THEN 'exact_reuse' WHEN s > 0.85 THEN 'partial_reuse' ELSE 'ensemble' END ELSE 'ensemble' END AS strategy FROM g")
def g12(spark, sf_dir):
    e = C.table(spark, sf_dir, "embeddings")
    m = e.select((F.col("label") * 100 + F.col("vec_id") % 37).alias("question"), ((F.col("vec_id") % 100) / F.lit(100.0)).alias("similarity"), ((F.col("vec_id") * 7 % 100) / F.lit(100.0)).alias("quality"))
    return R.reuse_strategy(m, "question")


_SRC_SQL = _SEC_SQL + r""",
srcs AS (SELECT doc_id, 'w' || (doc_id % 20) AS name, ['on memory', 'smith', 's1', '1'] AS keys FROM documents
  UNION ALL SELECT doc_id, 'item_' || (doc_id % 5 + 30), ['research result ' || (doc_id % 5 + 30), 'result ' || (doc_id % 5 + 30), 's2', '2'] FROM documents
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'w' || (doc_id % 20) ELSE 'w7' END, ['kim papers', 's3', '3'] FROM documents WHERE doc_id % 2 = 0),
div AS (SELECT doc_id, count(DISTINCT name) AS sources FROM srcs JOIN sec1 USING (doc_id) WHERE len(list_filter(c, lambda x: len(list_filter(keys, lambda k: contains(lower(x), k))) > 0)) > 0 GROUP BY 1),
brk AS (SELECT doc_id, len(list_filter(c, lambda x: len(list_filter(every, lambda k: contains(lower(x), k))) = 0)) AS broken FROM sec1 JOIN (SELECT doc_id, flatten(list(keys)) AS every FROM srcs GROUP BY 1) USING (doc_id))"""


def sourced(spark, sf_dir):
    """Sections with their citations and their sources: a work, a research result, and for even ids another work, which can be the same."""
    source = "array<struct<work_id: long, title: string, authors: string, type: string, item_id: long>>"
    k, none = F.col("doc_id"), F.lit(None)
    one = lambda *v: F.struct(*[x.alias(n) for n, x in zip(("work_id", "title", "authors", "type", "item_id"), v, strict=True)])
    first = one(k % 20, F.lit("On Memory"), F.lit("John Smith, A. Other"), F.lit("excerpt"), none.cast("long"))
    second = one(none.cast("long"), none.cast("string"), none.cast("string"), F.lit("research_result"), k % 5 + 30)
    third = one(F.when(k % 4 == 0, k % 20).otherwise(7).cast("long"), F.lit("Kim Papers"), F.lit(""), F.lit("excerpt"), none.cast("long"))
    both = F.array(first, second).cast(source)
    s = F.when(k % 2 == 0, F.concat(both, F.array(third).cast(source))).otherwise(both)
    return sections(spark, sf_dir).withColumns({"c": R.citations(F.col("text")), "s": s})


@query("g13_section_metadata", f"WITH {_SRC_SQL} SELECT doc_id, CAST(words AS INT) AS words, CAST(len(c) AS INT) AS citations, CAST(coalesce(sources, 0) AS INT) AS sources FROM sec1 LEFT JOIN div USING (doc_id)")
def g13(spark, sf_dir):
    """Words, citations, and how many different sources the citations name."""
    return sourced(spark, sf_dir).select("doc_id", X.count_words(F.col("text")).alias("words"), F.size("c").alias("citations"), R.source_diversity(F.col("c"), F.col("s")).alias("sources"))


_QUAL = f"""{_SRC_SQL}, qual AS (SELECT doc_id, words AS w, c, least(1.0::DOUBLE, len(c) / greatest(1, len(list_filter(regexp_split_to_array(text, '\\.\\s+'), lambda s: trim(s) <> '')))::DOUBLE) AS cov,
  coalesce(sources, 0) AS sources FROM sec1 LEFT JOIN div USING (doc_id)),
ql AS (SELECT *, CASE WHEN w > 800 AND cov > 0.5 THEN 'High' WHEN w > 400 AND cov > 0.3 THEN 'Medium' ELSE 'Low' END AS coherence FROM qual)"""


def judged(spark, sf_dir):
    """Sections with the counts that their quality is made of."""
    s = sourced(spark, sf_dir).select(
        "doc_id", X.count_words(F.col("text")).alias("words"), F.size("c").alias("citations"), R.count_sentences(F.col("text")).alias("sentences"), R.source_diversity(F.col("c"), F.col("s")).alias("sources"), F.size(R.broken_citations(F.col("c"), F.col("s"))).alias("broken"))
    return R.section_quality(s)


@query("g14_section_quality", f"WITH {_QUAL} SELECT doc_id, round(cov, 2) AS coverage, coherence, CASE WHEN sources >= 3 AND w > 600 THEN 'High' WHEN sources >= 1 AND w > 200 THEN 'Medium' ELSE 'Low' END AS completeness FROM ql")
def g14(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", "coverage", "coherence", "completeness")


@query("g15_broken_citations", f"WITH {_SRC_SQL} SELECT doc_id, CAST(broken AS INT) AS broken FROM brk")
def g15(spark, sf_dir):
    return sourced(spark, sf_dir).select("doc_id", F.size(R.broken_citations(F.col("c"), F.col("s"))).alias("broken"))


@query("g16_refinement_decision", f"WITH {_QUAL} SELECT doc_id, (round(cov, 2) < 0.7 OR sources < 3 OR coherence = 'Low' OR broken > 0) AND doc_id % 4 < 2 AS refine FROM ql JOIN brk USING (doc_id)")
def g16(spark, sf_dir):
    """Sections that go for another round, of at most two; their number says how many they had."""
    return R.needs_refinement(judged(spark, sf_dir).withColumn("rounds", F.col("doc_id") % 4)).select("doc_id", "refine")


_MORE = " [On Memory 2001] [Kim Papers 2003]"
_ROUNDS = rf"""{_SRC_SQL},
t1 AS (SELECT doc_id, text || ' ' || text || '{_MORE}' AS text FROM sec0), t2 AS (SELECT doc_id, text || ' ' || text || '{_MORE}' AS text FROM t1),
tr AS (SELECT 0 AS r, * FROM sec0 UNION ALL SELECT 1, * FROM t1 UNION ALL SELECT 2, * FROM t2),
mr AS (SELECT doc_id, r, length(text) AS n_chars, len(regexp_extract_all(text, '[^\s]+')) AS w, regexp_extract_all(text, '\[[A-Za-z\s]+(?:\set\sal\.)?\s\d{{4}}\]') AS c, len(list_filter(regexp_split_to_array(text, '\.\s+'), lambda s: trim(s) <> '')) AS n FROM tr),
sr AS (SELECT *, 0 AS since FROM srcs UNION ALL SELECT doc_id, 'w40', ['kim papers', 's3', '3'], 1 FROM documents WHERE doc_id % 2 = 1),
pr AS (SELECT doc_id, r, count(DISTINCT CASE WHEN len(list_filter(c, lambda x: len(list_filter(keys, lambda k: contains(lower(x), k))) > 0)) > 0 THEN name END) AS sources, flatten(list(keys)) AS every FROM mr JOIN sr USING (doc_id) WHERE since <= r GROUP BY 1, 2),
qr AS (SELECT *, least(1.0::DOUBLE, len(c) / greatest(1, n)::DOUBLE) AS cov, len(list_filter(c, lambda x: len(list_filter(every, lambda k: contains(lower(x), k))) = 0)) AS broken FROM mr JOIN pr USING (doc_id, r)),
jr AS (SELECT *, CASE WHEN w > 800 AND cov > 0.5 THEN 'High' WHEN w > 400 AND cov > 0.3 THEN 'Medium' ELSE 'Low' END AS coherence FROM qr),
fr AS (SELECT doc_id, coalesce(min(r) FILTER (NOT (round(cov, 2) < 0.7 OR sources < 3 OR coherence = 'Low' OR broken > 0)), 2) AS r FROM jr GROUP BY 1)"""


@query("g16_refinement_rounds", f"WITH {_ROUNDS} SELECT doc_id, CAST(r AS INT) AS rounds, CAST(n_chars AS INT) AS n_chars, round(cov, 2) AS coverage, coherence, CAST(sources AS INT) AS sources, CAST(broken AS INT) AS broken FROM jr JOIN fr USING (doc_id, r)")
def g16_rounds(spark, sf_dir):
    """Sections through up to two rounds: each makes a poor one twice as long, with two more citations and a third source where it has two."""
    def improve(poor):
        kim = F.array(F.struct(F.lit(40).cast("long").alias("work_id"), F.lit("Kim Papers").alias("title"), F.lit("").alias("authors"), F.lit("excerpt").alias("type"), F.lit(None).cast("long").alias("item_id")))
        return poor.withColumns({"text": F.concat("text", F.lit(" "), "text", F.lit(_MORE)), "s": F.when(F.size("s") < 3, F.concat("s", kim)).otherwise(F.col("s"))})

    got = R.refined(sourced(spark, sf_dir).drop("c"), improve, IO.scratch(spark, "refinement"))
    return got.select("doc_id", "rounds", F.length("text").alias("n_chars"), "coverage", "coherence", "sources", "broken")


_HEADS = r"""h6 AS (SELECT doc_id, line, len(regexp_extract(text, '^(#+)\s+', 1)) AS level, lower(trim(regexp_extract(text, '^#+\s+(.*)$', 1))) AS name FROM md WHERE regexp_matches(text, '^#{1,6}\s+')),
hs AS (SELECT h.*, total_lines, (coalesce((SELECT min(x.line) FROM h6 x WHERE x.doc_id = h.doc_id AND x.line > h.line AND x.level <= h.level), total_lines + 1) - h.line) * 12 AS size,
  row_number() OVER w AS k, line - lag(line) OVER w AS gap, abs(level - lag(level) OVER w) AS jump FROM h6 h JOIN tot USING (doc_id) WINDOW w AS (PARTITION BY h.doc_id ORDER BY line))"""
_ST = """tops AS (SELECT doc_id, count(*) AS top, coalesce(var_samp(s), 0) AS spread FROM (SELECT doc_id, line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS s FROM hs WHERE level <= 2) GROUP BY 1),
rep AS (SELECT doc_id, 5 * count(*) AS repeated FROM (SELECT doc_id, name FROM hs GROUP BY 1, 2 HAVING count(*) >= 3 AND avg(size) < 30) GROUP BY 1),
five AS (SELECT DISTINCT a.doc_id FROM hs a WHERE (SELECT count(*) FROM hs b WHERE b.doc_id = a.doc_id AND b.k BETWEEN a.k - 4 AND a.k AND b.gap <= 2) = 5),
g AS (SELECT doc_id, max(total_lines) AS total_lines, count(*) AS n, max(level) AS depth, count(*) FILTER (jump > 2) AS jumps, count(*) FILTER (size BETWEEN 150 AND 400) AS good, count(*) FILTER (size < 50) AS small, count(*) FILTER (size > 800) AS large, max(size) AS largest, sum(size) AS total FROM hs GROUP BY 1),
d AS (SELECT g.*, coalesce(top, 0) AS top, coalesce(spread, 0) AS spread, coalesce(repeated, 0) AS repeated, CASE WHEN five.doc_id IS NULL THEN 0 ELSE 10 END AS runs, CASE WHEN n > 1 AND largest > 0.5 * total THEN 15 ELSE 0 END AS imbalance,
  CASE depth WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.7 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 ELSE 0.9 END AS dp FROM g LEFT JOIN tops USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN five USING (doc_id)),
st AS (SELECT *, round(CASE WHEN n = 1 THEN dp ELSE dp * 0.5::DOUBLE + 0.5::DOUBLE * greatest(0::DOUBLE, 1 - jumps * 2.0::DOUBLE / (n - 1)) END, 6) AS hierarchy, round(greatest(0::DOUBLE, good / n::DOUBLE - small / n::DOUBLE * 0.3::DOUBLE - large / n::DOUBLE * 0.5::DOUBLE), 6) AS chunkability,
  round(CASE WHEN top = 0 THEN 0 ELSE least(top / 10.0::DOUBLE, 1) * 0.6::DOUBLE + 0.4::DOUBLE * CASE WHEN top = 1 THEN 0.5 ELSE greatest(0::DOUBLE, 1 - spread / (total_lines * total_lines)::DOUBLE * 100) END END, 6) AS coverage, repeated + runs + imbalance AS penalty FROM d),
sc AS (SELECT *, round(greatest(0::DOUBLE, hierarchy * 0.4::DOUBLE + chunkability * 0.4::DOUBLE + coverage * 0.2::DOUBLE - least(penalty / 30.0::DOUBLE, 1)), 6) AS score FROM st)"""


def scored(spark, sf_dir):
    x = md_lines(spark, sf_dir)
    return R.structure_scores(S.parse_headings(x, most=6), totals(x))


def _st(cols: str) -> str:
    return C.sql(f"SELECT doc_id, {cols} FROM sc", MD_SQL.strip(), _HEADS, _ST)


@query("g17_structure_score", _st("score"))
def g17(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "score")


@query("g18_coverage_score", _st("top, coverage"))
def g18(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "top", "coverage")


@query("g19_hierarchy_score", _st("CAST(depth AS INT) AS depth, jumps, hierarchy"))
def g19(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "depth", "jumps", "hierarchy")


@query("g20_chunkability_score", _st("good, small, large, chunkability"))
def g20(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "good", "small", "large", "chunkability")


@query("g21_penalties", _st("CAST(repeated AS BIGINT) AS repeated, CAST(runs AS INT) AS runs, CAST(imbalance AS INT) AS imbalance, CAST(penalty AS BIGINT) AS penalty"))
def g21(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "repeated", "runs", "imbalance", "penalty")


@query("g22_compare_documents", C.sql("""SELECT coalesce(a.doc_id, b.doc_id) // 2 AS k, CASE WHEN b.doc_id IS NULL THEN 'first' WHEN a.doc_id IS NULL THEN 'second' WHEN abs(a.score - b.score) >= 0.01 THEN CASE WHEN a.score > b.score THEN 'first' ELSE 'second' END
  WHEN (a.chunkability, -a.jumps, a.top) > (b.chunkability, -b.jumps, b.top) THEN 'first' ELSE 'second' END AS best FROM (SELECT * FROM sc WHERE doc_id % 2 = 0) a FULL JOIN (SELECT * FROM sc WHERE doc_id % 2 = 1) b ON a.doc_id // 2 = b.doc_id // 2""", MD_SQL.strip(), _HEADS, _ST))
def g22(spark, sf_dir):
    """Two conversions of one work: documents 2k and 2k + 1."""
    s = scored(spark, sf_dir).withColumn("k", F.floor(F.col("doc_id") / 2))
    return R.better_of(s.where("doc_id % 2 = 0"), s.where("doc_id % 2 = 1"), "k")
