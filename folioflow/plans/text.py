"""Queries of text functions and rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import chunking as CH
from folioflow.operators import rewriting as R
from folioflow.operators import structure as S
from folioflow.plans import corpus as C
from folioflow.plans.hierarchy import ANC, MD_SQL, md_lines, sql
from folioflow.plans.predicates import docs, events
from folioflow.registry import query

_W = r"len(regexp_extract_all(text, '[^\s]+'))"


@query("t3_bullets_to_sentences", sql(r"""SELECT doc_id, CAST(min(line) AS INT) AS line, CASE WHEN bullet THEN string_agg(CASE WHEN regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END, ' ' ORDER BY line) FILTER (t <> '') ELSE any_value(b) END AS text
  FROM (SELECT *, trim(regexp_replace(b, '^\s*[-*+]\s*', '')) AS t, line - row_number() OVER (PARTITION BY doc_id, bullet ORDER BY line) AS run FROM (SELECT *, regexp_matches(b, '^\s*[-*+]\s+') AS bullet FROM (SELECT doc_id, line, CASE WHEN line % 5 IN (2, 3) THEN '- ' || text ELSE text END AS b FROM md)))
  GROUP BY doc_id, bullet, run, CASE WHEN bullet THEN 0 ELSE line END HAVING NOT bullet OR count(*) FILTER (t <> '') > 0"""))
def t3(spark, sf_dir):
    b = F.when((F.col("line") % 5).isin(2, 3), F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    return CH.bullets_to_sentences(md_lines(spark, sf_dir).withColumn("text", b)).select("doc_id", "line", "text")


@query("t6_paragraph_chunks")
def t6(spark, sf_dir):
    return CH.paragraph_chunks(S.blocks(md_lines(spark, sf_dir)).where("kind = 'paragraph'").select("doc_id", "start_line", "end_line", "content"))


@query("t8_merge_small")
def t8(spark, sf_dir):
    return CH.merge_small(S.blocks(md_lines(spark, sf_dir)).where("kind != 'heading'").select("doc_id", "start_line", "end_line", "kind", "content"))


@query("t10_count_words", f"SELECT doc_id, CAST({_W} AS INT) AS words FROM documents")
def t10(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.count_words(F.col("text")).alias("words"))


@query("t11_count_words_stripped", r"SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(text, '[#*_`~]+', '', 'g'), '[\p{L}\p{M}\p{N}_]+')) AS INT) AS words FROM documents")
def t11(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.count_words_stripped(F.col("text")).alias("words"))


_SENT = r"list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query("t12_split_sentences", f"SELECT doc_id, CAST(len(s) AS INT) AS n, s[1] AS first FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
def t12(spark, sf_dir):
    s = X.split_sentences(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(s).alias("n"), F.get(s, F.lit(0)).alias("first"))


@query("t13_valid_sentences", rf"SELECT doc_id, CAST(len(list_filter(s, lambda x: len(regexp_extract_all(x, '[^\s]+')) >= 7)) AS INT) AS n_valid FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
def t13(spark, sf_dir):
    """At least seven tokens; the part-of-speech rule is a pluggable function."""
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(X.split_sentences(F.col("text")), lambda s: X.count_words(s) >= 7)).alias("n_valid"))


@query("t14_is_heading", sql(r"SELECT doc_id, CAST(line AS INT) AS line, regexp_matches(text, '^#{1,6}\s+') AS is_heading FROM md"))
def t14(spark, sf_dir):
    return md_lines(spark, sf_dir).select("doc_id", "line", X.is_heading(F.col("text")).alias("is_heading"))


@query("t16_normalize_whitespace", r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, '. ', '.   '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM documents")
def t16(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.normalize_whitespace(F.replace("text", F.lit(". "), F.lit(".   "))).alias("text"))


@query("t17_token_counts", f"SELECT doc_id, CAST(trunc(w / 0.75::DOUBLE) AS INT) AS by_ratio, CAST(trunc(w * 1.3::DOUBLE) AS INT) AS by_factor FROM (SELECT doc_id, {_W} AS w FROM documents)")
def t17(spark, sf_dir):
    w = X.count_words(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", X.tokens_by_ratio(w).alias("by_ratio"), X.tokens_per_word(w, 1.3).alias("by_factor"))


@query("t18_heading_context", sql(r"""SELECT doc_id, CAST(line AS INT) AS line, CAST(len(regexp_extract(text, '^(#+)', 1)) AS INT) AS level, trim(regexp_extract(text, '^#+\s+(.*)$', 1)) AS title, pos AS position,
  regexp_replace(right(left(whole, pos), 100), '^\s+|\s+$', '', 'g') AS before, regexp_replace(left(substr(whole, pos + length(text) + 1), 100), '^\s+|\s+$', '', 'g') AS after
  FROM (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM md) JOIN (SELECT doc_id, string_agg(text, chr(10) ORDER BY line) AS whole FROM md GROUP BY 1) USING (doc_id) WHERE regexp_matches(text, '^#{1,6}\s+\S')"""))
def t18(spark, sf_dir):
    """Headings with 100 characters of the document on both sides."""
    return S.heading_context(md_lines(spark, sf_dir))


@query("t19_condensed", sql("SELECT doc_id, string_agg('L' || line || ' ' || title, chr(10) ORDER BY line) AS condensed FROM hd GROUP BY 1"))
def t19(spark, sf_dir):
    h = S.parse_headings(md_lines(spark, sf_dir)).select("doc_id", "line", F.concat(F.lit("L"), F.col("line").cast("string"), F.lit(" "), "title").alias("text"))
    return R.joined(h).withColumnRenamed("content", "condensed")


_CHG = "chg AS (SELECT doc_id, line, CASE CAST((doc_id + line) % 4 AS INT) WHEN 0 THEN 'REMOVE' WHEN 1 THEN 'NO_CHANGE' WHEN 2 THEN 'H2' ELSE 'H3' END AS action, CASE WHEN line % 8 = 1 THEN 'New ' || title END AS title FROM hd)"
_APPLIED = r"""ap AS (SELECT m.doc_id, m.line, CASE WHEN action IN ('H2', 'H3') THEN repeat('#', CAST(substr(action, 2, 1) AS INT)) || ' ' || coalesce(c.title, regexp_replace(m.text, '^#+\s*', '')) ELSE m.text END AS text FROM md m LEFT JOIN chg c ON c.doc_id = m.doc_id AND c.line = m.line WHERE coalesce(action <> 'REMOVE', TRUE))"""


def changes(spark, sf_dir):
    h = S.parse_headings(md_lines(spark, sf_dir))
    n = (F.col("doc_id") + F.col("line")) % 4
    return h.select("doc_id", "line", F.when(n == 0, "REMOVE").when(n == 1, "NO_CHANGE").when(n == 2, "H2").otherwise("H3").alias("action"), F.when(F.col("line") % 8 == 1, F.concat(F.lit("New "), "title")).alias("title"))


@query("t20_apply_modifications", C.sql(r"SELECT doc_id, regexp_replace(string_agg(text, chr(10) ORDER BY line), '\n{3,}', chr(10) || chr(10), 'g') AS content FROM ap GROUP BY 1", MD_SQL.strip(), _CHG, _APPLIED))
def t20(spark, sf_dir):
    c = R.joined(R.apply_changes(md_lines(spark, sf_dir), changes(spark, sf_dir)))
    return c.select("doc_id", F.regexp_replace("content", r"\n{3,}", "\n\n").alias("content"))


@query("t21_apply_title_changes", C.sql("SELECT doc_id, CAST(line AS INT) AS line, text FROM ap", MD_SQL.strip(), _CHG, _APPLIED))
def t21(spark, sf_dir):
    return R.apply_changes(md_lines(spark, sf_dir), changes(spark, sf_dir))


@query("t22_preview_changes", C.sql("SELECT m.doc_id, CAST(m.line AS INT) AS line, m.text AS old, c.action FROM md m JOIN chg c ON c.doc_id = m.doc_id AND c.line = m.line WHERE action <> 'NO_CHANGE'", MD_SQL.strip(), _CHG))
def t22(spark, sf_dir):
    return md_lines(spark, sf_dir).join(changes(spark, sf_dir), ["doc_id", "line"]).where("action != 'NO_CHANGE'").select("doc_id", "line", F.col("text").alias("old"), "action")


@query("t23_apply_title_edits", sql(r"SELECT m.doc_id, CAST(m.line AS INT) AS line, CASE WHEN h.line IS NULL OR e = 1 THEN m.text WHEN e = 2 THEN regexp_replace(m.text, '^#+\s*', '') ELSE '# Edited' END AS text FROM md m LEFT JOIN (SELECT doc_id, line, (doc_id + line) % 4 AS e FROM hd) h ON h.doc_id = m.doc_id AND h.line = m.line WHERE e IS NULL OR e <> 0"))
def t23(spark, sf_dir):
    x = md_lines(spark, sf_dir)
    n = (F.col("doc_id") + F.col("line")) % 4
    e = S.parse_headings(x).select("doc_id", "line", F.when(n == 0, "-").when(n == 1, "***MISSING***").when(n == 2, "--").otherwise("# Edited").alias("edit"))
    return R.apply_edits(x, e)


@query("t24_parse_change_lines", "SELECT event_id AS line, CASE WHEN event_id % 2 = 0 THEN 'REMOVE' ELSE 'H2' END AS action, CASE WHEN event_id % 2 = 1 THEN 'T' || user_id END AS title FROM events")
def t24(spark, sf_dir):
    """`N: ACTION title` lines inside a code fence."""
    e = events(spark, sf_dir)
    line = F.concat(F.col("event_id").cast("string"), F.lit(": "), F.when(F.col("event_id") % 2 == 0, "REMOVE").otherwise(F.concat(F.lit("H2 T"), F.col("user_id").cast("string"))))
    reply = F.concat(F.lit("Here:\n```\n"), line, F.lit("\n```\n"))
    return CH.parse_reply_lines(e.select(reply.alias("reply")), "reply")


@query("t27_mapping_replace", "SELECT doc_id, replace(replace(text, 'the', 'THE'), 'THE ', '_') AS text, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INT) AS n FROM documents")
def t27(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", R.apply_mapping(t, [("the", "THE"), ("THE ", "_")]).alias("text"), R.occurrences(t, "the").alias("n"))


@query("t28_hierarchy_decisions", sql("""SELECT doc_id, CAST(line AS INT) AS line, CASE WHEN EXISTS (SELECT 1 FROM d2 i WHERE i.doc_id = d.doc_id AND i.decision = 'VECTORIZE' AND i.line > d.line AND NOT EXISTS (SELECT 1 FROM d0 x WHERE x.doc_id = d.doc_id AND x.line > d.line AND x.line <= i.line AND x.level <= d.level)) THEN 'VECTORIZE' ELSE decision END AS decision FROM d2 d""").replace("SELECT doc_id, CAST(line AS INT)", """, d0 AS (SELECT doc_id, line, level, CASE WHEN (doc_id + line) % 3 = 0 THEN 'SKIP' ELSE 'VECTORIZE' END AS decision FROM hd),
d2 AS (SELECT doc_id, line, level, CASE WHEN EXISTS (SELECT 1 FROM d0 s WHERE s.doc_id = d.doc_id AND s.decision = 'SKIP' AND s.line < d.line AND NOT EXISTS (SELECT 1 FROM d0 x WHERE x.doc_id = d.doc_id AND x.line > s.line AND x.line <= d.line AND x.level <= s.level)) THEN 'SKIP' ELSE decision END AS decision FROM d0 d)
SELECT doc_id, CAST(line AS INT)""", 1))
def t28(spark, sf_dir):
    h = S.parse_headings(md_lines(spark, sf_dir))
    n = (F.col("doc_id") + F.col("line")) % 3
    return CH.propagate_decisions(h.withColumn("decision", F.when(n == 0, "SKIP").otherwise("VECTORIZE")))


@query("t29_changes_without_heading", C.sql("SELECT c.doc_id, CAST(c.line + c.doc_id % 2 AS INT) AS line FROM chg c WHERE NOT EXISTS (SELECT 1 FROM hd h WHERE h.doc_id = c.doc_id AND h.line = c.line + c.doc_id % 2)", MD_SQL.strip(), _CHG))
def t29(spark, sf_dir):
    """Integrity: changes whose line is no heading."""
    x = md_lines(spark, sf_dir)
    c = changes(spark, sf_dir).select("doc_id", (F.col("line") + F.col("doc_id") % 2).cast("int").alias("line"))
    return c.join(S.parse_headings(x), ["doc_id", "line"], "left_anti")


@query("t30_hash_validation", "SELECT doc_id, sha256(text) AS content_hash, doc_id % 4 <> 0 AS unchanged FROM documents")
def t30(spark, sf_dir):
    now = F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_hash"), (now == F.sha2("text", 256)).alias("unchanged"))


@query("t31_file_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def t31(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"))


@query("t32_skip_apply", "SELECT doc_id, text AS sanitized FROM documents")
def t32(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.col("text").alias("sanitized"))


@query("t34_parse_expansion", "SELECT event_id, 'q' || event_id AS first, CASE WHEN event_id % 2 = 0 THEN 'DEFINITION' ELSE 'OTHER' END AS intent, CAST(2 AS INT) AS n FROM events")
def t34(spark, sf_dir):
    """A fenced JSON reply; missing keys get defaults."""
    j = F.concat(F.lit('```json\n{"queries": ["q'), F.col("event_id").cast("string"), F.lit('", "x"]'), F.when(F.col("event_id") % 2 == 0, ', "intent": "DEFINITION"').otherwise(""), F.lit("}\n```"))
    p = F.from_json(CH.unfenced(j), "queries array<string>, hyde_answer string, intent string, entities array<string>")
    return events(spark, sf_dir).select("event_id", p.alias("p")).select("event_id", F.get("p.queries", F.lit(0)).alias("first"), F.coalesce("p.intent", F.lit("OTHER")).alias("intent"), F.size("p.queries").alias("n"))


@query("t33_extract_json", "SELECT event_id, CAST(event_id AS INT) AS a FROM events")
def t33(spark, sf_dir):
    """JSON with prose around it, curly quotes and a trailing comma."""
    reply = F.concat(F.lit("Sure: {“a”: "), F.col("event_id").cast("string"), F.lit(", “b”: [1,2,],} bye"))
    return events(spark, sf_dir).select("event_id", F.get_json_object(CH.repaired_json(reply), "$.a").cast("int").alias("a"))


@query("t35_parse_judge", "SELECT event_id, CAST(event_id % 21 - 10 AS INT) AS score FROM events")
def t35(spark, sf_dir):
    """JSON, or KEY: lines."""
    s = (F.col("event_id") % 21 - 10).cast("string")
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"overall_score": '), s, F.lit("}"))).otherwise(F.concat(F.lit("OVERALL_SCORE: "), s, F.lit("\nJUSTIFICATION: ok")))
    score = F.coalesce(F.get_json_object(reply, "$.overall_score"), F.nullif(F.regexp_extract(reply, r"(?i)OVERALL_SCORE:\s*(-?\d+)", 1), F.lit("")))
    return events(spark, sf_dir).select("event_id", score.cast("int").alias("score"))


@query("t36_parse_summaries", "SELECT conv_id, turn AS heading_id, CASE WHEN role = 'system' THEN NULL ELSE length(text) END AS size, CASE WHEN role = 'system' THEN 'missing summary' END AS error FROM conversations")
def t36(spark, sf_dir):
    """A JSON array of items per conversation, in a fence; an item without a summary gets an error."""
    item = F.struct(F.col("turn").alias("heading_id"), F.when(F.col("role") != "system", F.col("text")).alias("summary"))
    reply = F.concat(F.lit("Summaries:\n```json\n"), F.to_json(F.collect_list(item)), F.lit("\n```"))
    replies = C.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(reply.alias("reply"))
    p = replies.select("conv_id", F.inline(F.from_json(CH.unfenced(F.col("reply")), "array<struct<heading_id: bigint, summary: string>>")))
    return p.select("conv_id", "heading_id", F.length("summary").cast("long").alias("size"), F.when(F.col("summary").isNull(), "missing summary").alias("error"))


@query("t37_reconcile_ids", "SELECT coalesce(p.k, x.doc_id) AS id, CASE WHEN p.k IS NULL THEN 'missing' WHEN x.doc_id IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS state FROM (SELECT k, count(*) AS n FROM (SELECT doc_id * 2 AS k FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 10 = 0) GROUP BY 1) p FULL JOIN (SELECT doc_id FROM documents) x ON p.k = x.doc_id")
def t37(spark, sf_dir):
    d = docs(spark, sf_dir)
    got = d.select((F.col("doc_id") * 2).alias("k")).unionAll(d.where("doc_id % 10 = 0").select("doc_id")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("k").isNull(), "missing").when(F.col("doc_id").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return got.join(d.select("doc_id"), F.col("k") == F.col("doc_id"), "full").select(F.coalesce("k", "doc_id").alias("id"), state.alias("state"))


@query("t38_parse_breakdown", "SELECT event_id, least(event_id % 10, 7) AS sections, event_id % 10 >= 3 AS valid FROM events")
def t38(spark, sf_dir):
    """Three to seven sections; more are cut, fewer are invalid."""
    one = F.lit('{"title": "t", "question": "q"}')
    reply = F.concat(F.lit("["), F.array_join(F.array_repeat(one, (F.col("event_id") % 10).cast("int")), ","), F.lit("]"))
    p = F.filter(F.from_json(reply, "array<struct<title: string, question: string>>"), lambda s: s["title"].isNotNull() & s["question"].isNotNull())
    return events(spark, sf_dir).select("event_id", F.size(F.slice(p, 1, 7)).cast("long").alias("sections"), (F.size(p) >= 3).alias("valid"))


@query("t39_plan_validation", "SELECT conv_id, count(*) AS sections, bool_and(role <> 'system' AND turn % 5 <> 4) AS valid FROM conversations GROUP BY 1")
def t39(spark, sf_dir):
    """A plan is valid if each of its sections has a title and at least one question; plans come as JSON, a section a turn."""
    section = F.struct(F.when(F.col("role") != "system", F.col("role")).alias("title"), F.when(F.col("turn") % 5 != 4, F.array("text")).otherwise(F.array().cast("array<string>")).alias("questions"))
    plans = C.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(section)).alias("reply"))
    p = plans.select("conv_id", F.from_json("reply", "array<struct<title: string, questions: array<string>>>").alias("p"))
    return p.select("conv_id", F.size("p").cast("long").alias("sections"), F.forall("p", lambda s: s["title"].isNotNull() & (F.size(s["questions"]) > 0)).alias("valid"))


@query("t40_embed_chunks")
def t40(spark, sf_dir):
    from folioflow.operators.external import hashing_embedder, with_embedding
    return with_embedding(docs(spark, sf_dir).select("doc_id", "text"), "text", hashing_embedder).select("doc_id", "embedding", "vector_status")


@query("t44_breadcrumb_backfill", C.sql("SELECT c.id, CASE WHEN c.id % 3 <> 0 THEN c.heading_breadcrumbs ELSE coalesce((SELECT string_agg(regexp_replace(split_part(p.content, chr(10), 1), '^#+ *', ''), ' > ' ORDER BY u.depth DESC) FROM up u JOIN headings p ON p.id = u.anc WHERE u.id = c.id), '[No heading]') END AS heading_breadcrumbs FROM chunks c", ANC).replace("WITH ", "WITH RECURSIVE ", 1))
def t44(spark, sf_dir):
    """A third of all chunks have lost their breadcrumbs; these are found by walking up."""
    c = C.chunks(spark, sf_dir).select("id", "parent_id", F.when(F.col("id") % 3 != 0, F.col("heading_breadcrumbs")).alias("heading_breadcrumbs"))
    walked = S.breadcrumb_walk(c.where("heading_breadcrumbs is null"), C.headings(spark, sf_dir))
    return c.where("heading_breadcrumbs is not null").select("id", "heading_breadcrumbs").unionAll(walked)


@query("t45_sentence_backfill", C.sql(f"SELECT id, CAST(len({_SENT.replace('text', 'content')}) AS INT) AS sentence_count FROM leaves"))
def t45(spark, sf_dir):
    return C.leaves(spark, sf_dir).select("id", F.size(X.split_sentences(F.col("content"))).alias("sentence_count"))


@query("t46_tab_repair", "SELECT doc_id, replace(replace(text, ', ', chr(9)), chr(9), ' ') AS text FROM documents")
def t46(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.regexp_replace(F.replace("text", F.lit(", "), F.lit("\t")), "\t", " ").alias("text"))


@query("t47_path_to_name", "SELECT page_id, split_part(url, '/', -1) AS name FROM pages")
def t47(spark, sf_dir):
    return C.table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "/", -1).alias("name"))


@query("t50_heading_table", C.sql("SELECT h.doc_id, CAST(h.line AS INT) AS line, coalesce(c.action, 'H' || h.level) AS action, coalesce(c.title, h.title) AS title FROM hd h LEFT JOIN (SELECT * FROM chg WHERE line % 3 = 0) c ON c.doc_id = h.doc_id AND c.line = h.line", MD_SQL.strip(), _CHG))
def t50(spark, sf_dir):
    h = S.parse_headings(md_lines(spark, sf_dir))
    c = changes(spark, sf_dir).where("line % 3 = 0").select("doc_id", "line", "action", F.col("title").alias("new"))
    return h.join(c, ["doc_id", "line"], "left").select("doc_id", "line", F.coalesce("action", F.concat(F.lit("H"), F.col("level").cast("string"))).alias("action"), F.coalesce("new", "title").alias("title"))


@query("t51_change_file", C.sql("SELECT doc_id, string_agg(line || ': ' || action, chr(10) ORDER BY line) AS content FROM chg WHERE action <> 'NO_CHANGE' GROUP BY 1", MD_SQL.strip(), _CHG))
def t51(spark, sf_dir):
    c = changes(spark, sf_dir).where("action != 'NO_CHANGE'")
    return R.joined(c.select("doc_id", "line", F.concat(F.col("line").cast("string"), F.lit(": "), "action").alias("text")))


@query("t52_decision_table", C.sql("SELECT h.doc_id, CAST(h.line AS INT) AS line, CASE WHEN (h.doc_id + h.line) % 4 = 0 THEN 'SKIP' ELSE 'VECTORIZE' END AS decision FROM hd h", MD_SQL.strip()))
def t52(spark, sf_dir):
    h = S.parse_headings(md_lines(spark, sf_dir))
    d = h.where("(doc_id + line) % 4 = 0").select("doc_id", "line", F.lit("SKIP").alias("decision"))
    return h.select("doc_id", "line").join(d, ["doc_id", "line"], "left").select("doc_id", "line", F.coalesce("decision", F.lit("VECTORIZE")).alias("decision"))


@query("t53_decision_file", C.sql("SELECT doc_id, string_agg(line || ': ' || CASE WHEN (doc_id + line) % 4 = 0 THEN 'SKIP' ELSE 'VECTORIZE' END, chr(10) ORDER BY line) AS content FROM hd GROUP BY 1", MD_SQL.strip()))
def t53(spark, sf_dir):
    d = t52(spark, sf_dir)
    return R.joined(d.select("doc_id", "line", F.concat(F.col("line").cast("string"), F.lit(": "), "decision").alias("text")))
