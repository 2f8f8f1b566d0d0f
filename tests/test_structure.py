"""Closures, ranges, contexts, sources, heading-wise ranking and prompts against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import fulltext, research, structure, summarize


def climbed(parent):
    """{(id, depth, ancestor)} by walking up until a node comes again."""
    out = set()
    for i in parent:
        seen, at, d = {i}, parent[i], 1
        while at is not None and at not in seen:
            out.add((i, d, at))
            seen.add(at)
            at, d = parent.get(at), d + 1
    return out


def tuples(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_deep_trees_circles_and_lost_parents(spark, seed):
    rng = random.Random(seed)
    parent = {0: None, **{i: i - 1 for i in range(1, 70)}}  # a chain of 70
    parent |= {100 + i: rng.choice([None, 99, *range(100, 100 + i)]) if i else None for i in range(60)}  # bushes; 99 isn't there
    parent |= {200: 201, 201: 202, 202: 200, 203: 202, 204: 204, 205: 203, **{210 + i: 210 + (i + 1) % 9 for i in range(9)}, 220: 212, 221: 220}  # circles with tails
    df = spark.createDataFrame(list(parent.items()), "id long, parent_id long")
    assert tuples(structure.ancestors(df)) == climbed(parent)
    assert tuples(structure.ancestors(df, 3)) == {x for x in climbed(parent) if x[1] <= 3}
    assert structure.ancestors(df.limit(0)).count() == 0
    items = spark.createDataFrame([(1000, 69), (1001, 0), (1002, None), (1003, 99), (1003, 205)], "id long, parent_id long")
    got = tuples(structure.ancestors_of(items, structure.ancestors(df)))
    assert {x for x in got if x[0] == 1000} == {(1000, d, 70 - d) for d in range(1, 71)}
    assert {x for x in got if x[0] in (1001, 1002)} == {(1001, 1, 0)} and (1003, 1, 99) in got and (1003, 2, 203) in got


def test_ranges_of_any_width_meet_each_piece_once(spark):
    rng = random.Random(1)
    ranges = [(i, rng.randrange(3), a := rng.randrange(200), a + rng.choice([-1, 0, 5, 40, 150])) for i in range(60)]
    pieces = [(i, rng.randrange(3), a := rng.randrange(200), a + rng.randrange(6)) for i in range(200)]
    r, p = spark.createDataFrame(ranges, "item_id int, work_id int, range_start int, range_end int"), spark.createDataFrame(pieces, "id int, work_id int, start_line int, end_line int")
    want = sorted((i, j) for i, w, s, e in ranges for j, v, a, b in pieces if w == v and s <= a and b <= e)
    for width in (1, 7, 1000):
        got = structure.within_ranges(r, p, "work_id", width)
        assert sorted((x.item_id, x.id) for x in got.collect()) == want


def test_excerpts_say_what_is_missing(spark):
    chunks = spark.createDataFrame([(2, 1, 5, 6, "b", "B"), (1, 1, 3, 4, "a", "A"), (3, 1, 7, 9, "c", "C")], "id long, work_id long, start_line int, end_line int, content string, heading_breadcrumbs string")
    works = spark.createDataFrame([(1,)], "work_id long")
    items = spark.createDataFrame([(10, 1, 3, 6), (11, 1, 4, 5), (12, 9, 1, 99)], "item_id long, work_id long, range_start int, range_end int")
    got = {r.item_id: (r.content, r.heading_breadcrumbs, r.preview) for r in structure.excerpts(items, works, chunks, preview=3).collect()}
    assert got == {10: ("a\n\nb", "A", "a\n\n"), 11: ("Excerpt content not found.", None, None), 12: ("Source work deleted.", None, None)}


def test_heading_context_is_of_the_whole_document(spark):
    text = "x" * 150 + "\n# One\ntwo\n###### Six  \n#no\n# \nend"
    lines = spark.createDataFrame([(0, i, t) for i, t in enumerate(text.split("\n"), 1)], "doc_id int, line int, text string")
    got = [tuple(r) for r in structure.heading_context(lines).orderBy("line").collect()]
    assert got == [(0, 2, 1, "One", 151, "x" * 99, "two\n###### Six  \n#no\n# \nend"), (0, 4, 6, "Six", 161, ("x" * 150 + "\n# One\ntwo\n")[-100:].strip(), "#no\n# \nend")]


def test_sources_by_title_author_result_and_number(spark):
    kind = "c array<string>, s array<struct<work_id: long, title: string, authors: string, type: string, item_id: long>>"
    sources = [(5, "Deep Work", "Ann B. Lee, C. Doe", "excerpt", None), (None, None, None, "research_result", 77), (5, None, "", "excerpt", None), (8, "", "van Dam", "excerpt", None)]
    rows = [(["[lee 5555]"], 1, 0), (["[Deep Work 9999]", "[Nobody 5555]"], 1, 1), (["[see Result 77]"], 1, 0), (["[S3]", "[x S1]"], 1, 0), (["[Dam 6666]"], 1, 0), ([], 0, 0), (["[S2]", "[S4]"], 2, 0)]
    df = spark.createDataFrame([(c, sources) for c, _, _ in rows], kind)
    got = df.select(research.source_diversity(F.col("c"), F.col("s")), F.size(research.broken_citations(F.col("c"), F.col("s")))).collect()
    assert [tuple(r) for r in got] == [(n, b) for _, n, b in rows]


def chosen(children, q, qe, lam=0.7):
    """Lists, fusion and diversity for one heading in plain loops; children {id: (text, vector)}."""
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    dense = sorted((i for i in children if children[i][1]), key=lambda i: (-round(cos(qe, children[i][1]), 6), i))[:7]

    def cover(i):
        at = {w: [p for p, x in enumerate(children[i][0].split(), 1) if x == w] for w in q.split()}
        return fulltext.cover_rank(fulltext.parse_plain(q, "simple"), at) if all(at.values()) else 0.0

    lexical = sorted(children, key=lambda i: (-round(cover(i), 8), i))[:7]
    score = {i: round(sum(1 / (60 + (x.index(i) + 1 if i in x else 999999)) for x in (dense, lexical)), 10) for i in {*dense, *lexical}}
    best = sorted(score, key=lambda i: (-score[i], i))[:7]
    left, out = [i for i in best if children[i][1]], []
    while left and len(out) < 5:
        value = lambda i: round(lam * score[i] - (1 - lam) * max((round(cos(children[i][1], children[j][1]), 9) for j in out), default=0), 9)  # noqa: E731, B023
        out.append(max(left, key=lambda i: (value(i), -left.index(i))))
        left.remove(out[-1])
    return best, out


def test_children_of_all_headings_are_ranked_inside_their_heading(spark):
    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    headings = [(h, f"w{h} w{h + 1}", vec()) for h in range(5)]
    kids = [(h, 100 * h + i, " ".join(f"w{rng.randrange(7)}" for _ in range(rng.randrange(2, 12))), vec() if rng.random() < 0.8 else None) for h in range(4) for i in range(rng.randrange(1, 14))]
    hd = spark.createDataFrame(headings, "heading_id long, q string, qe array<double>")
    kd = spark.createDataFrame([(h, i, e) for h, i, _, e in kids], "heading_id long, id long, embedding array<double>")
    index = fulltext.postings(spark.createDataFrame([(i, t) for _, i, t, _ in kids], "id long, content string"), "simple")
    fused = summarize.fused_children(hd, kd, index).collect()
    final = summarize.rank_children(hd, kd, index).collect()
    for h, q, qe in headings:
        best, out = chosen({i: (t, e) for k, i, t, e in kids if k == h}, q, qe)
        assert [r.id for r in sorted(fused, key=lambda r: r.rank) if r.heading_id == h] == best
        assert [r.id for r in sorted(final, key=lambda r: r.rank) if r.heading_id == h] == out


def test_prompt_sections_and_context(spark):
    h = spark.createDataFrame([(1, 10, 0, 0, "A", 1, 5), (1, 11, 1, 0, "B", 6, 9), (1, 12, 2, 1, "C", 10, 12)], "work_id int, heading_id long, pos int, batch int, title string, start_line int, end_line int")
    c = spark.createDataFrame([(10, 2, 101, "second", 3, 4), (10, 1, 100, "first", 2, 2)], "heading_id long, rank int, id long, content string, start_line int, end_line int")
    got = {r.batch: (r.sections, r.context) for r in summarize.prompt_sections(h, c).collect()}
    assert got[0] == ("# A\n-- id: 10\n-- lines: 1-5\n\nfirst\n-- chunk_id: 100, lines: 2-2\n\nsecond\n-- chunk_id: 101, lines: 3-4\n\n# B\n-- id: 11\n-- lines: 6-9\n", "## Subsequent context (headings only):\n- C\n")
    assert got[1] == ("# C\n-- id: 12\n-- lines: 10-12\n", "## Previous context (headings only):\n- A\n- B\n")


def test_heading_query(spark):
    df = spark.createDataFrame([("A > **B**", "the _T_"), (None, " x  y ")], "b string, t string")
    assert [r.q for r in df.select(summarize.heading_query(F.col("b"), F.col("t")).alias("q")).collect()] == ["A B the T", "x y"]
