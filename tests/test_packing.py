"""Table functions and windows that pack, merge and decide, against whole lists in plain Python."""

import random
import re

import pytest

from folioflow.operators import chunking, summarize


def packed(rows):
    """Chunks of paragraphs (start, end, content), the whole document at hand."""
    out, held, words, start, end = [], [], 0, None, None

    def flush():
        out.append((start, end, words, "\n".join(held)))
        s = [x for x in re.split(r"(?<=[.!?])\s+", held[-1].strip()) if x]
        return [" ".join(s[-3:] if len(s) >= 2 else s)]

    for i, (a, b, text) in enumerate(rows):
        n = len(text.split())
        if held and words >= 50 and words + n > 300:
            held = flush()
            words, start = len(held[0].split()), end
        held.append(text)
        words, end, start = words + n, b, a if start is None else start
        if words >= 200 and i < len(rows) - 1:
            held = flush()
            words, start = len(held[0].split()), a
    if held:
        flush()
    return out


def merged(rows, least=50):
    out = []
    for a, b, kind, text in rows:
        n = len(text.split())
        if out and kind == out[-1][2] == "paragraph" and out[-1][3] < least:
            out[-1][1], out[-1][3] = b, out[-1][3] + n
        else:
            out.append([a, b, kind, n])
    i = len(out) - 1
    while i > 0:
        if out[i][2] == out[i - 1][2] == "paragraph" and out[i][3] < least:
            out[i - 1][1], out[i - 1][3] = out[i][1], out[i - 1][3] + out[i][3]
            del out[i]
        i -= 1
    return [tuple(x) for x in out]


def decided(level, decision):
    decision = list(decision)
    for i, d in enumerate(decision):
        if d == "SKIP":
            for j in range(i + 1, len(level)):
                if level[j] <= level[i]:
                    break
                decision[j] = "SKIP"
    for i, d in enumerate(list(decision)):
        if d == "VECTORIZE":
            top = level[i]
            for j in range(i - 1, -1, -1):
                if level[j] < top:
                    top, decision[j] = level[j], "VECTORIZE"
    return decision


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["a", "bb", "c.", "d!", "e?"]) for _ in range(rng.choice([0, 1, 5, 20, 49, 50, 60, 120, 200, 320])))
    return {d: [(2 * i + 1, 2 * i + 1 + i % 2, rng.choice(["paragraph", "paragraph", "paragraph", "table", "figure"]), text()) for i in range(rng.randrange(1, 25))] for d in range(40)}


def test_packing_and_merging(spark, documents):
    rows = [(d, *r) for d, rs in documents.items() for r in rs]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, start_line int, end_line int, kind string, content string")
    got = chunking.merge_small(df).collect()
    assert {d: sorted((r.start_line, r.end_line, r.kind, r.words) for r in got if r.doc_id == d) for d in documents} == {d: merged(rs) for d, rs in documents.items()}
    paragraphs = {d: [(a, b, t) for a, b, k, t in rs if k == "paragraph"] for d, rs in documents.items()}
    got = chunking.paragraph_chunks(df.where("kind = 'paragraph'")).collect()
    assert {d: sorted((r.start_line, r.end_line, r.words, r.content) for r in got if r.doc_id == d) for d in documents} == {d: sorted(packed(rs)) for d, rs in paragraphs.items()}
    assert chunking.merge_small(df.limit(0)).count() == chunking.paragraph_chunks(df.limit(0)).count() == 0


def test_decisions(spark):
    rng = random.Random(4)
    docs = {d: [(rng.randrange(1, 6), rng.choice(["SKIP", "VECTORIZE"])) for _ in range(rng.randrange(1, 40))] for d in range(50)}
    df = spark.createDataFrame([(d, i, lv, x) for d, rs in docs.items() for i, (lv, x) in enumerate(rs)], "doc_id int, line int, level int, decision string")
    got = chunking.propagate_decisions(df).collect()
    assert {d: [r.decision for r in sorted(got, key=lambda r: r.line) if r.doc_id == d] for d in docs} == {d: decided([lv for lv, _ in rs], [x for _, x in rs]) for d, rs in docs.items()}


def test_pruning_pops_the_deepest_and_fullest(spark):
    rng = random.Random(6)
    works = {w: [(h, rng.randrange(1, 5), rng.randrange(1, 9), [rng.randrange(1, 50) for _ in range(rng.randrange(7))]) for h in range(rng.randrange(1, 12))] for w in range(30)}
    df = spark.createDataFrame([(w, h, f"H{lv}", t, c) for w, hs in works.items() for h, lv, t, c in hs], "work_id int, heading_id long, level string, title_tokens int, chunk_tokens array<int>")
    got = summarize.prune_to_budget(df, 150).collect()
    for w, hs in works.items():
        rows = [[h, lv, {1: 2, 2: 2}.get(lv, 1), t, list(c)] for h, lv, t, c in hs]
        total = sum(r[3] + sum(r[4]) for r in rows)
        while total > 150 and (more := [r for r in rows if len(r[4]) > r[2]]):
            total -= max(more, key=lambda r: (r[1], len(r[4])))[4].pop()
        while total > 150 and rows:
            gone = max(rows, key=lambda r: r[1])
            total -= gone[3] + sum(gone[4])
            rows.remove(gone)
        assert sorted((r.heading_id, r.n_chunks) for r in got if r.work_id == w) == [(r[0], len(r[4])) for r in rows]


def test_pruning_needs_no_python_for_each_work(spark):
    rows = [(1, 3, "H3", 5, [4, 0, 4]), (1, 2, "H3", 5, [4, 4, 4]), (1, 1, "H1", 5, [1, 1, 1]), (None, 9, "H2", 50, []), (2, 9, "H2", 8, [1, 1, 1])]
    df = spark.createDataFrame(rows, "work_id int, heading_id long, level string, title_tokens int, chunk_tokens array<int>")
    pruned = summarize.prune_to_budget(df, 30)
    assert sorted((str(r.work_id), r.heading_id, r.n_chunks) for r in pruned.collect()) == [("1", 1, 3), ("1", 2, 2), ("1", 3, 2), ("2", 9, 3)]
    assert "Pandas" not in pruned._jdf.queryExecution().toString()
