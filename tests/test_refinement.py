"""Rounds of refinement: only poor sections go on, and a run takes up where another one broke off."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import research as R

SCHEMA = "id long, v int, note string"


def judge(df):
    """A section of v 10 or more is good."""
    return df.withColumns({"coverage": F.col("v") / 10.0, "sources": F.lit(3), "coherence": F.lit("High"), "broken": F.lit(0)})


def grown(seen):
    def improve(poor):
        seen.append(sorted(r.id for r in poor.collect()))
        return poor.withColumn("v", F.col("v") + 4)

    return improve


def test_only_poor_sections_go_on(spark, tmp_path):
    rows = [(1, 9, "a"), (2, 4, "b"), (3, 0, None), (4, 9, "a"), (4, 9, "a"), (None, 1, "c")]
    seen: list = []
    df = spark.createDataFrame(rows, SCHEMA)
    got = R.refined(df.where("id is not null"), grown(seen), f"file://{tmp_path}/s", judge)
    assert sorted((r.id, r.v, r.note or "", r.rounds) for r in got.collect()) == [(1, 9, "a", 0), (2, 8, "b", 1), (3, 8, "", 2), (4, 9, "a", 0), (4, 9, "a", 0)]
    assert seen == [[2, 3], [3]]
    assert [(r.v, r.rounds) for r in R.refined(df.where("id is null"), lambda p: p.withColumn("v", F.lit(7)), f"file://{tmp_path}/n", judge).collect()] == [(7, 1)]
    assert R.refined(df.limit(0), grown(seen), f"file://{tmp_path}/e", judge).count() == 0 and len(seen) == 2


def test_a_run_takes_up_after_the_last_whole_round(spark, tmp_path):
    path, seen = f"file://{tmp_path}/s", []
    df = spark.createDataFrame([(1, 9, "a"), (2, -9, "b")], SCHEMA)

    def broken(poor):
        raise RuntimeError("the model is away")

    with pytest.raises(RuntimeError):
        R.refined(df, broken, path, judge)
    first = spark.read.parquet(f"{path}/round=0").count()
    poor = tmp_path / "s" / "round=0" / "refine=true"
    assert poor.exists()
    got = R.refined(df, grown(seen), path, judge, most=3)
    assert first == 2 and sorted((r.id, r.v, r.rounds) for r in got.collect()) == [(1, 9, 0), (2, 3, 3)]
    assert not poor.exists()  # the round after it is whole
    again = R.refined(df, broken_late(seen), path, judge, most=3)
    assert sorted((r.id, r.v, r.rounds) for r in again.collect()) == [(1, 9, 0), (2, 3, 3)]


def broken_late(seen):
    """Rounds that are written are not judged from new improvements again."""
    return lambda poor: poor.withColumn("v", F.lit(1000))


def test_citations_of_sources(spark):
    source = "struct<work_id: long, title: string, authors: string, type: string, item_id: long>"
    rows = [("[On Memory 2001] x [Nobody 3888] y [kim papers 2003]", [(1, "On Memory", "A Berg", "excerpt", None), (2, "Else", "Jo Kim, X", "excerpt", None)]), ("no citation", []), ("[On Memory 2001]", None), (None, [(1, "t", None, "excerpt", None)])]
    got = R.measured(spark.createDataFrame(rows, f"text string, s array<{source}>")).collect()
    assert [(r.citations, r.sources, r.broken) for r in got[:2]] == [(3, 2, 1), (0, 0, 0)]
    assert len(got) == 4 and got[3].sources in (-1, 0, None)
