"""Long texts stay where they are: search without an index, climbs and consolidation move ids, counts and what is chosen."""

import random

from pyspark.sql import functions as F

from folioflow.operators import consolidation, external, fulltext, search


def test_texts_are_searched_where_they_are_like_their_postings(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(12)}"
    texts = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(30))) if i % 9 else None) for i in range(120)], "id long, content string")
    asked = [f"{word()} {word()} or \"{word()} {word()}\" -{word()}" for _ in range(25)] + ["-w1", "the of", "", None, "w1 the w2", '"w1 w2" w3']
    q = spark.createDataFrame([((i, 1), t) for i, t in enumerate(asked)], "query_id struct<a: int, b: int>, q string")
    monkeypatch.setattr(search, "BATCH", 5)
    get = lambda df: sorted(map(tuple, df.collect()))
    found = fulltext.search_web_texts(q, texts, 4)
    assert get(found) == get(fulltext.search_web(q, fulltext.postings(texts), 4))
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()


def test_items_do_not_carry_their_parents_text(spark, monkeypatch):
    seen = []
    real = consolidation.S.islands
    monkeypatch.setattr(consolidation.S, "islands", lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k))
    items = spark.createDataFrame([(1, i, 9, "x" * 10, 2 * i, 2 * i, 0.5) for i in range(4)], "query_id long, id long, parent_id long, content string, start_line int, end_line int, score double")
    parents = spark.createDataFrame([(9, None, "y" * 1000, 0, 99)], "id long, parent_id long, content string, start_line int, end_line int")
    assert consolidation.consolidate(items, parents, 0.5, 1).count() == 4
    assert consolidation.consolidate(items, parents, 0.01, 1).first().content == "y" * 1000
    assert seen and not any("_content" in c for c in seen)


def test_models_get_batches_of_bounded_bytes(spark):
    long = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("a "), 200_000).alias("t"))
    sizes = lambda texts: [str(len(texts)) for _ in texts]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    got = {int(r.reply) for r in external.with_completion(long, "t", sizes, batch=1_000).collect()}
    assert max(got) <= 20
