"""The pipeline against brute force, stage by stage, on a small table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import mixing, queries
from tests.llm.test_operators import DOCS, brute_components, prose


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, passage = [], prose(rng, 60, 40000)
    for i in range(120):
        text = prose(rng, rng.randrange(30, 150), 40000)
        if i % 6 == 0:
            text += "\n" + passage
        rows.append((i, text, "en" if i % 2 else "fr", f"src{i % 4}"))
    rows += [(200 + i, rows[i][1], "en", "src0") for i in range(10)]  # exact copies
    for i in range(20, 30):  # near copies
        words = rows[i][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((300 + i, " ".join(words) if len(words) > 80 else rows[i][1] + " x", "en", "src1"))
    rows += [(400, None, "en", "src0"), (401, "", "en", None), (402, "123 456 !!", "fr", "src2"), (None, prose(rng, 40), "en", "src3"), (500, rows[5][1], "en", "src0"), (500, rows[5][1], "en", "src0")]
    base = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], DOCS).write.parquet(f"file://{base}/documents.parquet")
    docs, out = spark.read.parquet(f"file://{base}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, f"file://{base}").write.parquet(f"file://{base}/{k}")
        docs = spark.read.parquet(f"file://{base}/{k}")
        out.append(docs.collect())
    return rows, out, passage, base


def test_language_stage_drops_texts_without_letters_only(stages):
    rows, out, _, _ = stages
    assert sorted(map(str, (r.doc_id for r in out[0]))) == sorted(str(r[0]) for r in rows if r[1] and any(map(str.isalpha, r[1])))


def test_one_document_of_each_group_stays(stages):
    _, out, _, _ = stages
    given = [(r.doc_id, r.text) for r in out[0]]
    want = {d for d, _, c in brute_components(given, 5, 80) if d == c or d == "None"}
    assert sorted(str(r.doc_id) for r in out[1]) == sorted(want)


def test_passage_stays_in_one_document(stages):
    _, out, passage, _ = stages
    holders = [r.doc_id for r in out[2] if passage in r.text]
    before = [r.doc_id for r in out[1] if r.doc_id is not None and passage in r.text]
    assert len(before) > 5 and holders == [min(before)]
    was = {r.doc_id: r.text for r in out[1]}
    for r in out[2]:
        assert r.n_chars == len(r.text) and (r.doc_id in before or r.text == was[r.doc_id])


def test_mix_and_tokens(spark, stages):
    _, out, _, base = stages
    counted = mixing.mix_counts(spark.read.parquet(f"file://{base}/2")).collect()
    assert len(out[3]) == len(out[4]) == sum(r.copies for r in counted)
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary_path())
    want = sorted((str(r.doc_id), tuple(lib.encode(r.text, add_special_tokens=False).ids)) for r in out[3])
    assert sorted((str(r.doc_id), tuple(np.array(r.ids).tolist())) for r in out[4]) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out[4])


def test_run_gives_the_last_stage(spark, stages):
    _, out, _, base = stages
    got = corpus_pipeline.run(spark, f"file://{base}").collect()
    assert sorted(map(str, got)) == sorted(map(str, out[4]))


def chained(spark, docs, base):
    out = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, f"file://{base}").write.parquet(f"file://{base}/{k}")
        docs = spark.read.parquet(f"file://{base}/{k}")
        out.append(docs)
    return out


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    out = chained(spark, docs, tmp_path)
    assert all(d.count() == 0 for d in out) and all(d.columns == docs.columns for d in out[:-1])


def test_stages_with_clashing_columns_and_a_very_long_text(spark, tmp_path):
    rng = random.Random(12)
    long = prose(rng, 120000, 90000)
    rows = [(1, long, None, None), (2, prose(rng, 30, 9000) + " " + long[-5000:], "en", None), (3, prose(rng, 60, 9000), None, "a"), (3, prose(rng, 60, 9000), None, "a"), (4, "one word", "fr", "b")]
    docs = spark.createDataFrame([(*r, None) for r in rows], DOCS)
    names = ["spans", "removed_words", "clean_text", "size", "source_size", "rate", "copies", "lang_pred", "score", "held_out", "component_id", "set_id", "c", "component", "_id", "_doc", "_p", "_text", "k", "host", "ids", "n_tokens", "node", "key"]
    docs = docs.select("*", *[F.lit("x").alias(n) for n in names])
    out = chained(spark, docs, tmp_path)
    assert all(d.columns == docs.columns for d in out[:-1])
    kept = {r.doc_id: r for r in out[2].collect()}
    assert set(kept) <= {1, 2, 3, 4} and kept[1].text == long and len(kept[2].text) < 600 and kept[1]["_p"] == kept[1]["host"] == "x"
    assert out[4].where("not round_trip").count() == 0
