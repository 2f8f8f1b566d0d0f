"""The stream of chunks to be embedded: results once, tries again after failures, bad texts given up."""

import time

import pytest

from folioflow.streaming import queue

SCHEMA = "id long, parent_id long, content string, vector_status string, embedding array<float>"


def embed(texts):
    """Fails for any call with a bad text."""
    if any("bad" in t for t in texts):
        raise RuntimeError("refused")
    return [[float(len(t))] for t in texts]


def test_one_pass(spark):
    rows = [(i, 1, f"text {i}", "to_vec", None) for i in range(250)]
    rows += [(1000, 1, " ", "to_vec", None), (1001, 1, None, "to_vec", None), (1002, None, "root", "to_vec", None), (1003, 1, "done", "vec", [1.0]), (1004, 1, "x", "no_vec", None), (1005, 1, "y", "to_vec", [1.0]), (None, 1, "z", "to_vec", None)]
    got = {r.id: r for r in queue.vectorised(spark.createDataFrame(rows, SCHEMA), embed, shards=3, batch=7).collect()}
    assert sorted(got) == [*range(250), 1000, 1001]
    assert all(got[i].vector_status == "vec" and got[i].embedding == [float(len(f"text {i}"))] and got[i].attempts == 1 for i in range(250))
    assert {got[i].vector_status for i in (1000, 1001)} == {"vec_err"}
    assert queue.vectorised(spark.createDataFrame([], SCHEMA), embed).count() == 0


def test_failures_wait_and_are_tried_again(spark, tmp_path):
    """A bad text takes its batch along the first time; alone, the others go through, and it is given up after its last try."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(i, 1, "bad" if i == 5 else f"t{i}", "to_vec", None) for i in range(20)], SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    q = queue.start(queue.vectorise_stream(stream, embed, shards=1, most=3, wait_ms=200), out, f"{tmp_path}/state", processingTime="200 milliseconds")
    try:
        end = time.time() + 120
        rows = []
        while time.time() < end and len(rows) < 20:
            time.sleep(1)
            assert q.exception() is None
            try:
                rows = spark.read.schema(queue.RESULT).parquet(out).collect()
            except Exception:  # noqa: BLE001 - nothing written yet
                rows = []
    finally:
        q.stop()
    assert sorted(r.id for r in rows) == list(range(20))
    assert {r.id: (r.vector_status, r.attempts) for r in rows} == {i: ("vec_err", 3) if i == 5 else ("vec", 2) for i in range(20)}
    assert next(r.error for r in rows if r.id == 5) == "RuntimeError: refused"


@pytest.mark.parametrize("n", [0, 3])
def test_a_model_that_gives_too_few_vectors_fails(spark, n):
    rows = spark.createDataFrame([(i, 1, "t", "to_vec", None) for i in range(4)], SCHEMA)
    assert {r.vector_status for r in queue.vectorised(rows, lambda t: [[0.0]] * n, shards=1).collect()} == {"vec_err"}
