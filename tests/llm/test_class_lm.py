"""The class model: counts against brute force, exchange against recomputed likelihoods, probabilities that add up, held-out accuracy."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import class_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def based(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score), plainly."""
    fold = lambda k: None if k is None else zlib.crc32(str(k).encode()) % 7
    c = collections.Counter(w for k, t in rows if fold(k) not in (None, 2) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(k, fold(k) == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for k, t in rows]


def grammar(seed=0, n=250):
    """Texts in which kinds of words follow each other, with rare words, nulls, blanks, repeats and a long text."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}{e}" for i in range(30)] for k, e in (("the", "x"), ("adj", "ly"), ("noun", "s"), ("verb", "ed"))]
    one = lambda: " ".join(rng.choice(kinds[i % 4]) if rng.random() > 0.05 else f"Rare{rng.randrange(10**6)}{'sy'[i % 2]}" for i in range(rng.randrange(4, 60)))
    rows = [(i, one()) for i in range(n)]
    return rows + [(1001, None), (1002, ""), (1003, " \n\t"), (None, "thex nobody"), rows[3], rows[3], (1004, " ".join(one() for _ in range(300))), (1005, "É é THE0X the0x"), (1006, "y" * 20_000)]


@pytest.mark.parametrize("share", [1 << 16, 50])
def test_base_columns_equal_brute_force_and_the_model_beats_them(spark, share):
    rows = grammar()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, other string")
    out = class_lm.score(df, ["doc_id", "other", "score"], share=share, classes=8, rounds=8, suffixes=64)
    assert out.columns == ["doc_id", "other", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect()), key=str)
    assert got == sorted(((*r[:5], round(r[5], 6)) for r in based(rows)), key=str)
    held = out.where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    assert held.s / held.n > held.b / held.n + 0.2
    again = class_lm.score(df.repartition(5), ["doc_id"], share=share, classes=8, rounds=8, suffixes=64)
    assert sorted(map(str, again.select("doc_id", F.round("score", 9)).collect())) == sorted(map(str, out.select("doc_id", F.round("score", 9)).collect()))


def test_sequences_in_pieces(monkeypatch):
    texts = ["a B  c", None, "", "x " * 4000 + "End", "  one\ntwo ", "q" * 3000]
    whole = [np.concatenate(x) for x in zip(*class_lm.sequences(texts), strict=True)]
    small = [np.concatenate(x) for x in zip(*class_lm.sequences(texts, chunk=64), strict=True)]
    for a, b in zip(whole, small, strict=True):
        assert (a == b).all()
    assert np.bincount(whole[0]).tolist() == [len(tokens(t)) for t in texts] and (whole[1] == class_lm.END).sum() == len(texts)


def test_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(0)
    n, k = 40, 7
    seq = np.concatenate(([0], rng.integers(0, n, 3000), [0]))
    seq[rng.integers(1, 3000, 300)] = 5  # a unit that follows itself
    seq[rng.integers(1, 3000, 300) + 1] = 5
    bigrams = np.zeros((n, n))
    np.add.at(bigrams, (seq[:-1], seq[1:]), 1)
    counts = bigrams.sum(axis=0)
    classes = rng.integers(0, k, n)

    def of(c):
        p = np.zeros((k, k))
        np.add.at(p, (np.repeat(c, n), np.tile(c, n)), bigrams.ravel())
        return p

    pairs, sizes = of(classes), np.bincount(classes, weights=counts, minlength=k)
    for unit in range(1, n):
        own, at = bigrams[unit, unit], classes[unit]
        before, after = np.bincount(classes, weights=bigrams[:, unit], minlength=k), np.bincount(classes, weights=bigrams[unit], minlength=k)
        before[at] -= own
        after[at] -= own
        got = class_lm.gains(pairs, sizes, at, before, after, own, counts[unit])
        for to in range(k):
            moved = classes.copy()
            moved[unit] = to
            assert got[to] == pytest.approx(class_lm.likelihood(of(moved)) - class_lm.likelihood(pairs), abs=1e-6)


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    classes = np.array([0, 1, 1, 2, 4, 4, 4])  # class 3 is empty
    counts, pairs = np.array([9, 5, 0, 7, 1, 2, 0]), np.zeros((5, 5))
    pairs[np.ix_([0, 1, 2], [0, 1, 2, 4])] = rng.integers(0, 9, (3, 4))
    p = 10 ** class_lm.transitions(pairs, classes)
    there = np.array([0, 1, 2, 4])
    assert p[:, there].sum(axis=1) == pytest.approx(np.ones(5)) and (p[:, there] > 0).all()
    assert np.bincount(classes, weights=10 ** class_lm.emissions(counts, classes)) == pytest.approx([1, 1, 1, 0, 1])


def test_exchange_finds_the_kinds(spark):
    rng = random.Random(5)
    text = " ".join(f"{'abcd'[i % 4]}{rng.randrange(12)}" for i in range(8000))
    df = spark.createDataFrame([(0, text), (3, text)], "doc_id long, text string")
    words = class_lm.count_words(df, "text", 16).where("w != 0").toPandas()
    units = class_lm.Units(words["w"].to_numpy().view(np.uint64), words["n"].to_numpy(), np.zeros(16, dtype=np.int64), 2)
    classes, _ = class_lm.exchange(class_lm.neighbours(df, "text", units, 16), units.counts, 6, 16)
    hashes = {f"{c}{i}": next(class_lm.sequences([f"{c}{i}"]))[1] for c in "abcd" for i in range(12)}
    of = {w: classes[units.of(h[:1], np.zeros(1, dtype=np.int32))[0]] for w, h in hashes.items()}
    for c in "abcd":
        _, most = collections.Counter(of[f"{c}{i}"] for i in range(12)).most_common(1)[0]
        assert most >= 6
    assert all(of[f"a{i}"] != of[f"b{j}"] for i in range(12) for j in range(12))


def test_nothing_to_learn_from_and_empty_tables(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = class_lm.score(df, ["doc_id"]).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0
    assert class_lm.score(df.limit(0), ["doc_id"]).count() == 0


def test_rows_of_scratch_tables_stay_narrow(spark, monkeypatch):
    seen, stored = {}, class_lm.stored
    monkeypatch.setattr(class_lm, "stored", lambda df, name: seen.setdefault(name, stored(df, name)))
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert class_lm.score(df, ["doc_id"], share=50, classes=8, rounds=2, suffixes=64).count() == len(rows)
    blocks = seen["class-blocks"][0]
    lists = [F.coalesce(F.size(f.name), F.lit(0)) for f in blocks.schema if f.dataType.typeName() == "array"]
    # a reader holds rows by number: a row has the documents of one word, not the words of a block of documents
    assert blocks.select(sum(lists).alias("n")).agg(F.max("n")).first()[0] < 200


def test_small_blocks_and_files_give_the_same(spark, monkeypatch):
    rows = grammar()
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    run = lambda: sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))) for r in class_lm.score(df, ["doc_id"], share=50, classes=8, rounds=4, suffixes=64).collect())
    whole = run()
    monkeypatch.setattr(class_lm, "BLOCK", 1)
    monkeypatch.setattr(class_lm, "PAIRS", 100)
    monkeypatch.setattr(class_lm, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20"))
    try:
        assert run() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
