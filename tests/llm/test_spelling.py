"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pytest

from folioflow.llm import spelling


def counted(rows):
    out = collections.Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'null' if key is None else key}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= ratio * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


def test_counts_of_whole_texts(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdéÀÿ×") for _ in range(rng.randrange(3, 12))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary).upper() if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(None, "abcdefg " * 900), (5, None), (5, ""), (6, "z" * 30_000), (7, "wörter,wörter;wörterŁwörter-wörter1wörter_wörter"), rows[0], rows[0]]
    expect = counted(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(map(tuple, spelling.count_words(df).collect())) == expect and len(expect) > 20
    for piece in (1, 50):  # pieces end between words
        monkeypatch.setattr(spelling, "PIECE", piece)
        got = collections.Counter()
        for k, text in rows:
            for w, n in spelling.text_words("null" if k is None else str(k), text or ""):
                got[w] += n
        assert {w: n for w, n in got.items() if n >= 5} == expect


@pytest.mark.parametrize("hot", [1, 8, 256])
def test_groups_equal_brute_force_at_any_bound_of_hot_keys(spark, hot):
    rng = random.Random(hot)
    words = {}
    for _ in range(120):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 10)))
        words[w] = rng.choice([5, 6, 30, 31, 200, 200, 5000])
    for end in "abcdefghijklmnop":  # many words share one half, and many the other
        words[f"common{end}"], words[f"{end}common"], words[f"common{end}{end}"] = rng.randrange(5, 40), rng.randrange(5, 40), 7
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "x" * 3000: 9, "x" * 3001: 45, "x" * 2999 + "y": 9, "日本語日本語": 5, "日本語日本人": 25}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.group_variants(df, hot=hot)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert key(got.collect()) == key(grouped(words))


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([("planet", 30), ("planet", 10), ("plamet", 8), (None, 9), ("", 9), ("alone!", 5)], "word string, n long")
    assert key(spelling.group_variants(df).collect()) == [("alone!", None, "alone!", 5, 0, None), ("plamet", "planet", "planet", 8, 1, 40), ("planet", None, "planet", 40, 1, None)]
    assert spelling.group_variants(df.limit(0)).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, n string, word string")
    assert spelling.count_words(empty).count() == 0
