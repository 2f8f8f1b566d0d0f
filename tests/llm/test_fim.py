"""Fill-in-middle against the contract in plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) of a document, with all units in a list."""
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.MARKERS) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(1)
    out = [None, "", " ", "\n\t ", "one", " one", "one ", "a <P> b", "<S>", "x<M>", "tail <P", "<", "<S", "é ñ \U0001f600 ü", "a\xa0b c d", "very " * 50_000, " " * 30_000, "x" * 30_000]
    for _ in range(200):
        out.append("".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "é", "\U0001f600", "\xa0", "<", "P>", "<M", "ß"]) for _ in range(rng.randrange(40))))
    return out


def test_outputs_equal_the_plain_rule_and_come_back(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id here"), (7, "one two three"), (7, "one two three")]
    out = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), r.text or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out) == sorted((str(i), t or "", *plainly(i, t), t or "") for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_places_are_ends_of_units():
    for text in filter(None, texts()):
        units = UNIT.findall(text[:5_000])
        assert fim.count_units(text[:5_000]) == len(units)
        for a in range(0, len(units) + 1, max(1, len(units) // 5)):
            for b in range(a, len(units) + 1, max(1, len(units) // 5)):
                assert fim.cut_places(text[:5_000], a, b) == (len("".join(units[:a])), len("".join(units[:b])))


def test_columns_that_clash_other_markers_and_empty_tables(spark):
    df = spark.createDataFrame([(i, f"a b c {i}", "mine", 5, "z") for i in range(40)], "doc_id long, text string, form string, n int, other string")
    out = fim.fill_in_middle(df, percent=100, spm_percent=0, markers=("[pre]", "[suf]", "[mid]"))
    assert out.columns == ["doc_id", "text", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.withColumn("back", fim.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect()
    assert {r.form for r in rows} == {"psm"} and all(r.back == r.text and r.output.startswith("[pre]") for r in rows)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "x"), ("aa", "x", "y"), ("abc", "b", "x")])
def test_markers_that_can_be_confused_are_refused(markers):
    with pytest.raises(ValueError):
        fim.checked(markers)
