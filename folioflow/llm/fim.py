"""Fill-in-middle transformation: a document is cut at two units and its pieces are put in another order, with markers between.

Units are matched left to right by a lazy iterator, twice, in constant memory beside the text: the first pass counts
them, the second goes on to both ranks and stops there; no array of units exists. Python sees the text and two
hashes and returns three numbers; hashing, the choice of a form, the cutting and the joining are column expressions.

A document's draws come from the sha256 of `seed:` and its id, so reruns agree and rows may come in any order.

Defined results: a null text is empty, and an empty one is plain with no units; a text that holds a marker is plain, so
that every output can be undone; a null id is drawn as `null`; rows that repeat an id and a text come out alike; an
empty table gives an empty table; further columns pass through (the added names are replaced if present).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import give_back, small_batches

#: A unit: a word with the white space before it, or white space at the end.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def count_units(text: str) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def cut_places(text: str, first: int, second: int) -> tuple[int, int]:
    """Code points of text up to the end of its first-th and of its second-th unit (0 for the 0th); first <= second."""
    units, ends = UNIT.finditer(text), [0]
    for n in (first, second - first):
        m = next(itertools.islice(units, n - 1, None), None) if n else None
        ends.append(m.end() if m else ends[-1])
    return ends[1], ends[2]


def checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """Markers that can be told apart wherever they stand: none is part of another, or ends as one begins."""
    for a, b in itertools.product(markers, repeat=2):
        if not a or (a is not b and a in b) or any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)))):
            raise ValueError("markers must not be empty, hold each other or overlap")
    if len(set(markers)) != 3:
        raise ValueError("markers must differ")
    return markers


def fill_in_middle(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, markers=MARKERS) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    percent of the documents are cut, spm_percent of those come suffix first.
    """
    small_batches(docs.sparkSession)
    p, s, m = checked(tuple(markers))

    @F.pandas_udf("n long, first long, second long")
    def places(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, one, two in batches:
            out = []
            for text, a, b in zip(texts, one, two, strict=True):
                n = count_units(text)
                a, b = sorted((a % (n + 1), b % (n + 1)))
                out.append((n, *cut_places(text, a, b)))
            yield pd.DataFrame(out, columns=["n", "first", "second"], dtype="int64")
        give_back()

    text, h = F.coalesce(F.col(text_col), F.lit("")), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key_col).cast("string"), F.lit("null"))), 256)
    draw = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    kept = [docs[c] for c in docs.columns if c not in ADDED]
    once = places.asNondeterministic()  # so that filters on the result don't run it again
    x = docs.select(*kept, text.alias("__text"), draw[2].alias("__h3"), draw[3].alias("__h4"), once(text, draw[0], draw[1]).alias("__at"))
    marked = F.lit(False)
    for marker in (p, s, m):
        marked = marked | F.contains(F.col("__text"), F.lit(marker))
    plain = (F.col("__text") == "") | marked | (F.col("__h3") % 100 >= percent)
    x = x.withColumn("__form", F.when(plain, "plain").when(F.col("__h4") % 100 < spm_percent, "spm").otherwise("psm"))
    a, b, t = F.col("__at.first"), F.col("__at.second"), F.col("__text")
    prefix, middle, suffix = F.substr(t, F.lit(1), a.cast("int")), F.substr(t, (a + 1).cast("int"), (b - a).cast("int")), F.substr(t, (b + 1).cast("int"))
    cut_up = F.when(F.col("__form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle)).when(F.col("__form") == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)).otherwise(t)
    is_cut = F.col("__form") != "plain"
    return x.select(
        *[c for c in docs.columns if c not in ADDED], F.col("__at.n").alias("n"), F.col("__form").alias("form"), F.when(is_cut, a).alias("prefix_chars"), F.when(is_cut, b - a).alias("middle_chars"), cut_up.alias("output")
    )


def restored(output: Column, form: Column, markers=MARKERS) -> Column:
    """The text that an output was made of."""
    p, s, m = markers

    def pieces(one: str, two: str) -> tuple[Column, Column, Column]:
        """What follows the first, the second and the last marker."""
        body = F.substr(output, F.lit(len(one) + 1))
        i = F.instr(body, two)
        rest = F.substr(body, i + len(two))
        j = F.instr(rest, m)
        return F.substr(body, F.lit(1), i - 1), F.substr(rest, F.lit(1), j - 1), F.substr(rest, j + len(m))

    before, after, middle = pieces(p, s)
    psm = F.concat(before, middle, after)
    after, before, middle = pieces(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(before, middle, after)).otherwise(output)
