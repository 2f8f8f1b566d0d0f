"""Spelling variants: words that differ by one code point, grouped under their frequent forms.

Words within one edit are found by an even-partition pigeonhole join. A word is cut in two halves by its length; one edit
leaves one of them as it is, so each word is indexed by (length, first half) and (length, second half), and each word
probes, for its own length and the one below, with its own beginning and its own end of those lengths (the end moved by one
place where the word is longer). Candidates are verified as the join's condition and freed of repeats.

A half that over HOT words share isn't joined as it is. What is left between the known ends is halved again, by the same
argument, and the words move to the longer keys; this goes on until a key has few words or its words differ in one place,
so work is bounded by HOT times the probes, and no pair is lost.

Defined results: a null text has no words; a null id is counted as `null`; repeated rows count each time; null words and
those without letters are left out of a given list, repeated ones are added up; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import remove_path, small_batches, stored, tidy

LETTERS = "A-Za-zÀ-ÿ"
#: Index entries of a key that are joined as they are.
HOT = 256
#: Words that a task holds before it hands their counts on, and code points of a text that are looked at at a time.
HELD, PIECE = 200_000, 1_000_000
_OTHER = re.compile(f"[^{LETTERS}]")
_KEY = ["l", "head", "tail"]


def text_words(key: str, text: str, shortest: int = 6, one_in: int = 199) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text's letter runs, A-Z lower-cased; one in so many (document, run) pairs loses a code point, as typing does."""
    run = re.compile(f"[{LETTERS}]{{{shortest},}}")
    start, low, at = zlib.crc32(f"{key}:".encode()), text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), 0
    while at < len(low):
        m = _OTHER.search(low, at + PIECE)
        end = m.end() if m else len(low)
        for word, n in Counter(run.findall(low, at, end)).items():
            h = zlib.crc32(word.encode(), start)
            if h % one_in == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1 :]
            if len(word) >= shortest:
                yield word, n
        at = end


def count_words(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of words of so many code points that occur so often in all documents."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in text_words(key, text, shortest):
                    found[word] += n
                if len(found) > HELD:
                    yield rows()
        if found:
            yield rows()

    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(key_col).cast("string"), F.lit("null")), F.col(text_col))
    return texts.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halved(df: DataFrame, word: str) -> DataFrame:
    """df with two keys instead of its key: the known ends of a word, and one more half of the l - p - q code points between."""
    left = F.col("l") - F.col("p") - F.col("q")
    half = F.floor(left / 2).cast("int")
    ends = F.explode(F.array(F.struct((F.col("p") + half).alias("p"), F.col("q").alias("q")), F.struct(F.col("p").alias("p"), (F.col("q") + left - half).alias("q"))))
    x = df.select(word, f"{word}_n", "l", ends.alias("e")).select(word, f"{word}_n", "l", "e.p", "e.q")
    w = F.col(word)
    return x.withColumns({"head": F.substr(w, F.lit(1), F.col("p")), "tail": F.substr(w, F.length(w) - F.col("q") + 1, F.col("q"))})


def _verified(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Pairs of the index and the probes under equal keys that one edit apart; of words of equal length, each pair once."""
    i, p = index.select(*_KEY, "a", "a_n"), probes.select(*_KEY, "b", "b_n")
    near: Column = ((F.length("b") > F.col("l")) | (F.col("a") < F.col("b"))) & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1)
    return i.join(p, _KEY).where(near).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, a_n, b, b_n): every two of the distinct words (word, n) that are one edit apart, once, b the longer or else the later one."""
    spark = words.sparkSession
    zero = {"p": F.lit(0), "q": F.lit(0)}
    index = _halved(words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.length("word").alias("l")).withColumns(zero), "a")
    probes = _halved(words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("l")).where("l > 0").withColumns(zero), "b")
    out, used = [], []
    while True:
        often = index.where("l - p - q > 1").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select(*_KEY)
        often, path = stored(often, "spelling-hot")
        used.append(path)
        if often.isEmpty():
            out.append(_verified(index, probes))
            break
        found, path = stored(_verified(index.join(often, _KEY, "left_anti"), probes.join(often, _KEY, "left_anti")), "spelling-pairs")
        out.append(found)
        used.append(path)
        index, path = stored(_halved(index.join(often, _KEY, "left_semi"), "a"), "spelling-index")
        used.append(path)
        probes, path = stored(_halved(probes.join(often, _KEY, "left_semi"), "b"), "spelling-probes")
        used.append(path)
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.unionAll(more)
    pairs, _ = stored(pairs.distinct(), "spelling-near")
    for path in used:
        remove_path(spark, path)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that lead on from a word. forms (word, form) has one row a word and no circles; each round doubles the way that is known."""
    spark = forms.sparkSession
    links, path = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined, after = stored(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        remove_path(spark, path)
        links, path = joined.select("word", "root"), after
        if joined.where("moved").isEmpty():
            return links


def group_variants(words: DataFrame, ratio: int = 5, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word (word, n).

    form is the near word of largest n (ties: the first in code-point order) if it has ratio times the word's n, else null;
    root is the last form from there, the word itself if it has none.
    """
    words, _ = stored(words.where("word != ''").groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    pairs = near_pairs(words, hot)
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionAll(pairs.select("b", "b_n", "a", "a_n"))
    rows = both.unionByName(words, allowMissingColumns=True)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    t = rows.groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    t = t.select("word", "n", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    t, _ = stored(t, "spelling-forms")
    r = roots(t.where("form is not null").select("word", "form"))
    return t.join(r, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
