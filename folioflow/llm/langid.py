"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language on the cluster; the matrix of log probabilities (languages x buckets)
is small and broadcast; scoring is a sparse product: the counts of each text's own buckets times the matrix's
rows, for a batch of texts at once in numpy.

Training reads whole texts, but at most about `per_language` labelled rows of each language, drawn by a
hash of the key (the documented bound); prediction covers every row and whole texts and sees nothing but the text.
A long text is counted in pieces, so memory doesn't grow with it.

Defined results: a text that is null or has no letters is `und` with score 0, as is everything when there
is nothing to learn from; ties go to the language first in code-point order; repeated rows are predicted alike;
an empty table gives an empty table; further columns pass through (the added names are replaced if present).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import give_back, small_batches, tidy

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 17
UNKNOWN = "und"
#: Characters that are counted at a time, and numbers of the matrix that are added up at a time.
CHARS, CELLS = 500_000, 4_000_000
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def _runs(texts: list[str], chars: int) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of (text, piece, n) of about so many characters: lower-cased pieces with n characters of their own and those that their last n-grams run into."""
    run, size = [], 0
    for i, t in enumerate(texts):
        low = t.lower()
        for at in range(0, len(low), chars):
            run.append((i, low[at : at + chars + ORDERS[-1] - 1], min(chars, len(low) - at)))
            size += run[-1][2]
            if size >= chars:
                yield run
                run, size = [], 0
    if run:
        yield run


def ngram_counts(texts: list[str], chars: int = CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, count) arrays for runs of texts, sorted: how often each text has n-grams of a bucket. A long text is in several runs."""
    for run in _runs(texts, chars):
        codes = np.frombuffer("".join(p for _, p, _ in run).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = np.array([len(p) for _, p, _ in run])
        own = np.repeat(np.array([n for _, _, n in run]), size)
        start = np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
        place = np.arange(len(codes)) - start  # inside its piece
        left = np.repeat(size, size) - place
        row = np.repeat(np.array([i for i, _, _ in run], dtype=np.int64), size) * BUCKETS
        h, keys = np.zeros(len(codes), dtype=np.uint32), []
        for n in ORDERS:
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :] * _MULT[(n - 1) % 4] if len(codes) >= n else h[:0]
            g = h ^ (h >> np.uint32(15))
            g = (g * np.uint32(0x2C1B3C6D)) >> np.uint32(15)
            here = (place < own)[: len(g)] & (left >= n)[: len(g)]
            keys.append(row[: len(g)][here] + g[here])
        found, count = np.unique(np.concatenate(keys), return_counts=True)
        yield found // BUCKETS, found % BUCKETS, count


def train(docs: DataFrame, label_col: str, text_col: str = "text", key_col: str = "doc_id", per_language: int = 5_000, block: int = 4_096):
    """(languages, log priors, matrix of log probabilities) from rows with a label and a text."""
    docs = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in docs.groupBy(label_col).count().collect()}  # one row per language
    langs = sorted(counts)
    if not langs:
        return [], np.zeros(0), np.zeros((BUCKETS, 0))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(label_col) == lang, min(1.0, per_language / n)).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(8), key_col), 11).cast("double") / float(1 << 53)
    sample = docs.where(draw < share).select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                total = found.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for _, bucket, n in ngram_counts([t for t in rows["text"] if t]):
                    np.add.at(total, bucket, n)
        for lang, total in found.items():
            yield pd.DataFrame({"lang": lang, "block": range(BUCKETS // block), "n": [total[i : i + block] for i in range(0, BUCKETS, block)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "block": [group["block"].iloc[0]], "n": [np.sum(np.stack(group["n"].to_list()), axis=0)]})

    schema = "lang string, block int, n array<long>"
    summed = sample.mapInPandas(tidy(count), schema).groupBy("lang", "block").applyInPandas(add, schema)
    matrix = np.full((BUCKETS, len(langs)), 0.1)  # additive smoothing
    for lang, b, n in summed.toLocalIterator():  # languages * BUCKETS numbers in all
        matrix[b * block : (b + 1) * block, langs.index(lang)] += n
    prior = np.log(np.array([counts[x] for x in langs]) / sum(counts.values()))
    return langs, prior, np.log(matrix / matrix.sum(axis=0))


def score_texts(texts: list[str], model, chars: int = CHARS) -> tuple[list[str], list[float]]:
    """Language and posterior probability of each text."""
    langs, prior, matrix = model
    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    there = [i for i, t in enumerate(texts) if isinstance(t, str) and any(map(str.isalpha, t))] if langs else []
    if not there:
        return pred, score
    total = np.tile(prior, (len(there), 1))
    step = max(1, CELLS // len(langs))
    for text, bucket, n in ngram_counts([texts[i] for i in there], chars):
        for at in range(0, len(text), step):
            t = text[at : at + step]
            edge = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            total[t[edge]] += np.add.reduceat(matrix[bucket[at : at + step]] * n[at : at + step, None], edge, axis=0)
    best = total.argmax(axis=1)
    prob = 1.0 / np.exp(total - total[np.arange(len(there)), best][:, None]).sum(axis=1)
    for k, i in enumerate(there):
        pred[i], score[i] = langs[best[k]], float(prob[k])
    return pred, score


def predict(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. Only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            pred, score = score_texts(texts.to_list(), shared.value)
            yield pd.DataFrame({"lang_pred": pd.Series(pred, dtype=object), "score": score})
        give_back()

    once = work.asNondeterministic()  # so that filters on the result don't run it again
    kept = [docs[c] for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, once(docs[text_col]).alias("__lang")).select(*[c for c in docs.columns if c not in ("lang_pred", "score")], "__lang.lang_pred", "__lang.score")


def identify(docs: DataFrame, keep: list[str], per_language: int = 5_000) -> DataFrame:
    """Train on documents whose crc32(doc_id) mod 4 is not 2, predict all; held_out marks the others. A null doc_id is neither trained on nor held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = train(docs.where(fold != 2), "lang", per_language=per_language)
    marked = docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    return predict(marked, model).select(*[c for c in keep if c not in ("held_out", "lang_pred", "score")], "held_out", "lang_pred", "score")
