"""Scoring texts by a class-based n-gram model (Brown classes), learned from the corpus itself.

P(word | previous word) = P(class | previous class) * P(word | class). Classes are found by exchange: starting with words dealt
by frequency, each round moves words to the class that raises the likelihood of the training tokens most.

Words come in two kinds. A word that makes up at least one in SHARE training tokens (and isn't seen once only) is a unit of its own; by
arithmetic there are at most SHARE of these, at any corpus size. All other words, the unseen included, belong to one of SUFFIXES units by their
last three bytes; inside such a unit a word has its own discounted frequency and what the discount frees is the unseen
words'. So units, classes and their matrices are of bounded size and go to every task, while the counts of all words
stay in a table, and texts meet them in blocks: the distinct rare words of a block of documents are looked up by a join. No row is wide: a document is
one, a rare word of a block is one, with the documents that have it, so readers and joins, which hold rows by number, hold little at any size of the table.

Passes: count words; count pairs of units; find classes over lists of neighbours, one row a unit; score documents up to
their rare words; look those up. All counts cover every training token. Counts are integers and rounds depend on them alone, so reruns agree.

Probabilities of the units of a class, of the classes after a class and of the words of a suffix unit each add up to one.

Defined results: a null text is empty and has one token, its end; a null id is neither learned from nor held out; repeated rows count each time and
are scored alike; with nothing to learn from, all is smoothing; an empty table gives an empty table; texts of any length are read in pieces. Kept
columns with the name of an added one are left out. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import CHUNK, _hashed, _pieces, mix64, remove_path, shrink_heaps, small_batches, stored, tidy

#: Part of the training tokens from which a word is a unit; units of other words, by their ends; classes; rounds of exchange.
SHARE, SUFFIXES, CLASSES, ROUNDS = 1 << 16, 1 << 11, 128, 12
#: Pairs of units in a file of lists of neighbours, about.
PAIRS = 1 << 19
#: Tokens of rare words in a block, about.
BLOCK = 1 << 20
#: Taken off each count of a pair of classes.
DISCOUNT = 0.5
END = np.uint64(0)
ADDED = T.StructType([T.StructField("held_out", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]])


# ---------------------------------------------------------------- tokens


def _words(data: bytes, suffixes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, suffix units) of the words of lower-cased bytes; no hash is END."""
    starts, ends, hashes = _hashed(data)
    buf, key = np.frombuffer(data, dtype=np.uint8), np.zeros(len(starts), dtype=np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        key = key * np.uint64(256) + np.where(at >= starts, buf[np.maximum(at, 0)] if len(buf) else 0, 0).astype(np.uint64)
    hashes[hashes == END] = 1
    return starts, hashes, (mix64(key) % np.uint64(suffixes)).astype(np.int32)


def sequences(texts: list, suffixes: int = SUFFIXES, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, word, suffix unit) of the tokens of all texts in turn, in runs of about `chunk` bytes; each text ends with END. A long text comes in pieces."""
    at = 0
    while at < len(texts):
        raw, size, first = [], 0, at
        while at < len(texts) and (not raw or size < chunk):
            b = (texts[at] or "").encode("utf-8", "surrogatepass").lower()  # A-Z only
            if raw and size + len(b) > 2 * chunk:
                break
            raw.append(b)
            size += len(b) + 1
            at += 1
        if len(raw) == 1 and size > 2 * chunk:
            for _, piece in _pieces(raw[0], chunk):
                _, words, ends = _words(piece, suffixes)
                yield np.full(len(words), first), words, ends
            yield np.array([first]), np.array([END]), np.array([0], dtype=np.int32)
            continue
        starts, words, ends = _words(b"\n".join(raw), suffixes)
        bounds = np.cumsum([0] + [len(b) + 1 for b in raw])
        docs = np.searchsorted(bounds, starts, side="right") - 1
        place = np.arange(len(words)) + docs  # an END stands after each text before
        n = len(words) + len(raw)
        doc, word, end = np.zeros(n, dtype=np.int64), np.full(n, END), np.zeros(n, dtype=np.int32)
        is_end = np.ones(n, dtype=bool)
        doc[place], word[place], end[place], is_end[place] = docs, words, ends, False
        doc[is_end] = np.arange(len(raw))
        yield doc + first, word, end


class Units:
    """Which unit a token is: 0 the end, then the frequent words, then the suffix units."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, suffix_counts: np.ndarray, ends: int):
        order = np.lexsort((words, -counts))
        self.words, self.counts = words[order], np.concatenate(([ends], counts[order], suffix_counts)).astype(np.int64)
        self.sorted = np.argsort(self.words)
        self.keys, self.suffix = self.words[self.sorted], 1 + len(words)

    def of(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.suffix + ends.astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
            out = np.where(self.keys[at] == words, 1 + self.sorted[at], out)
        return np.where(words == END, 0, out)


# ---------------------------------------------------------------- counting


def count_words(docs: DataFrame, text_col: str, suffixes: int) -> DataFrame:
    """(w, suffix, n): how often each word is in docs; END has its row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = list(zip(*((w, e) for _, w, e in sequences(batch.column(0).to_pylist(), suffixes)), strict=True))
            if not runs:
                continue
            words, at, n = np.unique(np.concatenate(runs[0]), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.concatenate(runs[1])[at]), pa.array(n)], ["w", "suffix", "n"])

    return docs.select(text_col).mapInArrow(tidy(count), "w long, suffix int, n long").groupBy("w").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def neighbours(docs: DataFrame, text_col: str, units: Units, suffixes: int) -> DataFrame:
    """(unit, before, after): the lists of (unit, n) that stand before and after each unit, at most one entry a unit."""
    shared, size = docs.sparkSession.sparkContext.broadcast(units), len(units.counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, pairs = 0, []
            for _, words, ends in sequences(batch.column(0).to_pylist(), suffixes):
                unit = shared.value.of(words, ends)
                pairs.append(np.concatenate(([last], unit[:-1])) * size + unit)
                last = int(unit[-1]) if len(unit) else last
            if pairs:
                found, n = np.unique(np.concatenate(pairs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["pair", "n"])

    pairs = docs.select(text_col).mapInArrow(tidy(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs, path = stored(pairs.select(F.floor(F.col("pair") / size).cast("int").alias("a"), (F.col("pair") % size).cast("int").alias("b"), "n"), "class-pairs")
    after = pairs.groupBy(F.col("a").alias("unit")).agg(F.collect_list("b").alias("after"), F.collect_list("n").alias("after_n"))
    before = pairs.groupBy(F.col("b").alias("unit")).agg(F.collect_list("a").alias("before"), F.collect_list("n").alias("before_n"))
    files = pairs.count() // PAIRS + 1  # a reader holds the lists of thousands of units at once, so no file has more of them as tables grow
    out, _ = stored(before.join(after, "unit").repartition(files, F.col("unit")), "class-neighbours")
    remove_path(docs.sparkSession, path)
    return out


# ---------------------------------------------------------------- exchange


def _phi(x: np.ndarray) -> np.ndarray:
    """x log x of counts."""
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the training tokens' log likelihood that depends on classes."""
    return float(_phi(pairs).sum() - _phi(pairs.sum(axis=0)).sum() - _phi(pairs.sum(axis=1)).sum())


def gains(pairs: np.ndarray, sizes: np.ndarray, at: int, before: np.ndarray, after: np.ndarray, own: float, n: float) -> np.ndarray:
    """What the likelihood gains when a unit of class `at` moves to each class; before, after: counts by class of its neighbours but itself, own: of itself after itself."""
    rest = pairs.copy()
    rest[:, at] -= before
    rest[at, :] -= after
    rest[at, at] -= own
    left, classes = sizes.copy(), np.arange(len(sizes))
    left[at] -= n
    g, h = np.flatnonzero(before), np.flatnonzero(after)
    out = (_phi(rest[g] + before[g, None]) - _phi(rest[g])).sum(axis=0) + (_phi(rest[:, h] + after[h]) - _phi(rest[:, h])).sum(axis=1)
    loop = rest[classes, classes]  # pairs inside the class itself change from both sides
    out += _phi(loop + before + after + own) - _phi(loop + before) - _phi(loop + after) + _phi(loop)
    out -= 2 * (_phi(left + n) - _phi(left))
    return out - out[at]


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """unit, before, n, after, n of each row."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in ("before", "before_n", "after", "after_n")]
    for i, unit in enumerate(batch.column(batch.schema.get_field_index("unit")).to_pylist()):
        yield unit, *(c[i].values.to_numpy(zero_copy_only=False) for c in columns)


def class_pairs(lists: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """How often each class stands before each."""
    shared = lists.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros((k, k), dtype=np.int64), shared.value
        for batch in batches:
            for unit, _, _, after, n in _lists(batch):
                total[of[unit]] += np.bincount(of[after], weights=n, minlength=k).astype(np.int64)
        g, h = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(h), pa.array(total[g, h])], ["g", "h", "n"])

    out = np.zeros((k, k))
    rows = lists.mapInArrow(tidy(count), "g long, h long, n long").groupBy("g", "h").agg(F.sum("n").alias("n")).toPandas()  # at most k * k rows
    out[rows["g"].to_numpy(dtype=int), rows["h"].to_numpy(dtype=int)] = rows["n"]
    shared.unpersist()
    return out


def best_moves(lists: DataFrame, classes: np.ndarray, pairs: np.ndarray, counts: np.ndarray, turn: int) -> dict[int, int]:
    """The class that each unit whose turn it is gains most by moving to."""
    k = len(pairs)
    shared = lists.sparkSession.sparkContext.broadcast((classes, pairs, np.bincount(classes, weights=counts, minlength=k), counts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pairs, sizes, counts = shared.value
        for batch in batches:
            out = []
            for unit, before, before_n, after, after_n in _lists(batch):
                if unit == 0 or (int(mix64(np.array([unit * 64 + turn // 2]))[0]) + turn) % 2:
                    continue
                own = float(after_n[after == unit].sum())
                b, a = np.bincount(of[before], weights=before_n, minlength=k), np.bincount(of[after], weights=after_n, minlength=k)
                at = int(of[unit])
                b[at] -= own
                a[at] -= own
                g = gains(pairs, sizes, at, b, a, own, float(counts[unit]))
                g[0] = -np.inf  # the end is a class of its own
                best = int(np.argmax(g))
                if best != at and g[best] > 1e-6:
                    out.append((unit, best))
            unit, best = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(best, pa.int32())], ["unit", "best"])

    moves = lists.mapInArrow(tidy(work), "unit int, best int").toPandas()  # at most one row a unit
    shared.unpersist()
    return dict(zip(moves["unit"].tolist(), moves["best"].tolist(), strict=True))


def exchange(lists: DataFrame, counts: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, pairs of classes): the likeliest that rounds of exchange meet. Half of the units have a turn in a round, the other half in the next."""
    order = np.lexsort((np.arange(1, len(counts)), -counts[1:])) + 1
    classes = np.zeros(len(counts), dtype=np.int64)
    classes[order] = 1 + np.arange(len(order)) % (k - 1)
    pairs = class_pairs(lists, classes, k)
    best = (likelihood(pairs), classes.copy(), pairs)
    for turn in range(rounds):
        moves = best_moves(lists, classes, pairs, counts, turn)
        if not moves:
            if turn % 2:
                break
            continue
        classes = classes.copy()
        classes[list(moves)] = list(moves.values())
        pairs = class_pairs(lists, classes, k)
        if (now := likelihood(pairs)) > best[0]:
            best = (now, classes, pairs)
    return best[1], best[2]


# ---------------------------------------------------------------- the model


def transitions(pairs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 P(class | previous class): discounted pairs, the rest by the classes' own frequency; a class without units has none."""
    there = np.bincount(classes, minlength=len(pairs)) > 0
    alone = np.where(there, pairs.sum(axis=0) + 1.0, 0.0)
    alone /= alone.sum()
    n = pairs.sum(axis=1, keepdims=True)
    freed = DISCOUNT * (pairs > 0).sum(axis=1, keepdims=True)
    p = np.where(n > 0, (np.maximum(pairs - DISCOUNT, 0) + freed * alone) / np.maximum(n, 1), alone)
    return np.log10(np.where(there, p, 1.0))


def emissions(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 P(unit | its class), one added to each count."""
    total = np.bincount(classes, weights=counts + 1.0)
    return np.log10((counts + 1.0) / total[classes])


def score(docs: DataFrame, keep: list[str], key_col: str = "doc_id", text_col: str = "text", share: int = SHARE, suffixes: int = SUFFIXES, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """The kept columns of docs with held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the documents whose crc32(key) mod 7 is not 2; held_out marks the others. base_score is the texts' log10 probability by single words with one
    added to each count, score by the class model; perplexity is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.crc32(F.col(key_col).cast("string").cast("binary")) % 7
    learn = docs.where(fold != 2)
    words, words_path = stored(count_words(learn, text_col, suffixes), "class-words")
    tokens, types, once, twice = words.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    tokens = tokens or 0
    frequent = (F.col("n") * share >= tokens) & (F.col("n") > 1) & (F.col("w") != int(END))
    top = words.where(frequent).toPandas()  # at most `share` rows
    rare = words.where(~frequent & (F.col("w") != int(END)))
    ends = words.where(F.col("w") == int(END)).first()
    n_suffix, types_suffix = np.zeros(suffixes, dtype=np.int64), np.zeros(suffixes)
    for r in rare.groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():  # at most `suffixes` rows
        n_suffix[r["suffix"]], types_suffix[r["suffix"]] = r["n"], r["types"]
    units = Units(top["w"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64), n_suffix, ends["n"] if ends else 0)
    lists = neighbours(learn, text_col, units, suffixes)
    of, pairs = exchange(lists, units.counts, classes, rounds)
    off = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
    model = spark.sparkContext.broadcast((units, of, transitions(pairs, of), emissions(units.counts, of)))

    kept = [docs.schema[c] for c in keep if c not in ADDED.names]
    held = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    blocks = docs.select(F.struct(*[F.col(f.name) for f in kept], held).alias("row"), F.col(text_col).alias("text"))
    row = blocks.schema["row"].dataType
    shrink_heaps(spark)  # they grew under the shuffles of the counts
    made, _ = stored(blocks.mapInArrow(tidy(_block_scorer(model, suffixes)), T.StructType([T.StructField("block", T.LongType()), T.StructField("row", row), *_DOC, *_RARE])), "class-blocks")
    scored = made.where("doc IS NOT NULL").select("block", "row", *(f.name for f in _DOC))
    rare = made.where("w IS NOT NULL").select("block", *(f.name for f in _RARE)).join(words.select("w", "n"), "w", "left").drop("w")
    sums = rare.groupBy("block").applyInArrow(_summer(spark.sparkContext.broadcast((n_suffix, types_suffix, off))), "block long, doc int, rare_known long, rare_base double, rare_score double")
    with_rare = lambda c, zero: F.col(c) + F.coalesce(F.col(f"rare_{c}"), F.lit(zero))
    return scored.join(sums, ["block", "doc"], "left").select(
        "row.*", "n_tokens", with_rare("known", 0).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (with_rare("base", 0.0) - F.col("n_tokens") * F.lit(float(np.log10(tokens + types + 1)))).alias("base_score"), with_rare("score", 0.0).alias("score"),
    )


#: Of a document, its place in the block and what is known of it without its rare words; of a rare word of a block, places and numbers of times in turn of the documents that have it.
_DOC = [T.StructField("doc", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "known")], *[T.StructField(c, T.DoubleType()) for c in ("base", "score")]]
_RARE = [T.StructField("w", T.LongType()), T.StructField("suffix", T.IntegerType()), T.StructField("found", T.ArrayType(T.IntegerType()))]
_ARROW = {"doc": pa.int32(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "w": pa.int64(), "suffix": pa.int32(), "found": pa.list_(pa.int32())}


def _block_scorer(model, suffixes: int):
    """Batches of (row, text) to a row for each document and, for each block of consecutive documents, one for each distinct rare word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, of, trans, emit = model.value
        logs = np.log10(units.counts + 1.0)
        block, first, rare, row = TaskContext.get().partitionId() << 32, 0, [], None
        for batch in batches:
            m, last, row = batch.num_rows, 0, batch.column(0).type
            if not m:
                continue
            n, known, base, score = np.zeros(m), np.zeros(m), np.zeros(m), np.zeros(m)
            for doc, words, ends in sequences(batch.column(1).to_pylist(), suffixes):
                if not len(words):
                    continue
                unit = units.of(words, ends)
                own, now = unit < units.suffix, of[unit]
                value = emit[unit] + trans[np.concatenate(([of[last]], now[:-1])), now]
                last = int(unit[-1])
                n += np.bincount(doc, minlength=m)
                score += np.bincount(doc, weights=value, minlength=m)
                base += np.bincount(doc, weights=np.where(own, logs[unit], 0.0), minlength=m)
                known += np.bincount(doc, weights=own & (units.counts[unit] > 0), minlength=m)
                rare.append([(doc[~own] + first).astype(np.int32), words[~own], ends[~own]])
            docs = np.arange(first, first + m, dtype=np.int32)
            yield _rows(block, m, row, {"row": batch.column(0), "doc": docs, "n_tokens": n.astype(np.int64), "known": known.astype(np.int64), "base": base, "score": score})
            first += m
            if sum(len(words) for _, words, _ in rare) >= BLOCK:
                yield from _rare_rows(block, row, rare)
                block, first, rare = block + 1, 0, []
        if rare:
            yield from _rare_rows(block, row, rare)

    return work


def _rows(block: int, n: int, row: pa.DataType, columns: dict) -> pa.RecordBatch:
    """n rows of a block; columns that are not given are null."""
    out = {"block": pa.array(np.full(n, block)), "row": pa.nulls(n, row)} | {f.name: pa.nulls(n, _ARROW[f.name]) for f in (*_DOC, *_RARE)}
    return pa.RecordBatch.from_pydict(out | {k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})


def _rare_rows(block: int, row: pa.DataType, rare: list, most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The distinct rare words of a block's (document, word, suffix unit), in batches of at most so many."""
    doc, word, end = (np.concatenate([r.pop(0) for r in rare]) for _ in range(3))  # parts go as they are joined
    order = np.lexsort((doc, word))
    doc, word, end = doc[order], word[order], end[order]
    new_word = np.concatenate((np.ones(min(len(word), 1), dtype=bool), word[1:] != word[:-1]))
    at = np.flatnonzero(new_word | np.concatenate((new_word[:1], doc[1:] != doc[:-1])))  # first of each word and document
    found = np.stack([doc[at], np.diff(at, append=len(doc))], axis=1, dtype=np.int32, casting="same_kind").ravel()
    starts = np.concatenate((np.flatnonzero(new_word[at]), [len(at)]))
    for i in range(0, len(starts) - 1, most):
        ends = starts[i : i + most + 1]
        words = at[ends[:-1]]
        lists = pa.ListArray.from_arrays(pa.array((2 * (ends - ends[0])).astype(np.int32)), pa.array(found[2 * ends[0] : 2 * ends[-1]]))
        yield _rows(block, len(words), row, {"w": word[words].view(np.int64), "suffix": end[words], "found": lists})


def _summer(values):
    """The rare words of a block with their counts to what they add to each document."""

    def work(rare: pa.Table) -> pa.Table:
        n_suffix, types_suffix, off = values.value
        found = rare["found"].combine_chunks()
        which = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy() // 2)
        doc, times = found.flatten().to_numpy().reshape(-1, 2).T
        count, suffix = rare["n"].fill_null(0).to_numpy(), rare["suffix"].to_numpy()
        of, kinds = n_suffix[suffix], types_suffix[suffix]
        value = np.where(of > 0, np.log10(np.where(count > 0, count - off, off * np.maximum(kinds, 1)) / np.maximum(of, 1)), 0.0)
        docs = np.flatnonzero(np.bincount(doc))

        def add(x: np.ndarray) -> np.ndarray:
            x = times * x[which]
            order = np.argsort(x)  # sums are alike whatever the order of rows
            return np.bincount(doc[order], weights=x[order])[docs]

        sums = [docs.astype(np.int32), add((count > 0).astype(float)).astype(np.int64), add(np.log10(count + 1)), add(value)]
        return pa.table([pa.array(np.full(len(docs), rare["block"][0].as_py())), *(pa.array(a) for a in sums)], ["block", "doc", "rare_known", "rare_base", "rare_score"])

    return work
