"""N-gram Jaccard join by token-combination prefixes, exact.

A document is its set of word shingles (tokens, as 64-bit hashes). Tokens have one global order: rare ones
first, then frequent ones by rising document frequency. Two sets whose Jaccard similarity reaches the
threshold share a token within short prefixes of that order, and at least two within prefixes longer by one.

1. Frequency: every token of every document is counted; those in more than `least` documents are frequent
   (at most FREQUENT of them, the commonest; any such class keeps the join exact, so the list may be broadcast).
2. Index: each distinct set posts the tokens of its extended prefix. Tokens posted once go.
3. Large groups first: along each long posting list neighbours in size order are compared, and every set with the
   list's hub, the set that has the token earliest in its order: the one with fewest tokens of its own, to which
   copies with changes link sooner than to each other. Links found make components, so that a group of many near
   copies is one component before any list is paired up.
4. The rest exactly: pairs of different components that share a posting. Short lists are joined by
   single tokens, with a filter on how many they share; of long ones two tokens are combined into
   one key, as a pair without a short list in common shares two long ones. There the places of the two
   tokens bound what the sets can share: all before the first and between both is unshared. The smaller set of a pair
   needs a shorter prefix, so its side of the join is small.
5. Candidate pairs are verified on the whole sets.

Sets are compared once however many documents have them. Defined results: texts without words, and null texts, have
no shingles, no set and no links; a text shorter than a shingle is one token; rows with equal id are told apart by
their text; null ids don't count as smallest (a group with none but null ids has a null component); an
empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import cut, shingle_hashes, small_batches, tidy, word_hashes
from folioflow.llm.components import components

#: Most tokens in the broadcast list of frequent ones (8 bytes and a class each).
FREQUENT = 1 << 20
#: Posting lists longer than this are compared along their order first, and paired by two tokens later.
LONG = 64
#: Rows of a list of documents to fetch up to which it is broadcast (8 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def token_sets(texts: list, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct token hashes of each text (uint64)."""
    for _, n, docs, hashes in word_hashes(texts):
        edge = np.searchsorted(docs, np.arange(n + 1))
        whole = shingle_hashes(hashes, k) if len(hashes) >= k else hashes[:0]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield np.unique(whole[a : b - k + 1] if b - a >= k else shingle_hashes(hashes[a:b], k))


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n, percent: int):
    """Tokens of a set of n that must be posted: any partner shares at least percent of n with it."""
    return n + (-percent * n) // 100 + 1


def _texts(batch: pd.DataFrame) -> list:
    return [t if isinstance(t, str) else None for t in batch["text"]]


def frequent_tokens(docs: DataFrame, k: int, least: int, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (the top 32 + range_bits bits) of the frequent tokens, sorted, and their classes (1 and up, by frequency).

    Every task counts what it has, two million tokens at a time, and ships it as packed 32-bit remainders per range of hashes, with counts of those that
    it has several times; a range is then summed at once. Ranges are many enough to be small, and a token of any number of documents takes few bytes in one.
    """
    shift, low = 32 - range_bits, np.uint64(0xFFFFFFFF)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            fp, n = np.unique(np.concatenate(held) >> np.uint64(shift), return_counts=True)
            out = []
            for some, take in ((fp[n == 1], None), (fp[n > 1], n[n > 1])):
                edge = np.searchsorted((some >> np.uint64(32)).astype(np.int64), np.arange((1 << range_bits) + 1))
                rest = (some & low).astype("<u4")
                for r, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    if a < b:
                        out.append((r, rest[a:b].tobytes(), None if take is None else take[a:b].astype("<u4").tobytes()))
            return pd.DataFrame(out, columns=["part", "rest", "n"])

        for batch in batches:
            for tokens in token_sets(_texts(batch), k):
                held.append(tokens)
                size += len(tokens)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        rest = np.frombuffer(b"".join(group["rest"]), dtype="<u4")
        times = np.concatenate([np.ones(len(r) // 4, dtype=np.int64) if n is None else np.frombuffer(n, dtype="<u4").astype(np.int64) for r, n in zip(group["rest"], group["n"], strict=True)])
        order = np.argsort(rest, kind="stable")
        rest, times = rest[order], times[order]
        first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
        rest, n = rest[first], np.add.reduceat(times, first)
        rest, n = rest[n > least], n[n > least]
        return pd.DataFrame({"fp": (np.int64(group["part"].iloc[0]) << 32) + rest.astype(np.int64), "class": np.log2(n / least).astype(np.int32) * 2 + 1 + (np.log2(n / least) % 1 > 0.5)})

    counted = cut(docs.select("text").where("text is not null").mapInPandas(tidy(pack), "part int, rest binary, n binary").groupBy("part").applyInPandas(count, "fp long, class int"))
    room, floor = FREQUENT, 1
    for c, n in sorted(counted.groupBy("class").count().collect(), reverse=True):  # a few dozen classes
        room -= n
        if room < 0:
            floor = c + 1
            break
    got = counted.where(F.col("class") >= floor).toPandas().sort_values("fp")  # at most FREQUENT rows
    return got["fp"].to_numpy(np.uint64), got["class"].to_numpy(np.int32)


def postings(docs: DataFrame, k: int, percent: int, frequent, range_bits: int) -> DataFrame:
    """(token, set_id, n, pos): the extended prefix of every set with the tokens' places in the order; a task posts a set once."""
    shared, shift = docs.sparkSession.sparkContext.broadcast(frequent), np.uint64(32 - range_bits)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fps, classes = shared.value
        done: set[int] = set()
        for batch in batches:
            rows: list[tuple] = []
            for tokens in token_sets(_texts(batch), k):
                n = len(tokens)
                if not n or (sid := set_id(tokens)) in done:
                    continue
                done.add(sid)
                cls = np.zeros(n, dtype=np.int32)
                if len(fps):
                    fp = tokens >> shift
                    at = np.minimum(np.searchsorted(fps, fp), len(fps) - 1)
                    cls = np.where(fps[at] == fp, classes[at], 0)
                order = np.argsort(cls, kind="stable")[: prefix_length(n, percent) + 1]
                rows.append((tokens[order].view(np.int64), np.full(len(order), sid), np.full(len(order), n, dtype=np.int32), np.arange(len(order), dtype=np.int32)))
            if len(done) > 300_000:
                done.clear()
            if rows:
                yield pd.DataFrame({name: np.concatenate([r[i] for r in rows]) for i, name in enumerate(("token", "set_id", "n", "pos"))})

    return docs.select("text").where("text is not null").mapInPandas(tidy(post), "token long, set_id long, n int, pos int")


def memberships(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, set_id, n_shingles) of every row; set_id is null where there is no shingle."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [(len(t), set_id(t) if len(t) else None) for t in token_sets(_texts(batch), k)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "set_id": pd.array([s for _, s in sets], dtype="Int64"), "n_shingles": [n for n, _ in sets]})

    return docs.select("doc_id", "text").mapInPandas(tidy(work), "doc_id long, set_id long, n_shingles long")


def linked(pairs: DataFrame, docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) of pairs of set ids whose sets reach the threshold. Fetches the texts of the sets that occur in pairs only."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    first = members.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    ids = cut(first.join(wanted, "set_id", "left_semi").select(F.col("doc_id").alias("_id")).distinct())
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", "text").where("text is not null")
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select("text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got, size = [], 0
            for t in token_sets(_texts(batch), k):
                if len(t):
                    got.append((set_id(t), t.tobytes()))
                    size += len(t)
                if size > 500_000:
                    yield pd.DataFrame(got, columns=["set_id", "tokens"])
                    got, size = [], 0
            if got:
                yield pd.DataFrame(got, columns=["set_id", "tokens"])

    whole = texts.mapInPandas(tidy(sets), "set_id long, tokens binary").dropDuplicates(["set_id"])
    both = pairs.join(whole.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta")), "a").join(whole.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["ta"], batch["tb"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[ok, ["a", "b"]]

    return both.mapInPandas(tidy(verify), "a long, b long")


def links(docs: DataFrame, members: DataFrame, k: int = 4, percent: int = 85, least: int = 16) -> DataFrame:
    """(node, component) over set ids: enough verified links to span every component of the whole link graph."""
    n_rows = members.count()
    range_bits = int(np.clip(np.ceil(np.log2(max(1, n_rows) / 2_000)), 4, 24))
    posted = postings(docs, k, percent, frequent_tokens(docs, k, least, range_bits), range_bits)
    by_token = Window.partitionBy("token")
    live = posted.repartition("token").dropDuplicates(["token", "set_id"]).withColumn("m", F.count(F.lit(1)).over(by_token))
    live = cut(live.where("m > 1"))

    def fits(x: str, y: str):
        return F.greatest(x, y) * percent <= F.least(x, y) * 100

    in_order = by_token.orderBy("n", "set_id")
    hub = F.min_by(F.struct("set_id", "n"), F.struct("pos", "set_id")).over(by_token)
    stepped = live.where("m >= 8").withColumns({"b1": F.lag("set_id").over(in_order), "n1": F.lag("n").over(in_order), "hub": hub})
    stepped = stepped.select(F.col("set_id").alias("a"), "n", F.inline(F.array(F.struct(F.col("b1").alias("b"), F.col("n1").alias("o")), F.struct(F.col("hub.set_id").alias("b"), F.col("hub.n").alias("o")))))
    stepped = stepped.where("a != b").where(fits("n", "o"))
    stepped = cut(stepped.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    near = cut(linked(stepped, docs, members, k, percent))
    groups = components(near)

    labelled = live.join(groups.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("c", F.coalesce("component", "set_id")).drop("component", "m")
    spread = labelled.withColumns({"m": F.count(F.lit(1)).over(by_token), "c0": F.min("c").over(by_token), "c1": F.max("c").over(by_token)}).where("c0 != c1").drop("c0", "c1")
    spread = cut(spread.withColumn("long", F.col("m") > LONG))
    many = spread.where("long").groupBy("set_id").agg(F.count(F.lit(1)).alias("h"))
    short = spread.where("not long").join(many, "set_id", "left").select("token", "set_id", "n", "c", F.coalesce("h", F.lit(0)).alias("h"))

    def sides(df: DataFrame, keys: list[str]) -> DataFrame:
        x, y = (df.select(*keys, *[F.col(c).alias(c + s) for c in df.columns if c not in keys]) for s in "ab")
        return x.join(y, keys).where((F.col("set_ida") < F.col("set_idb")) & (F.col("ca") != F.col("cb")) & fits("na", "nb"))

    # of what two sets share, all beyond both prefixes lies in the rest of the one that ends first
    rest = lambda n: n - F.least(n, n - F.ceil(n * percent / 100) + 2)
    shared = sides(short, ["token"]).groupBy("set_ida", "set_idb", "na", "nb", "ha", "hb").agg(F.count(F.lit(1)).alias("s"))
    most = F.col("s") + F.least("ha", "hb") + F.greatest(rest(F.col("na")), rest(F.col("nb")))
    single = shared.where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select(F.col("set_ida").alias("a"), F.col("set_idb").alias("b"))
    pair = spread.where("long").groupBy("set_id", "n", "c").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("ts")).where("size(ts) > 1")
    pair = pair.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("ts") - 1))).withColumn("x", F.element_at("ts", F.col("i")))
    pair = pair.select("set_id", "n", "c", F.col("x.token").alias("t1"), F.col("x.pos").alias("p1"), F.explode(F.slice("ts", F.col("i") + 1, F.size("ts"))).alias("y"))
    pair = pair.select("set_id", "n", "c", "t1", "p1", F.col("y.token").alias("t2"), F.col("y.pos").alias("p2"))
    both = lambda o, n, m: o * (100 + percent) >= (n + m) * percent
    small = pair.where(both(F.col("n") - F.col("p1"), F.col("n"), F.col("n"))).select("t1", "t2", *[F.col(c).alias(c + "a") for c in ("set_id", "n", "c", "p1", "p2")])
    large = pair.select("t1", "t2", *[F.col(c).alias(c + "b") for c in ("set_id", "n", "c", "p1", "p2")])
    combined = small.join(large, ["t1", "t2"]).where(
        ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("set_ida") < F.col("set_idb"))) & (F.col("ca") != F.col("cb"))
        & both(F.least(F.col("na") - F.col("p1a"), F.col("nb") - F.col("p1b")), F.col("na"), F.col("nb"))
        & both(F.least(F.col("na") - F.col("p2a"), F.col("nb") - F.col("p2b")) + 1, F.col("na"), F.col("nb"))
    ).select(F.least("set_ida", "set_idb").alias("a"), F.greatest("set_ida", "set_idb").alias("b"))
    rest_pairs = cut(single.unionAll(combined).distinct())
    more = linked(rest_pairs, docs, members, k, percent)
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more.select("a", "b")))


def cluster(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, set_id, n_shingles, component_id) of every row: component_id is the smallest id among all documents reachable by links."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    members = cut(memberships(docs, k))
    label = links(docs, members, k, percent).select(F.col("node").alias("_node"), "component")
    rows = members.join(label, members["set_id"] == label["_node"], "left").withColumn("c", F.coalesce("component", "set_id")).drop("_node", "component")
    smallest = cut(rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))).withColumnRenamed("c", "_c")
    out = rows.join(smallest, rows["c"] == smallest["_c"], "left")
    return out.select("doc_id", "set_id", "n_shingles", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
