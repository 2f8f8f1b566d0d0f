"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch, sorted as bytes, are their trie in depth-first order: what a word
shares with its predecessor is the path from the root that is already on the stack. For every node
(prefix) the stack holds the last token of that prefix's encoding. The last token is the one
token that ends the prefix and is compatible with the last token of what stands before it: no merge
crosses their boundary. So a child costs a few look-ups, shared prefixes are computed once, and a
word's ids are read off by walking back along last tokens.

Text is split as the vocabulary file says: special tokens first, then the byte-level word pattern. Files that ask for more
than that (normalizers, prefix spaces, unknown tokens, dropout, tokens that take in white space) are refused.
Defined results: a null text is empty and has no ids; texts of any length are encoded whole; repeated rows
are encoded alike; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import give_back, small_batches

#: Fixed value: the public byte-level word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a task remembers across batches: bytes of words and their ids, and pairs of tokens; beyond it the memory starts anew (results don't depend on it).
CACHE_BYTES, CACHE_PAIRS = 36 << 20, 250_000
#: The same where the task shares its executor with the stages of a pipeline that ran before: less memory for some more time.
SMALL_CACHE = (8 << 20, 60_000)
#: Characters of texts that are split into words at a time (a longer text alone), and the longest word that is remembered.
CHARS, CACHE_WORD = 500_000, 64
_ALONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def supported(spec: dict) -> None:
    """Raises where a vocabulary file asks for what this encoder doesn't do."""
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {"type": "ByteLevel"}, spec.get("added_tokens", [])
    asks = {
        "a model other than BPE": model.get("type", "BPE") != "BPE",
        "a normalizer": spec.get("normalizer") is not None,
        "another split than the byte-level one": pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", False) or not pre.get("use_regex", True),
        "dropout, unknown tokens, word affixes, byte fallback or whole words first": any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")),
        "added tokens that depend on what surrounds them": any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip")),
    }
    if any(asks.values()):
        raise ValueError("the vocabulary file asks for " + ", ".join(k for k, v in asks.items() if v))


class TrieEncoder:
    """Encoder and decoder of one vocabulary (the text of a tokenizers JSON file with a byte-level BPE model)."""

    def __init__(self, vocabulary: str, cache_bytes: int = CACHE_BYTES, cache_pairs: int = CACHE_PAIRS):
        self.cache_bytes, self.cache_pairs = cache_bytes, cache_pairs
        spec = json.loads(vocabulary)
        supported(spec)
        letters = {c: b for b, c in enumerate(byte_letters())}
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.bytes_of = {i: raw[t] for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank, self.left, self.right, self.made = {}, {}, {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            new = vocab[a + b]
            if new in self.made:
                raise ValueError("two merges make the same token; this traversal needs one")
            self.rank[vocab[a], vocab[b]] = r
            self.left[new], self.right[new], self.made[new] = vocab[a], vocab[b], r
        self._build({raw[t]: i for t, i in vocab.items() if i in self.made or len(raw[t]) == 1})
        self.word = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def _build(self, tokens: dict[bytes, int]) -> None:
        """An automaton over the tokens: its state after a prefix is the longest end of it that begins a token; ends has the tokens that end there, longest first."""
        self.goto: dict[int, int] = {}  # state and byte -> state
        self.ends: list[tuple] = [()]
        letters: list[list[tuple[int, int]]] = [[]]
        own: dict[int, tuple[int, int]] = {}
        for t, i in tokens.items():
            state = 0
            for byte in t:
                after = self.goto.get(state << 8 | byte)
                if after is None:
                    after = self.goto[state << 8 | byte] = len(letters)
                    letters[state].append((byte, after))
                    letters.append([])
                    self.ends.append(())
                state = after
            own[state] = (i, len(t))
        self.back = [0] * len(letters)
        queue = [0]
        for state in queue:  # breadth first: shorter ends are done before longer ones
            for byte, after in letters[state]:
                self.back[after] = self._step(self.back[state], byte) if state else 0
                self.ends[after] = ((own[after],) if after in own else ()) + self.ends[self.back[after]]
                queue.append(after)

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        while True:
            after = self.goto.get(state << 8 | byte)
            if after is not None or not state:
                return after or 0
            state = self.back[state]

    def _compatible(self, a: int, b: int) -> bool:
        """Do tokens a, b side by side stay two tokens? Not if a merge joins a right edge of a to a left edge of b while both still stand alone."""
        known, rank, x, x_until = True, self.rank, a, _ALONE
        while known and x is not None:
            y, y_until = b, _ALONE
            while y is not None:
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    known = False
                    break
                y, y_until = self.left.get(y), self.made.get(y)
            x, x_until = self.right.get(x), self.made.get(x)
        if len(self.fits) >= self.cache_pairs:
            self.fits.clear()
        self.fits[a << 32 | b] = known
        return known

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word; words must be sorted and distinct."""
        goto, ends, fits, out, before = self.goto, self.ends, self.fits, [], b""
        last, start, states = [0], [0], [0]  # of the prefix of each length: its last token, where that begins, and the automaton's state
        for w in words:
            n, m = 0, min(len(w), len(before))
            while n < m and w[n] == before[n]:
                n += 1
            del last[n + 1 :], start[n + 1 :], states[n + 1 :]
            state, end = states[n], n
            for byte in w[n:]:
                end += 1
                after = goto.get(state << 8 | byte)
                state = self._step(state, byte) if after is None else after
                states.append(state)
                for t, size in ends[state]:
                    if size == end:
                        break
                    a = last[end - size]
                    known = fits.get(a << 32 | t)
                    if known if known is not None else self._compatible(a, t):
                        break
                last.append(t)
                start.append(end - size)
            ids, end = [], len(w)
            while end:
                ids.append(last[end])
                end = start[end]
            out.append(np.array(ids[::-1], dtype="<u4").tobytes())
            before = w
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split, word = self.split, self.word
        cut = [word(t) if split is None or not any(s in t for s in self.special) else [w for p in split(t) for w in ([p] if p in self.special else word(p))] for t in texts]
        if self.cached > self.cache_bytes:
            self.cache.clear()
            self.cached = 0
        cache = self.cache
        new = set().union(*cut).difference(cache) if cut else ()
        pairs = sorted((w.encode(), w) for w in new if w not in self.special)
        made = {s: np.array([i], dtype="<u4").tobytes() for s, i in self.special.items()}
        for (_, w), ids in zip(pairs, self.encode_words([b for b, _ in pairs]), strict=True):
            if len(w) <= CACHE_WORD:
                cache[w] = ids
                self.cached += 2 * len(w) + len(ids) + 150
            else:
                made[w] = ids
        return [b"".join([cache.get(w) or made[w] for w in ws]) for ws in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def _runs(texts: list[str], chars: int = CHARS) -> Iterator[list[str]]:
    """Consecutive runs of whole texts of about so many characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def _column(df: DataFrame, vocabulary_path: str, col: str, kind: str, values, cache: tuple[int, int] = (CACHE_BYTES, CACHE_PAIRS)):
    """Column: values(encoder, list of col's values) of a batch, as a column of a type (for a struct, tuples). Only col goes to Python."""
    spark = df.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:  # a file of the driver, of fixed size
        vocabulary = spark.sparkContext.broadcast(f.read())
    small_batches(spark)
    names = [x.split(" ")[0] for x in kind.split(", ")] if " " in kind else []

    def rows(batches: Iterator[pd.Series]) -> Iterator[list]:
        enc = TrieEncoder(vocabulary.value, *cache)  # lives as long as the task
        for column in batches:
            yield list(values(enc, column.to_list()))
        del enc
        give_back()

    @F.pandas_udf(kind)
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in rows(batches):
            yield pd.Series(x, dtype=object)

    @F.pandas_udf(kind)
    def several(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in rows(batches):
            yield pd.DataFrame(x, columns=names)

    return (several if names else one).asNondeterministic()(df[col])  # so that filters on the result don't run it again


def _encoded(enc: TrieEncoder, texts: list) -> Iterator[tuple[str, bytes]]:
    for run in _runs([t if isinstance(t, str) else "" for t in texts]):
        yield from zip(run, enc.encode_batch(run), strict=True)


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of every text as an array of ints."""
    ids = _column(docs, vocabulary_path, text_col, "array<int>", lambda enc, texts: (np.frombuffer(b, dtype="<i4") for _, b in _encoded(enc, texts)))
    return docs.withColumn(ids_col, ids)


def decode(df: DataFrame, vocabulary_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with the text of every array of ids (null: empty)."""
    return df.withColumn(text_col, _column(df, vocabulary_path, ids_col, "string", lambda enc, all_ids: (enc.decode(np.asarray(x if x is not None else [], dtype="<u4").tobytes()) for x in all_ids)))


def encode_checked(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids and round_trip (decoding the ids gives the text again), in one pass."""
    kind = "n_tokens long, ids array<int>, round_trip boolean"
    coded = _column(docs, vocabulary_path, text_col, kind, lambda enc, texts: ((len(b) // 4, np.frombuffer(b, dtype="<i4"), enc.decode(b) == t) for t, b in _encoded(enc, texts)), SMALL_CACHE)
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids", "round_trip")]
    return docs.select(*kept, coded.alias("__bpe")).select(*kept, "__bpe.*")


def round_trip(docs: DataFrame, vocabulary_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns with n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256, in one pass that ships no ids."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    coded = _column(docs, vocabulary_path, text_col, kind, lambda enc, texts: ((len(b) // 4, sha(b), sha(enc.decode(b).encode("utf-8", "surrogatepass"))) for _, b in _encoded(enc, texts)))
    kept = [c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return docs.select(*kept, coded.alias("__bpe")).select(*kept, "__bpe.*")
