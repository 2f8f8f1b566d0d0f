"""Sequential packing of a document's blocks into chunks, and parsing of model replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators.structure import LEVELS

#: Words in a chunk (aim, most, least) and sentences carried over.
TARGET, MOST, LEAST, OVERLAP = 200, 300, 50, 3
_EDGE = re.compile(r"(?<=[.!?])\s+")


BULLET = r"^\s*[-*+]\s+"


def bullet_sentence(line: Column) -> Column:
    """A bullet's text as a sentence; '' if it has none."""
    body = F.trim(F.regexp_replace(line, r"^\s*[-*+]\s*", ""))
    return F.when(body == "", "").otherwise(F.concat(body, F.when(body.rlike(r"[.!?]$"), "").otherwise(".")))


def bullets_to_sentences(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, line, text) of lines (by, line, text): each run of bullets becomes one line of sentences, at the run's first line; a run without any text goes."""
    along = Window.partitionBy(by).orderBy("line")
    x = lines.withColumn("bullet", F.col("text").rlike(BULLET))
    new = ~F.col("bullet") | ~F.coalesce(F.lag("bullet").over(along), F.lit(False))
    x = x.withColumn("run", F.sum(new.cast("int")).over(along))
    said = F.array_sort(F.collect_list(F.struct("line", F.when(F.col("bullet"), bullet_sentence(F.col("text"))).otherwise(F.col("text")).alias("t"))))
    g = x.groupBy(by, "run", "bullet").agg(F.min("line").alias("line"), said.alias("p"))
    text = F.array_join(F.filter(F.transform("p", lambda s: s["t"]), lambda t: t != ""), " ")
    return g.select(by, "line", F.when(F.col("bullet"), text).otherwise(F.col("p")[0]["t"]).alias("text"), "bullet").where("not bullet or text != ''").drop("bullet")


def _n_words(text: str | None) -> int:
    return len((text or "").split())


def paragraph_chunks(paragraphs: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, start_line, end_line, words, content): paragraphs of a document packed in order up to the aim, with the last sentences of a chunk carried into the next.

    A chunk ends when it reaches TARGET or the next paragraph would take it over MOST, unless it is under LEAST. A table function gets the paragraphs in order and
    holds the chunk that is being packed, nothing else of the document.
    """
    kind = paragraphs.schema[by].dataType.simpleString()

    @F.udtf(returnType=f"{by} {kind}, start_line int, end_line int, words int, content string")
    class Pack:
        def __init__(self):
            self.held, self.words, self.start, self.end, self.full, self.key = [], 0, None, None, False, None

        def flush(self):
            out = (self.key, self.start, self.end, self.words, "\n".join(self.held))
            sentences = [x for x in _EDGE.split(self.held[-1].strip()) if x]
            self.held = [" ".join(sentences[-OVERLAP:] if len(sentences) >= 2 else sentences)]
            self.words = _n_words(self.held[0])
            return out

        def eval(self, r: Row):
            n, self.key = _n_words(r["content"]), r[by]
            if self.full:  # it reached the aim, and there is a next paragraph
                at = self.last
                yield self.flush()
                self.start, self.full = at, False
            if self.held and self.words >= LEAST and self.words + n > MOST:
                end = self.end
                yield self.flush()
                self.start = end
            self.held.append(r["content"] or "")
            self.words, self.end, self.last = self.words + n, r["end_line"], r["start_line"]
            self.start = r["start_line"] if self.start is None else self.start
            self.full = self.words >= TARGET

        def terminate(self):
            if self.held:
                yield self.flush()

    return Pack(paragraphs.select(by, "start_line", "end_line", "content").asTable().partitionBy(by).orderBy("start_line"))


def merge_small(blocks: DataFrame, least: int = LEAST, by: str = "doc_id") -> DataFrame:
    """(by, start_line, end_line, kind, words): paragraphs under `least` words join the next, or else the previous, paragraph; tables and figures are barriers.

    A table function gets the blocks in order and holds two of them: the last whole one, and one that may still grow.
    """
    kind_ = blocks.schema[by].dataType.simpleString()

    @F.udtf(returnType=f"{by} {kind_}, start_line int, end_line int, kind string, words int")
    class Merge:
        def __init__(self):
            self.before, self.now, self.key = None, None, None

        def settled(self):
            """What is known to stay when nothing more joins `now`: a small one goes to the paragraph before."""
            if self.before and self.now and self.before[2] == self.now[2] == "paragraph" and self.now[3] < least:
                self.before[1], self.before[3] = self.now[1], self.before[3] + self.now[3]
                self.now = None

        def eval(self, r: Row):
            self.key, block = r[by], [r["start_line"], r["end_line"], r["kind"], r["words"]]
            if self.now and block[2] == self.now[2] == "paragraph" and self.now[3] < least:
                self.now[1], self.now[3] = block[1], self.now[3] + block[3]
                return
            if block[2] != "paragraph":
                self.settled()
            if self.now:
                if self.before:
                    yield (self.key, *self.before)
                self.before = self.now
            self.now = block

        def terminate(self):
            self.settled()
            for b in (self.before, self.now):
                if b:
                    yield (self.key, *b)

    rows = blocks.select(by, "start_line", "end_line", "kind", X.count_words(F.col("content")).alias("words"))
    return Merge(rows.asTable().partitionBy(by).orderBy("start_line"))


def propagate_decisions(headings: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, line, decision): a skipped heading's descendants are skipped too; after that, the ancestors of a vectorised heading are vectorised.

    A heading is a skipped one's descendant if, for some level, the last heading of that level or a higher one is skipped; it is an ancestor of what comes before the
    next heading of its level or a higher one. So four windows do, at any number of headings.
    """
    along = Window.partitionBy(by).orderBy("line")
    so_far, after = along.rowsBetween(Window.unboundedPreceding, Window.currentRow), along.rowsBetween(1, Window.unboundedFollowing)
    skipped = F.lit(False)
    for n in LEVELS:
        skipped = skipped | F.coalesce(F.last(F.when(F.col("level") <= n, F.col("decision") == "SKIP"), ignorenulls=True).over(so_far), F.lit(False))
    x = headings.select(by, "line", "level", F.when(skipped, "SKIP").otherwise(F.col("decision")).alias("decision"))
    wanted = F.first(F.when(F.col("decision") == "VECTORIZE", F.col("line")), ignorenulls=True).over(after)
    end = F.lit(None)
    for n in LEVELS:
        end = F.when(F.col("level") == n, F.first(F.when(F.col("level") <= n, F.col("line")), ignorenulls=True).over(after)).otherwise(end)
    above = wanted.isNotNull() & (end.isNull() | (wanted < end))
    return x.select(by, "line", F.when(above, "VECTORIZE").otherwise(F.col("decision")).alias("decision"))


def unfenced(reply: Column) -> Column:
    """What stands inside a code fence, or the reply itself."""
    inside = F.regexp_extract(reply, r"(?s)```[a-zA-Z]*\s*\n(.*?)\n?```", 1)
    return F.when(inside != "", inside).otherwise(reply)


def repaired_json(reply: Column) -> Column:
    """The outermost object of a reply, with straight quotes and no trailing commas."""
    body = F.regexp_extract(unfenced(reply), r"(?s)(\{.*\}|\[.*\])", 1)
    return F.regexp_replace(F.translate(body, "“”‘’", "\"\"''"), r",\s*([}\]])", "$1")


def parse_reply_lines(replies: DataFrame, reply_col: str) -> DataFrame:
    """(line, action, title) of `N: ACTION title` lines of a fenced reply."""
    x = replies.select(F.explode(F.split(unfenced(F.col(reply_col)), "\n")).alias("r"))
    pattern = r"^\s*(\d+)\s*:\s*(NO_CHANGE|REMOVE|H[1-4])\s*(.*?)\s*$"
    x = x.where(F.col("r").rlike(pattern))
    return x.select(F.regexp_extract("r", pattern, 1).cast("long").alias("line"), F.regexp_extract("r", pattern, 2).alias("action"), F.nullif(F.regexp_extract("r", pattern, 3), F.lit("")).alias("title"))
