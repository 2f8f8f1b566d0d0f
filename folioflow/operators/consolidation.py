"""Context consolidation: coverage, merging of neighbours, replacement by parents, context blocks."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import structure as S
from folioflow.sources.files import written


def coverage(items: DataFrame, parents: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, parent_id, coverage): characters of the items over those of their parent; 0 if the parent is absent or empty."""
    got = items.groupBy(by, "parent_id").agg(F.sum(F.length("content")).alias("chars"))
    p = parents.select(F.col("id").alias("_p"), F.length("content").alias("size"))
    j = got.join(p, F.col("parent_id") == F.col("_p"), "left")
    return j.select(by, "parent_id", F.round(F.coalesce(F.try_divide(F.col("chars").cast("double"), F.col("size")), F.lit(0.0)), 6).alias("coverage"))


def merged_groups(items: DataFrame, gap: int = 7, by: str = "query_id") -> DataFrame:
    """(by, parent_id, start_line, end_line, score, ids, content) of items in neighbouring lines."""
    x = S.islands(items, [by, "parent_id"], gap)
    parts = F.array_sort(F.collect_list(F.struct("start_line", "id", "content")))
    g = x.groupBy(by, "parent_id", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score"), parts.alias("p"))
    return g.select(by, "parent_id", "start_line", "end_line", "score", F.array_join(F.transform("p", lambda s: s["id"].cast("string")), ",").alias("ids"), F.array_join(F.transform("p", lambda s: s["content"]), "\n\n").alias("content"))


def consolidate_once(items: DataFrame, parents: DataFrame, threshold: float = 0.5, gap: int = 7, by: str = "query_id") -> DataFrame:
    """One round: groups covered enough become their parent, the others merge neighbours. (by, node_id, start_line, end_line, score, replaced)"""
    cov = coverage(items, parents, by)
    j = items.join(cov, [by, "parent_id"])
    p = parents.select(F.col("id").alias("_p"), F.col("start_line").alias("ps"), F.col("end_line").alias("pe"))
    up = j.where(F.col("coverage") >= threshold).groupBy(by, "parent_id").agg(F.max("score").alias("score"))
    up = up.join(p, F.col("parent_id") == F.col("_p")).select(by, F.col("parent_id").alias("node_id"), F.col("ps").alias("start_line"), F.col("pe").alias("end_line"), "score", F.lit(True).alias("replaced"))
    rest = merged_groups(j.where(F.col("coverage") < threshold).select(*items.columns), gap, by)
    return up.unionByName(rest.select(by, F.col("parent_id").alias("node_id"), "start_line", "end_line", "score", F.lit(False).alias("replaced")))


def consolidate(items: DataFrame, parents: DataFrame, threshold: float = 0.5, gap: int = 7, by: str = "query_id", enrich: bool = False) -> DataFrame:
    """(by, ids, parent_id, node_id, level_up, start_line, end_line, score, content): contexts consolidated until nothing changes.

    items (by, id, parent_id, content, start_line, end_line, score, and work_id and heading_breadcrumbs or not); parents (id, parent_id, content, start_line, end_line).
    In each round a group of items under one parent that covers `threshold` of it becomes the parent (node_id, its own parent next;
    level_up counts); the others merge what lies within `gap` lines, with the lines of the parent between them if `enrich`. Items
    without a parent merge inside their work. What isn't changed stays as it is, so nothing is lost at any height. Rounds are as many
    as the forest is high and merges follow each other; each is written to the shared folder.
    """
    p = parents.select(F.col("id").alias("_p"), F.col("parent_id").alias("_up"), F.length("content").alias("_size"), F.col("start_line").alias("_start"), F.col("end_line").alias("_end"))
    texts = parents.select(F.col("id").alias("_p"), F.col("content").alias("_content"))
    crumb = F.col("heading_breadcrumbs") if "heading_breadcrumbs" in items.columns else F.lit(None).cast("string")
    work = F.concat(F.lit("w"), F.col("work_id").cast("string")) if "work_id" in items.columns else F.concat(F.lit("i"), F.col("id").cast("string"))
    group = [by, "parent_id", "root"]
    key = [by, "parent_id", "work", "start_line", "end_line", "score", "content", "ids", "node_id", "level_up", "crumb"]
    state = items.select(by, "parent_id", work.alias("work"), "start_line", "end_line", "score", "content", F.array("id").alias("ids"), F.lit(None).cast("long").alias("node_id"), F.lit(0).alias("level_up"), crumb.alias("crumb"))
    state = written(state)
    before = state.count()
    while before:
        met = state.select(F.col("parent_id").alias("_p")).distinct()
        whole = state.join(met_by(p, met), F.col("parent_id") == F.col("_p"), "left").withColumn("root", F.when(F.col("_p").isNull(), F.col("work")))
        whole = whole.withColumn("covered", F.coalesce(F.try_divide(F.sum(F.length("content")).over(Window.partitionBy(*group)).cast("double"), F.col("_size")), F.lit(0.0)) >= threshold)
        up = whole.where("covered").groupBy(by, F.col("parent_id").alias("node_id"), F.col("_up").alias("parent_id")).agg(
            F.min("work").alias("work"), F.first("_start").alias("start_line"), F.first("_end").alias("end_line"), F.max("score").alias("score"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"),
            (F.max("level_up") + 1).alias("level_up"), F.lit(None).cast("string").alias("crumb"))
        up = up.join(met_by(texts, up.select(F.col("node_id").alias("_p")).distinct()), F.col("node_id") == F.col("_p")).withColumnRenamed("_content", "content").drop("_p")
        rest = S.islands(whole.where("not covered").withColumn("_id", F.element_at("ids", 1)), group, gap, order="_id")
        part = F.array_sort(F.collect_list(F.struct("start_line", "end_line", F.element_at("ids", 1).alias("id"), "content", "ids", "node_id", "crumb")))
        merged = rest.groupBy(*group, "island").agg(
            F.min("work").alias("work"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score"), part.alias("p"), F.max("level_up").alias("level_up"), F.first("_start").alias("_start"))
        if enrich:  # only what several items merge into takes lines of the parent
            few = merged.where(F.size("p") > 1).select(F.col("parent_id").alias("_p")).distinct()
            merged = merged.join(met_by(texts, few), (F.col("parent_id") == F.col("_p")) & (F.size("p") > 1), "left").drop("_p")
        joined = F.array_join(F.filter(F.transform("p", lambda x: x["content"]), lambda c: F.coalesce(c, F.lit("")) != ""), "\n\n")
        between = lines_of(F.col("_content"), F.col("start_line"), F.col("end_line"), F.col("_start")) if enrich else F.lit("")
        text = F.when(F.trim(F.coalesce(between, F.lit(""))) != "", between).otherwise(joined)
        head = F.trim(F.element_at(F.split(F.col("p")[0]["crumb"], " > "), -1))
        text = F.when((F.size("p") > 1) & (head != "") & ~F.startswith(text, head), F.concat(head, F.lit("\n\n"), text)).otherwise(text)
        merged = merged.select(
            by, "parent_id", "work", "start_line", "end_line", "score", F.when(F.size("p") == 1, F.col("p")[0]["content"]).otherwise(text).alias("content"),
            F.array_sort(F.flatten(F.transform("p", lambda x: x["ids"]))).alias("ids"), F.when(F.size("p") == 1, F.col("p")[0]["node_id"]).alias("node_id"), "level_up", F.col("p")[0]["crumb"].alias("crumb"))
        state = written(up.withColumn("covered", F.lit(True)).unionByName(merged.withColumn("covered", F.lit(False))))
        n, ups = state.agg(F.count(F.lit(1)), F.count_if("covered")).first()
        state = state.select(*key)
        if not ups and n == before:
            break
        before = n
    return state.drop("crumb", "work")


#: Ids that are broadcast; more are joined by a shuffle.
MOST_IDS = 500_000


def met_by(df: DataFrame, ids: DataFrame, key: str = "_p") -> DataFrame:
    """Rows of df whose key is among the distinct ids (key). Few ids go to where the rows are, so texts of other rows don't move."""
    kept = written(ids.where(F.col(key).isNotNull()))
    return df.join(F.broadcast(kept) if kept.count() <= MOST_IDS else kept, key, "left_semi")


def lines_of(content: Column, start: Column, end: Column, parent_start: Column) -> Column:
    """The lines start to end (document lines, inclusive) of a parent's content, clamped."""
    lines = F.split(content, "\n")
    a = F.greatest(start - parent_start + 1, F.lit(1))
    b = F.least(end - parent_start + 1, F.size(lines))
    return F.when(b >= a, F.array_join(F.slice(lines, a, b - a + 1), "\n")).otherwise("")


def context_blocks(items: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, blocks): `[S1] Source: ...` blocks in order of pos."""
    head = F.concat(F.lit("[S"), F.col("pos").cast("string"), F.lit("] Source: "), "title", F.lit(" | (work_id="), F.col("work_id").cast("string"), F.lit(", start-line="), F.col("start_line").cast("string"), F.lit(", end-line="), F.col("end_line").cast("string"), F.lit(")\nText:\n"), "content")
    return items.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", head.alias("h")))), lambda s: s["h"]), "\n\n").alias("blocks"))


def renumber(text: Column, offset: Column) -> Column:
    """[S3] with offset 5 becomes [S8]."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, offsets: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else re.sub(r"\[S(\d+)\]", lambda m, o=int(o): f"[S{int(m[1]) + o}]", t) for t, o in zip(texts, offsets, strict=True)], dtype=object)

    return run(text, offset)


def truncated(content: str, start: int, end: int, most: int) -> tuple[str, int, int]:
    """(text, first line, last line): the lines around the characters start to end, of at most so many words; headings always stay.

    The window grows by a line up and down in turn. The first line that doesn't fit ends it, there or at a line before it that ends a sentence.
    """
    if not content:
        return "", 0, 0
    lines = content.split("\n")
    count = [len(x.split()) for x in lines]
    if sum(count) <= most:
        return content, 0, len(lines) - 1
    ends = list(accumulate((len(x) + 1 for x in lines), initial=-1))[1:]  # the place of each line's break
    a = min(bisect_left(ends, start), len(lines) - 1)
    b = max(a, min(bisect_left(ends, end), len(lines) - 1))
    heads = {i for i, x in enumerate(lines) if re.match(r"#{1,6}\s+", x)}
    words = sum(count[i] for i in heads | set(range(a, b + 1)))
    up = True
    while words < most and (a > 0 or b < len(lines) - 1):
        if up and a == 0 or not up and b == len(lines) - 1:
            up = not up
        i = a - 1 if up else b + 1
        words += 0 if i in heads else count[i]
        if words > most:
            if up:
                a = sentence_edge_up(lines, a, i)
            else:
                b = sentence_edge_down(lines, b, i)
            break
        a, b, up = min(a, i), max(b, i), not up
    return "\n".join(x for i, x in enumerate(lines) if a <= i <= b or i in heads), a, b


def sentence_edge_up(lines: list[str], now: int, wanted: int) -> int:
    """The line after the nearest line from now - 1 up to `wanted` that ends a sentence; now if there is none."""
    return next((i + 1 for i in range(now - 1, max(wanted, 0) - 1, -1) if lines[i].rstrip().endswith((".", "!", "?"))), now)


def sentence_edge_down(lines: list[str], now: int, wanted: int) -> int:
    """The nearest line from now + 1 down to `wanted` that ends a sentence; now if there is none."""
    return next((i for i in range(now + 1, min(wanted, len(lines) - 1) + 1) if lines[i].rstrip().endswith((".", "!", "?"))), now)


def truncate_around(content: Column, start: Column, end: Column, most: Column) -> Column:
    """truncated() of a column of texts."""

    @F.pandas_udf("string")
    def run(contents: pd.Series, starts: pd.Series, ends: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else truncated(c, int(s), int(e), int(m))[0] for c, s, e, m in zip(contents, starts, ends, limits, strict=True)], dtype=object)

    return run(content, start, end, most)


def without_contained(items: DataFrame, by: str = "question_id") -> DataFrame:
    """(by, id): contents that no longer kept content of the same question contains (nor contains their first four fifths, over 100 characters). Longest first."""
    kind = items.schema[by].dataType.simpleString()

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_n=pdf["content"].str.len()).sort_values(["_n", "id"], ascending=[False, True])
        kept: list[str] = []
        ids = []
        for r in pdf.itertuples():
            head = r.content[: int(len(r.content) * 0.8)] if len(r.content) > 100 else r.content
            if not any(r.content in k or head in k for k in kept):
                kept.append(r.content)
                ids.append(r.id)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(ids), "id": ids})

    return items.groupBy(by).applyInPandas(keep, f"{by} {kind}, id long")
