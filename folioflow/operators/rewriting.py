"""Line-wise rewriting of documents: heading changes, edits, mappings, whitespace, front matter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(lines: DataFrame, by: str = "doc_id", text: str = "text", sep: str = "\n") -> DataFrame:
    """(by, content): the lines of each document in order."""
    return lines.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", text))), lambda s: s[text]), sep).alias("content"))


def apply_changes(lines: DataFrame, changes: DataFrame, by: str = "doc_id") -> DataFrame:
    """lines after changes (by, line, action, title): NO_CHANGE keeps, REMOVE drops, H1 to H4 replaces the heading (its own title where none is given)."""
    c = changes.select(F.col(by).alias("_d"), F.col("line").alias("_n"), "action", "title")
    j = lines.join(c, (F.col(by) == F.col("_d")) & (F.col("line") == F.col("_n")), "left")
    level = F.regexp_extract("action", r"^H([1-4])$", 1)
    title = F.coalesce("title", F.regexp_replace("text", r"^#+\s*", ""))
    new = F.when(F.col("action").rlike("^H[1-4]$"), F.concat(F.expr("repeat('#', cast(nullif(regexp_extract(action, '^H([1-4])$', 1), '') as int))"), F.lit(" "), title)).otherwise(F.col("text"))
    return j.where(F.coalesce(F.col("action") != "REMOVE", F.lit(True))).select(by, "line", new.alias("text"))


def apply_edits(lines: DataFrame, edits: DataFrame, by: str = "doc_id") -> DataFrame:
    """lines after edits (by, line, edit): `-` drops the line, `--` makes it plain text, ***MISSING*** and absent keep it, else it is replaced."""
    e = edits.select(F.col(by).alias("_d"), F.col("line").alias("_n"), "edit")
    j = lines.join(e, (F.col(by) == F.col("_d")) & (F.col("line") == F.col("_n")), "left").where(F.coalesce(F.col("edit") != "-", F.lit(True)))
    new = F.when(F.col("edit").isNull() | (F.col("edit") == "***MISSING***"), F.col("text")).when(F.col("edit") == "--", F.regexp_replace("text", r"^#+\s*", "")).otherwise(F.col("edit"))
    return j.select(by, "line", new.alias("text"))


def apply_mapping(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements in order; the mapping is a short configuration list."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def occurrences(text: Column, old: str) -> Column:
    """How often a literal stands in the text, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / F.lit(len(old))).cast("int")


def strip_front_matter(text: Column) -> Column:
    """The text without a leading block between lines of three hyphens."""
    return F.when(text.rlike(r"(?s)\A---\s*\n.*?\n---\s*(\n|\z)"), F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*(\n|\z)", "")).otherwise(text)


def front_matter_field(text: Column, key: str) -> Column:
    """One scalar of the front matter, without quotes; null if absent."""
    block = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    return F.nullif(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1), F.lit(""))
