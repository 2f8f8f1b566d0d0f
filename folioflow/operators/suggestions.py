"""What language models suggest for documents, as plans around a pluggable model: citations, tables of contents, heading changes, rewrites.

A model is a function from prompts to replies over batches (see external.with_completion). Replies are parsed by column
expressions; what can't be read leaves the document as it is and says so in `error`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import chunking, external

#: The fields of a citation, its formats, and the lines that a document may have to be rewritten.
CITATION = "title string, authors array<string>, year int, publisher string, isbn string, doi string, container_title string, volume string, issue string, pages string, url string, work_type string"
FORMATS = ["APA", "MLA", "Chicago"]
MOST_LINES = 3_000
#: Fixed value: a line of suggested changes, `line : ACTION : title`.
CHANGE = r"^\s*(\d+)\s*:\s*(NO_CHANGE|REMOVE|H[1-4])\s*:\s*(.*)$"
_REWRITE = "bibliographic struct<title: string, authors: array<string>, year: int, publisher: string, isbn: string, doi: string>, sanitized_markdown string, toc array<struct<level: int, title: string>>"


def _asked(df: DataFrame, prompt: Column, complete: Callable[[list[str]], list[str]]) -> DataFrame:
    return external.with_completion(df.withColumn("_prompt", prompt), "_prompt", complete, "_reply").drop("_prompt")


def _object(reply: Column, schema: str) -> Column:
    """The reply's JSON object; null if it has none."""
    body = chunking.repaired_json(reply)
    return F.when(F.coalesce(body, F.lit("")).startswith("{"), F.from_json(body, schema))


def citations(df: DataFrame, complete: Callable, text_col: str = "citation", format_col: str = "format") -> DataFrame:
    """df with the fields of each citation (nulls where unknown) and error: empty text, unknown format, unreadable reply or a year that isn't 1000 to 9999."""
    text, style = F.trim(F.coalesce(F.col(text_col), F.lit(""))), F.col(format_col)
    bad = F.when(text == "", "empty citation").when(~F.coalesce(style.isin(FORMATS), F.lit(False)), "unknown format")
    prompt = F.when(bad.isNull(), F.concat(F.lit("Extract the fields of this "), style, F.lit(" citation as one JSON object with title, authors, year, publisher, isbn, doi, container_title, volume, issue, pages, url, work_type; null where unknown.\nCitation: "), text))
    out = _asked(df, prompt, complete).withColumn("_p", _object(F.col("_reply"), CITATION))
    wrong = F.col("_p.year").isNotNull() & ~F.col("_p.year").between(1000, 9999)
    error = F.coalesce(bad, F.when(F.col("_p").isNull(), "unreadable reply").when(wrong, "year out of range"))
    names = [f.split(" ")[0] for f in CITATION.split(", ")]
    return out.select(*df.columns, *[F.when(error.isNull(), F.col(f"_p.{n}")).alias(n) for n in names], error.alias("error"))


def tables_of_contents(docs: DataFrame, complete: Callable, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, pos, level, title): the table of contents that a model reads off each document's text; entries without a title go, levels are kept within 1 to 6."""
    prompt = F.concat(F.lit("List the table of contents of this document as a JSON array of {level, title}.\n---\n"), F.col(text_col))
    body = chunking.repaired_json(F.col("_reply"))
    toc = F.from_json(F.when(body.startswith("["), body), "array<struct<level: int, title: string>>")
    out = _asked(docs.select(doc, text_col), prompt, complete).select(doc, F.posexplode(toc).alias("pos", "e")).where(F.trim(F.coalesce("e.title", F.lit(""))) != "")
    return out.select(doc, "pos", F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("e.level", F.lit(1)))).alias("level"), F.trim("e.title").alias("title"))


def change_lines(replies: DataFrame, doc: str, reply_col: str) -> DataFrame:
    """(doc, line, action, title) of the `line : ACTION : title` lines of replies, inside a code fence if there is one; other lines are passed over."""
    x = replies.select(doc, F.explode(F.split(chunking.unfenced(F.col(reply_col)), "\n")).alias("r")).where(F.col("r").rlike(CHANGE))
    part = lambda i: F.regexp_extract("r", CHANGE, i)
    return x.select(doc, part(1).cast("int").alias("line"), part(2).alias("action"), F.trim(part(3)).alias("title"))


def heading_changes(headings: DataFrame, complete: Callable, toc: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, line, action, title): what a model would change of each document's headings (doc, line, level, title), given its table of contents (doc, pos, level, title) or not.

    One prompt per document; suggestions for lines that aren't headings are left out, and of several for one line the last counts.
    """
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.concat(F.col("line").cast("string"), F.lit(": "), F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "title").alias("t")))), lambda s: s["t"]), "\n")
    asked = headings.groupBy(doc).agg(listed.alias("_headings"))
    if toc is not None:
        entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "title").alias("t")))), lambda s: s["t"]), "\n")
        asked = asked.join(toc.groupBy(doc).agg(entries.alias("_toc")), doc, "left")
    else:
        asked = asked.withColumn("_toc", F.lit(""))
    prompt = F.concat(F.lit("Answer with lines `line : ACTION : title`; ACTION is NO_CHANGE, REMOVE or H1 to H4.\nContents:\n"), F.coalesce("_toc", F.lit("")), F.lit("\nHeadings:\n"), F.col("_headings"))
    replies = _asked(asked, prompt, complete).select(doc, "_reply")
    known = headings.select(doc, "line").distinct()
    found = replies.select(doc, F.posexplode(F.split(chunking.unfenced(F.col("_reply")), "\n")).alias("_pos", "r")).where(F.col("r").rlike(CHANGE))
    part = lambda i: F.regexp_extract("r", CHANGE, i)
    found = found.select(doc, part(1).cast("int").alias("line"), part(2).alias("action"), F.trim(part(3)).alias("title"), "_pos").join(known, [doc, "line"], "left_semi")
    last = Window.partitionBy(doc, "line").orderBy(F.desc("_pos"))
    return found.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select(doc, "line", "action", "title")


def rewritten(docs: DataFrame, complete: Callable, doc: str = "doc_id", text_col: str = "text", most_lines: int = MOST_LINES, force: bool = False) -> DataFrame:
    """(doc, title, authors, year, sanitized, toc, content_hash, error): each document's bibliography, rewritten text and contents as one model reply gives them.

    Documents of more than most_lines lines are not sent unless forced; these, and those with an unreadable reply, keep their text.
    """
    lines = F.size(F.split(F.regexp_replace(F.col(text_col), r"\n$", ""), "\n"))
    long = F.lit(False) if force else lines > most_lines
    prompt = F.when(~long, F.concat(F.lit("Return JSON with bibliographic {title, authors, year, publisher, isbn, doi}, sanitized_markdown and toc [{level, title}] of this document.\n---\n"), F.col(text_col)))
    out = _asked(docs.select(doc, text_col).withColumn("_long", long), prompt, complete).withColumn("_p", _object(F.col("_reply"), _REWRITE))
    error = F.when(F.col("_long"), "too many lines").when(F.col("_p").isNull(), "unreadable reply")
    text = F.coalesce("_p.sanitized_markdown", text_col)
    return out.select(
        doc, F.col("_p.bibliographic.title").alias("title"), F.array_join("_p.bibliographic.authors", ", ").alias("authors"), F.col("_p.bibliographic.year").alias("year"), text.alias("sanitized"),
        F.coalesce("_p.toc", F.array().cast("array<struct<level: int, title: string>>")).alias("toc"), F.sha2(text, 256).alias("content_hash"), error.alias("error"))
