"""Sources and sinks: Markdown folders, HTML, CSV and JSON lines, and table maintenance as DataFrames."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import rewriting


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share: spark.checkpoint.dir. Unset, it is a temporary one in local mode (tests) and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/folioflow"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def step(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table written to the shared folder, which cuts their lineage, and its path, for remove()."""
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    return step(df)[0]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a step that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of the *.md files under a folder; hidden files are skipped, bytes that aren't UTF-8 are read as Latin-1."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return f.where(~name.startswith(".")).select("path", name.alias("name"), utf8.alias("content"))


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration file of JSON, by whatever store Spark reads; a missing or unreadable one is empty."""
    try:
        text = "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())  # a small file
        found = json.loads(text)
    except (AnalysisException, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def setting(config: dict, *keys: str, default: int) -> int:
    """A positive whole number inside nested sections; the default where it is absent or anything else."""
    for k in keys:
        config = config.get(k, {}) if isinstance(config, dict) else {}
    return config if isinstance(config, int) and not isinstance(config, bool) and config > 0 else default


def write_text_files(rows: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """One folder per name with its text as a file; Spark's commit makes each write whole or absent."""
    rows.select(F.col(name_col).alias("name"), F.col(text_col).alias("value")).write.partitionBy("name").option("lineSep", "\n").text(path)


def write_named_files(rows: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """Each row's text as a file of its own name (a few thousand at most: the driver names them)."""
    spark = rows.sparkSession
    write_text_files(rows, path, name_col, text_col)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(at):
        name = unquote(folder.getPath().getName())
        if name.startswith("name="):
            for part in fs.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), at.suffix("/" + name.removeprefix("name=")))
            fs.delete(folder.getPath(), True)


def import_markdown(files: DataFrame, most_bytes: int = 50 << 20, small_tokens: int = 15_000) -> DataFrame:
    """(path, name, title, author, year, content, content_hash, size_class, error) of read_markdown(): front matter taken off and read (the
    title falls back to the file's name), size class small or large by the estimate of tokens; empty files and those over most_bytes are errors without content."""
    size = F.octet_length("content")
    error = F.when(~F.coalesce("content", F.lit("")).rlike(r"\S"), "empty file").when(size > most_bytes, "file too large")
    body = F.trim(rewriting.strip_front_matter(F.col("content")), F.lit("\n"))
    field = lambda name: rewriting.front_matter_field(F.col("content"), name)
    out = files.withColumns({"error": error, "_body": F.when(error.isNull(), body)})
    small = X.tokens_by_ratio(X.count_words(F.col("_body"))) < small_tokens
    return out.select(
        "path", "name", F.coalesce(field("title"), F.regexp_replace("name", r"\.md$", "")).alias("title"), field("author").alias("author"), field("year").try_cast("int").alias("year"), F.col("_body").alias("content"),
        F.sha2("_body", 256).alias("content_hash"), F.when(F.col("_body").isNotNull(), F.when(small, "small").otherwise("large")).alias("size_class"), "error")


def duplicates_by_hash(new: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of new whose content hash a known row has."""
    k = known.select(F.sha2(text_col, 256).alias("_h")).distinct()
    return new.withColumn("_h", F.sha2(text_col, 256)).join(k, "_h", "left_semi").drop("_h")


def duplicates_by_title(new: DataFrame, works: DataFrame) -> DataFrame:
    """(id, work_id): same title, and the author's name inside the work's authors, both case-insensitive; joined on the title."""
    w = works.select("work_id", F.lower("title").alias("_t"), F.lower("authors").alias("_a"))
    n = new.select("id", F.lower("title").alias("_t"), F.lower("author").alias("_b"))
    return n.join(w, "_t").where(F.contains("_a", F.col("_b"))).select("id", "work_id")


def sync_plan(listing: DataFrame, table: DataFrame, key: str = "path") -> DataFrame:
    """(key, action): insert what only the listing has, touch what both have, delete what only the table has."""
    a, b = listing.select(F.col(key).alias("_l")), table.select(F.col(key).alias("_t"))
    j = a.join(b, F.col("_l") == F.col("_t"), "full")
    return j.select(F.coalesce("_l", "_t").alias(key), F.when(F.col("_t").isNull(), "insert").when(F.col("_l").isNull(), "delete").otherwise("touch").alias("action"))


def group_variants(names: DataFrame, name_col: str = "name") -> DataFrame:
    """(base, variants): names by what stands before their first dot."""
    return names.groupBy(F.substring_index(name_col, ".", 1).alias("base")).agg(F.array_join(F.array_sort(F.collect_set(F.regexp_replace(name_col, r"^[^.]*\.", ""))), ",").alias("variants"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new rows replacing those of equal keys."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def front_matter(title: Column, author: Column, year: Column) -> Column:
    line = lambda k, v: F.when(v.isNull(), "").otherwise(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\n")))
    return F.concat(F.lit("---\n"), line("title", title), line("author", author), line("year", year), F.lit("---\n\n"))


def export_name(title: Column) -> Column:
    return F.concat(X.slug(title), F.lit(".md"))


class _Markdown(HTMLParser):
    """ATX headings, hyphen bullets, links unwrapped, images, scripts and styles dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("p", "div", "article", "ul", "ol", "table", "tr", "section", "nav"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in ("p", "div", "ul", "ol", "table"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown_of(html: str) -> str:
    p = _Markdown()
    p.feed(html)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.out))).strip()


def html_to_markdown(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with markdown."""

    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if h is None else markdown_of(h) for h in b], dtype=object)

    return pages.withColumn("markdown", convert(F.col(html_col)))
