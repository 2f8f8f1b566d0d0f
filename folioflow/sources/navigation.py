"""Navigation of electronic books: the nav document of EPUB 3, or else the NCX of EPUB 2, as rows and as a Markdown table of contents."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The deepest heading, and what an empty table of contents says.
DEEPEST = 6
NOTHING = "<!-- No navigation structure found in EPUB. Add headings here manually. -->"
_ENTRY = "array<struct<level: int, title: string, document: string, fragment: string>>"
#: Bytes that a navigation document may unpack to; a book with a larger one has none.
MOST_BYTES = 64 << 20


def _target(href: str) -> tuple[str, str | None]:
    document, mark, fragment = href.partition("#")
    return document.rsplit("/", 1)[-1], fragment if mark else None


class _Nav(HTMLParser):
    """The first list of the first nav element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.depth = self.inside = 0
        self.done = self.found = False
        self.href, self.title = None, ""

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "nav":
            self.inside += 1
            self.found = True
        elif self.inside and tag == "ol":
            self.depth += 1
        elif self.depth and tag == "a":
            self.href, self.title = dict(attrs).get("href"), ""

    def handle_endtag(self, tag):
        if self.done:
            return
        if tag == "a" and self.depth:
            if self.href:
                document, fragment = _target(self.href)
                self.out.append({"level": min(self.depth, DEEPEST), "title": " ".join(self.title.split()), "document": document, "fragment": fragment})
            self.href = None
        elif tag == "ol" and self.depth:
            self.depth -= 1
            self.done = not self.depth
        elif tag == "nav" and self.inside:
            self.inside -= 1
            self.done = self.done or not self.inside

    def handle_data(self, data):
        if self.href is not None:
            self.title += data


def nav_entries(html: str) -> list[dict]:
    """Entries of an EPUB 3 nav document in order; level is the depth of the list."""
    p = _Nav()
    p.feed(html)
    p.close()
    return p.out


def ncx_entries(xml: str | bytes) -> list[dict]:
    """Entries of an EPUB 2 NCX document in order; level is the depth of the point. Points without label or source are passed over, their children not."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    name = lambda e: e.tag.rpartition("}")[2]
    out: list[dict] = []
    stack = [(p, 1) for top in root.iter() if name(top) == "navMap" for p in reversed([c for c in top if name(c) == "navPoint"])]
    while stack:
        point, level = stack.pop()
        label = next((" ".join("".join(c.itertext()).split()) for c in point if name(c) == "navLabel"), "")
        source = next((c.get("src", "") for c in point if name(c) == "content"), "")
        document, fragment = _target(source)
        if label and document:
            out.append({"level": min(level, DEEPEST), "title": label, "document": document, "fragment": fragment})
        stack += [(c, level + 1) for c in reversed(list(point)) if name(c) == "navPoint"]
    return out


def book_entries(data: bytes) -> list[dict]:
    """Entries of a book (the bytes of an EPUB file): of its first nav document that has a list, else of its first NCX with points."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            small = [i for i in book.infolist() if i.file_size <= MOST_BYTES]
            pages = [i for i in small if posixpath.splitext(i.filename)[1].lower() in (".xhtml", ".html", ".htm")]
            for i in sorted(pages, key=lambda i: "nav" not in i.filename.lower()):
                text = book.read(i).decode("utf-8", "ignore")
                if "<nav" in text and (found := nav_entries(text)):
                    return found
            for i in small:
                if i.filename.lower().endswith(".ncx") and (found := ncx_entries(book.read(i))):
                    return found
    except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, RuntimeError):
        return []
    return []


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of the *.epub files under a folder."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.substring_index("path", "/", -1).alias("name"), "content")


def with_entries(df: DataFrame, col: str, kind: str = "book") -> DataFrame:
    """df with entries (level, title, document, fragment) of books (bytes), nav documents or NCX documents (strings)."""
    read = {"book": lambda x: book_entries(bytes(x)), "nav": nav_entries, "ncx": ncx_entries}[kind]

    @F.pandas_udf(_ENTRY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[] if x is None else read(x) for x in b], dtype=object)

    return df.withColumn("entries", run(F.col(col)))


def toc_markdown(entries: Column) -> Column:
    """Column: entries as Markdown headings set apart by empty lines."""
    lines = F.transform(entries, lambda e: F.concat(F.repeat(F.lit("#"), e["level"]), F.lit(" "), e["title"]))
    return F.when(F.size(entries) == 0, NOTHING).otherwise(F.array_join(lines, "\n\n"))
