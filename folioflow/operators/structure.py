"""Document structure from lines (doc, line, text): headings, sections, breadcrumbs, blocks. All windows are per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = range(1, 7)


def parse_headings(lines: DataFrame, doc: str = "doc_id", most: int = 5) -> DataFrame:
    """(doc, line, level, title) of lines with one to `most` marks and a blank."""
    h = lines.where(F.col("text").rlike(r"^#{1,%d}\s+" % most))
    return h.select(doc, "line", F.length(F.regexp_extract("text", r"^(#+)\s+", 1)).alias("level"), F.trim(F.regexp_extract("text", r"^#+\s+(.*)$", 1)).alias("title"))


def _pick(level: Column, by_level: dict[int, Column]) -> Column:
    out = F.lit(None)
    for n, c in by_level.items():
        out = F.when(level == n, c).otherwise(out)
    return out


def section_ends(headings: DataFrame, totals: DataFrame, doc: str = "doc_id") -> DataFrame:
    """headings with end_line: the line before the next heading that isn't deeper, or the last line (totals: doc, total_lines)."""
    after = Window.partitionBy(doc).orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    nxt = _pick(F.col("level"), {n: F.first(F.when(F.col("level") <= n, F.col("line")), ignorenulls=True).over(after) for n in LEVELS})
    return headings.withColumn("_next", nxt).join(totals, doc).withColumn("end_line", F.coalesce(F.col("_next") - 1, F.col("total_lines"))).drop("_next", "total_lines")


def parents(headings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """headings with parent_line: the nearest heading before with a lower level."""
    before = Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return headings.withColumn("parent_line", _pick(F.col("level"), {n: F.last(F.when(F.col("level") < n, F.col("line")), ignorenulls=True).over(before) for n in LEVELS}))


def breadcrumbs(headings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """headings with breadcrumb: titles from the outermost heading still open to the heading itself, joined by ' > '."""
    before = Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    out, parts = headings, []
    for n in LEVELS:
        out = out.withColumn(f"_h{n}", F.last(F.when(F.col("level") == n, F.struct("line", "title")), ignorenulls=True).over(before))
        out = out.withColumn(f"_c{n}", F.last(F.when(F.col("level") < n, F.col("line")), ignorenulls=True).over(before))
        open_ = (F.col("level") > n) & (F.col(f"_c{n}").isNull() | (F.col(f"_h{n}.line") > F.col(f"_c{n}")))
        parts.append(F.when(open_, F.col(f"_h{n}.title")))
    return out.withColumn("breadcrumb", F.concat_ws(" > ", *parts, "title")).drop(*[f"_{x}{n}" for n in LEVELS for x in "hc"])


def heading_of_lines(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """lines with heading_line: the last heading strictly before (an as-of join without a join)."""
    before = Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("heading_line", F.last(F.when(F.col("text").rlike(r"^#{1,5}\s+"), F.col("line")), ignorenulls=True).over(before))


def kind(text: Column) -> Column:
    return F.when(text.rlike(r"^#{1,5}\s+"), "heading").when(text.rlike(r"^\s*\|"), "table").when(text.rlike(r"^!\[.*\]\(.*\)"), "figure").when(F.trim(text) == "", "blank").otherwise("paragraph")


def blocks(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, block, kind, start_line, end_line, content): runs of table or paragraph lines; headings and figures alone; blank lines only separate."""
    along = Window.partitionBy(doc).orderBy("line")
    x = lines.withColumn("kind", kind(F.col("text")))
    new = (F.col("kind") != F.coalesce(F.lag("kind").over(along), F.lit(""))) | F.col("kind").isin("heading", "figure")
    x = x.withColumn("block", F.sum(new.cast("int")).over(along)).where("kind != 'blank'")
    return x.groupBy(doc, "block", "kind").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("content"))


def section_contents(sections: DataFrame, lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """sections (doc, line, end_line, ...) with content: the lines from heading to end, joined. A range join inside each document."""
    x = lines.select(F.col(doc).alias("_d"), F.col("line").alias("_n"), F.col("text").alias("_t"))
    j = sections.join(x, (F.col(doc) == F.col("_d")) & F.col("_n").between(F.col("line"), F.col("end_line")))
    c = j.groupBy(doc, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda s: s["_t"]), "\n").alias("content"))
    return sections.join(c, [doc, "line"])


def islands(df: DataFrame, by: list[str], gap: int = 7, start: str = "start_line", end: str = "end_line", order: str = "id") -> DataFrame:
    """df with island: rows of a group in line order whose start is at most gap after the end before share one."""
    along = Window.partitionBy(*by).orderBy(start, end, order)
    new = F.coalesce((F.col(start) - F.lag(end).over(along) > gap).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(along)).drop("_new")


def ancestors(chunks: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth, ancestor_id): all that stands above each of chunks (id, parent_id), at any height, with the least depth.

    Each round joins what is known with itself: what stands 2^n above a node knows its own next 2^n, so a tree of height h takes about log h rounds. A climb ends
    where it would come to its own node again, and a round that finds nothing new is the last, so circles end too. A parent that isn't there is an
    ancestor without any of its own. depth: only so far up.
    """
    from folioflow.sources.files import remove, step  # it imports operators

    spark = chunks.sparkSession
    known, path = step(chunks.where("parent_id is not null and parent_id != id").select("id", F.lit(1).alias("depth"), F.col("parent_id").alias("ancestor_id")).distinct())
    n, span = known.count(), 1
    while n and (depth is None or span < depth):
        far = known.where(F.col("depth") == span).select("id", F.col("ancestor_id").alias("_via"))
        above = known.select(F.col("id").alias("_via"), (F.col("depth") + span).alias("depth"), "ancestor_id")
        more = far.join(above, "_via").where("id != ancestor_id").select("id", "depth", "ancestor_id")
        out, after = step(known.unionAll(more).groupBy("id", "ancestor_id").agg(F.min("depth").alias("depth")).select("id", "depth", "ancestor_id"))
        remove(spark, path)
        before, (known, path, span) = n, (out, after, span * 2)
        n = known.count()
        if n == before:
            break
    return known if depth is None else known.where(F.col("depth") <= depth)


def ancestors_of(items: DataFrame, above: DataFrame) -> DataFrame:
    """(id, depth, ancestor_id) of items (id, parent_id) below a tree whose ancestors() are known: one join, however many items there are."""
    first = items.where("parent_id is not null").select("id", F.lit(1).alias("depth"), F.col("parent_id").alias("ancestor_id"))
    up = above.select(F.col("id").alias("_p"), (F.col("depth") + 1).alias("depth"), "ancestor_id")
    more = items.select("id", F.col("parent_id").alias("_p")).join(up, "_p").select("id", "depth", "ancestor_id")
    return first.unionAll(more)


def breadcrumb_walk(items: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, breadcrumb) of items (id, parent_id) below or in a tree (id, parent_id, content): the headings above from the root down; none gives [No heading]."""
    titles = tree.select(F.col("id").alias("ancestor_id"), F.regexp_replace(F.split_part("content", F.lit("\n"), F.lit(1)), "^#+ *", "").alias("t"))
    a = ancestors_of(items, ancestors(tree)).join(titles, "ancestor_id")
    crumbs = a.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "t")), asc=False), lambda s: s["t"]), " > ").alias("b"))
    return items.select("id").join(crumbs, "id", "left").select("id", F.coalesce("b", F.lit("[No heading]")).alias("breadcrumb"))


def within_ranges(ranges: DataFrame, pieces: DataFrame, by: str, width: int = 64) -> DataFrame:
    """Rows of ranges (by, range_start, range_end, ...) with each of the pieces (by, start_line, end_line, ...) that lie inside.

    Lines are cut into bins of `width`: a range is in all bins that it touches, a piece in that of its start, so the join has equal keys, which
    part even a single large work, and each pair meets once.
    """
    bins = F.sequence(F.floor(F.col("range_start") / width), F.floor(F.col("range_end") / width))
    r = ranges.where("range_end >= range_start").withColumn("_bin", F.explode(bins))
    p = pieces.withColumn("_bin", F.floor(F.col("start_line") / width))
    return r.join(p, [by, "_bin"]).where("start_line >= range_start and end_line <= range_end").drop("_bin")


def excerpts(items: DataFrame, works: DataFrame, chunks: DataFrame, width: int = 64, preview: int = 2000) -> DataFrame:
    """(item_id, content, heading_breadcrumbs, preview) of excerpt links (item_id, work_id, range_start, range_end): the chunks of the work inside the range, in order of lines.

    The breadcrumbs are the first chunk's. A range without chunks and a work that is gone say so in content; their preview is null.
    """
    j = within_ranges(items, chunks.select("work_id", "id", "start_line", "end_line", "content", "heading_breadcrumbs"), "work_id", width)
    g = j.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "content", "heading_breadcrumbs"))).alias("c"))
    out = items.join(works.select("work_id", F.lit(True).alias("_there")).distinct(), "work_id", "left").join(g, "item_id", "left")
    text = F.array_join(F.transform("c", lambda x: x["content"]), "\n\n")
    has = F.col("_there") & F.col("c").isNotNull()
    return out.select(
        "item_id", F.when(F.col("_there").isNull(), "Source work deleted.").when(F.col("c").isNull(), "Excerpt content not found.").otherwise(text).alias("content"),
        F.when(has, F.col("c")[0]["heading_breadcrumbs"]).alias("heading_breadcrumbs"), F.when(has, F.substring(text, 1, preview)).alias("preview"))


def heading_context(lines: DataFrame, around: int = 100, doc: str = "doc_id") -> DataFrame:
    """(doc, line, level, title, position, before, after) of the headings of one to six marks: where they begin in their document, from 0, and so many characters of it on both sides, trimmed."""
    along = Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("position", F.coalesce(F.sum(F.length("text") + 1).over(along), F.lit(0)))
    whole = lines.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("_whole"))
    h = x.where(F.col("text").rlike(r"^#{1,6}\s+\S")).join(whole, doc)
    start, end = F.col("position").cast("int"), (F.col("position") + F.length("text")).cast("int")
    blank = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return h.select(
        doc, "line", F.length(F.regexp_extract("text", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("text", r"^#+\s+(.*)$", 1)).alias("title"), "position",
        blank(F.substr("_whole", F.greatest(start - around, F.lit(0)) + 1, F.least(start, F.lit(around)))).alias("before"), blank(F.substr("_whole", end + 1, F.lit(around))).alias("after"))
