"""Scoring of research results and of document structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import structure as S
from folioflow.sources.files import exists, remove

#: The citation pattern, and model names that count as strong.
CITATION = r"(\[[A-Za-z\s]+(?:\set\sal\.)?\s\d{4}\])"
STRONG = ["gpt-4", "o1", "pro", "ultra", "claude-3-5"]


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def source_keys(source: Column, place: Column) -> Column:
    """What a citation may call a source (work_id, title, authors, type, item_id) that is the place-th (from 0): its title, its first author's last name, `[research] result n`, `s` and its number, or its number."""
    number = (place + 1).cast("string")
    author = F.element_at(F.split(F.trim(F.split_part(source["authors"], F.lit(","), F.lit(1))), r"\s+"), -1)
    result = F.when(source["type"] == "research_result", F.coalesce(source["item_id"].cast("string"), number))
    keys = F.array(source["title"], author, F.concat(F.lit("result "), result), F.concat(F.lit("research result "), result), F.concat(F.lit("s"), number), number)
    return F.filter(F.transform(keys, F.lower), lambda k: F.coalesce(k, F.lit("")) != "")


def _names(citation: Column, keys: Column) -> Column:
    return _once(F.lower(citation), lambda c: F.exists(keys, lambda k: F.contains(c, k)))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once, however often then's own functions of items ask for it."""
    return F.transform(F.array(value), then)[0]


def source_diversity(cites: Column, sources: Column) -> Column:
    """How many different works (results without a work by their item) some citation names."""
    named = F.transform(sources, lambda s, i: F.struct(source_keys(s, i).alias("keys"), F.coalesce(s["work_id"].cast("string"), F.concat(F.lit("item_"), F.coalesce(s["item_id"].cast("string"), (i + 1).cast("string")))).alias("name")))
    found = F.filter(named, lambda s: F.exists(cites, lambda c: _names(c, s["keys"])))
    return F.size(F.array_distinct(F.transform(found, lambda s: s["name"])))


def broken_citations(cites: Column, sources: Column) -> Column:
    """The citations that name no source."""
    return _once(F.flatten(F.transform(sources, source_keys)), lambda keys: F.filter(cites, lambda c: ~_names(c, keys)))


def quality_score(text: Column, created: Column, model: Column, as_of: Column) -> Column:
    """.40 citation density (one in 50 words is full) + .20 freshness (180 days) + .15 completeness (1000 words) + .15 diversity (5 sources) + .10 model; 0 without words."""
    words, cites = X.count_words(text), citations(text)
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    density = clamp(F.coalesce(F.try_divide(F.size(cites) * 50.0, words), F.lit(0.0)))
    fresh = F.greatest(F.lit(0.0), 1 - F.datediff(as_of, created) / F.lit(180.0))
    strong = F.when(F.exists(F.array(*map(F.lit, STRONG)), lambda s: F.contains(F.lower(model), s)), 1.0).otherwise(0.5)
    total = 0.4 * density + 0.2 * fresh + 0.15 * clamp(words / F.lit(1000.0)) + 0.15 * clamp(F.size(F.array_distinct(cites)) / F.lit(5.0)) + 0.1 * strong
    return F.when(words == 0, 0.0).otherwise(F.round(clamp(total), 6))


def reuse_strategy(matches: DataFrame, by: str) -> DataFrame:
    """(by, strategy) of matches (by, similarity, quality): none good: new_generation; one: exact_reuse or partial_reuse by its similarity; else ensemble."""
    good = F.col("quality") > 0.75
    g = matches.groupBy(by).agg(F.count_if(good).alias("n"), F.max(F.when(good, F.col("similarity"))).alias("s"))
    one = F.col("n") == 1
    return g.select(by, F.when(F.col("n") == 0, "new_generation").when(one & (F.col("s") > 0.9), "exact_reuse").when(one & (F.col("s") > 0.85), "partial_reuse").otherwise("ensemble").alias("strategy"))


def count_sentences(text: Column) -> Column:
    """Pieces between periods followed by white space, at least one."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\.\s+"), lambda s: F.trim(s) != "")))


def section_quality(sections: DataFrame, words: str = "words", cites: str = "citations", sentences: str = "sentences", sources: str = "sources") -> DataFrame:
    """sections with coverage (citations a sentence), coherence and completeness bands."""
    cov = F.least(F.lit(1.0), F.col(cites).cast("double") / F.greatest(F.lit(1), F.col(sentences)))
    w = F.col(words)
    s = sections.withColumn("_cov", cov).withColumn("coverage", F.round("_cov", 2))
    return s.withColumn("coherence", F.when((w > 800) & (F.col("_cov") > 0.5), "High").when((w > 400) & (F.col("_cov") > 0.3), "Medium").otherwise("Low")).withColumn(
        "completeness", F.when((F.col(sources) >= 3) & (w > 600), "High").when((F.col(sources) >= 1) & (w > 200), "Medium").otherwise("Low")).drop("_cov")


def needs_refinement(sections: DataFrame, coverage: str = "coverage", sources: str = "sources", coherence: str = "coherence", broken: str = "broken", rounds: str = "rounds", most: int = 2) -> DataFrame:
    """sections with refine: coverage under .7, fewer than three sources, low coherence or a broken citation, and rounds left."""
    poor = (F.col(coverage) < 0.7) | (F.col(sources) < 3) | (F.col(coherence) == "Low") | (F.col(broken) > 0)
    return sections.withColumn("refine", poor & (F.col(rounds) < most))


def measured(sections: DataFrame, text: str = "text", sources: str = "s") -> DataFrame:
    """sections with all that needs_refinement() asks for, of their text and their sources (as source_keys() takes them)."""
    t, s, c = F.col(text), F.col(sources), F.col("_cites")
    return section_quality(sections.withColumn("_cites", citations(t)).withColumns({
        "words": X.count_words(t), "citations": F.size(c), "sentences": count_sentences(t), "sources": source_diversity(c, s), "broken": F.size(broken_citations(c, s))}).drop("_cites"))


def refined(sections: DataFrame, improve: Callable[[DataFrame], DataFrame], path: str, judge: Callable[[DataFrame], DataFrame] = measured, most: int = 2) -> DataFrame:
    """The judged sections after rounds of improvement, with rounds: how often each was improved, `most` times at most.

    A round judges its sections and writes them under path, settled ones and poor ones apart; only the poor ones go on, through improve (retrieval and a language model, say), which gives the same
    columns back. The rounds are the state: a run over the same path takes up after the last round that was written whole, and a round that broke off is written again. A round's poor sections
    are deleted once the next round is whole. Each section is settled in one round; a section that improve leaves out is gone.
    """
    spark, fields = sections.sparkSession, sections.columns
    whole = lambda n: exists(spark, f"{path}/round={n}/_SUCCESS")
    now = sections
    for n in range(most + 1):
        found = needs_refinement(judge(now).withColumn("rounds", F.lit(n)), most=most)
        schema, to = found.schema, f"{path}/round={n}"
        if not whole(n):
            found.write.mode("overwrite").partitionBy("refine").option("compression", "zstd").parquet(to)
        if n:
            remove(spark, f"{path}/round={n - 1}/refine=true")
        if n == most:
            break
        if whole(n + 1):
            continue
        poor = spark.read.schema(schema).parquet(to).where("refine").select(*fields)
        if poor.isEmpty():
            break
        now = improve(poor).select(*fields)
    written = [spark.read.schema(schema).parquet(f"{path}/round={k}") for k in range(n + 1)]
    out = written[0]
    for w in written[1:]:
        out = out.unionByName(w)
    return out.where("not refine").drop("refine")


def structure_scores(headings: DataFrame, totals: DataFrame, doc: str = "doc_id", words_per_line: float = 12.0) -> DataFrame:
    """Per document with headings: how well its structure serves chunking.

    headings (doc, line, level, title); totals (doc, total_lines). A section runs to the next heading that isn't deeper; its words are
    estimated from its lines. hierarchy, chunkability and coverage are 0 to 1; penalties are points of which 30 take all.
    """
    w = Window.partitionBy(doc).orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    h = S.section_ends(headings, totals, doc).join(totals, doc)
    h = h.withColumns({
        "size": ((F.col("end_line") - F.col("line") + 1) * words_per_line).cast("int"), "jump": F.abs(F.col("level") - F.lag("level").over(w)), "near": F.col("line") - F.lag("line").over(w) <= 2,
        "top": F.col("level") <= 2, "top_before": F.last(F.when(F.col("level") <= 2, F.col("line")), ignorenulls=True).over(before), "name": F.lower(F.trim("title"))})
    h = h.withColumn("stretch", F.sum(F.when(F.col("near"), 0).otherwise(1)).over(w))
    h = h.withColumns({"row": F.count_if("near").over(w.partitionBy(doc, "stretch")), "same": F.count(F.lit(1)).over(Window.partitionBy(doc, "name")), "mean": F.avg("size").over(Window.partitionBy(doc, "name")), "nth": F.row_number().over(Window.partitionBy(doc, "name").orderBy("line"))})
    spacing = F.when(F.col("top"), F.col("line") - F.col("top_before"))
    g = h.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"), F.max("level").alias("depth"), F.count_if(F.col("jump") > 2).alias("jumps"), F.count_if(F.col("size").between(150, 400)).alias("good"), F.count_if(F.col("size") < 50).alias("small"),
        F.count_if(F.col("size") > 800).alias("large"), F.count_if("top").alias("top"), F.coalesce(F.var_samp(spacing), F.lit(0.0)).alias("spread"), F.max("size").alias("largest"), F.sum("size").alias("total"),
        (F.count_if((F.col("same") >= 3) & (F.col("mean") < 30) & (F.col("nth") == 1)) * 5).alias("repeated"), F.when(F.max("row") >= 5, 10).otherwise(0).alias("runs"), F.max("total_lines").alias("total_lines"))
    n = F.col("n").cast("double")
    floor = lambda c: F.greatest(F.lit(0.0), c)
    depth = F.when(F.col("depth") == 1, 0.3).when(F.col("depth") == 2, 0.7).when(F.col("depth") <= 4, 1.0).otherwise(0.9)
    even = F.when(F.col("top") >= 2, floor(1 - 100 * F.coalesce(F.try_divide(F.col("spread"), F.col("total_lines").cast("double") ** 2), F.lit(0.0)))).otherwise(0.5)
    out = g.withColumns({
        "hierarchy": F.round(F.when(F.col("n") == 1, depth).otherwise(0.5 * depth + 0.5 * floor(1 - 2 * F.col("jumps") / (n - 1))), 6),
        "chunkability": F.round(floor((F.col("good") - 0.3 * F.col("small") - 0.5 * F.col("large")) / n), 6),
        "coverage": F.round(F.when(F.col("top") == 0, 0.0).otherwise(0.6 * F.least(F.col("top") / 10.0, F.lit(1.0)) + 0.4 * even), 6),
        "imbalance": F.when((F.col("n") > 1) & (F.col("largest") > 0.5 * F.col("total")), 15).otherwise(0)})
    out = out.withColumn("penalty", F.col("repeated") + F.col("runs") + F.col("imbalance"))
    return out.withColumn("score", F.round(floor(0.4 * F.col("hierarchy") + 0.4 * F.col("chunkability") + 0.2 * F.col("coverage") - F.least(F.col("penalty") / 30.0, F.lit(1.0))), 6))


def better_of(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, best): 'first' or 'second' of two scored documents: the higher score; within .01 better chunkability, fewer jumps, more top headings, then the second. One alone wins."""
    cols = ["score", "chunkability", "jumps", "top"]
    a, b = (df.select(key, F.struct(*cols).alias(n)) for df, n in ((first, "a"), (second, "b")))
    c = lambda n, x: F.col(f"{n}.{x}")
    wins = F.when(F.abs(c("a", "score") - c("b", "score")) >= 0.01, c("a", "score") > c("b", "score")).when(c("a", "chunkability") != c("b", "chunkability"), c("a", "chunkability") > c("b", "chunkability"))
    wins = wins.when(c("a", "jumps") != c("b", "jumps"), c("a", "jumps") < c("b", "jumps")).otherwise(c("a", "top") > c("b", "top"))
    return a.join(b, key, "full").select(key, F.when(F.col("b").isNull() | (F.col("a").isNotNull() & wins), "first").otherwise("second").alias("best"))
