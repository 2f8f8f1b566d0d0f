"""The retrieval pipeline as one plan: expansion, embedding, ranked lists, fusion, enrichment, reranking, diversity, consolidation, prompt.

Queries are a stated batch; all that grows with the corpus is scanned or joined by Spark. Models are functions over batches
of texts (see external).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import chunking, consolidation, external, fulltext, fusion, search, structure

#: Limits of the lists, of their fusion and of the result; words of an enriched text; weights.
DENSE, LEXICAL, RRF_K, FUSED, FINAL = 19, 5, 50, 75, 17
LEAST_WORDS, MOST_WORDS, HEIGHT, ENTITY, DIVERSITY = 150, 1000, 10, 0.05, 0.7
PROMPT = "Give {n} rephrasings, a short hypothetical answer, the intent and the entities of the question as JSON (queries, hyde_answer, intent, entities).\nQuestion: {question}"
_EXPANSION = "queries array<string>, hyde_answer string, intent string, entities array<string>"


def expand_queries(queries: DataFrame, complete: Callable[[list[str]], list[str]], n: int = 3) -> DataFrame:
    """queries (query_id, q) with queries, hyde_answer, intent, entities and error: what a language model makes of each; missing keys are empty, a reply that isn't JSON is an error."""
    prompt = F.replace(F.replace(F.lit(PROMPT), F.lit("{n}"), F.lit(str(n))), F.lit("{question}"), F.col("q"))
    out = external.with_completion(queries.withColumn("_prompt", prompt), "_prompt", complete, "_reply")
    body = chunking.unfenced(F.col("_reply"))
    p = F.from_json(F.when(F.is_valid_utf8(body) & body.rlike(r"(?s)^\s*\{.*\}\s*$"), body), _EXPANSION)
    out = out.withColumn("_p", p)
    none = F.array().cast("array<string>")
    read = F.col("_p").isNotNull() & (F.col("_p.queries").isNotNull() | F.col("_p.hyde_answer").isNotNull() | F.col("_p.intent").isNotNull() | F.col("_p.entities").isNotNull() | F.trim(body).rlike(r"^\{\s*\}$"))
    return out.select(
        *queries.columns, F.coalesce("_p.queries", none).alias("queries"), F.coalesce("_p.hyde_answer", F.lit("")).alias("hyde_answer"), F.coalesce("_p.intent", F.lit("")).alias("intent"),
        F.coalesce("_p.entities", none).alias("entities"), F.when(~F.coalesce(read, F.lit(False)), "not JSON").alias("error"))


def query_lists(expanded: DataFrame) -> DataFrame:
    """(query_id, list_id, kind, text): the question (original), its rephrasings (mqe) and the hypothetical answer (hyde, if there is one)."""
    one = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    hyde = F.when(F.col("hyde_answer") != "", F.array(one("hyde", F.col("hyde_answer")))).otherwise(F.array().cast("array<struct<kind: string, text: string>>"))
    every = F.concat(F.array(one("original", F.col("q"))), F.transform("queries", lambda t: one("mqe", t)), hyde)
    return expanded.select("query_id", F.posexplode(every).alias("list_id", "l")).select("query_id", "list_id", "l.kind", "l.text")


def vectorise_queries(expanded: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """query_lists() with embedding and vector_status."""
    return external.with_embedding(query_lists(expanded), "text", embed)


def enriched(items: DataFrame, chunks: DataFrame, least: int = LEAST_WORDS, most: int = MOST_WORDS, height: int = HEIGHT) -> DataFrame:
    """items (id, parent_id, content, start_line, end_line, heading_breadcrumbs, ...) with enriched_content, title, enriched_from, depth, fallback and reached_root.

    A text of fewer than `least` words takes that of the first ancestor with enough, or else of the topmost with a text, of at most `height` steps up;
    reached_root says that the root was not enough. A missing parent or a cycle ends the climb; where no ancestor has a text, the item keeps its own
    (fallback). Ancestors' texts over `most` words are cut to a window around the item. The climb has ids and word counts only; texts are joined once, at its end.
    """
    tree = consolidation.written(chunks.select(F.col("id").alias("_i"), F.col("parent_id").alias("_up"), F.col("content").isNotNull().alias("_has"), (X.count_words(F.col("content")) < least).alias("_few")))
    keys = {"_short": X.count_words(F.col("content")) < least, "_none": F.col("content").isNull()}
    state = items.select("id", "parent_id", *[v.alias(k) for k, v in keys.items()]).distinct().withColumns({
        "_at": F.when(F.col("_short") & ~F.col("_none"), F.col("parent_id")), "_seen": F.array("id"), "_stop": F.col("_none"), "enriched_from": F.lit(None).cast("long"), "depth": F.lit(0)})
    for _ in range(height):
        j = state.join(tree, F.col("_at") == F.col("_i"), "left")
        there = F.col("_at").isNotNull() & F.col("_i").isNotNull() & ~F.array_contains("_seen", F.col("_at"))
        circular = F.coalesce(F.array_contains("_seen", F.col("_at")), F.lit(False))
        state = j.select(
            "id", "parent_id", *keys, F.when(there & (~F.col("_has") | F.col("_few")), F.col("_up")).alias("_at"), F.when(there, F.array_append("_seen", F.col("_at"))).otherwise(F.col("_seen")).alias("_seen"),
            (F.col("_stop") | (F.col("_at").isNotNull() & (F.col("_i").isNull() | circular))).alias("_stop"),
            F.when(there & F.col("_has"), F.col("_at")).otherwise(F.col("enriched_from")).alias("enriched_from"), F.when(there, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"))
    state = consolidation.written(state.drop("_seen"))
    above = chunks.select(F.col("id").alias("_p"), F.col("content").alias("_text"), F.col("heading_breadcrumbs").alias("_title"))
    above = consolidation.met_by(above, state.select(F.col("enriched_from").alias("_p")).distinct())
    climbed = state.select(F.col("id").alias("_id"), F.col("parent_id").alias("_parent"), *[F.col(k).alias(k + "_") for k in keys], "_at", "_stop", "enriched_from", "depth")
    same = (F.col("id") == F.col("_id")) & F.col("parent_id").eqNullSafe(F.col("_parent")) & (F.col("_short") == F.col("_short_")) & (F.col("_none") == F.col("_none_"))
    state = items.withColumns(keys).join(climbed, same).join(above, F.col("enriched_from") == F.col("_p"), "left")
    text = F.coalesce("_text", "content", F.lit(""))
    place = F.greatest(F.lit(0), F.instr(text, F.substring(F.coalesce(F.col("content"), F.lit("")), 1, 50)) - 1)
    cut = consolidation.truncate_around(text, place, place + F.coalesce(F.length("content"), F.lit(0)), F.lit(most))
    found = F.col("enriched_from").isNotNull()
    title = F.coalesce(F.nullif(F.element_at(F.split(F.coalesce("_title", "heading_breadcrumbs"), " > "), -1), F.lit("")), F.lit("Untitled"))
    ended = F.col("_at").isNull() & ~F.col("_stop") & (F.col("depth") > 0)
    return state.select(
        *items.columns, F.when(found & (X.count_words(text) > most), cut).otherwise(text).alias("enriched_content"), title.alias("title"), "enriched_from", "depth",
        (~found & (F.col("_stop") | (F.col("depth") > 0))).alias("fallback"), (ended & (~found | (X.count_words(text) < least))).alias("reached_root"))


def enrichment_metrics(items: DataFrame, tree: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """One row of what enriched() comes to for items (id, parent_id, content) below a tree of chunks (id, parent_id, content), without the texts: how many there are, how many take an ancestor's text, in percent too,
    how many have to keep their own as no ancestor has one, from how far up on average, and how often the topmost wasn't enough. The tree's ancestors are found once; items join them by parent."""
    n = lambda c: X.count_words(F.col(c)).cast("long")
    short = items.select("id", "parent_id", n("content").alias("_w")).where(F.col("_w") < least)
    up = tree.where("content is not null").select(F.col("id").alias("ancestor_id"), n("content").alias("_aw"))
    above = structure.ancestors_of(short, structure.ancestors(tree)).join(up, "ancestor_id")
    enough = F.min_by(F.struct("depth", "_aw"), F.when(F.col("_aw") >= least, F.col("depth")))
    best = above.groupBy("id").agg(F.coalesce(enough, F.max_by(F.struct("depth", "_aw"), "depth")).alias("e"))
    found = short.join(best, "id", "left").agg(
        F.count("e").alias("enriched_count"), F.count_if(F.col("e").isNull() & F.col("parent_id").isNotNull()).alias("fallback_count"), F.coalesce(F.sum("e.depth"), F.lit(0)).alias("_d"), F.count_if(F.col("e._aw") < least).alias("reached_root_count"))
    total = items.agg(F.count(F.lit(1)).alias("total_chunks"))
    share = lambda c: F.try_divide(c.cast("double"), F.col("total_chunks"))
    return total.crossJoin(found).select("total_chunks", "enriched_count", "fallback_count", F.round(100 * share(F.col("enriched_count")), 4).alias("enrichment_percentage"), F.round(share(F.col("_d")), 4).alias("average_depth"), "reached_root_count")


def retrieve(
    expanded: DataFrame, chunks: DataFrame, embed: Callable = external.hashing_embedder, score: Callable = external.overlap_scorer, analyser: str = "english",
    dense: int = DENSE, lexical: int = LEXICAL, fused: int = FUSED, final: int = FINAL,
    index: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, id, parent_id, work_id, level, content, enriched_content, start_line, end_line, heading_breadcrumbs, rrf_score, final_score): the contexts of each query.

    expanded: what expand_queries() gives. A dense list for each embedded text and a lexical one for the question and each rephrasing are
    fused by rank (index: stored postings of the chunks; without it their texts are read, once); the best are enriched from their parents, reranked, moved by entities and intent, and chosen for diversity.
    """
    lists = vectorise_queries(expanded, embed)
    key = F.struct("query_id", "list_id").alias("query_id")
    near = search.dense_search(lists.select(key, F.col("embedding").alias("qe")), chunks, dense).select("query_id.*", "chunk_id", "rank")
    asked = lists.where("kind != 'hyde'").select(key, F.col("text").alias("q"))
    if index is None:
        found = fulltext.search_web_texts(asked, search.searchable(chunks), lexical, analyser)
    else:
        found = fulltext.search_web(asked, index, lexical, analyser, F.col("usable") & F.col("has_vector"))
    found = found.select("query_id.*", "chunk_id", "rank").withColumn("list_id", F.col("list_id") + 1000)
    best = consolidation.written(fusion.rrf(near.unionByName(found), RRF_K, fused))
    fields = ["id", "parent_id", "work_id", "level", "content", "start_line", "end_line", "heading_breadcrumbs", "embedding"]
    met = consolidation.met_by(chunks.select(*fields), best.select(F.col("chunk_id").alias("id")).distinct(), "id")
    cand = best.join(met, F.col("chunk_id") == F.col("id")).select("query_id", "rrf_score", *fields)
    cand = enriched(cand, chunks).drop("title", "enriched_from", "depth", "fallback", "reached_root")
    cand = cand.join(expanded.select("query_id", "q", "intent", "entities"), "query_id")
    cand = fusion.intent_boost(external.with_rerank_score(cand, "q", "enriched_content", score))
    cand = cand.withColumn("final_score", F.round(F.col("rerank_score") + fusion.entity_boost(F.col("enriched_content"), F.col("entities"), ENTITY) + F.col("intent_boost"), 6))
    cand = consolidation.written(cand)
    chosen = fusion.mmr(cand, "query_id", final, DIVERSITY, score="final_score")
    out = chosen.select("query_id", "id", F.col("mmr_rank").cast("int").alias("rank")).join(cand, ["query_id", "id"])
    return out.select("query_id", "rank", "id", "parent_id", "work_id", "level", "content", "enriched_content", "start_line", "end_line", "heading_breadcrumbs", "rrf_score", "final_score")


def consolidated(contexts: DataFrame, chunks: DataFrame, threshold: float = 0.5, gap: int = 7, enrich: bool = True, least_chars: int = 0) -> DataFrame:
    """What retrieve() found for each query (or section of a longer answer), consolidated; contents shorter than least_chars go."""
    items = contexts.select("query_id", "id", "parent_id", "work_id", F.coalesce("enriched_content", "content").alias("content"), "start_line", "end_line", F.col("final_score").alias("score"), "heading_breadcrumbs")
    parents = chunks.select("id", "parent_id", "content", "start_line", "end_line")
    out = consolidation.consolidate(items, parents, threshold, gap, enrich=enrich)
    works = items.select("query_id", F.col("id").alias("_id"), "work_id", "heading_breadcrumbs")
    out = out.join(works, (out["query_id"] == works["query_id"]) & (F.element_at("ids", 1) == F.col("_id"))).drop(works["query_id"]).drop("_id")
    return out.where(F.length("content") >= least_chars)


def sections_of(sections: DataFrame, chunks: DataFrame, complete: Callable, **options) -> DataFrame:
    """Contexts for the sections (section_id, prompt) of a longer answer, each a query of its own: expanded, retrieved and consolidated."""
    expanded = expand_queries(sections.select(F.col("section_id").alias("query_id"), F.col("prompt").alias("q")), complete)
    return consolidated(retrieve(expanded, chunks, **options), chunks).withColumnRenamed("query_id", "section_id")


def augmented_prompts(expanded: DataFrame, contexts: DataFrame, works: DataFrame, template: str, most: int = 5) -> DataFrame:
    """(query_id, prompt): the template with {question}, {intent}, {entities} and {context}, the best `most` contexts as numbered blocks."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.element_at("ids", 1))
    top = contexts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).join(works.select("work_id", "title"), "work_id", "left")
    blocks = consolidation.context_blocks(top)
    j = expanded.join(blocks, "query_id", "left")
    filled: Column = F.lit(template)
    for name, value in (("question", F.col("q")), ("intent", F.col("intent")), ("entities", F.array_join("entities", ", ")), ("context", F.coalesce("blocks", F.lit("")))):
        filled = F.replace(filled, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return j.select("query_id", filled.alias("prompt"))
