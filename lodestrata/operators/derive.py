"""Derived pages, their health, and the evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import short_hash, slug


def entity_pages(bridge: DataFrame, entities: DataFrame, frames: DataFrame, least: int = 2, lines: int = 8, width: int = 200) -> DataFrame:
    """One page per entity that at least ``least`` frames mention: slug, name, n_frames, markdown, content_hash.

    Without a model the page lists the first line parts of the earliest frames.
    Entities whose slugs clash share the page of the smallest id.
    """
    w = Window.partitionBy("entity_id").orderBy("frame_id")
    body = F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, width)
    ranked = bridge.join(frames.select(F.col("id").alias("frame_id"), body.alias("line")), "frame_id").withColumn("nth", F.row_number().over(w))
    pages = ranked.groupBy("entity_id").agg(F.count("*").alias("n_frames"), F.array_sort(F.collect_list(F.when(F.col("nth") <= lines, F.struct("nth", "line")))).alias("top")).filter(F.col("n_frames") >= least)
    named = pages.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").withColumn("slug", slug(F.col("name"))).filter("slug <> ''")
    first = Window.partitionBy("slug").orderBy("entity_id")
    once = named.withColumn("k", F.row_number().over(first)).filter("k = 1")
    markdown = F.concat(F.lit("# "), "name", F.lit("\n\n- "), F.array_join(F.transform("top", lambda x: x["line"]), "\n- "))
    return once.select("slug", "name", "n_frames", markdown.alias("markdown")).withColumn("content_hash", short_hash(F.col("markdown")))


def page_actions(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """slug and what compiling does to each page: created, updated, unchanged, or stale where it is no longer made."""
    joined = pages.select("slug", F.col("content_hash").alias("new")).join(stored.select("slug", F.col("content_hash").alias("old")), "slug", "full_outer")
    action = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "stale").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return joined.select("slug", action.alias("action"))


def health(entities: DataFrame, pages: DataFrame, relations: DataFrame, sources_per_page: DataFrame) -> DataFrame:
    """Issues of the pages: kind, subject, severity.

    missing_page: an entity that is an end of relations has no page, high above
    two of them; weak_confidence: a page rests on fewer than two sources;
    orphan_entity: an entity without any relation.
    """
    ends = relations.select(F.col("source_id").alias("id")).unionByName(relations.select(F.col("target_id").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    named = entities.select("id", "name").join(ends, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    page = pages.select(F.lower("name").alias("low")).distinct()
    missing = named.filter("n > 0").withColumn("low", F.lower("name")).join(page, "low", "left_anti").select(F.lit("missing_page").alias("kind"), "name", F.when(F.col("n") > 2, "high").otherwise("low").alias("severity"))
    weak = sources_per_page.filter("n_sources < 2").select(F.lit("weak_confidence").alias("kind"), F.col("slug").alias("name"), F.lit("low").alias("severity"))
    alone = named.filter("n = 0").select(F.lit("orphan_entity").alias("kind"), "name", F.lit("low").alias("severity"))
    return missing.unionByName(weak).unionByName(alone)


def health_score(issues: DataFrame) -> DataFrame:
    """The share of the four parts of a healthy wiki, of 100; high issues cost ten each, at most forty."""
    counts = issues.agg(*(F.sum((F.col("kind") == k).cast("int")).alias(k) for k in ("missing_page", "weak_confidence", "orphan_entity")), F.sum((F.col("severity") == "high").cast("int")).alias("high"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    part = sum((F.when(zero(k) == 0, 20).otherwise(0) for k in ("missing_page", "weak_confidence", "orphan_entity")), F.lit(40))
    return counts.select(*(zero(c).cast("long").alias(c) for c in ("missing_page", "weak_confidence", "orphan_entity", "high")), (part - F.least(F.lit(40), 10 * zero("high"))).cast("long").alias("score"))


def concepts(entities: DataFrame, least: int = 3, limit: int = 20) -> DataFrame:
    """Types with at least ``least`` active entities and the names of concept entities: name and n, the first ``limit``."""
    live = entities.filter("valid_to IS NULL")
    types = live.filter("entity_type IS NOT NULL AND entity_type <> 'concept'").groupBy(F.col("entity_type").alias("name")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    names = live.filter("entity_type = 'concept'").groupBy("name").agg(F.count("*").alias("n"))
    return types.unionByName(names).groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def precision_at(hits: DataFrame, gold: DataFrame, k: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """qid and the share of its first ``k`` hits that are right; a query without hits has 0.

    Only the pairs of ``gold(qid, id)`` that are hits matter if ``queries(qid)``
    names the queries, each once; else they are those of ``gold``.
    """
    right = gold.select("qid", "id", F.lit(1).alias("right")).distinct()
    top = hits.filter(F.col("rank") < k).join(right, ["qid", "id"], "left").groupBy("qid").agg((F.sum(F.coalesce("right", F.lit(0))) / F.count("*")).alias("precision"))
    queries = gold.select("qid").distinct() if queries is None else queries
    return queries.join(top, "qid", "left").select("qid", F.round(F.coalesce("precision", F.lit(0.0)), 6).alias("precision"))


def recall_at(hits: DataFrame, gold: DataFrame, k: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """qid and whether any right row is among its first ``k`` hits; ``queries`` as in ``precision_at``."""
    top = hits.filter(F.col("rank") < k).join(gold.select("qid", "id").distinct(), ["qid", "id"], "left_semi").select("qid", F.lit(True).alias("found")).distinct()
    queries = gold.select("qid").distinct() if queries is None else queries
    return queries.join(top, "qid", "left").select("qid", F.coalesce("found", F.lit(False)).alias("found"))


def judge_rollup(votes: DataFrame, by: str) -> DataFrame:
    """Per category and over all (null): n, shares by all three and by two of three of the judges j1, j2, j3."""
    v = votes.withColumn("sum", F.col("j1").cast("int") + F.col("j2").cast("int") + F.col("j3").cast("int"))
    return v.rollup(by).agg(F.count("*").alias("n"), F.round(F.avg((F.col("sum") == 3).cast("double")), 6).alias("strict"), F.round(F.avg((F.col("sum") >= 2).cast("double")), 6).alias("majority"))


def kappa(votes: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two judges, and their plain agreement."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    m = votes.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select(F.lit(f"{a}-{b}").alias("pair"), F.round("po", 6).alias("agreement"), F.round(F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).otherwise(1.0), 6).alias("kappa"))


def z_test(votes: DataFrame, vote: str, expected: float) -> DataFrame:
    """n, share and z of one proportion against ``expected``."""
    m = votes.agg(F.count("*").alias("n"), F.avg(F.col(vote).cast("double")).alias("p"))
    return m.select("n", F.round("p", 6).alias("share"), F.round((F.col("p") - expected) / F.sqrt(F.lit(expected) * (1 - expected) / F.col("n")), 6).alias("z"))
