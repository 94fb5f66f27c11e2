"""Recall lanes beside plain search, and what is made of their hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import fixed
from lodestrata.functions.text import TURN_HEADER, is_bookkeeping, reports_failure


def turns(frames: DataFrame) -> DataFrame:
    """id, conv, turn, speaker and content of the frames that hold one turn of a conversation."""
    part = lambda i: F.regexp_extract("content", TURN_HEADER, i)
    return frames.filter(F.col("content").rlike(TURN_HEADER)).select("id", "content", "created_at", part(1).alias("conv"), part(2).cast("long").alias("turn"), part(3).alias("speaker"))


def with_neighbours(hits: DataFrame, all_turns: DataFrame, reach: int = 1) -> DataFrame:
    """qid, id, conv, turn and whether it is a hit, of the hits' turns and those up to ``reach`` away."""
    wanted = hits.select("qid", "conv", F.col("turn").alias("hit_turn"), F.explode(F.sequence(F.col("turn") - reach, F.col("turn") + reach)).alias("turn"))
    met = wanted.groupBy("qid", "conv", "turn").agg(F.max((F.col("turn") == F.col("hit_turn")).cast("int")).alias("hit"))
    return met.join(all_turns.select("id", "conv", "turn"), ["conv", "turn"]).select("qid", "id", "conv", "turn", (F.col("hit") == 1).alias("is_hit"))


def raw_detail(hits: DataFrame, all_turns: DataFrame, keep: int = fixed.DETAIL_KEEP) -> DataFrame:
    """The best ``keep`` hits of each query with their neighbours, in the order of time: qid, id, is_hit, position.

    ``hits``: qid, id, rank over turn frames.
    """
    top = hits.filter(F.col("rank") < keep).join(all_turns.select("id", "conv", "turn"), "id")
    wide = with_neighbours(top, all_turns).join(all_turns.select("id", "created_at"), "id")
    once = wide.groupBy("qid", "id", "conv", "turn", "created_at").agg(F.max("is_hit").alias("is_hit"))
    w = Window.partitionBy("qid").orderBy("created_at", "conv", "turn", "id")
    return once.withColumn("position", F.row_number().over(w) - 1).select("qid", "id", "is_hit", "position")


def merged_lanes(*lanes: tuple[str, DataFrame]) -> DataFrame:
    """qid, id and lane of every hit of named lanes of qid and id; an earlier lane keeps a hit that several have."""
    parts = [df.select("qid", "id", F.lit(n).alias("place"), F.lit(name).alias("lane")) for n, (name, df) in enumerate(lanes)]
    together = reduce(DataFrame.unionByName, parts)
    return together.groupBy("qid", "id").agg(F.min(F.struct("place", "lane")).alias("first")).select("qid", "id", F.col("first.lane").alias("lane"))


def failures(hits: DataFrame, frames: DataFrame, most: int = 2, floor: float = 0.0) -> DataFrame:
    """The first ``most`` hits of each query that tell of a failure not yet over: qid, id, nth."""
    body = frames.select("id", "content", "importance")
    trace = (F.col("importance") == "temporary") & F.col("content").rlike(r"^\[hm session:")
    kept = hits.filter(F.col("score") >= floor).join(body, "id").filter(reports_failure(F.col("content")) & ~F.coalesce(trace, F.lit(False)))
    w = Window.partitionBy("qid").orderBy("rank", "id")
    return kept.withColumn("nth", F.row_number().over(w) - 1).filter(F.col("nth") < most).select("qid", "id", "nth")


def without_bookkeeping(frames: DataFrame) -> DataFrame:
    return frames.filter(~is_bookkeeping(F.col("content")))


def first_by_prefix(hits: DataFrame, frames: DataFrame, length: int = 80, most: int = 3) -> DataFrame:
    """The first ``most`` hits of each query whose beginnings differ: qid, id, nth."""
    body = frames.select("id", F.substring("content", 1, length).alias("prefix"))
    one = Window.partitionBy("qid", "prefix").orderBy("rank", "id")
    kept = hits.join(body, "id").withColumn("k", F.row_number().over(one)).filter("k = 1")
    w = Window.partitionBy("qid").orderBy("rank", "id")
    return kept.withColumn("nth", F.row_number().over(w) - 1).filter(F.col("nth") < most).select("qid", "id", "nth")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a length differs or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def verified(pairs: DataFrame, least: float = 0.55) -> DataFrame:
    """Pairs of vectors a and b alike enough; a pair without vectors passes."""
    return pairs.filter(F.coalesce(F.round(cosine(F.col("a"), F.col("b")), 6) >= least, F.lit(True)))


#: Sections of a composed context in order, with their caps per tier (none, some, all).
SECTIONS = {"identity": (1, 3, 5), "awareness": (2, 4, 8), "frames": (3, 6, 10), "failures": (2, 2, 2)}


def composed(parts: DataFrame, tier: int = 1, cap: int = 240) -> DataFrame:
    """qid and one text of the sections of ``parts(qid, section, nth, content)``, each cut to its cap of entries and characters."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(SECTIONS) for x in (s, i)])
    caps = F.create_map(*[F.lit(x) for s, c in SECTIONS.items() for x in (s, c[tier])])
    kept = parts.filter(F.col("nth") < F.element_at(caps, F.col("section")))
    cut = F.when(F.length("content") > cap, F.concat(F.substring("content", 1, cap), F.lit("…"))).otherwise(F.col("content"))
    lines = kept.groupBy("qid", "section").agg(F.array_sort(F.collect_list(F.struct("nth", cut.alias("line")))).alias("lines"))
    section = lines.select("qid", F.element_at(order, F.col("section")).alias("place"), F.concat(F.lit("## "), "section", F.lit("\n- "), F.array_join(F.transform("lines", lambda x: x["line"]), "\n- ")).alias("text"))
    return section.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("all")).select("qid", F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("context"))
