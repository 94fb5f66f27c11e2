"""Operators on entities and relations with validity intervals.

Entities: id, entity_type, name, valid_from, valid_to.  Relations: source_id,
target_id, relation_type, confidence, valid_from, valid_to.  A row is active
while valid_to is null.  Traversals are unrolled joins of bounded depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import entity_key
from lodestrata.tables import written


def active(rows: DataFrame) -> DataFrame:
    return rows.filter("valid_to IS NULL")


def valid_at(rows: DataFrame, instants: DataFrame) -> DataFrame:
    """The rows valid at each instant of ``instants(at)``: from inclusive, to exclusive.

    Instants are days of a calendar, so rows are spread over their first day's
    month blocks and joined by block instead of each with each.
    """
    block = lambda c: F.date_trunc("month", c).cast("date")
    last = instants.agg(F.max(block(F.col("at")))).first()[0]
    if last is None:
        return rows.limit(0).withColumn("at", F.lit(None).cast("timestamp_ntz"))
    start = block(F.col("valid_from"))
    stop = F.least(F.coalesce(block(F.col("valid_to")), F.lit(last)), F.lit(last))
    spread = rows.filter(F.col("valid_from").isNotNull() & (start <= F.lit(last))).withColumn("block", F.explode(F.sequence(start, F.greatest(stop, start), F.expr("INTERVAL 1 MONTH"))))
    joined = spread.join(instants.withColumn("block", block(F.col("at"))), "block")
    return joined.filter((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at")))).drop("block")


def reach(relations: DataFrame, seeds: DataFrame, depth: int = 3, kind: str | None = None, entities: DataFrame | None = None) -> DataFrame:
    """seed, node and the smallest number of active out-edges between them, up to ``depth``.

    Seeds are at distance 0.  Each step keeps only nodes not reached before, so
    the frontier never holds a node twice for a seed.  With ``entities`` retired
    targets aren't reached, and nothing through them.
    """
    edges = active(relations)
    if kind is not None:
        edges = edges.filter(F.col("relation_type") == kind)
    edges = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct()
    if entities is not None:
        edges = edges.join(active(entities).select(F.col("id").alias("next")).distinct(), "next", "left_semi").select("node", "next")
    edges = written(edges, "edges")
    seen = written(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("distance")).distinct(), "frontier")
    frontier = seen.select("seed", "node")
    for d in range(1, depth + 1):
        step = frontier.join(edges, "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = written(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier.withColumn("distance", F.lit(d)))
    return seen


def frame_distances(distances: DataFrame, bridge: DataFrame) -> DataFrame:
    """seed, frame_id and the smallest distance of an entity that the frame mentions."""
    return distances.join(bridge.select(F.col("entity_id").alias("node"), "frame_id"), "node").groupBy("seed", "frame_id").agg(F.min("distance").alias("distance"))


def degrees(relations: DataFrame) -> DataFrame:
    """id and the number of active relations it is an end of; a loop counts twice."""
    ends = active(relations)
    return ends.select(F.col("source_id").alias("id")).unionByName(ends.select(F.col("target_id").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    ends = active(relations)
    return active(entities).join(ends.select(F.col("source_id").alias("id")), "id", "left_anti").join(ends.select(F.col("target_id").alias("id")), "id", "left_anti")


def neighbours(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Per entity the number of active relations out and in, by type, as text."""
    ends = active(relations)
    out = ends.groupBy(F.col("source_id").alias("id"), "relation_type").agg(F.count("*").alias("n")).select("id", F.concat(F.lit(">"), "relation_type", F.lit(":"), F.col("n").cast("string")).alias("part"))
    into = ends.groupBy(F.col("target_id").alias("id"), "relation_type").agg(F.count("*").alias("n")).select("id", F.concat(F.lit("<"), "relation_type", F.lit(":"), F.col("n").cast("string")).alias("part"))
    parts = out.unionByName(into).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("part")), " ").alias("relations"))
    return active(entities).select("id").join(parts, "id", "left").select("id", F.coalesce("relations", F.lit("")).alias("relations"))


def duplicate_groups(entities: DataFrame) -> DataFrame:
    """key, type and the ids of active entities of one normalised name and type, where there are several."""
    keyed = active(entities).filter("name IS NOT NULL").select("id", entity_key(F.col("name")).alias("key"), F.lower(F.coalesce("entity_type", F.lit(""))).alias("kind"))
    return keyed.groupBy("key", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n > 1")


def survivors(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """id and the survivor its duplicate group folds into: the best connected, then the smallest id."""
    keyed = active(entities).filter("name IS NOT NULL").select("id", entity_key(F.col("name")).alias("key"), F.lower(F.coalesce("entity_type", F.lit(""))).alias("kind"))
    ranked = keyed.join(degrees(relations), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = ranked.groupBy("key", "kind").agg(F.count("*").alias("n"), F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("best")).filter("n > 1")
    return ranked.join(best, ["key", "kind"]).select("id", (-F.col("best.minus")).alias("survivor"))


def repointed(relations: DataFrame, folded: DataFrame) -> DataFrame:
    """Active relations after folding ``folded(id, survivor)``, loops dropped, equal ones once."""
    s = folded.select(F.col("id").alias("source_id"), F.col("survivor").alias("new_source"))
    t = folded.select(F.col("id").alias("target_id"), F.col("survivor").alias("new_target"))
    moved = active(relations).join(s, "source_id", "left").join(t, "target_id", "left")
    ends = moved.select(F.coalesce("new_source", "source_id").alias("source_id"), F.coalesce("new_target", "target_id").alias("target_id"), "relation_type")
    return ends.filter("source_id <> target_id").distinct()


def mentions(texts: DataFrame, names: DataFrame, min_length: int = 3, block: int = 200_000) -> DataFrame:
    """id and name of every name (lower case) that a text contains, wherever it stands.

    Exact, without joining each text with each name: blocks of at most ``block``
    distinct names become an automaton that reads every text once.
    """
    spark = texts.sparkSession
    wanted = names.select(F.lower("name").alias("name")).filter(F.length("name") >= min_length).distinct()
    blocks = max(1, -(-wanted.count() // block))
    out = None
    for b in range(blocks):
        held = spark.sparkContext.broadcast([r["name"] for r in wanted.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b).collect()])
        found = texts.select("id", F.lower("text").alias("text")).filter("text IS NOT NULL").mapInArrow(_mentions_kernel(held), "id long, name string")
        out = found if out is None else out.unionByName(found)
    return out


def _mentions_kernel(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for n in held.value:
            automaton.add_word(n, n)
        if held.value:
            automaton.make_automaton()
        for b in batches:
            ids, found = [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if held.value:
                    hits = sorted({n for _, n in automaton.iter(text)})
                    ids += [i] * len(hits)
                    found += hits
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["id", "name"])

    return run


def seeds_in_text(texts: DataFrame, entities: DataFrame, limit: int = 12) -> DataFrame:
    """The active entities that a text names, longest names first, at most ``limit`` per text: id, entity_id, rank."""
    named = active(entities).select(F.col("id").alias("entity_id"), F.lower("name").alias("name"))
    hits = mentions(texts, active(entities).select("name")).join(named, "name")
    w = Window.partitionBy("id").orderBy(F.desc(F.length("name")), "entity_id")
    return hits.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < limit).select("id", "entity_id", "rank")


def bridge(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, frame_id of every mention, without names so common that they say nothing.

    Names in more than 40 per cent of the texts and more than twenty are dropped.
    """
    named = active(entities).select(F.col("id").alias("entity_id"), F.lower("name").alias("name"))
    hits = mentions(texts, active(entities).select("name"))
    most = max(20, int(0.4 * texts.count()))
    kept = hits.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("name")
    return hits.join(kept, "name").join(named, "name").select("entity_id", F.col("id").alias("frame_id")).distinct()


def cognify(texts: DataFrame, entities: DataFrame, after: int) -> DataFrame:
    """Names found in the texts with an id above ``after``: name, how many texts, and the entity it already is."""
    from lodestrata.functions.text import candidate_entities

    found = texts.filter(F.col("id") > after).select("id", F.explode(candidate_entities(F.col("text"))).alias("name"))
    seen = found.groupBy("name").agg(F.count("*").alias("seen"))
    known = active(entities).groupBy("name").agg(F.min("id").alias("entity_id"))
    return seen.join(known, "name", "left")


def broken_properties(entities: DataFrame, required: dict[str, list[str]], allowed: list[str]) -> DataFrame:
    """Entities whose properties miss a required key or have an unknown one: id, missing, unknown."""
    keys = F.coalesce(F.map_keys(F.from_json("properties", "map<string,string>")), F.array().cast("array<string>"))
    need = F.coalesce(F.element_at(F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.lower("entity_type")), F.array().cast("array<string>"))
    out = entities.select("id", F.array_join(F.array_sort(F.array_except(need, keys)), ",").alias("missing"), F.array_join(F.array_sort(F.array_except(keys, F.array(*map(F.lit, allowed)))), ",").alias("unknown"))
    return out.filter("missing <> '' OR unknown <> ''")
