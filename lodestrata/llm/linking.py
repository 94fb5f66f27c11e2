"""Linking the variant spellings of the names of persons and firms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.names import Name, certainty, fits, imaged_blocks, read_name, same_name, short_blocks
from lodestrata.operators.components import connected_components
from lodestrata.tables import written

# Entity types as people type them.
BEING = ("person", "per", "people", "contact", "org", "organization", "organisation", "company", "firm", "human", "individual")
OTHER = ("concept", "project", "tool", "technology", "topic", "event", "place", "product", "idea")


def _name(key: str) -> Name:
    kind, _, parts = key.partition(":")
    return Name(kind, tuple(parts.split("|")))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = [read_name(n) for n in b.column("name").to_pylist()]
        sure = [certainty(n) for n in names]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("entity_type"), pa.array([n.kind for n in names]), pa.array([n.key for n in names]), pa.array(sure, pa.int64())], ["id", "entity_type", "kind", "key", "sure"])


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = [_name(k) for k in b.column("key").to_pylist()]
        columns = []
        for found in (imaged_blocks, short_blocks):
            all_of = [list(found(n)) for n in names]
            ends = pa.array(np.cumsum([0, *map(len, all_of)]).astype(np.int32))
            parts = list(zip(*(x for xs in all_of for x in xs))) or [(), ()]
            columns.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(parts[0], pa.string()), pa.array(parts[1], pa.int64())], ["block", "letters"])))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("node"), *columns], ["key", "node", "own", "other"])


def _alike() -> Column:
    """Whether the letters of x and y differ by no more than two slips can make."""
    away = lambda p, q: F.bit_count(F.col(f"{p}.letters").bitwiseAND(F.bitwise_not(f"{q}.letters"))) <= 2
    return away("x", "y") & away("y", "x")


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [same_name(_name(x), _name(y)) for x, y in zip(b.column("key_a").to_pylist(), b.column("key_b").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep, pa.bool_())), b.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [fits(_name(x), _name(y)) for x, y in zip(b.column("key_a").to_pylist(), b.column("key_b").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(got, pa.int32())], ["a", "b", "fit"])


def link_names(entities: DataFrame) -> DataFrame:
    """``(id, entity_id)`` of every row of ``entities(id, name, entity_type)`` that names a person or a firm.

    Spellings are reduced to keys; keys that share a block (phonetic codes of
    their sorted words, one sound more or less) are compared by Jaro-Winkler
    similarity and the nickname table, accepted pairs form components.  An
    initial or a bare family name joins the one person it fits, or none where it
    fits several.  Whether a component is a person or firm at all is decided by
    its spellings and by the types of all its rows together, so one wrong type
    doesn't matter.  entity_id is a 64-bit number, the same for equal input.

    Null and blank names give no row.  Only keys of a block whose letters differ by
    what two slips can make are met, which about one in a hundred does; repeated
    spellings are one key.
    """
    read = entities.select(F.col("id").cast("long").alias("id"), "entity_type", "name").filter("id IS NOT NULL AND name IS NOT NULL").mapInArrow(_read, "id long, entity_type string, kind string, key string, sure long")
    rows = written(read.filter("kind <> 'none' AND kind <> 'thing'").withColumn("node", F.xxhash64("key")), "names")
    kind = F.lower(F.trim("entity_type"))
    vote = F.when(kind.isin(*BEING), 1).when(kind.isin(*OTHER), -1).otherwise(0)
    keys = rows.groupBy("key", "node").agg(F.sum(vote).alias("votes"), F.max("sure").alias("sure"))
    # Blocks take far longer to make than the keys are wide, so the keys stay spread.
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = written(keys.select("key", "node").repartition(parts, "node").mapInArrow(_block, "key string, node long, own array<struct<block string, letters long>>, other array<struct<block string, letters long>>"), "name-blocks")
    own = keyed.select(F.inline("own"), "key", "node")
    x, y = own.alias("x"), own.alias("y")
    met = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.node") < F.col("y.node")) & _alike()).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b")).distinct()
    edges = written(met.mapInArrow(_matching, "a long, b long"), "name-links")
    alone = keys.select(F.col("node").alias("a"), F.col("node").alias("b"))
    groups = written(connected_components(edges.unionByName(alone)), "name-groups")
    # Initials and family names: the persons they fit, best fit first.
    shorts = own.filter("block LIKE 'i:%' OR block LIKE 'n:%'")
    people = keyed.select(F.inline("other"), "key", "node")
    near = shorts.alias("x").join(people.alias("y"), (F.col("x.block") == F.col("y.block")) & _alike())
    fitted = near.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b")).distinct().mapInArrow(_fitting, "a long, b long, fit int").filter("fit > 0")
    per = fitted.join(groups.select(F.col("node").alias("b"), F.col("component").alias("person")), "b").groupBy("a", "person").agg(F.max("fit").alias("fit"))
    best = per.groupBy("a").agg(F.max("fit").alias("fit"))
    only = per.join(best, ["a", "fit"]).groupBy("a").agg(F.count("*").alias("n"), F.min("person").alias("person")).filter("n = 1").select(F.col("a").alias("node"), "person")
    final = groups.join(only, "node", "left").select("node", F.coalesce("person", "component").alias("entity_id"))
    judged = keys.join(final, "node").groupBy("entity_id").agg((F.sum("votes") + F.max("sure")).alias("weight")).filter("weight > 0")
    return rows.select("id", "node").join(final, "node").join(judged.select("entity_id"), "entity_id", "left_semi").select("id", "entity_id").distinct()


def pairs_of(members: DataFrame) -> DataFrame:
    """Every pair of rows of one entity: id_a < id_b."""
    a, b = members.select("entity_id", F.col("id").alias("id_a")), members.select("entity_id", F.col("id").alias("id_b"))
    return a.join(b, "entity_id").filter("id_a < id_b").select("id_a", "id_b")
