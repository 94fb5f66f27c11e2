"""Queries on the names of persons and firms (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.linking import link_names, pairs_of
from lodestrata.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs_of(link_names(table(spark, root, "knowledge_entities")))


def p2_entities(spark: SparkSession, root: str) -> DataFrame:
    """Per linked entity the number of rows."""
    return link_names(table(spark, root, "knowledge_entities")).groupBy("entity_id").agg(F.count("*").alias("n_rows"))


def p2_members(spark: SparkSession, root: str) -> DataFrame:
    """Each row of a linked entity with the smallest id of the entity, which stands for it."""
    linked = link_names(table(spark, root, "knowledge_entities"))
    heads = linked.groupBy("entity_id").agg(F.min("id").alias("first_id"))
    return linked.join(heads, "entity_id").select("id", "first_id")


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities, "p2_members": p2_members}
