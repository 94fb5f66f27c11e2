"""One memory as an object: save, recall, entities, erasure, pages and reports over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import frame_hash
from lodestrata.operators import archive, derive, frames, graph, lanes, pipeline, search, similarity, state
from lodestrata.operators.pipeline import Embed
from lodestrata.store import Store
from lodestrata.tables import numbered, written

FRAMES = "id long, frame_type string, gop_id string, t int, base_frame_id long, content string, importance string, source string, access_count int, created_at timestamp_ntz, last_accessed timestamp_ntz, content_hash string, metadata string, mind string"
ENTITIES = "id long, entity_type string, name string, properties string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz"
RELATIONS = "source_id long, target_id long, relation_type string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz"
ARCHIVE = "id long, archive_uid string, source string, source_ref string, title string, content string, content_sha256 string, erased_at timestamp_ntz, erased_reason string"
SCHEMAS = {"frames": FRAMES, "entities": ENTITIES, "relations": RELATIONS, "archive": ARCHIVE}


def merged_properties(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per key the JSON object of all properties of its rows; of several values of a property the greatest."""
    each = rows.select(*by, F.explode(F.from_json("properties", "map<string,string>")).alias("k", "v"))
    values = each.groupBy(*by, "k").agg(F.max("v").alias("v"))
    return values.groupBy(*by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("properties"))


def _with_properties(entities: DataFrame, more: DataFrame, own_first: bool = False) -> DataFrame:
    """Entities with the properties of ``more(id, more)`` merged in."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    a, b = (read("more"), read("properties")) if own_first else (read("properties"), read("more"))
    joined = entities.join(more, "id", "left")
    both = F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    return joined.select(*(F.when(F.col("more").isNotNull(), F.to_json(both)).otherwise(F.col(c)).alias(c) if c == "properties" else F.col(c) for c in entities.columns))


class Memory:
    """The calls of the memory tools, each over whole tables; ``now`` is given by the caller."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def table(self, name: str) -> DataFrame:
        found = self.store.read(name)
        return self.spark.createDataFrame([], SCHEMAS[name]) if found is None else found

    def save(self, contents: DataFrame, now: str, gop_id: str = "session", mind: str = "personal", importance: str = "normal", source: str = "agent_inferred") -> DataFrame:
        """Save ``contents(id, content)``, with ``metadata`` if there is such a column, as base frames; returns action and frame_id of each distinct body."""
        stored = self.table("frames")
        top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"), F.coalesce(F.max(F.when(F.col("gop_id") == gop_id, F.col("t"))), F.lit(-1)).alias("t")).first()
        plan = frames.admit(contents, stored)
        new = contents.join(plan.filter("action = 'insert'").select(F.col("frame_id").alias("id")), "id")
        new, nth = numbered(new, "id"), F.col("nth") + 1
        at = F.lit(now).cast("timestamp_ntz")
        rows = new.select((nth + top["id"]).cast("long").alias("new_id"), F.col("id").alias("given"), (nth + top["t"]).cast("int").alias("t"), "content", (F.coalesce("metadata", F.lit("{}")) if "metadata" in contents.columns else F.lit("{}")).alias("metadata"))
        added = rows.select(F.col("new_id").alias("id"), F.lit("I").alias("frame_type"), F.lit(gop_id).alias("gop_id"), "t", F.lit(None).cast("long").alias("base_frame_id"), "content", F.lit(importance).alias("importance"), F.lit(source).alias("source"), F.lit(0).alias("access_count"), at.alias("created_at"), at.alias("last_accessed"), frame_hash(F.col("content")).alias("content_hash"), "metadata", F.lit(mind).alias("mind"))
        touched = frames.touched(stored, plan.filter("touches > 0 AND action = 'touch'").select("frame_id", F.col("touches").alias("n"), at.alias("at")))
        kept = stored.drop("access_count", "last_accessed").join(touched, "id").select(*stored.columns)
        self.store.write(frames=kept.unionByName(added))
        return plan

    def harvest(self, items: DataFrame, now: str, gop_id: str = "harvest", mind: str = "personal") -> DataFrame:
        """Take in ``items(item_id, source, title, content)``; returns item_id and what became of each.

        suppressed: its subject was erased; present: the archive has it already;
        blocked: it tries to take over a model; skip: a stored frame says the same,
        nearly the same, or it has no content; keep: it is a frame now.  Blocked and
        skipped items are archived all the same.  Of repeated ids the smallest content counts.
        """
        given = items.groupBy("item_id").agg(F.min(F.struct("content", "source", "title")).alias("x")).select("item_id", "x.source", "x.title", "x.content")
        stored = self.table("archive")
        plan = written(archive.appended(given, stored, archive.suppressed(stored)), "appended")
        start = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = written(numbered(given.join(plan.filter("action = 'insert'").select("item_id", "uid"), "item_id"), "item_id").withColumn("id", (F.col("nth") + 1 + start).cast("long")), "fresh")
        none = lambda kind: F.lit(None).cast(kind)
        added = fresh.select("id", F.col("uid").alias("archive_uid"), "source", F.col("item_id").alias("source_ref"), "title", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_sha256"), none("timestamp_ntz").alias("erased_at"), none("string").alias("erased_reason"))
        self.store.write(archive=stored.unionByName(added))
        screened = written(pipeline.screened(fresh), "screened")
        frames_now = self.table("frames").select("id", F.col("content").alias("text"))
        judged = written(similarity.screened_against(screened.filter("NOT blocked").select("id", F.col("content").alias("text")), frames_now), "judged")
        kept = screened.join(judged.filter("action = 'keep'").select("id"), "id")
        metadata = F.to_json(F.struct(F.array("uid").alias("archiveUids"), F.col("item_id").alias("sourceId")))
        self.save(kept.select("id", "content", metadata.alias("metadata")), now, gop_id, mind, source="import")
        after = screened.select("id", "item_id", "blocked").join(judged.select("id", F.col("action").alias("judged")), "id", "left").select("item_id", F.when(F.col("blocked"), "blocked").otherwise(F.col("judged")).alias("became"))
        return plan.select("item_id", "action").join(after, "item_id", "left").select("item_id", F.coalesce("became", "action").alias("action"))

    def recall(self, queries: DataFrame, now: str, limit: int = 10, profile: str = "balanced", mind: str | None = None, since: str | None = None, until: str | None = None, embed: Embed | None = None, dims: int = 384) -> DataFrame:
        """The best frames for each of ``queries(qid, text)``: lanes fused and scored with the graph context of the query.

        With ``embed`` there is a vector lane beside the keyword lane.
        """
        kept = frames.within(self.table("frames"), since, until)
        kept = kept if mind is None else kept.filter(F.col("mind") == mind)
        corpus = kept.select("id", F.col("content").alias("text"))
        found = [search.bm25(queries, corpus, 2 * limit), *([search.vector_lane(queries, corpus, embed, dims, 2 * limit)] if embed else [])]
        fused = search.fuse(*found)
        near = search.graph_context(queries, fused, corpus, self.table("entities"), self.table("relations"))
        return search.rescore(fused, kept, now, profile, near, limit).join(kept.select("id", "content"), "id")

    def context(self, queries: DataFrame, now: str, tier: int = 1) -> DataFrame:
        hits = self.recall(queries, now)
        return lanes.composed(hits.select("qid", F.lit("frames").alias("section"), F.col("rank").alias("nth"), "content"), tier)

    def status(self) -> DataFrame:
        return frames.statistics(self.table("frames"))

    def save_entities(self, rows: DataFrame, now: str) -> None:
        """Add ``rows(name, entity_type, properties)``, or merge their properties into the active entity of that name and type.

        Names and types are compared without case; of several rows of one entity
        the properties are put together, of several values of one the greatest
        counts.  New values replace stored ones.  Rows without a name are left out.
        """
        old = self.table("entities")
        start = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        key = [F.lower("name").alias("k_name"), F.lower(F.coalesce("entity_type", F.lit(""))).alias("k_type")]
        given = rows.filter("name IS NOT NULL").select("name", "entity_type", "properties", *key)
        once = given.groupBy("k_name", "k_type").agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type"))
        fresh = once.join(merged_properties(given, ["k_name", "k_type"]), ["k_name", "k_type"], "left")
        held = graph.active(old).select("id", *key).groupBy("k_name", "k_type").agg(F.min("id").alias("id"))
        known = fresh.join(held, ["k_name", "k_type"]).select("id", F.col("properties").alias("more"))
        new = fresh.join(held, ["k_name", "k_type"], "left_anti")
        at = F.lit(now).cast("timestamp_ntz")
        added = numbered(new, "name", "entity_type").select((F.col("nth") + 1 + start).cast("long").alias("id"), "entity_type", "name", F.coalesce("properties", F.lit("{}")).alias("properties"), at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), at.alias("recorded_at"))
        self.store.write(entities=_with_properties(old, known).unionByName(added))

    def relate(self, rows: DataFrame, now: str) -> None:
        at = F.lit(now).cast("timestamp_ntz")
        added = rows.select("source_id", "target_id", "relation_type", F.lit(1.0).alias("confidence"), at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
        self.store.write(relations=self.table("relations").unionByName(added))

    def traverse(self, ids: DataFrame, depth: int = 3, kind: str | None = None) -> DataFrame:
        """seed, node and distance of what active relations lead to from ``ids(id)``, not through retired entities."""
        return graph.reach(self.table("relations"), ids, depth, kind, self.table("entities"))

    def search_entities(self, text: str, limit: int = 10) -> DataFrame:
        return graph.active(self.table("entities")).filter(F.lower("name").contains(text.lower())).orderBy("name", "id").limit(limit)

    def retire(self, ids: DataFrame, now: str) -> None:
        """End the validity of entities and of their relations."""
        at, gone = F.lit(now).cast("timestamp_ntz"), ids.select("id", F.lit(True).alias("gone")).distinct()
        e = self.table("entities").join(gone, "id", "left")
        ended = e.select(*(F.when(F.col("gone") & F.col("valid_to").isNull(), at).otherwise(F.col(c)).alias(c) if c == "valid_to" else F.col(c) for c in self.table("entities").columns))
        r = self.table("relations")
        hit = r.join(gone.withColumnRenamed("id", "source_id").withColumnRenamed("gone", "gs"), "source_id", "left").join(gone.withColumnRenamed("id", "target_id").withColumnRenamed("gone", "gt"), "target_id", "left")
        cut = hit.select(*(F.when((F.col("gs") | F.col("gt")) & F.col("valid_to").isNull(), at).otherwise(F.col(c)).alias(c) if c == "valid_to" else F.col(c) for c in r.columns))
        self.store.write(entities=ended, relations=cut)

    def dedupe_entities(self, now: str) -> DataFrame:
        """Fold active entities of one name and type into the best connected; returns id and survivor of the others.

        Only relations with a folded end change: they end now, and those they
        become are added from now on, once each with the greatest confidence,
        unless there already is one or it would be a loop.  Properties of folded
        entities are merged into the survivor's, whose own values count.
        """
        entities, relations = self.table("entities"), self.table("relations")
        folded = written(graph.survivors(entities, relations).filter("id <> survivor"), "folded")
        at = F.lit(now).cast("timestamp_ntz")
        s = folded.select(F.col("id").alias("source_id"), F.col("survivor").alias("new_source"))
        t = folded.select(F.col("id").alias("target_id"), F.col("survivor").alias("new_target"))
        marked = relations.join(s, "source_id", "left").join(t, "target_id", "left").withColumn("moves", (F.col("new_source").isNotNull() | F.col("new_target").isNotNull()) & F.col("valid_to").isNull())
        ended = marked.select(*(F.when(F.col("moves"), at).otherwise(F.col(c)).alias(c) if c == "valid_to" else F.col(c) for c in relations.columns))
        moved = marked.filter("moves").select(F.coalesce("new_source", "source_id").alias("source_id"), F.coalesce("new_target", "target_id").alias("target_id"), "relation_type", "confidence").filter("source_id <> target_id")
        moved = moved.groupBy("source_id", "target_id", "relation_type").agg(F.max("confidence").alias("confidence"))
        there = marked.filter("NOT moves AND valid_to IS NULL").select("source_id", "target_id", "relation_type")
        moved = moved.join(there, ["source_id", "target_id", "relation_type"], "left_anti").select("source_id", "target_id", "relation_type", "confidence", at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
        gone = folded.select("id", F.lit(True).alias("gone"))
        closed = entities.join(gone, "id", "left").select(*(F.when(F.col("gone"), F.coalesce("valid_to", at)).otherwise(F.col(c)).alias(c) if c == "valid_to" else F.col(c) for c in entities.columns))
        more = merged_properties(entities.join(folded, "id").select(F.col("survivor").alias("key"), "properties"), ["key"])
        self.store.write(entities=_with_properties(closed, more.select(F.col("key").alias("id"), F.col("properties").alias("more")), own_first=True), relations=ended.unionByName(moved))
        return folded

    def erase(self, subjects: DataFrame, now: str, reason: str) -> DataFrame:
        """Redact the archive rows of ``subjects`` and delete all that rests on them, at once; returns the frame ids.

        Entities that only deleted frames mention go with their relations.
        """
        old, kept = self.table("archive"), self.table("frames")
        subjects = archive.with_decisions(subjects)
        gone = written(archive.erased_frames(kept, old, subjects), "erased")
        after = archive.redacted(old, subjects, now, reason)
        if not archive.violations(old, after).isEmpty():
            raise RuntimeError("the redaction would change other rows")
        entities, relations = self.table("entities"), self.table("relations")
        seen = graph.mentions(kept.select("id", F.col("content").alias("text")), graph.active(entities).select("name")).join(graph.active(entities).select(F.col("id").alias("entity_id"), F.lower("name").alias("name")), "name")
        lonely = written(archive.lonely_entities(seen.select("entity_id", F.col("id").alias("frame_id")), gone), "lonely")
        ends = lambda c: lonely.select(F.col("entity_id").alias(c))
        self.store.write(
            archive=after,
            frames=frames.deleted(kept, gone).select(*kept.columns),
            entities=entities.join(ends("id"), "id", "left_anti").select(*entities.columns),
            relations=relations.join(ends("source_id"), "source_id", "left_anti").join(ends("target_id"), "target_id", "left_anti").select(*relations.columns),
        )
        return gone

    def compact(self, now: str) -> None:
        f = self.table("frames")
        pruned = frames.deleted(f, frames.expired(f, now).select("id")).select(*f.columns)
        merged = frames.merged(pruned)
        folded = merged.select(F.explode("merged_ids").alias("id"))
        new = merged.select("base_id", F.col("content").alias("folded"))
        left = pruned.join(folded, "id", "left_anti").join(new, F.col("id") == F.col("base_id"), "left").withColumn("content", F.coalesce("folded", "content")).drop("base_id", "folded")
        self.store.write(frames=left.withColumn("content_hash", frame_hash(F.col("content"))).select(*f.columns))

    def pages(self) -> DataFrame:
        e, f = self.table("entities"), self.table("frames")
        return derive.entity_pages(graph.bridge(f.select("id", F.col("content").alias("text")), e), e, f)

    def due_sources(self, sources: DataFrame, now: str) -> DataFrame:
        return state.stale_sources(sources, now)
