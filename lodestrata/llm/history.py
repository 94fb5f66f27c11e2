"""Checking new batches for copies against all accepted contents.

A text is a sparse vector: one coordinate for each of its phrases (stretches of
words between content-defined borders), weighted by the phrase's words times the
bits of its rarity.  Every coordinate is a cell.  A text is entered in the cells
of its rarest coordinates and probes the same ones; both stop where the weight
that is left can't bring any other text within the distance, and a meeting in a
cell counts only if what is left from there on could still suffice.  What meets
is compared exactly on the full texts.  Texts equal in all words share one key
and enter once.

Copy means: weighted Jaccard similarity of the phrases at least ``NEAR``, and
Jaccard similarity of the word pairs at least ``SAME``.  A text's parent is the
smallest earlier id it is a copy of, its class the end of its line of parents;
so a class depends on earlier rows only, however rows are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.textkeys import WordHashes, distinct, mixed, phrases, words_of
from lodestrata.tables import written

SAME, NEAR = 0.6, 0.25
BUCKET_BITS = 18
#: Cells with more texts are joined pivot first and in parts: another plan, the same matches.
CROWDED = 256
#: Up to so many probed cells, or ids of texts to compare, go to every task, which spares moving the others.
FEW = 1_000_000


def _hashes(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts on end, and how many each text has."""
    words = [t.split(" ") if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(sizes.sum())), sizes


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [(" ".join(words_of(t)), t) for t in b.column("content").to_pylist()]
        # A text without a single word is known by its signs.
        keys = [xxhash.xxh3_128_digest(w.encode() if w else b"\0" + t.strip().encode("utf-8", "replace")) for w, t in texts]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary()), pa.array([w for w, _ in texts], pa.string())], ["id", "key", "words"])


def vectors(contents: DataFrame) -> DataFrame:
    """id, key and folded words of every row of ``contents(id, content)`` whose content isn't null or blank."""
    some = contents.select(F.col("id").cast("long").alias("id"), "content").filter("id IS NOT NULL AND content IS NOT NULL AND trim(content) <> ''")
    return some.mapInArrow(_texts, "id long, key binary, words string")


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, hashes = np.zeros(1 << BUCKET_BITS, np.int64), WordHashes()
    for b in batches:
        _, found, _ = phrases(*_hashes(b.column("words").to_pylist(), hashes))
        total += np.bincount(_bucket(found), minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])


def rarity(texts: DataFrame) -> np.ndarray:
    """Bits of rarity, 1 to 18, of the coordinates of each of 2**18 buckets, counted over all of ``texts(words)``.

    At most 2**18 rows reach the driver, whatever the input.
    """
    rows = texts.mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << BUCKET_BITS, np.int64)
    n[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return np.clip(np.round(np.log2(max(1, n.sum()) / np.maximum(n, 1))), 1, BUCKET_BITS).astype(np.uint8)


def weighted(words: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinates of some texts, rarest first: row, coordinate, weight."""
    row, found, long = phrases(words, sizes)
    rare = bits[_bucket(found)].astype(np.int64)
    order = np.lexsort((found, -rare, row))
    return row[order], found[order], (long * rare)[order]


def left_from(row: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole weight of each of ``n`` rows, and of each coordinate what is left from it on."""
    whole = np.bincount(row, weights, n).astype(np.int64)
    before = np.cumsum(weights) - weights
    starts = np.cumsum(whole) - whole
    return whole, whole[row] - (before - starts[row])


#: An image of a text's word pairs has 64 bits for each of these.
SIGNS = range(4)
_CELL = ["cell", "id", "size", "left", "pairs", *(f"sign_{k}" for k in SIGNS)]
_CELL_SCHEMA = "cell long, id long, size int, left int, pairs int, " + ", ".join(f"sign_{k} long" for k in SIGNS)


def _images(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per text the number of its word pairs and an image of them; a single word counts as a pair."""
    n, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    inside = np.append(row[:-1] == row[1:], False) if len(row) else np.empty(0, bool)
    inside |= sizes[row] == 1
    pairs = mixed(words, np.append(words[1:], np.uint64(0)))[inside] if len(row) else words
    alone = sizes[row][inside] == 1
    pairs[alone] = words[inside][alone]
    at = distinct(row[inside], pairs)
    row, pairs = row[inside][at], pairs[at]
    signs, spot = [], pairs >> np.uint64(56)
    for k in SIGNS:
        bit = np.where(spot >> np.uint64(6) == k, np.uint64(1) << (spot & np.uint64(63)), np.uint64(0))
        sign = np.zeros(n, np.uint64)
        if len(row):
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sign[row[starts]] = np.bitwise_or.reduceat(bit, starts)
        signs.append(sign)
    return np.bincount(row, minlength=n), signs


def cells(firsts: DataFrame, bits: np.ndarray) -> DataFrame:
    """The cells of ``firsts(id, words)``: size is the whole weight, left what is left from this cell on, pairs the
    number of word pairs and sign_0 to sign_3 an image of them, of which each missing bit is a missing pair."""
    shared = firsts.sparkSession.sparkContext.broadcast(bits)  # 2**18 bytes

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            words, sizes = _hashes(b.column("words").to_pylist(), hashes)
            row, found, weights = weighted(words, sizes, shared.value)
            whole, left = left_from(row, weights, len(sizes))
            count, signs = _images(words, sizes)
            keep = left >= NEAR * whole[row]
            row = row[keep]
            out = [found[keep].view(np.int64), b.column("id").to_numpy()[row], whole[row].astype(np.int32), left[keep].astype(np.int32), count[row].astype(np.int32), *(s[row].view(np.int64) for s in signs)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], _CELL)

    return firsts.select("id", "words").mapInArrow(spread, _CELL_SCHEMA)


def _may_match(limited: bool = False) -> Column:
    """Whether y, earlier, can still be what x is a copy of, given that no earlier cell of theirs is common."""
    both = F.col("x.size") + F.col("y.size")
    missing = lambda p, q: sum((F.bit_count(F.col(f"{p}.sign_{k}").bitwiseAND(F.bitwise_not(f"{q}.sign_{k}"))) for k in SIGNS), F.lit(0))
    wanted = F.lit(SAME / (1 + SAME)) * (F.col("x.pairs") + F.col("y.pairs")) - F.lit(1e-6)
    return (
        (F.col("y.id") < (F.col("x.limit") if limited else F.col("x.id")))
        & (F.least("x.left", "y.left") >= F.lit(NEAR / (1 + NEAR)) * both - F.lit(1e-6))
        & (F.col("x.pairs") - missing("x", "y") >= wanted)
        & (F.col("y.pairs") - missing("y", "x") >= wanted)
    )


@lru_cache(maxsize=2048)
def word_pairs(text: str) -> frozenset[tuple[str, ...]]:
    words = text.split(" ")
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset({(words[0],)} if words[0] else ())


def _similar(x: str, y: str) -> bool:
    a, b = word_pairs(x), word_pairs(y)
    common = len(a & b)
    return bool(common) and common >= SAME * (len(a) + len(b) - common)


def _near(x: str, y: str, bits: np.ndarray, hashes: WordHashes) -> bool:
    row, found, weights = weighted(*_hashes([x, y], hashes), bits)
    _, at, _ = np.intersect1d(found[row == 0], found[row == 1], assume_unique=True, return_indices=True)
    common = weights[row == 0][at].sum()
    return common >= NEAR * (weights.sum() - common)


def matches(candidates: DataFrame, full: DataFrame, bits: np.ndarray) -> DataFrame:
    """The candidate pairs ``(a, b)``, b earlier, whose full texts are copies."""
    shared = candidates.sparkSession.sparkContext.broadcast(bits)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            keep = pa.array([_similar(x, y) and _near(x, y, shared.value, hashes) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    candidates = written(candidates, "candidates")
    ids = candidates.select(F.col("a").alias("id")).unionByName(candidates.select(F.col("b").alias("id"))).distinct()
    if candidates.count() <= FEW:
        full = full.join(F.broadcast(ids), "id", "left_semi")
    x, y = full.select(F.col("id").alias("a"), F.col("words").alias("x")), full.select(F.col("id").alias("b"), F.col("words").alias("y"))
    return candidates.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _met(x: DataFrame, y: DataFrame, on: list[str], limited: bool = False) -> DataFrame:
    joined = x.alias("x").join(y.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on] + [_may_match(limited)])
    return joined.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def parents(fresh: DataFrame, all_cells: DataFrame, full: DataFrame, bits: np.ndarray) -> DataFrame:
    """(a, b): every text of the ``fresh`` cells that is a copy, and the earliest text it is a copy of.

    In a crowded cell every text first meets the earliest one, which settles a
    large group of near copies at linear cost; then it meets only what is
    earlier than the match it has, the cell cut into parts by id.
    """
    sizes = all_cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("pivot"))
    busy = written(sizes.filter(F.col("n") > CROWDED), "crowded-cells")
    crowded = not busy.isEmpty()
    if not crowded:
        return matches(_met(fresh, all_cells, ["cell"]), full, bits).groupBy("a").agg(F.min("b").alias("b"))
    hot = lambda df, how: df.join(busy.select("cell"), "cell", how)
    calm = _met(hot(fresh, "left_anti"), hot(all_cells, "left_anti"), ["cell"])
    crowd = written(all_cells.join(busy, "cell"), "crowded")
    mine = fresh.join(busy, "cell")
    stars = _met(mine, crowd.filter("id = pivot"), ["cell"])
    first = written(matches(calm.unionByName(stars).distinct(), full, bits).groupBy("a").agg(F.min("b").alias("b")), "first-matches")
    parts = F.ceil(F.col("n") / CROWDED).cast("int")
    left = mine.join(first.select(F.col("a").alias("id"), F.col("b").alias("limit")), "id", "left").withColumn("limit", F.coalesce("limit", "id"))
    left = left.filter(F.col("limit") > F.col("pivot")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = crowd.filter("id <> pivot").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    more = matches(_met(left, right, ["cell", "part"], limited=True), full, bits)
    return first.unionByName(more).groupBy("a").agg(F.min("b").alias("b"))


def roots(lines: DataFrame) -> DataFrame:
    """``(a, b)`` with b the end of the line of parents ``(a, b)``, b < a, one row per a."""
    now = written(lines, "parents")
    while True:
        upper = now.select(F.col("a").alias("u"), F.col("b").alias("top"))
        joined = written(now.join(upper, F.col("b") == F.col("u"), "left").select("a", F.coalesce("top", "b").alias("b"), F.col("u").isNotNull().alias("moved")), "parents")
        now = joined.select("a", "b")
        if joined.filter("moved").isEmpty():
            return now


class History:
    """The persisted index of everything accepted so far, below ``folder``; opening an existing folder goes on with it.

    Each ``admit`` reads the stored keys and cells, and full texts only to compare
    what met; it appends the batch's own.  The rarities are fixed when the index is
    made.  A batch counts once its ``done`` mark is written; the rest of a broken
    one is overwritten by the next.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.batches = [f"{folder}/batch-{k:05d}" for k in range(self._committed())]
        self.bits: np.ndarray | None = None
        if self._exists(f"{folder}/rarity/_SUCCESS"):
            rows = spark.read.parquet(f"{folder}/rarity").first()
            self.bits = np.frombuffer(bytes(rows["bits"]), np.uint8)

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _committed(self) -> int:
        k = 0
        while self._exists(f"{self.folder}/batch-{k:05d}/done/_SUCCESS"):
            k += 1
        return k

    def _stored(self, name: str) -> DataFrame | None:
        paths = [f"{b}/{name}" for b in self.batches]
        return self.spark.read.parquet(*paths) if paths else None

    def fit(self, texts: DataFrame) -> None:
        """Fix the rarities by all of ``texts(words)``; only a new index can be fitted."""
        if self.bits is not None:
            raise ValueError("the rarities of this index are fixed")
        self.bits = rarity(texts)
        self.spark.createDataFrame([(bytearray(self.bits.tobytes()),)], "bits binary").write.mode("overwrite").parquet(f"{self.folder}/rarity")

    def admit(self, contents: DataFrame, repeated_ids: bool = True) -> DataFrame:
        """Check ``contents(id, content)`` and append it; returns id, class_id of its rows.

        class_id is the smallest id, of this batch or earlier, that holds the
        content; rows with class_id = id are new.  Ids must rise from batch to
        batch.  Null and blank contents and null ids give no row; of repeated ids
        the smallest content counts (``repeated_ids=False`` says there are none).
        """
        if repeated_ids:
            contents = contents.groupBy("id").agg(F.min("content").alias("content"))
        return self.admit_texts(vectors(contents))

    def admit_texts(self, texts: DataFrame) -> DataFrame:
        """As ``admit``, of texts as ``vectors`` gives them, one row per id."""
        at = f"{self.folder}/batch-{len(self.batches):05d}"
        keep = lambda df, name: (df.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/{name}"), self.spark.read.parquet(f"{at}/{name}"))[1]
        fresh = keep(texts.select("id", "key"), "rows")
        if self.bits is None:
            self.fit(texts)
        groups = fresh.groupBy("key").agg(F.min("id").alias("id"))
        old_keys, old_cells = self._stored("keys"), self._stored("cells")
        known = None
        if old_keys is not None:
            known = groups.select("key").join(old_keys.select("key", "class_id"), "key")
            groups = groups.join(old_keys.select("key"), "key", "left_anti")
        groups = written(groups, "groups")
        own = keep(texts.select("id", "words").join(groups.select("id"), "id", "left_semi"), "texts")
        mine = keep(cells(own, self.bits), "cells")
        everything, full = mine, own
        if old_cells is not None:
            probed = written(mine.select("cell").distinct(), "probed")
            near = F.broadcast(probed) if probed.count() <= FEW else probed
            everything, full = mine.unionByName(old_cells.join(near, "cell", "left_semi")), own.unionByName(self._stored("texts"))
        lines = written(parents(mine, everything, full, self.bits), "parents")
        ends = roots(lines)
        if old_keys is not None:
            # The end of a line may be an old copy, which stands for its class.
            ends = ends.join(old_keys.select(F.col("id").alias("b"), "class_id"), "b", "left").select("a", F.coalesce("class_id", "b").alias("b"))
        classed = keep(groups.join(ends.select(F.col("a").alias("id"), F.col("b").alias("class_id")), "id", "left").select("key", "id", F.coalesce("class_id", "id").alias("class_id")), "keys")
        heads = classed.select("key", "class_id")
        heads = heads if known is None else heads.unionByName(known)
        out = keep(fresh.join(heads, "key").select("id", "class_id"), "classes")
        self.spark.range(1).write.mode("overwrite").parquet(f"{at}/done")
        self.batches.append(at)
        return out
