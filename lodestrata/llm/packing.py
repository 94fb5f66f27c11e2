"""Packing texts of many lengths into containers of one capacity.

Only the histogram of lengths, at most ``capacity`` rows whatever the input,
reaches the driver.  There sets of lengths that provably belong together are
fixed first (dominance after Martello and Toth), the rest goes best fit, largest
first; both work on multiplicities, so the result is a bounded list of patterns
(which lengths, how many containers).  Each text then finds its container from
its rank among the texts of its length, counted in parallel per salted part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.tokens import VOCABULARY, count_tokens
from lodestrata.tables import written

CAPACITY = 2048


@dataclass
class Pattern:
    """``times`` containers, each holding ``counts[size]`` texts of each size."""

    times: int
    counts: dict[int, int] = field(default_factory=dict)
    fixed: bool = False


class _Sizes:
    """The sizes still to place: a sorted list with counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.pop(bisect_left(self.order, size))

    def at_most(self, size: int, without: tuple[int, ...] = ()) -> int:
        """The largest size up to ``size`` of which one is left besides ``without``; 0 if none."""
        at = bisect_left(self.order, size + 1) - 1
        while at >= 0:
            s = self.order[at]
            if self.count[s] > without.count(s):
                return s
            at -= 1
        return 0

    def smallest(self, n: int, without: int) -> list[int]:
        out: list[int] = []
        for s in self.order:
            out += [s] * min(n - len(out), self.count[s] - (s == without))
            if len(out) >= n:
                break
        return out


def _dominant(sizes: _Sizes, s: int, capacity: int) -> tuple[int, ...] | None:
    """Companions of a text of size ``s`` in some best packing, where that can be proved."""
    room = capacity - s
    best = sizes.at_most(room, (s,))
    if not best:
        return ()
    if best == room:
        return (best,)
    few = sizes.smallest(3, s)
    if len(few) < 2 or few[0] + few[1] > room:
        return (best,)
    # At most two others fit: a pair with one as large as any that fits and another as large as any second can be.
    if len(few) < 3 or sum(few) > room:
        second = sizes.at_most(room - best, (s, best))
        if second and second >= sizes.at_most(room // 2, (s,)):
            return (best, second)
    return None


def _reduce(sizes: _Sizes, capacity: int) -> list[Pattern]:
    """Fix dominant sets for as long as any is found, largest sizes first."""
    out: list[Pattern] = []
    found = True
    while found:
        found = False
        for s in sorted(sizes.order, reverse=True):
            while s in sizes.count:
                mates = _dominant(sizes, s, capacity)
                if mates is None:
                    break
                need: dict[int, int] = {}
                for x in (s, *mates):
                    need[x] = need.get(x, 0) + 1
                times = min(sizes.count[x] // n for x, n in need.items())
                if len(mates) != 1 or s + mates[0] != capacity:
                    if any(x in sizes.count and sizes.count[x] - times * n < n for x, n in need.items()):
                        times = max(1, times - 1)  # what fits may change with the last ones
                for x, n in need.items():
                    sizes.take(x, times * n)
                out.append(Pattern(times, need, True))
                found = True
    return out


def _best_fit(sizes: _Sizes, capacity: int) -> list[Pattern]:
    """Largest first, each into the fullest container that takes it, many alike at once."""
    rooms: list[tuple[int, int]] = []  # (room left, pattern number), sorted
    out: list[Pattern] = []
    for s in sorted(sizes.count, reverse=True):
        left = sizes.count[s]
        while left:
            at = bisect_left(rooms, (s, -1))
            if at < len(rooms):
                room, number = rooms.pop(at)
                p = out[number]
            else:
                room, number, p = capacity, len(out), Pattern(left, {})
                out.append(p)
            each = min(room // s, left)
            full = min(p.times, left // each)
            if full < p.times:
                if number == len(out) - 1 and not p.counts:
                    p.times = full
                else:
                    out.append(Pattern(p.times - full, dict(p.counts)))
                    insort(rooms, (room, len(out) - 1))
                    p.times = full
            p.counts[s] = p.counts.get(s, 0) + each
            if room - each * s:
                insort(rooms, (room - each * s, number))
            left -= full * each
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every size of ``histogram`` (1 to ``capacity``) as often as it occurs."""
    sizes = _Sizes(histogram)
    fixed = _reduce(sizes, capacity)
    return fixed + _best_fit(sizes, capacity)


def _slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each run of texts of one size: its first rank, its first container and how many share one."""
    rows, seen, base = [], {}, 0
    for p in patterns:
        for s, each in p.counts.items():
            rows.append((s, seen.get(s, 0), base, each))
            seen[s] = seen.get(s, 0) + p.times * each
        base += p.times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"size": table[:, 0], "start": table[:, 1], "base": table[:, 2], "each": table[:, 3], "containers": np.int64(base)}


def pack(texts: DataFrame, key: str, column: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, per_salt: int = 1_000_000) -> DataFrame:
    """Pieces of every text with their container.

    Result: ``key``, piece (from 0), token_start, token_end, n_tokens,
    container_id.  A text above ``capacity`` tokens is cut into pieces of
    ``capacity`` and a last one; nothing else is cut.  Texts without tokens (null
    or empty) need no room and are spread over the containers; where there is
    none, they share container 0.  Repeated keys are texts of their own.  A size
    that very many texts have is ranked in salted parts of about ``per_salt`` or fewer.
    """
    counts = written(count_tokens(texts, key, column, vocabulary), "token-counts")
    salts = max(64, -(-counts.count() // per_salt))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.lit(capacity))).cast("int")
    cut = counts.select(key, "n_tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece"))
    cut = cut.select(key, "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("token_start"), F.least(F.col("n_tokens"), (F.col("piece") + 1) * F.lit(capacity)).cast("long").alias("token_end"))
    cut = cut.withColumn("size", (F.col("token_end") - F.col("token_start")).cast("int")).withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    spread = cut.groupBy("size", "salt").agg(F.count("*").alias("n"))
    histogram = {r["size"]: r["n"] for r in spread.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    histogram.pop(0, None)
    slots = _slots(solve(histogram, capacity))
    shared = texts.sparkSession.sparkContext.broadcast(slots)  # bounded by the number of sizes
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("size", "salt", "before")
    ranked = cut.withColumn("nth", F.row_number().over(Window.partitionBy("size", "salt").orderBy(key, "piece"))).join(starts, ["size", "salt"])
    ranked = ranked.select(key, "piece", "token_start", "token_end", "size", (F.col("before") + F.col("nth") - 1).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        wide = np.int64(1 << 44)
        starts_at = s["size"] * wide + s["start"]
        for b in batches:
            size, rank = b.column("size").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            at = np.maximum(np.searchsorted(starts_at, size * wide + rank, side="right") - 1, 0)
            if len(starts_at):
                found = s["base"][at] + (rank - s["start"][at]) // s["each"][at]
                found = np.where(size == 0, rank % s["containers"], found)
            else:
                found = np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, "piece", "token_start", "token_end")), pa.array(size), pa.array(found)], [key, "piece", "token_start", "token_end", "n_tokens", "container_id"])

    kind = texts.schema[key].dataType.simpleString()
    return ranked.mapInArrow(assign, f"`{key}` {kind}, piece int, token_start long, token_end long, n_tokens long, container_id long")
