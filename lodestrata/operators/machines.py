"""Guarded state changes of many things at once: runs, sessions, queue tasks.

A machine is a table of states and, per event, of what each state becomes; an
event that a state doesn't allow leaves it as it is.  Events compose: a stretch of
them is again a table from states to states, so each thing's events are folded
day by day and the days after that, and no thing's events are gathered as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Machine:
    """``states``, the first being where everything begins, and ``moves``: event to {state: next state}."""

    states: tuple[str, ...]
    moves: dict[str, dict[str, str]]

    def table(self, event: str) -> list[int]:
        return [self.states.index(self.moves[event].get(s, s)) for s in self.states]


RUNS = Machine(
    ("none", "running", "completed", "failed", "abandoned"),
    {"start": {"none": "running", "failed": "running"}, "heartbeat": {}, "complete": {"running": "completed"}, "fail": {"running": "failed"}, "abandon": {"running": "abandoned", "failed": "abandoned"}},
)
SESSIONS = Machine(
    ("none", "active", "closed", "archived"),
    {"ensure": {"none": "active", "closed": "active"}, "close": {"active": "closed"}, "archive": {"active": "archived", "closed": "archived"}},
)
QUEUE = Machine(
    ("none", "pending", "working", "done"),
    {"enqueue": {"none": "pending"}, "claim": {"pending": "working"}, "done": {"working": "done"}, "reclaim": {"working": "pending"}},
)


def folded(events: DataFrame, machine: Machine) -> DataFrame:
    """key, state, n (how many events) and last (when the latest was) after all ``events(key, at, id, event)``.

    Events of one key are taken by ``at``, then ``id``; unknown events and null
    keys are left out, repeated ids count each.  A key without a known event has no row.
    """
    n = len(machine.states)
    places = F.create_map(*[x for e in machine.moves for x in (F.lit(e), F.array(*map(F.lit, machine.table(e))))])
    known = events.filter(F.col("key").isNotNull() & F.col("event").isin(*machine.moves))
    same = F.array(*map(F.lit, range(n)))

    def then(acc: Column, step: Column) -> Column:
        return F.transform(acc, lambda s: F.get(step, s))

    days = known.groupBy("key", F.to_date("at").alias("day")).agg(F.array_sort(F.collect_list(F.struct("at", "id", places[F.col("event")].alias("step")))).alias("steps"), F.count("*").alias("n"), F.max("at").alias("last"))
    daily = days.select("key", "day", "n", "last", F.aggregate("steps", same, lambda a, x: then(a, x["step"])).alias("step"))
    whole = daily.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("day", "step"))).alias("steps"), F.sum("n").alias("n"), F.max("last").alias("last"))
    end = F.get(F.aggregate("steps", same, lambda a, x: then(a, x["step"])), F.lit(0))
    return whole.select("key", F.get(F.array(*map(F.lit, machine.states)), end).alias("state"), "n", "last")


def compacted(tasks: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Queue tasks ``(key, state, last)`` without those done more than ``days`` ago."""
    old = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return tasks.filter(~((F.col("state") == "done") & (F.col("last") < old)))
