"""Queries on state changes: the event stream read as events of runs, sessions and queue tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import machines as op
from lodestrata.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

NOW = "2024-01-25 00:00:00"
#: Which kind of event stands for which, by machine; other kinds stand for none.
READ_AS = {
    "runs": (op.RUNS, {"signup": "start", "view": "heartbeat", "purchase": "complete", "error": "fail", "click": "start"}),
    "sessions": (op.SESSIONS, {"signup": "ensure", "click": "ensure", "purchase": "close", "error": "archive"}),
    "queue": (op.QUEUE, {"signup": "enqueue", "view": "enqueue", "click": "claim", "purchase": "done", "error": "reclaim"}),
}


def told(spark: SparkSession, root: str, name: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in READ_AS[name][1].items() for x in kv])
    return table(spark, root, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), kinds[F.col("event_type")].alias("event"))


def _sql(name: str) -> str:
    machine, kinds = READ_AS[name]
    cases = " ".join(f"WHEN e = '{k}' AND s = '{s}' THEN '{t}'" for k, event in kinds.items() for s, t in machine.moves[event].items())
    known = ", ".join(f"'{k}'" for k in kinds)
    step = cases.replace("e = ", "x = ").replace("s = ", "a = ")
    return f"""SELECT user_id AS key, list_reduce(list_prepend('{machine.states[0]}', list(event_type::VARCHAR ORDER BY ts, event_id)), lambda a, x: CASE {step} ELSE a END) AS state, count(*) AS n, max(ts) AS last
    FROM events WHERE user_id IS NOT NULL AND event_type IN ({known}) GROUP BY 1"""


def _register(name: str) -> None:
    QUERIES[f"{name}_after_events"] = lambda spark, root: op.folded(told(spark, root, name), READ_AS[name][0])
    SQL[f"{name}_after_events"] = _sql(name)


for _name in READ_AS:
    _register(_name)


def queue_compacted(spark: SparkSession, root: str) -> DataFrame:
    return op.compacted(op.folded(told(spark, root, "queue"), op.QUEUE), NOW)


QUERIES["queue_compacted"] = queue_compacted
SQL["queue_compacted"] = f"SELECT * FROM ({_sql('queue')}) WHERE NOT (state = 'done' AND last < TIMESTAMP '{NOW}' - INTERVAL 7 DAY)"
