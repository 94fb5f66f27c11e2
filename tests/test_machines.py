import random
from datetime import datetime, timedelta

import pytest

from lodestrata.operators.machines import QUEUE, RUNS, SESSIONS, compacted, folded


@pytest.mark.parametrize("machine", [RUNS, SESSIONS, QUEUE])
def test_folding_is_taking_events_one_by_one(spark, machine):
    rng = random.Random(1)
    rows = [(rng.randrange(20), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(100)), i, rng.choice([*machine.moves, "unknown", None])) for i in range(600)]
    rows += [(None, datetime(2024, 1, 1), 1, "start"), rows[0]]
    state = {}
    for key, at, i, event in sorted((r for r in rows if r[0] is not None and r[3] in machine.moves), key=lambda r: (r[0], r[1], r[2])):
        old = state.get(key, machine.states[0])
        state[key] = machine.moves[event].get(old, old)
    df = spark.createDataFrame(rows, "key long, at timestamp_ntz, id long, event string").selectExpr("*", "1 AS state")
    assert {r.key: r.state for r in folded(df, machine).collect()} == state
    assert folded(df.limit(0), machine).count() == 0


def test_done_tasks_are_dropped_after_a_week(spark):
    df = spark.createDataFrame([(1, "done", datetime(2024, 1, 1)), (2, "done", datetime(2024, 1, 9)), (3, "pending", datetime(2024, 1, 1)), (4, None, None)], "key long, state string, last timestamp_ntz")
    assert {r.key for r in compacted(df, "2024-01-10 00:00:00").collect()} >= {2, 3}
