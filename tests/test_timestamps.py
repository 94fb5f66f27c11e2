import pytest

from lodestrata.functions.instants import candidates, is_plain
from lodestrata.operators.timestamps import fit_orders, normalize_times

US = 1_000_000
BASE = 1_714_550_400  # 2024-05-01T08:00:00Z


@pytest.mark.parametrize(
    "value,zone,seconds",
    [
        ("2024-05-01t08:00:00z", "UTC", BASE), ("1714550400", "UTC", BASE), ("1714550400000", "UTC", BASE), ("1714550400.25", "UTC", BASE + 0.25), ("20240501T080000Z", "UTC", BASE), ("Wed, 1 May 2024 10:00:00 +0200", "UTC", BASE),
        ("2024-05-01 10:00", "Europe/Paris", BASE), (" 2024/05/01 10:00:00\n", "Europe/Paris", BASE), ("1 mai 2024 à 10h00", "Europe/Paris", BASE), ("1. Mai 2024, 10:00", "Europe/Berlin", BASE), ("1 de mayo de 2024, 10:00", "Europe/Madrid", BASE),
        ("May 1, 2024 at 4:00 a.m.", "America/New_York", BASE), ("2024年5月1日 16:00", "Asia/Shanghai", BASE), ("2024-05-01 13:30:00 UTC+5:30", "UTC", BASE), ("2024-05-01T10:00:00+02:00[Europe/Paris]", "UTC", BASE), ("2024-05-01 04:00:00 America/New_York", "UTC", BASE),
        ("2024-05-01 16:00:00 CST", "Asia/Shanghai", BASE), ("2024-05-01 03:00:00 CDT", "America/Chicago", BASE), ("2024-05-01T08:00:00,500+00", "UTC", BASE + 0.5), ("2024-11-03 01:30:00 EDT", "America/New_York", 1730611800), ("2024-11-03 01:30:00 EST", "America/New_York", 1730615400),
    ],
)
def test_one_instant(value, zone, seconds):
    assert [at for _, at in candidates(value, zone)] == [[round(seconds * US)]]


@pytest.mark.parametrize("value", ["2024-05-01", "25:61", "just now", "", None, "2024-02-30 10:00:00", "2025-13-04 08:00:00", "Thu, 1 May 2024 10:00:00 +0200", "0000-00-00 00:00:00", "null", "May 1, 2024 at 14:00 PM"])
def test_no_reading(value):
    assert candidates(value, "UTC") == []


def test_clock_changes():
    assert candidates("2024-03-31 02:30", "Europe/Berlin") == [("year_first", [])]
    assert len(candidates("2024-10-27 02:30", "Europe/Berlin")[0][1]) == 2


def test_mixture():
    counts = [("DMY|MDY", 100.0), ("DMY", 40.0), ("MDY", 1.0)]
    free, rounds = fit_orders(counts, None)
    assert free["DMY"] > 0.9 and rounds > 1 and free["slip"] < 0.01
    told, rounds = fit_orders(counts, "MDY")
    assert told["MDY"] > 0.9 and rounds > 0 and told["slip"] > told["DMY"]


def test_the_mixture_finds_hidden_orders(spark):
    import random

    rng = random.Random(5)
    rows, truth = [], {}
    for source, shape in (("a", "{d:02}/{m:02}/{y} 10:00"), ("b", "{m}/{d}/{y} 10:00"), ("c", "{d}.{m}.{s} 10:00")):
        for k in range(60):
            y, m, d = (2040 if source == "c" else 2020) + rng.randrange(5), rng.randrange(1, 13), rng.randrange(1, 29)
            rows.append(("f", f"{source}{k}", shape.format(y=y, s=y % 100, m=m, d=d), source))
            truth[f"{source}{k}"] = (y, m, d)
    sources = spark.createDataFrame([(s, "UTC", None) for s in "abc"], "source string, home_zone string, date_order string")
    got = normalize_times(spark.createDataFrame(rows, "src_field string, row_key string, value string, source string"), sources).selectExpr("row_key", "status", "timestamp_micros(utc_us) AS at").collect()
    right = [r for r in got if r.status == "resolved" and (r.at.year, r.at.month, r.at.day) == truth[r.row_key]]
    assert len(right) >= 0.9 * len(rows)
    assert {r.status for r in got if r not in right} <= {"ambiguous_order"}


def test_table(spark):
    values = [
        ("f", "1", "03/04/2024 10:00", "us"), ("f", "2", "03/04/2024 10:00", "eu"), ("f", "3", "25/04/2024 10:00", "us"), ("f", "4", "2024-10-27 02:30", "eu"), ("f", "5", "2024-03-31 02:30", "eu"), ("f", "6", "2024-05-01", "eu"), ("f", "7", None, "eu"),
        ("f", "8", " ", "eu"), ("f", "9", "03/04/2024 10:00", None), ("f", "10", "2024-05-01T08:00:00+00:00", None), ("f", "11", "x" * 100000, "eu"), ("f", "12", "05/05/2024 10:00", "open"), ("f", "13", "04/05/2024 10:00", "open"), ("f", "1", "03/04/2024 10:00", "us"),
    ]
    df = spark.createDataFrame(values, "src_field string, row_key string, value string, source string").selectExpr("*", "1 AS home_zone", "2 AS status")
    sources = spark.createDataFrame([("us", "America/New_York", "MDY"), ("eu", "Europe/Berlin", "DMY"), ("open", "UTC", None), ("eu", "Europe/Berlin", "DMY"), (None, "UTC", "DMY")], "source string, home_zone string, date_order string")
    got = {}
    for r in normalize_times(df, sources).collect():
        got.setdefault(r.row_key, []).append((r.status, r.utc_us))
    assert len(got["1"]) == 2 and got["1"][0] == ("resolved", 1709564400 * US) and got["2"] == [("resolved", 1712131200 * US)]
    assert [got[str(k)][0][0] for k in range(3, 14)] == ["contradicts_order", "shown_twice", "skipped_by_clock", "date_only", "empty", "empty", "unreadable", "resolved", "unreadable", "resolved", "ambiguous_order"]
    assert normalize_times(df.limit(0), sources).count() == 0 and normalize_times(df, sources.limit(0)).filter("status = 'resolved'").count() == 1


def test_plain():
    assert is_plain("2024-05-01T08:00:00.123Z") and not is_plain("2024-05-01T08:00:00z") and not is_plain(None)
