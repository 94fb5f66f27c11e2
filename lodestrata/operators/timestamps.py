"""Mixed timestamp notations to one UTC instant each.

Every value is read under each notation it is valid in.  All-number dates can
have more than one (day, month or year first), so those form a mixture per source
of the three orders and of slips, which are valid by chance; an expectation-
maximisation fit estimates its weights from all such values of the source.  A
declared ``date_order`` is a prior worth ``TRUST`` times the source's values, with
a slip as likely as one value in ``TRUST``.  The posterior over readings chooses the
instant, or the row says why none is chosen.  Other notations can't be mistaken for
each other: units of Unix times differ in their digits, and what a missing zone or
an abbreviation means is given by the source's zone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.instants import ORDERS, candidates, is_plain

PLAIN = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"
_NUMBERS = r"^\s*(\p{L}+\.?,?\s+)?\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b"
FEW_SOURCES = 10_000
WEIGHTS = ("w_dmy", "w_mdy", "w_ymd", "w_slip")
_DATE_ONLY = r"^\s*(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{8})\s*$"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(b.column("value").to_pylist(), b.column("home_zone").to_pylist())
        read = ["|".join(f for f, _ in candidates(v, z) if f in ORDERS) for v, z in rows]
        yield pa.RecordBatch.from_arrays([b.column("source"), b.column("date_order"), pa.array(read, pa.string())], ["source", "date_order", "readings"])


SLIP = "slip"
#: How many times the values of a source its declared order counts.
TRUST = 100.0
#: The likelihood of a slip to be valid in some order, against 1 of a value in its own order.
BY_CHANCE = 0.1


def fit_orders(counts: list[tuple[str, float]], declared: str | None, prior: float = 1.0, rounds: int = 200, eps: float = 1e-9) -> tuple[dict[str, float], int]:
    """Mixture weights of the three orders and of slips from ``(readings, count)`` pairs.

    ``prior`` is the Dirichlet pseudo-count of each order where none is declared; a
    slip has a hundredth of it.  Returns the weights and the number of rounds.
    """
    sets = [(r.split("|"), n) for r, n in counts if r]
    total = math.fsum(n for _, n in sets)
    if declared in ORDERS:
        pseudo = {o: TRUST * (total + prior) if o == declared else 0.0 for o in ORDERS} | {SLIP: (total + prior) / BY_CHANCE}
    else:
        pseudo = dict.fromkeys(ORDERS, prior) | {SLIP: prior / TRUST}
    whole = math.fsum(pseudo.values())
    weights = {o: max(v / whole, 1e-9) for o, v in pseudo.items()}
    for turn in range(1, rounds + 1):
        mass = dict(pseudo)
        for orders, n in sets:
            likely = {o: weights[o] for o in orders} | {SLIP: weights[SLIP] * BY_CHANCE}
            shares = math.fsum(likely.values())
            for o, v in likely.items():
                mass[o] += n * v / shares
        whole = math.fsum(mass.values())
        fresh = {o: v / whole for o, v in mass.items()}
        moved = max(abs(fresh[o] - weights[o]) for o in fresh)
        weights = fresh
        if moved < eps:
            return weights, turn
    return weights, rounds


def order_mixtures(values: DataFrame, prior: float = 1.0) -> DataFrame:
    """One row per source: the fitted weight of each date order and of slips.

    ``values`` has value, source, home_zone and date_order.  Only the counts per
    source and set of valid orders (at most eight each) reach the fit.
    """
    numeric = values.filter(F.col("value").rlike(_NUMBERS)).select("source", "date_order", "home_zone", "value")
    counted = numeric.mapInArrow(_signatures, "source string, date_order string, readings string").groupBy("source", "date_order", "readings").count()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        declared = pdf["date_order"].iloc[0]
        w, turns = fit_orders(list(zip(pdf["readings"], pdf["count"])), declared if isinstance(declared, str) else None, prior)
        return pd.DataFrame([[pdf["source"].iloc[0], *(w[o] for o in (*ORDERS, SLIP)), int(pdf["count"].sum()), turns]], columns=["source", *WEIGHTS, "n_values", "em_rounds"])

    return counted.groupBy("source", "date_order").applyInPandas(fit, "source string, w_dmy double, w_mdy double, w_ymd double, w_slip double, n_values long, em_rounds int")


def choose(value: str | None, home: str | None, weights: dict[str, float], sure: float) -> tuple[str, str | None, int | None, float | None]:
    """``(status, format, utc_us, posterior)`` of one value."""
    if value is None or not value.strip():
        return "empty", None, None, None
    read = candidates(value, home)
    if not read:
        return "unreadable", None, None, None
    if not any(f in ORDERS for f, _ in read):
        scored, slip = [(f, at, 1.0) for f, at in read], 0.0
    else:
        scored, slip = [(f, at, weights[f]) for f, at in read], weights[SLIP] * BY_CHANCE
    total = math.fsum((slip, *(w for _, _, w in scored)))
    if slip >= 0.5 * total:
        return "contradicts_order", None, None, None
    by_result: dict[tuple[int, ...], float] = {}
    for _, at, w in scored:
        by_result[tuple(at)] = by_result.get(tuple(at), 0.0) + w / total
    at, posterior = max(by_result.items(), key=lambda x: (x[1], x[0]))
    fmt = max((s for s in scored if tuple(s[1]) == at), key=lambda s: (s[2], s[0]))[0]
    if posterior < sure:
        return "ambiguous_order", fmt, None, posterior
    if len(at) != 1:
        return ("skipped_by_clock" if not at else "shown_twice"), fmt, None, posterior
    return "resolved", fmt, at[0], posterior


def normalize_times(values: DataFrame, sources: DataFrame, sure: float = 0.95, prior: float = 1.0) -> DataFrame:
    """Each value's instant, or the reason why it has none.

    ``values``: src_field, row_key, value, source (other columns are dropped);
    ``sources``: source, home_zone, date_order; of several rows of a source the
    smallest counts.  Result:
    src_field, row_key, value, status, format, utc_us, posterior.

    Defined cases: null and blank values are ``empty``; dates without a time are
    ``date_only``; impossible values are ``unreadable``; a wall time the zone's
    clock skipped is ``skipped_by_clock``, one it showed twice ``shown_twice``; a
    posterior below ``sure`` is ``ambiguous_order``, a value more likely a slip
    ``contradicts_order``.  A value without zone whose
    source is unknown or names no zone is ``unreadable``.  Rows repeat as given.
    """
    homes = sources.filter("source IS NOT NULL").groupBy(F.col("source").alias("s_source")).agg(F.min(F.struct("home_zone", "date_order")).alias("home")).select("s_source", "home.home_zone", "home.date_order")
    # Both tables have a row per source. Few sources go to every task, so that no value moves; many are joined by key.
    near = F.broadcast if homes.count() <= FEW_SOURCES else (lambda df: df)
    known = values.select("src_field", "row_key", "value", "source").join(near(homes), F.col("source") == F.col("s_source"), "left").drop("s_source")
    mixture = order_mixtures(known, prior).filter("source IS NOT NULL").select(F.col("source").alias("m_source"), *WEIGHTS)
    unknown = [F.lit((1 - 1e-3) / 3)] * 3 + [F.lit(1e-3)]
    ready = known.join(near(mixture), F.col("source") == F.col("m_source"), "left").select("src_field", "row_key", "value", "home_zone", *(F.coalesce(c, u).alias(c) for c, u in zip(WEIGHTS, unknown)))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["src_field", "row_key", "value", "status", "format", "utc_us", "posterior"]
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("value", "home_zone", *WEIGHTS)]
            got = [choose(v, z, dict(zip((*ORDERS, SLIP), w)), sure) for v, z, *w in zip(*columns)]
            parts = list(zip(*got)) if got else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("src_field"), b.column("row_key"), b.column("value"), pa.array(parts[0], pa.string()), pa.array(parts[1], pa.string()), pa.array(parts[2], pa.int64()), pa.array(parts[3], pa.float64())], names
            )

    out = ready.mapInArrow(resolve, "src_field string, row_key string, value string, status string, format string, utc_us long, posterior double")
    bare = (F.col("status") == "unreadable") & F.col("value").rlike(_DATE_ONLY)
    return out.withColumn("status", F.when(bare, "date_only").otherwise(F.col("status")))


__all__ = ["PLAIN", "choose", "fit_orders", "is_plain", "normalize_times", "order_mixtures"]
