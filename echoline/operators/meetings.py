"""All recordings of a pair of sensors at one place, without a shuffle of the pairs of recordings.

There are far more pairs than recordings, so recordings are dealt out instead: sensors go to blocks, and a cell, two
blocks, gets the recordings of both. A cell holds every match of its pairs of sensors, and works through them in
portions of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.functions.text import micros

#: Recordings of a block at most, unless one sensor has more; pairs of a portion; rows of a batch.
BLOCK, PORTION, BATCH = 1_500_000, 500_000, 100_000
#: Stands for a null id, and sorts last.
NONE = np.iinfo(np.int64).max

Columns = dict[str, np.ndarray]


def by_sensor_pair(recordings: DataFrame, within_s: float, kernel: Callable[[Columns], Columns], schema: str, values: bool = True) -> DataFrame:
    """``kernel`` on the matches within ``within_s`` of recordings (event_id, user_id, ts, value) of different sensors.

    The kernel gets columns of whole pairs of sensors: event_id, user_id and, if ``values`` are wanted, value and null (value missing) with _a for the sensor with
    the lower id and _b, drift (microseconds), and pair, a number for each pair of sensors in the portion.
    """
    width = int(within_s * 1_000_000)
    e = recordings.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    e = e.select(F.coalesce(F.col("event_id").cast("long"), F.lit(int(NONE))).alias("event_id"), F.col("user_id").cast("long").alias("user_id"), micros(F.col("ts")).alias("t"), *[F.col("value").cast("double").alias("value")] * values)
    blocks, least = -(-e.count() // BLOCK), 2 * recordings.sparkSession.sparkContext.defaultParallelism
    while blocks * (blocks + 1) // 2 < least:
        blocks += 1
    e = e.withColumn("own", F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cells = e.select(((high * (high + 1) / 2 + low) * 2 + (F.col("own") == high).cast("int")).cast("int").alias("cell"), "event_id", "user_id", "t", *["value"] * values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            cell = batch.column("cell").to_numpy() // 2
            for k in np.unique(cell):
                held.setdefault(int(k), []).append(batch if (cell == k).all() else batch.filter(pa.array(cell == k)))
        for k in sorted(held):
            table = pa.Table.from_batches(held.pop(k))
            side, x = table["cell"].to_numpy() % 2, {n: table[n].to_numpy() for n in ("event_id", "user_id", "t")}
            if values:
                x |= {"value": table["value"].fill_null(0.0).to_numpy(), "null": table["value"].is_null().to_numpy()}
            del table
            top = int((np.sqrt(8 * k + 1) - 1) / 2)
            within = k == top * (top + 1) // 2 + top
            sides = [x, x] if within else [{n: v[side == s] for n, v in x.items()} for s in (0, 1)]
            for matches in _matches(_sorted(sides[0], "user_id"), _sorted(sides[1], "t"), width, within):
                out = kernel(matches)
                for at in range(0, len(next(iter(out.values()))), BATCH):
                    part = {n: v[at : at + BATCH] if isinstance(v, (np.ndarray, pa.Array)) else v for n, v in out.items()}
                    yield pa.RecordBatch.from_arrays([pa.array(v, mask=v == NONE) if isinstance(v, np.ndarray) and v.dtype == np.int64 else pa.array(v) if isinstance(v, np.ndarray) else v for v in part.values()], names=list(part))

    return cells.repartitionById(blocks * (blocks + 1) // 2, F.floor(F.col("cell") / 2).cast("int")).mapInArrow(run, schema)


def _sorted(x: Columns, by: str) -> Columns:
    order = np.argsort(x[by], kind="stable")
    out = {n: v[order] for n, v in x.items()}
    return out | {"rank": np.unique(out["user_id"], return_inverse=True)[1].astype(np.int64)}


def _matches(x: Columns, y: Columns, width: int, within: bool) -> Iterator[Columns]:
    """Portions of the matches of ``x`` (by sensor) and ``y`` (by time); ``within`` a block, every pair of sensors once."""
    if not len(x["t"]) or not len(y["t"]):
        return
    low, high = np.searchsorted(y["t"], x["t"] - width, "left"), np.searchsorted(y["t"], x["t"] + width, "right")
    n = high - low
    starts = np.flatnonzero(np.r_[True, x["rank"][1:] != x["rank"][:-1]])
    each, ends = np.add.reduceat(n, starts), np.r_[starts[1:], len(n)]
    done = np.cumsum(each)
    first = 0
    while first < len(starts):
        past = int(np.searchsorted(done, (done[first - 1] if first else 0) + PORTION, "right"))
        past = max(past, first + 1)
        rows = slice(starts[first], ends[past - 1])
        first = past
        total = int(n[rows].sum())
        parts = min(-(-total // PORTION), int(y["rank"].max()) + 1)
        if parts > 1:  # one sensor with very many matches
            one = {k: v[rows] for k, v in x.items()}
            for p in range(parts):
                some = y["rank"] % parts == p
                a, z = one["t"], y["t"][some]
                begin = np.searchsorted(z, a - width, "left")
                yield from _portion(one, {k: v[some] for k, v in y.items()}, begin, np.searchsorted(z, a + width, "right") - begin, within)
        elif total:
            yield from _portion({k: v[rows] for k, v in x.items()}, y, low[rows], n[rows], within)


def _portion(x: Columns, y: Columns, low: np.ndarray, n: np.ndarray, within: bool) -> Iterator[Columns]:
    i = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(i)) + np.repeat(low - (np.cumsum(n) - n), n)
    if within:
        keep = x["rank"][i] < y["rank"][j]
        i, j = i[keep], j[keep]
    if not len(i):
        return
    out = {"pair": x["rank"][i] * (int(y["rank"].max()) + 1) + y["rank"][j], "drift": np.abs(x["t"][i] - y["t"][j])}
    swap = x["user_id"][i] > y["user_id"][j]
    for name in x.keys() - {"t", "rank"}:
        a, b = x[name][i], y[name][j]
        if not within:
            a, b = np.where(swap, b, a), np.where(swap, a, b)
        out |= {f"{name}_a": a, f"{name}_b": b}
    yield out


def in_groups(key: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows by key and, in a key, by ``order``; where groups begin and how long they are. Only groups of several rows are sorted by more than the key."""
    at = np.argsort(key, kind="stable")
    k = key[at]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, int)
    sizes = np.diff(np.r_[starts, len(k)])
    if not order:
        return at, starts, sizes
    several = np.repeat(sizes > 1, sizes)
    some = at[several]
    at[several] = some[np.lexsort([*(c[some] for c in reversed(order)), key[some]])]
    return at, starts, sizes


def first_of(key: np.ndarray, order: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` rows of each key in an order, and their places from 1."""
    at, starts, sizes = in_groups(key, *order)
    place = np.arange(len(at)) - np.repeat(starts, sizes) + 1
    return at[place <= n], place[place <= n].astype(np.int32)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does: the product's halves go away from zero. No negative zero."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    return (whole + np.sign(y) * (np.abs(y - whole) >= 0.5)) / 10.0**digits + 0.0


def located(m: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, whether it is unknown, and confidence of matches: ``network.located`` on columns, missing values as SQL takes them."""
    drift_s = m["drift"] / 1e6
    length = 100.0 + np.fmod(m["user_id_a"] * 31 + m["user_id_b"] * 17, 900)
    raw = (length - 1400.0 * ((m["value_a"] - m["value_b"]) / 1000)) / 2
    # A value that is no number counts as the greatest, as in SQL.
    raw = np.where(np.isnan(raw), np.inf, raw)
    spot = np.where((raw < -5.0) | (raw > length + 5.0), np.minimum(np.maximum(raw, 0.0), length), raw)
    share = lambda v, null: np.where(null, 0.0, np.where(np.isnan(v), 1.0, np.minimum(np.maximum(v, 0.0), 1.0)))
    conf = 0.3 * share(np.abs(m["value_a"] / 100), m["null_a"]) + 0.4 * share(m["value_b"] / 3 / 30, m["null_b"]) + 0.3 * share((1.0 + drift_s / 10 - 1) / 9, False)
    return spot, m["null_a"] | m["null_b"], conf


def located_clusters(m: Columns, gap: float, n: int) -> Columns:
    """Matches of a pair of sensors clustered along the pipe where steps exceed ``gap``; the surest of each cluster, the ``n`` surest of each pair; to four digits."""
    spot, null, conf = located(m)
    at, starts, sizes = in_groups(m["pair"], null, spot, m["event_id_a"], m["event_id_b"])
    x, unknown = spot[at], null[at]
    with np.errstate(invalid="ignore"):
        begins = np.r_[False, (x[1:] - x[:-1] > gap) & ~unknown[1:]]
    begins[starts] = False
    counted = np.cumsum(begins)
    cluster = counted - np.repeat(counted[starts], sizes)
    first = begins.copy()
    first[starts] = True
    whole = np.cumsum(first) - 1
    members = np.bincount(whole)
    best, _ = first_of(whole, (-conf[at], m["event_id_a"][at], m["event_id_b"][at]), 1)
    row = at[best]
    top, place = first_of(m["pair"][row], (-conf[row], m["event_id_a"][row], m["event_id_b"][row]), n)
    row, best = row[top], best[top]
    return {k: m[k][row] for k in ("user_id_a", "user_id_b", "event_id_a", "event_id_b")} | {
        "cluster_id": cluster[best].astype(np.int32), "members": members[whole[best]].astype(np.int64), "place": place, "spot": pa.array(rounded(spot[row], 4), mask=null[row]), "conf": rounded(conf[row], 4),
    }


def _fixed(x: np.ndarray, digits: int) -> list[object]:
    """Parts of the text of numbers that are rounded to six digits, then to fewer."""
    micro = rounded(x, 6) * 1e6
    size, unit = np.abs(np.rint(micro)).astype(np.int64), 10 ** (6 - digits)
    size = (size + unit // 2) // unit
    sign = pa.array(["", "-"]).take(pa.array(((micro < 0) & (size > 0)).astype(np.int8)))
    rest = pa.array([f"{k:0{digits}d}" for k in range(10**digits)]).take(pa.array(size % 10**digits))
    return [sign, pa.array(size // 10**digits).cast(pa.string()), ".", rest]


def surest(m: Columns, n: int) -> Columns:
    """The ``n`` surest matches of each pair of sensors as one document, in order; confidence is compared to nine digits. Unknown positions are left out."""
    spot, null, conf = located(m)
    row, place = first_of(m["pair"], (-np.round(conf, 9), m["event_id_a"], m["event_id_b"]), n)
    starts, known = np.flatnonzero(place == 1), ~null[row]
    some = row[known]
    each = pc.binary_join_element_wise('{"distance_m":', *_fixed(spot[some], 2), ',"confidence":', *_fixed(conf[some], 3), "}", "")
    ends = np.r_[0, np.cumsum(known)][np.r_[starts, len(row)]]
    listed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), ",")
    json = pc.binary_join_element_wise('{"leaks":[', pc.if_else(pa.array(np.diff(ends) > 0), listed, pa.scalar(None, pa.string())), "]}", "")
    return {k: m[k][row[starts]] for k in ("user_id_a", "user_id_b")} | {"json": json}


def mean_confidence(m: Columns) -> Columns:
    """Mean confidence and signal-to-noise ratio of each pair of sensors."""
    conf = located(m)[2]
    at, starts, sizes = in_groups(m["pair"])
    if not len(starts):
        return {"c": np.empty(0), "s": np.empty(0)}
    return {"c": np.add.reduceat(conf[at], starts) / sizes, "s": np.add.reduceat(conf[at] * 25, starts) / sizes}
