"""SQL of the array kernels for the oracle: recursive filters sample by sample, adaptive filters, wavelets, mel frames.

Everything is worked out from definitions, on lists or with recursive CTEs; only filter coefficients are shared.
"""

from __future__ import annotations

import numpy as np

from echoline.functions import dsp

E = "s AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), e AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM s)"
OUT = "SELECT vec_id, (n - 1)::INTEGER AS i, round(x[n], 6) + 0 AS v FROM (SELECT vec_id, x, unnest(range(1, len(x) + 1)) AS n FROM {})"


def number(x: float) -> str:
    return f"({float(x):.17e}::DOUBLE)"


def _pass(name: str, source: str, sos: np.ndarray) -> list[str]:
    """CTE ``name(vec_id, w)``: the sections run over ``source(vec_id, w)``, a sample a step, from the steady state."""
    steady, k = dsp._steady(sos), range(len(sos))
    begin = ", ".join(f"{number(a)} * w[1] AS p{j}, {number(b)} * w[1] AS q{j}" for j, (a, b) in zip(k, steady, strict=True))
    inner, states, before = f"(SELECT * FROM {name}_r WHERE i < len(w))", [], "w[i + 1]"
    for j, (b0, b1, b2, _, a1, a2) in zip(k, sos, strict=True):
        inner = f"(SELECT *, {number(b0)} * {before} + p{j} AS o{j} FROM {inner})"
        states += [f"{number(b1)} * {before} - {number(a1)} * o{j} + q{j}", f"{number(b2)} * {before} - {number(a2)} * o{j}"]
        before = f"o{j}"
    return [
        f"{name}_r AS (SELECT vec_id, w, 0 AS i, []::DOUBLE[] AS y, {begin} FROM {source} UNION ALL SELECT vec_id, w, i + 1, list_append(y, {before}), {', '.join(states)} FROM {inner})",
        f"{name} AS (SELECT vec_id, list_reverse(y) AS w FROM {name}_r WHERE i = len(w))",
    ]


def zero_phase(name: str, source: str, sos: np.ndarray, n: int = 64) -> list[str]:
    """CTE ``name(vec_id, x)``: forward and backward over the odd extension of ``source(vec_id, x)``."""
    edge = min(3 * (2 * len(sos) + 1), n - 1)
    wide = f"list_concat(list_concat(list_transform(range({edge}), lambda j: 2 * x[1] - x[{edge} + 1 - j]), x), list_transform(range({edge}), lambda j: 2 * x[{n}] - x[{n - 1} - j]))"
    return [
        f"{name}_w AS (SELECT vec_id, {wide} AS w FROM {source})", *_pass(f"{name}_f", f"{name}_w", sos), *_pass(f"{name}_b", f"{name}_f", sos),
        f"{name} AS (SELECT vec_id, w[{edge + 1}:{edge + n}] AS x FROM {name}_b)",
    ]


def filtered(stages: list[np.ndarray], start: str = "x", end: str = "x") -> str:
    """Zero-phase stages one after another; ``start`` and ``end`` are expressions over the list x."""
    ctes, at = [f"z AS (SELECT vec_id, {start} AS x FROM s)"], "z"
    for k, sos in enumerate(stages):
        ctes += zero_phase(f"t{k}", at, sos)
        at = f"t{k}"
    ctes.append(f"last AS (SELECT vec_id, {end} AS x FROM {at})")
    return f"WITH RECURSIVE {E}, {', '.join(ctes)} {OUT.format('last')}"


CENTRED = "list_transform(x, lambda v: v - list_avg(x))"
WHITENED = "list_transform(range(1, 65), lambda j: x[j] - CASE WHEN j > 1 THEN 0.9::DOUBLE * x[j - 1] ELSE 0 END)"


def sections(low: float | None, high: float | None, stop: bool = False, rate: float = 4096.0) -> np.ndarray:
    return dsp.butterworth(4, low and low / (rate / 2), high and high / (rate / 2), stop)


def notches(base: float, quality: float | None, rate: float = 4096.0, width: float = 5.0) -> list[np.ndarray]:
    return [dsp.notch(base * k / (rate / 2), quality or base * k / width) for k in range(1, 6) if base * k < rate / 2]


def prepared() -> str:
    stages = filtered([sections(100, 1500)], CENTRED, WHITENED)
    return stages.replace("FROM last)", "FROM (SELECT vec_id, list_transform(x, lambda v: v / list_stddev_pop(x)) AS x FROM last))")


_PAIRED = "p AS (SELECT a.vec_id // 2 AS pair_id, a.x AS a, b.x AS b FROM s a JOIN s b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1)"
_LMS = f"""WITH RECURSIVE {E}, {_PAIRED},
r AS (SELECT pair_id, a, b, 0 AS i, list_transform(range(16), lambda j: 0.0::DOUBLE) AS w, list_transform(range(16), lambda j: 0.0::DOUBLE) AS y FROM p
  UNION ALL SELECT pair_id, a, b, i + 1, list_transform(range(1, 17), lambda j: w[j] + 0.01::DOUBLE * miss * past[j]), list_append(y, miss)
  FROM (SELECT *, b[i + 17] - list_dot_product(w, past) AS miss FROM (SELECT *, list_reverse(a[i + 1:i + 16]) AS past FROM r WHERE i < 48))),
f AS (SELECT pair_id, a, y FROM r WHERE i = 48)"""
LMS = f"{_LMS} SELECT pair_id, (n - 1)::INTEGER AS i, round(y[n], 6) + 0 AS v FROM (SELECT pair_id, y, unnest(range(1, 65)) AS n FROM f)"
ADAPTIVE = f"""{_LMS}, l AS (SELECT pair_id, a, y, list_stddev_pop(a) * list_stddev_pop(y) * 64 AS scale, unnest(range(-63, 64)) AS lag FROM f)
SELECT pair_id, (lag + 63)::INTEGER AS i, round(list_sum(list_transform(range(greatest(0, -lag), least(64, 64 - lag)), lambda j: a[j + lag + 1] * y[j + 1])) / CASE WHEN scale > 0 THEN scale ELSE 1 END, 6) + 0 AS v FROM l"""

_LOW = "[" + ", ".join(number(v) for v in dsp.DB4) + "]"


def _branch(high: bool, x: str = "x") -> str:
    """One level of the wavelet with half-sample symmetric extension."""
    tap = f"{_LOW}[t + 1] * CASE WHEN t % 2 = 0 THEN 1 ELSE -1 END" if high else f"{_LOW}[8 - t]"
    at = f"CASE WHEN 2 * j + t < 6 THEN 6 - 2 * j - t WHEN 2 * j + t - 6 >= len({x}) THEN 2 * len({x}) - (2 * j + t - 6) ELSE 2 * j + t - 5 END"
    return f"list_transform(range((len({x}) + 7) // 2), lambda j: list_sum(list_transform(range(8), lambda t: {tap} * {x}[{at}])))"


def _packets() -> str:
    ctes, at = [], "SELECT vec_id, 0 AS node, x FROM s"
    for k in range(4):
        ctes.append(f"l{k} AS (SELECT vec_id, node * 2 AS node, {_branch(False)} AS x FROM ({at}) UNION ALL SELECT vec_id, node * 2 + 1, {_branch(True)} FROM ({at}))")
        at = f"SELECT * FROM l{k}"
    return f"WITH {E}, {', '.join(ctes)} SELECT vec_id, node::INTEGER AS i, round(list_sum(list_transform(x, lambda v: v * v)), 6) + 0 AS v FROM l3"


PACKETS = _packets()


def _levels() -> str:
    """Correlations of three levels, stretched to 64 samples, weighted 1, 2, 4, 8 from the coarsest."""
    ctes, a, b = [], "a", "b"
    ctes.append("w0 AS (SELECT pair_id, a, b FROM p)")
    for k in range(1, 4):
        ctes.append(f"w{k} AS (SELECT pair_id, {_branch(False, 'a')} AS a, {_branch(False, 'b')} AS b, {_branch(True, 'a')} AS da, {_branch(True, 'b')} AS db FROM w{k - 1})")
    parts = "SELECT pair_id, 1 AS weight, a AS x, b AS y FROM w3 UNION ALL SELECT pair_id, 2, da, db FROM w3 UNION ALL SELECT pair_id, 4, da, db FROM w2 UNION ALL SELECT pair_id, 8, da, db FROM w1"
    ctes.append(f"v AS ({parts})")
    ctes.append("c AS (SELECT pair_id, weight, len(x) AS n, list_transform(range(len(x)), lambda q: list_sum(list_transform(range(greatest(0, len(x) // 2 - q), least(len(x), len(x) - q + len(x) // 2)), lambda j: x[j + q - len(x) // 2 + 1] * y[j + 1]))) AS r FROM v)")
    ctes.append("u AS (SELECT *, k / 63.0::DOUBLE * (n - 1) AS spot FROM c, (SELECT unnest(range(64)) AS k))")
    ctes.append("h AS (SELECT *, least(floor(spot)::BIGINT, n - 2) AS low FROM u)")
    return f"WITH {E}, {_PAIRED}, {', '.join(ctes)} SELECT pair_id, k::INTEGER AS i, round(sum(weight * (r[low + 1] + (spot - low) * (r[low + 2] - r[low + 1]))) / 15, 6) + 0 AS v FROM h GROUP BY pair_id, k"


WAVELET = _levels()
MORLET = f"""WITH {E}, g AS (SELECT k AS s, u, exp(-pow(u / k::DOUBLE, 2) / 2) * cos(5 * u / k::DOUBLE) / sqrt(k) AS w FROM (SELECT unnest(range(1, 33)) AS k), (SELECT unnest(range(-32, 33)) AS u) WHERE abs(u) <= least(5 * k, 32)),
c AS (SELECT vec_id, s, i - u AS p, sum(v * w) AS r FROM e, g WHERE i - u BETWEEN 0 AND 63 GROUP BY vec_id, s, i - u)
SELECT vec_id, (s - 1)::INTEGER AS i, round(sum(r * r), 6) + 0 AS v FROM c GROUP BY vec_id, s"""

SUBTRACTED = f"""WITH {E}, n16 AS (SELECT vec_id, i, (v - avg(v) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS v FROM e WHERE i < 16),
nf AS (SELECT vec_id, k, sum(v * cos(2 * pi() * ((k * i) % 16) / 16)) AS re, sum(v * sin(2 * pi() * ((k * i) % 16) / 16)) AS im FROM n16, (SELECT unnest(range(9)) AS k) GROUP BY vec_id, k),
nm AS (SELECT vec_id, avg((re * re + im * im) / (4096 * 6.0) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) AS m FROM nf GROUP BY vec_id),
fr AS (SELECT vec_id, f, i - 8 * f AS j, v * (0.5 - 0.5 * cos(2 * pi() * (i - 8 * f) / 31)) AS v FROM e, (SELECT unnest(range(5)) AS f) WHERE i BETWEEN 8 * f AND 8 * f + 31),
sp AS (SELECT vec_id, f, k, sum(v * cos(2 * pi() * ((k * j) % 32) / 32)) AS re, -sum(v * sin(2 * pi() * ((k * j) % 32) / 32)) AS im FROM fr, (SELECT unnest(range(17)) AS k) GROUP BY vec_id, f, k),
sz AS (SELECT sp.*, m, sqrt(re * re + im * im) AS size FROM sp JOIN nm USING (vec_id)),
ad AS (SELECT vec_id, f, k, re * g AS re, im * g AS im FROM (SELECT *, CASE WHEN size > 0 THEN greatest(size - 1.5 * m, 0.01 * size) / size ELSE 0 END AS g FROM sz)),
sy AS (SELECT vec_id, f, j, sum(CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END * (re * cos(2 * pi() * ((k * j) % 32) / 32) - im * sin(2 * pi() * ((k * j) % 32) / 32))) / 32 AS v, any_value(0.5 - 0.5 * cos(2 * pi() * j / 31)) AS w FROM ad, (SELECT unnest(range(32)) AS j) GROUP BY vec_id, f, j)
SELECT vec_id, (8 * f + j)::INTEGER AS i, round(sum(v * w) / CASE WHEN sum(w * w) > 1e-10 THEN sum(w * w) ELSE 1 END, 6) + 0 AS v FROM sy GROUP BY vec_id, 8 * f + j"""

_MEL = f"""WITH {E}, fr AS (SELECT vec_id, f, i - 16 * f AS j, v * (0.5 - 0.5 * cos(2 * pi() * (i - 16 * f) / 32)) AS v FROM e, (SELECT unnest(range(3)) AS f) WHERE i BETWEEN 16 * f AND 16 * f + 31),
sp AS (SELECT vec_id, f, k, sqrt(pow(sum(v * cos(2 * pi() * ((k * j) % 32) / 32)), 2) + pow(sum(v * sin(2 * pi() * ((k * j) % 32) / 32)), 2)) AS size FROM fr, (SELECT unnest(range(17)) AS k) GROUP BY vec_id, f, k),
ed AS (SELECT q, 700 * (pow(10, (2595 * log10(1 + 2048 / 700.0::DOUBLE) * q / 17) / 2595) - 1) AS hz FROM (SELECT unnest(range(18)) AS q)),
bank AS (SELECT a.q AS m, k, greatest(0, least((128.0::DOUBLE * k - a.hz) / (b.hz - a.hz), (c.hz - 128.0::DOUBLE * k) / (c.hz - b.hz))) AS w FROM ed a JOIN ed b ON b.q = a.q + 1 JOIN ed c ON c.q = a.q + 2, (SELECT unnest(range(17)) AS k)),
db AS (SELECT vec_id, f, m, 20 * log10(greatest(sum(size * w), 1e-10)) AS db FROM sp JOIN bank USING (k) GROUP BY vec_id, f, m),
half AS (SELECT vec_id, f, m, round_even(db / pow(2, floor(log2(abs(db))) - 10), 0) * pow(2, floor(log2(abs(db))) - 10) AS v FROM db)"""
MEL = f"{_MEL} SELECT vec_id, (f * 16 + m)::INTEGER AS i, round(v, 6) + 0 AS v FROM half"
MFCC = f"{_MEL} SELECT vec_id, (f * 8 + c)::INTEGER AS i, round(sum(v * cos(pi() / 16 * (m + 0.5) * c)) * sqrt(2 / 16.0::DOUBLE) / CASE WHEN c = 0 THEN sqrt(2) ELSE 1 END, 6) + 0 AS v FROM half, (SELECT unnest(range(8)) AS c) GROUP BY vec_id, f, c"

_POWERS = "f AS (SELECT vec_id, k, pow(sum(v * cos(2 * pi() * ((k * i) % 64) / 64)), 2) + pow(sum(v * sin(2 * pi() * ((k * i) % 64) / 64)), 2) AS p FROM e, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k), snr AS (SELECT vec_id, 10 * log10(avg(p) / list_avg(list_sort(list(p))[1:3])) AS snr FROM f GROUP BY vec_id)"
SNR = f"WITH {E}, {_POWERS} SELECT vec_id, round(snr, 4) AS snr_db, round(peak, 6) AS peak FROM snr JOIN (SELECT vec_id, max(abs(v)) AS peak FROM e GROUP BY vec_id) USING (vec_id)"
STACKED = f"""WITH {E}, {_POWERS}, q AS (SELECT label::BIGINT AS pair_id, least(greatest((a.snr + b.snr) / 2 / 30, 0), 1) >= 0.3 AS good FROM snr a JOIN snr b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1 JOIN s ON s.vec_id = a.vec_id)
SELECT pair_id, count_if(good)::INTEGER AS used, count_if(NOT good)::INTEGER AS rejected, round(CASE WHEN count_if(good) > 0 THEN 10 * log10(count_if(good)) ELSE 0 END, 4) AS gain_db, CASE WHEN count_if(good) > 0 THEN 64 END::INTEGER AS n FROM q GROUP BY pair_id"""


def _spline(n: int) -> np.ndarray:
    """Second derivatives of a not-a-knot spline from its second differences."""
    m = np.zeros((n, n))
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = 1, 4, 1
    m[0, :3] = m[-1, -3:] = 1, -2, 1
    return np.linalg.inv(m)


def spline_delay(phat: str) -> str:
    """``phat``: CTEs up to c(pair_id, lag, v). The highest point of a spline around the peak on a grid ten times as fine."""
    rows = ", ".join(f"({n}, {i}, {j}, {number(v)})" for n in range(11, 22) for (i, j), v in np.ndenumerate(_spline(n)))
    return f"""WITH {phat}, minv AS (SELECT * FROM (VALUES {rows}) t(n, i, j, coef)), peak AS (SELECT pair_id, arg_max(lag, (v, -lag)) + 63 AS k FROM c GROUP BY pair_id),
span AS (SELECT pair_id, greatest(0, k - 10) AS a, least(127, k + 11) - greatest(0, k - 10) AS n FROM peak), y AS (SELECT pair_id, a, n, lag + 63 - a AS t, v FROM span JOIN c USING (pair_id) WHERE lag + 63 >= a AND lag + 63 < a + n),
d AS (SELECT *, CASE WHEN t = 0 OR t = n - 1 THEN 0 ELSE 6 * (lag(v) OVER o - 2 * v + lead(v) OVER o) END AS d FROM y WINDOW o AS (PARTITION BY pair_id ORDER BY t)),
b AS (SELECT d.pair_id, minv.i AS t, sum(coef * d.d) AS bend FROM d JOIN minv ON minv.n = d.n AND minv.j = d.t GROUP BY d.pair_id, minv.i), z AS (SELECT y.*, bend FROM y JOIN b USING (pair_id, t)),
grid AS (SELECT pair_id, a, n, q * 0.1::DOUBLE AS spot, least(floor(q * 0.1::DOUBLE)::BIGINT, n - 2) AS low, q FROM span, (SELECT unnest(range(201)) AS q) WHERE q <= (n - 1) * 10),
top AS (SELECT g.pair_id, g.a, g.spot, g.q, l.bend * pow(1 - (g.spot - g.low), 3) / 6 + h.bend * pow(g.spot - g.low, 3) / 6 + (l.v - l.bend / 6) * (1 - (g.spot - g.low)) + (h.v - h.bend / 6) * (g.spot - g.low) AS s FROM grid g JOIN z l ON l.pair_id = g.pair_id AND l.t = g.low JOIN z h ON h.pair_id = g.pair_id AND h.t = g.low + 1)
SELECT pair_id, round(-(arg_max(a + spot, (round(s, 12), -q)) - 63) / 4096, 8) + 0 AS delay_s FROM top GROUP BY pair_id"""


def linkage(sensors: str) -> str:
    """``sensors``: a CTE sensors(site_id, sensor_id, latitude, longitude). Average linkage of each site at 400 m, merge by merge."""
    metres = "6371000.0::DOUBLE * pi() / 180"
    mean = "list_avg(flatten(list_transform(z.p, lambda i: list_transform(z.q, lambda j: sqrt(pow(px[i] - px[j], 2) + pow(py[i] - py[j], 2))))))"
    pairs = "flatten(list_transform(range(1, len(g) + 1), lambda a: list_transform(range(a + 1, len(g) + 1), lambda b: {'a': a, 'b': b, 'p': g[a], 'q': g[b]})))"
    return f"""WITH RECURSIVE {sensors}, c AS (SELECT *, 0.5::DOUBLE + (sensor_id * 13 % 50) / 100.0::DOUBLE AS conf FROM sensors),
l AS (SELECT site_id, list(sensor_id ORDER BY sensor_id) AS ids, list(latitude ORDER BY sensor_id) AS la, list(longitude ORDER BY sensor_id) AS lo FROM c GROUP BY site_id),
r AS (SELECT site_id, ids, list_transform(la, lambda v: (v - la[1]) * {metres}) AS px, list_transform(lo, lambda v: (v - lo[1]) * {metres} * cos(radians(la[1]))) AS py, list_transform(range(1, len(ids) + 1), lambda i: [i]) AS g, false AS done FROM l
  UNION ALL SELECT site_id, ids, px, py, CASE WHEN best.d <= 400 THEN list_append(list_filter(g, lambda v: v <> best.p AND v <> best.q), list_sort(list_concat(best.p, best.q))) ELSE g END, best IS NULL OR NOT best.d <= 400
  FROM (SELECT *, list_sort(list_transform({pairs}, lambda z: {{'d': {mean}, 'p': z.p, 'q': z.q}}))[1] AS best FROM r WHERE NOT done)),
k AS (SELECT site_id, ids, list_sort(g) AS g FROM r WHERE done), u AS (SELECT site_id, ids, unnest(g) AS members, unnest(range(len(g))) AS cluster_id FROM k), v AS (SELECT site_id, cluster_id, ids[unnest(members)] AS sensor_id FROM u),
h AS (SELECT v.site_id, cluster_id, c.* EXCLUDE (site_id) FROM v JOIN c ON c.sensor_id = v.sensor_id), m AS (SELECT site_id, cluster_id, sum(conf * latitude) / sum(conf) AS la, sum(conf * longitude) / sum(conf) AS lo FROM h GROUP BY site_id, cluster_id)"""
