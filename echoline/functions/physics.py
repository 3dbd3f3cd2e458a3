"""Geography, wave speeds, delays and confidences as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoline.functions import constants as K


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def clip(c: Column, low: object, high: object) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(c, lit(low)), lit(high))


def material_key(material: Column) -> Column:
    return F.translate(F.lower(material), " -", "__")


def wave_speed(material: Column) -> Column:
    """m/s by material; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for x in chain(*((k, float(v)) for k, v in K.WAVE_SPEEDS.items()))])
    return F.element_at(table, material_key(material))


def environmental_speed(base: Column, temperature: Column, pressure: Column) -> Column:
    warm = F.coalesce(temperature, F.lit(K.REFERENCE_TEMPERATURE_C)) - K.REFERENCE_TEMPERATURE_C
    dense = F.coalesce(pressure, F.lit(K.REFERENCE_PRESSURE_BAR)) - K.REFERENCE_PRESSURE_BAR
    return base + K.PER_DEGREE * warm + K.PER_BAR * dense


def samples_to_seconds(n: Column, rate: float = K.SAMPLE_RATE) -> Column:
    return n / F.lit(float(rate))


def seconds_to_samples(s: Column, rate: float = K.SAMPLE_RATE) -> Column:
    """Truncated towards zero."""
    return (s * F.lit(float(rate))).cast("int")


def distance_to_delay(metres: Column, speed: Column) -> Column:
    return metres / speed


def delay_to_distance(seconds: Column, speed: Column) -> Column:
    return seconds * speed


def raw_position(length: Column, speed: Column, delay: Column) -> Column:
    """Metres from sensor A for a delay t_B - t_A."""
    return (length - speed * delay) / 2


def position(length: Column, speed: Column, delay: Column, tolerance: float = K.TOLERANCE_M) -> Column:
    """``raw_position``, moved into [0, length] where it is out by more than the tolerance."""
    x = raw_position(length, speed, delay)
    return F.when((x < -tolerance) | (x > length + tolerance), clip(x, 0.0, length)).otherwise(x)


def position_message(x: Column, length: Column, tolerance: float = K.TOLERANCE_M) -> Column:
    return (
        F.when(x < -tolerance, F.lit("before sensor A")).when(x > length + tolerance, F.lit("beyond sensor B"))
        .when((x < 0) | (x > length), F.lit("within tolerance")).otherwise(F.lit("ok"))
    )


def delay_of(x: Column, length: Column, speed: Column) -> Column:
    return (length - 2 * x) / speed


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * K.EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def distance_3d(flat: Column, depth_a: Column, depth_b: Column) -> Column:
    return F.sqrt(flat * flat + F.pow(F.coalesce(depth_b, F.lit(0.0)) - F.coalesce(depth_a, F.lit(0.0)), 2))


def interpolate(a: list[Column], b: list[Column], share: Column) -> Column:
    """Struct of latitude, longitude and elevation at ``share`` of the great circle; null outside [0, 1], ``a`` where both coincide."""
    la, oa, lb, ob = (F.radians(c) for c in (a[0], a[1], b[0], b[1]))
    d = haversine(a[0], a[1], b[0], b[1]) / K.EARTH_RADIUS_M
    wa, wb = F.sin((1 - share) * d) / F.sin(d), F.sin(share * d) / F.sin(d)
    x = wa * F.cos(la) * F.cos(oa) + wb * F.cos(lb) * F.cos(ob)
    y = wa * F.cos(la) * F.sin(oa) + wb * F.cos(lb) * F.sin(ob)
    z = wa * F.sin(la) + wb * F.sin(lb)
    height = a[2] + share * (b[2] - a[2])
    there = F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("latitude"), F.degrees(F.atan2(y, x)).alias("longitude"), height.alias("elevation"))
    here = F.struct(a[0].alias("latitude"), a[1].alias("longitude"), height.alias("elevation"))
    return F.when((share >= 0) & (share <= 1), F.when(d < 1e-15, here).otherwise(there))


def confidence(height: Column, snr_db: Column, sharpness: Column) -> Column:
    return 0.3 * clip(F.abs(height), 0.0, 1.0) + 0.4 * clip(snr_db / 30, 0.0, 1.0) + 0.3 * clip((sharpness - 1) / 9, 0.0, 1.0)


def estimate_message(delay: Column, conf: Column, snr: Column, sharpness: Column) -> Column:
    """The first rule that an estimate breaks, else ``valid``."""
    return (
        F.when(F.abs(delay) > K.MAX_DELAY_S, F.lit("delay")).when(conf < K.MIN_CONFIDENCE, F.lit("confidence"))
        .when(snr < K.MIN_SNR_DB, F.lit("snr")).when(sharpness < K.MIN_SHARPNESS, F.lit("sharpness")).otherwise(F.lit("valid"))
    )


def confidence_band(conf: Column) -> Column:
    return F.when(conf > 0.8, F.lit("high")).when(conf > 0.6, F.lit("medium")).otherwise(F.lit("low"))


def decibel(x: Column, power: int = 1) -> Column:
    return F.lit(10.0 if power == 2 else 20.0) * F.log10(F.greatest(x, F.lit(1e-10)))


def ceiling_half(n: Column) -> Column:
    return F.floor((n + 1) / 2).cast("int")


def config_problems(rate: Column, method: Column, low: Column, high: Column, conf: Column) -> Column:
    """The invariants that a configuration breaks, in one text; empty if none."""
    rules = [
        (rate != K.SAMPLE_RATE, "sample rate differs"), (~method.isin("phat", "scot", "roth"), "unknown method"), (low >= high, "band is empty"),
        (high > K.SAMPLE_RATE / 2, "band passes Nyquist"), ((conf < 0) | (conf > 1), "confidence out of range"),
    ]
    return F.concat_ws("; ", *[F.when(c, F.lit(t)) for c, t in rules])
