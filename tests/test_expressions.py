import math

import pytest
from pyspark.sql import functions as F

from echoline.functions import arrays as A
from echoline.functions import physics as P
from echoline.functions import text as X


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_golden_values(spark):
    lit = F.lit
    row = one(
        spark,
        warm=P.environmental_speed(lit(1400.0), lit(15.0), lit(5.0)), hot=P.environmental_speed(lit(5000.0), lit(25.0), lit(1.0)),
        near=P.haversine(lit(40.7128), lit(-74.0060), lit(40.7138), lit(-74.0055)), conf=P.confidence(lit(0.85), lit(25.0), lit(3.5)),
        x=P.position(lit(100.0), lit(1400.0), lit(0.0285714285714)), back=P.delay_of(lit(30.0), lit(100.0), lit(1400.0)), inf=P.confidence(lit(1.0), lit(90.0), lit(float("inf"))),
        gps=P.interpolate([lit(40.7128), lit(-74.0060), lit(10.5)], [lit(40.7138), lit(-74.0055), lit(11.2)], lit(0.3)),
        here=P.interpolate([lit(1.0), lit(2.0), lit(3.0)], [lit(1.0), lit(2.0), lit(3.0)], lit(0.5)), out=P.interpolate([lit(1.0)] * 3, [lit(2.0)] * 3, lit(1.5)),
        cut=P.seconds_to_samples(lit(-0.0009)), half=P.ceiling_half(lit(79)), speed=P.wave_speed(lit("Cast Iron")), none=P.wave_speed(lit("glass")),
    )
    assert row.warm == pytest.approx(1388.64) and row.hot == pytest.approx(5012.0) and row.near == pytest.approx(118.9128, abs=1e-3)
    assert row.conf == pytest.approx(0.671667, abs=1e-6) and row.x == pytest.approx(30) and row.back == pytest.approx(0.0285714, abs=1e-6) and row.inf == pytest.approx(1.0)
    assert row.gps.latitude == pytest.approx(40.7131, abs=1e-6) and row.gps.longitude == pytest.approx(-74.00585, abs=1e-6) and row.gps.elevation == pytest.approx(10.71)
    assert row.here.latitude == 1.0 and row.out is None and row.cut == -3 and row.half == 40 and row.speed == 3500 and row.none is None


def test_names(spark):
    lit = F.lit
    row = one(
        spark, bad=X.parse_filename(lit("a~b~c.wav")), null=X.parse_filename(lit(None).cast("string")), upper=X.parse_filename(lit("a~b~c~d.WAV")),
        t4=X.parse_time(lit("2025-01-18_12_05_30")), t0=X.parse_time(lit("x")), off=X.site_tokens(lit(None).cast("string")), gain=X.viewer_gain(lit("a~b~c~12.5~e.wav")),
        kb=X.bytes_human(lit(1536)), rep=X.repaired_as(lit(" Manifold ")),
    )
    assert row.bad is None and row.null is None and row.upper.gain_db == "d" and row.t4.hour == 12 and row.t0 is None
    assert row.off == ["OFF"] * 4 and row.gain == 12.5 and row.kb == "1.50 KB" and row.rep == "mainifold"
    with pytest.raises(Exception, match="a wav needs"):
        one(spark, p=X.output_path(lit("o"), lit("b"), lit("wav"), lit(None).cast("string"), lit("1")))


def test_arrays(spark):
    x = F.array(*[F.lit(float(v)) for v in (3, -1, 4, 1, -5)])
    zero = F.array(F.lit(0.0), F.lit(0.0))
    row = one(
        spark, rms=A.rms(x), median=A.median(x), silent=A.peak_normalised(zero), kurt=A.excess_kurtosis(zero), right=A.shifted(x, F.lit(2)), left=A.shifted(x, F.lit(-9)),
        scaled=A.scaled_to(x), w=A.windows(x, 6, 1), k=A.argmax(x), edge=A.parabolic_offset(x, F.lit(0)), off=A.parabolic_offset(x, F.lit(2)), sharp=A.sharpness(zero, F.lit(0), 0), seg=A.padded_segments(x, 3), energy=A.frame_energy(x, 2, 1),
    )
    assert row.rms == pytest.approx(math.sqrt(52 / 5)) and row.median == 1 and row.silent == [0, 0] and row.kurt == 0
    assert row.right == [0, 0, 3, -1, 4] and row.left == [0] * 5 and row.scaled[4] == pytest.approx(-0.98) and row.w == [] and row.k == 2
    assert row.edge == 0 and row.off == pytest.approx((1 - -1) / (2 * (8 - 0))) and math.isinf(row.sharp) and row.seg[1] == [1, -5, 0] and len(row.energy) == 3


def test_ranks_in_bins(spark):
    from echoline.operators import relational as R

    rows = [(k, v, i) for i, (k, v) in enumerate((k, v) for k in ("a", "b", None) for v in (3.0, -1.0, None, 7.5, 7.5, 0.0))]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    binned, bin_ = R.even_bins(df, ["k"], "v", 4)
    got = R.ranks(binned, ["k"], bin_, F.col("v").asc_nulls_last(), F.col("i")).collect()
    assert len(got) == len(rows)
    for k in ("a", "b", None):
        mine = sorted((r.place, r.i) for r in got if r.k == k)
        want = sorted((v is None, v or 0.0, i) for kk, v, i in rows if kk == k)
        assert [i for _, i in mine] == [i for *_, i in want] and [p for p, _ in mine] == list(range(1, 7))
