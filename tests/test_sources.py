import numpy as np
import pytest

from echoline.operators import estimators
from echoline.sources import catalogues, synthetic, wav


def test_decode_all_widths():
    x = np.array([0, 0.5, -0.5, 0.25])
    for bits in (16, 32):
        out = wav.decode(wav.encode(x, 4096, bits))
        assert out["error"] is None and np.allclose(out["samples"], x, atol=1e-4) and out["bits"] == bits
    assert np.allclose(wav.pcm(bytes([128, 255, 0]), 8), [0, 127 / 128, -1])
    assert np.allclose(wav.pcm(b"\x00\x00\x40\x00\x00\x80", 24), [0.5, -1])
    assert wav.decode(b"RIFF")["error"] and wav.decode(wav.encode(x), rate=8000)["error"]
    ten = np.zeros(40960)
    assert wav.decode(wav.encode(ten[:40141]), seconds=10)["error"] and wav.decode(wav.encode(np.zeros(41164)), seconds=10)["error"] is None


def test_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    good = rng.normal(0, 0.1, 40960)
    zero_run = good.copy()
    zero_run[100:2300] = 0
    tail = good.copy()
    tail[-600:] = 0
    names = {"S1~R1~20250118120530~100.wav": wav.encode(good), "S2~R2~20250118120535~90.wav": wav.encode(zero_run), "odd.wav": wav.encode(tail), "S3~R3~x~1.wav": wav.encode(np.zeros(40960)), "short.wav": b"RIFF", "S4~R~1~2.flac": b"", "wide.wav": wav.encode(good, bits=32)}
    for i, (name, data) in enumerate(names.items()):
        folder = tmp_path / "in" / ("LEAK" if i % 2 else "NORMAL")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    (tmp_path / "in" / "root.wav").write_bytes(wav.encode(good))
    root = str(tmp_path / "in")
    assert wav.files(spark, root).count() == 7
    rows = {r.path.rsplit("/", 1)[1]: r for r in wav.read(spark, root, rate=4096, seconds=10).collect()}
    assert rows["short.wav"].error and rows["short.wav"].samples is None and rows["odd.wav"].n_frames == 40960
    assert np.allclose(rows["root.wav"].samples, good, atol=1e-4)
    assert wav.listing(spark, root, "S1").first().gain == 100 and wav.listing(spark, root).count() == 7
    assert {r.label for r in wav.labelled(spark, root).collect()} == {"LEAK", "NORMAL"} and wav.labelled(spark, root).count() == 6
    ok = {r.path.rsplit("/", 1)[1]: r.i for r in wav.files(spark, root).select("path", wav.integrity(wav.F.col("content")).alias("i")).collect()}
    assert ok["root.wav"].message == "ok" and ok["S2~R2~20250118120535~90.wav"].message == "long_zero_run=2200" and ok["odd.wav"].message == "trailing_zero_run=600"
    assert not ok["S3~R3~x~1.wav"].ok and ok["short.wav"].message == "too_small_for_header" and ok["wide.wav"].message == "sample_width_4"
    again = wav.read(spark, root).filter("error IS NULL").select(wav.encoded(wav.F.col("samples")).alias("w")).collect()
    assert all(wav.decode(bytes(r.w))["error"] is None for r in again)
    (tmp_path / "a.raw").write_bytes((good[:8000] * 2**31).astype("<i4").tobytes())
    raw = wav.read_raw(spark, str(tmp_path)).first()
    assert raw.seconds == 1.0 and np.allclose(raw.samples, good[:8000], atol=1e-6)


REGISTRY = """{"sensors": {"S001": {"name": "A", "position": {"latitude": 40.7128, "longitude": -74.006, "elevation": 10.5}, "site_id": "X", "logger_id": "L1"},
 "S002": {"position": {"latitude": 40.7138, "longitude": -74.0055}}},
 "sensor_pairs": [{"sensor_a": "S001", "sensor_b": "S002", "distance_meters": 100.0, "pipe_segment": {"material": "PVC"}}, {"sensor_a": "S001", "sensor_b": "S9", "distance_meters": 150.0, "wave_speed_mps": 1200.0}]}"""


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text(REGISTRY)
    sensors, pairs = catalogues.read_registry(spark, str(tmp_path / "r.json"))
    assert {r.sensor_id: (r.name, r.elevation, r.depth) for r in sensors.collect()} == {"S001": ("A", 10.5, 0.0), "S002": ("S002", 0.0, 0.0)}
    assert sorted((r.sensor_b, r.speed, r.material) for r in pairs.collect()) == [("S002", 450.0, "PVC"), ("S9", 1200.0, "ductile_iron")]
    assert [r.sensor_b for r in catalogues.dangling(pairs, sensors).collect()] == ["S9"]
    catalogues.registry_json(sensors, pairs).coalesce(1).write.text(str(tmp_path / "out"))
    s2, p2 = catalogues.read_registry(spark, str(tmp_path / "out"))
    assert sorted(s2.collect()) == sorted(sensors.collect()) and p2.count() == 2
    new = sensors.filter("sensor_id = 'S001'").withColumn("name", catalogues.F.lit("B"))
    assert {r.sensor_id: r.name for r in catalogues.upsert(sensors, new, "sensor_id").collect()} == {"S001": "B", "S002": "S002"}


def test_labels_and_xml(spark, tmp_path):
    (tmp_path / "l.csv").write_text("file,leak_found\na/one.wav,no\ntwo.wav,yes\nb/one.wav,yes\n")
    assert {r.base: r.leak_found for r in catalogues.read_labels(spark, str(tmp_path / "l.csv")).collect()} == {"one": "yes", "two": "yes"}
    (tmp_path / "c.xml").write_text('<all><loggers><logger id="1" owner="x"/><logger id="2" owner="y"/></loggers><recordings><recording><id>7</id><recordingType>3</recordingType><gain>9</gain></recording><recording><id>8</id><recordingType>3</recordingType></recording></recordings></all>')
    assert catalogues.read_loggers(spark, str(tmp_path / "c.xml")).count() == 2
    rec = catalogues.read_recordings(spark, str(tmp_path / "c.xml"))
    assert [r.id for r in rec.filter(catalogues.wanted(rec.recordingType, rec.siteidtext, rec.gain)).collect()] == ["7"]
    (tmp_path / "p.txt").write_text("a.wav\n\n b.wav \n")
    assert catalogues.read_paths(spark, str(tmp_path / "p.txt")).count() == 2


def test_estimators(spark):
    pairs = synthetic.sensor_pairs(spark.range(8)).cache()
    for r in estimators.locate(pairs).collect():
        assert abs(r.from_a - r.source_m) < 0.5 and abs(r.from_a + r.from_b - r.length) < 1e-9
    best = {r.pair_id: r.at for r in estimators.detect_many(pairs).filter("place = 1").collect()}
    assert all(abs(best[r.pair_id] - r.source_m) < 1 for r in pairs.collect())
    assert all(abs(r.from_a - r.source_m) < 1 for r in estimators.report(pairs).collect())


def test_generator_does_not_depend_on_partitions(spark):
    a = synthetic.labelled_set(spark.range(10), n=2048).collect()
    b = synthetic.labelled_set(spark.range(10), n=2048).repartition(1).sort("row_id").collect()
    assert sorted(a) == b and len({r.label for r in a}) == 5
    x = np.random.default_rng(0).normal(size=256)
    y = synthetic.surrogate(x, np.random.default_rng(1))
    assert np.allclose(np.abs(np.fft.rfft(x))[1:-1], np.abs(np.fft.rfft(y))[1:-1])


def test_stack_and_classify(spark):
    rng = np.random.default_rng(3)
    t = np.sin(2 * np.pi * 800 * np.arange(4096) / 4096) * np.linspace(0, 1, 4096)
    rows = [(1, i, (t + rng.normal(0, 0.05, 4096)).tolist(), (t + rng.normal(0, 0.05, 4096)).tolist()) for i in range(4)]
    out = estimators.stack_pairs(spark.createDataFrame(rows, "pair_id long, recording_id long, a array<double>, b array<double>"), least_quality=0.0).first()
    assert out.used == 4 and out.gain_db == pytest.approx(6.0206, abs=1e-3) and np.std(np.array(out.a) - t) < 0.05
    rec = spark.createDataFrame([("x.wav", rng.normal(0, 0.3, 40960).tolist(), None), ("y.wav", [0.0] * 100, None), ("z.wav", None, "bad")], "path string, samples array<double>, error string")
    rows = {r.filepath: r for r in catalogues.classification_rows(estimators.classify(rec, np.full(64, 0.05), 1.0)).collect()}
    assert rows["x.wav"].is_leak == 1 and rows["y.wav"].is_leak == 0 and rows["z.wav"].notes == "error:bad"


def test_upper_case_suffix(spark, tmp_path):
    for name in ("a.wav", "b.WAV", "c.txt"):
        (tmp_path / name).write_bytes(wav.encode(np.zeros(10)))
    assert sorted(r.path.rsplit("/", 1)[-1] for r in wav.files(spark, str(tmp_path)).select("path").collect()) == ["a.wav", "b.WAV"]
