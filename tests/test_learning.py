import numpy as np
import pytest
from pyspark.sql import functions as F

from echoline.functions.register import register
from echoline.operators import estimators, learning
from echoline.sources import datasets, synthetic, wav


def test_network_size_and_shapes():
    net = learning.new_network(5)
    assert sum(w.size for w in net.values()) == 618_758
    classes, leak = learning.forward(net, np.random.default_rng(0).normal(size=(3, 64, 1)))
    assert classes.shape == (3, 5) and leak.shape == (3,)
    soft = learning.probabilities(classes, leak, 2, "softmax")
    assert np.allclose(learning.probabilities(classes, leak, 2), (soft + 1 / (1 + np.exp(-leak))) / 2)


def test_convolution_against_loops():
    rng = np.random.default_rng(1)
    x, w, b = rng.normal(size=(2, 3, 5, 4)), rng.normal(size=(2, 3, 3, 3)), rng.normal(size=2)
    wide = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    want = np.array([[[[max(0, (wide[n, :, i : i + 3, j : j + 3] * w[o]).sum() + b[o]) for j in range(4)] for i in range(5)] for o in range(2)] for n in range(2)])
    assert np.allclose(learning._conv(x, w, b), want)


def test_training_and_classification(spark):
    data = synthetic.labelled_set(spark.range(120), n=8192).cache()
    f = learning.weighted(learning.binary_labels(data.withColumn("features", learning.mel_features(F.col("samples")))))
    model = learning.fit(f)
    scored = model.transform(f.withColumn("v", learning.array_to_vector("features")))
    right = scored.filter("prediction = target").count() / scored.count()
    assert right > 0.9
    weights, bias = learning.weights_of(learning.tune(f, (0.01, 0.1)))
    out = estimators.classify(data.select(F.col("row_id").cast("string").alias("path"), "samples", F.lit(None).cast("string").alias("error")), weights, bias, frac=0.1)  # two of ten seconds sound
    assert out.filter("leak").count() > 0 and all(len(r.longs) == 40 for r in out.select("longs").collect())
    net = learning.new_network(2)
    p = data.select(learning.network_scores(learning.mel_features(F.col("samples")), net, 64, 1).alias("p")).collect()
    assert all(0 <= r.p <= 1 for r in p)


def test_dataset_build(spark, tmp_path):
    rng = np.random.default_rng(2)
    for split in ("train", "val"):
        for label in ("LEAK", "NORMAL"):
            folder = tmp_path / split / label
            folder.mkdir(parents=True)
            (folder / f"{split}{label}.wav").write_bytes(wav.encode(rng.normal(0, 0.1, 30000)))
    (tmp_path / "train" / "LEAK" / "bad.wav").write_bytes(b"no")
    rejects = datasets.build(spark, {s: str(tmp_path / s) for s in ("train", "val")}, str(tmp_path / "out"))
    assert [r.split for r in rejects.collect()] == ["train"]
    rows = spark.read.parquet(str(tmp_path / "out")).filter("error IS NULL")
    assert rows.count() == 4 * 80 and {(r.label, r.label_id) for r in rows.select("label", "label_id").distinct().collect()} == {("LEAK", 0), ("NORMAL", 1)}
    first = rows.filter("split = 'val'").first()
    assert len(first.waveform) == 512 and len(first.mel) == 64
    datasets.check_ratios(datasets.RATIOS)
    with pytest.raises(ValueError, match="sum"):
        datasets.check_ratios((0.5, 0.6))


def test_standardise_normalise_copy(spark):
    rng = np.random.default_rng(4)
    base = {"leak_found": "yes", "siteid": "s", "recording_id": "r", "datetime": "2018-12-16 04:30:00", "noise": "", "spread": "-1", "repaired_as": "Main"}
    rows = [{"path": p, "sample_rate": r, "samples": rng.normal(0, 0.1, n).tolist(), **base} for p, r, n in (("long", 4096, 60000), ("short", 4096, 1000), ("fast", 8192, 81920), ("none", 4096, 0))]
    df = spark.createDataFrame(rows, "path string, sample_rate int, samples array<float>, leak_found string, siteid string, recording_id string, datetime string, noise string, spread string, repaired_as string")
    out = {(r.path, r.name): len(r.samples) for r in datasets.standardised(df).collect()}
    stem = "leak~s~r~2018_12_16_04_30_00~100~0~0~main"
    assert out == {("long", f"{stem}_part1.wav"): 40960, ("long", f"{stem}_part2.wav"): 40960, ("short", f"{stem}_padded.wav"): 40960, ("fast", f"{stem}.wav"): 40960}
    n = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.5, -0.25]), ("c", [0.95, 0.1]), ("x/_quarantine/d", [0.5])], "path string, samples array<float>")
    got = {r.path: (r.status, [round(v, 4) for v in r.samples]) for r in datasets.normalised(n).collect()}
    assert got == {"a": ("skip_zero", [0, 0]), "b": ("normalise", [0.98, -0.49]), "c": ("skip_already", [0.95, 0.1])}
    files = spark.createDataFrame([("s1", b"one", "t1"), ("s2", b"two", "t2")], "path string, content binary, target string")
    there = spark.createDataFrame([("t1", b"one"), ("t2", b"tw0")], "target string, content binary")
    assert {r.target: (r.skipped_existing, r.same) for r in datasets.copy_verified(files, there).collect()} == {"t1": (True, True), "t2": (False, False)}
    assert datasets.copy_verified(files).filter("skipped_existing").count() == 0


def test_sql_functions(spark):
    assert "acoustic_gcc_phat" in register(spark)
    row = spark.sql("SELECT acoustic_gcc_phat(array(1D, 2D, 3D, 0D), array(1D, 2D, 3D, 0D)) AS r, acoustic_envelope(CAST(NULL AS array<double>)) AS n").first()
    assert len(row.r) == 7 and int(np.argmax(row.r)) == 3 and row.n is None
