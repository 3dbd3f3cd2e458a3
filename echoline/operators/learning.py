"""Classifiers over log-mel frames: Spark ML training, and inference with a small convolutional network in NumPy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.functions import constants as K
from echoline.functions import dsp
from echoline.operators.kernels import array_kernel


def mel_features(samples: Column, rate: float = K.SAMPLE_RATE) -> Column:
    """Mean log-mel frame of the short segments of a recording."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1] // K.SHORT_WINDOW * K.SHORT_WINDOW
        x = x[:, :n] if n else np.pad(x, ((0, 0), (0, K.SHORT_WINDOW - x.shape[1])))
        return dsp.log_mel(x.reshape(-1, K.SHORT_WINDOW), rate)[:, 0].reshape(len(x), -1, 64).mean(axis=1)

    return array_kernel(run, samples)


def binary_labels(labelled: DataFrame, positive: str = "LEAK") -> DataFrame:
    return labelled.withColumn("target", (F.upper("label") == positive).cast("double"))


def weighted(labelled: DataFrame, boost: float = 2.5) -> DataFrame:
    """Inverse class frequencies with mean 1, the positive class boosted; the two class counts are sent to all tasks."""
    n = labelled.groupBy("target").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    w = n.crossJoin(F.broadcast(total)).select("target", (F.col("total") / (F.col("n") * F.col("classes")) * F.when(F.col("target") == 1, boost).otherwise(1.0)).alias("weight"))
    return labelled.join(F.broadcast(w), "target")


def fit(features: DataFrame, reg: float = 0.01, rounds: int = 50) -> LogisticRegressionModel:
    """``features``: features (array), target, weight."""
    vectors = features.withColumn("v", array_to_vector("features"))
    return LogisticRegression(featuresCol="v", labelCol="target", weightCol="weight", regParam=reg, maxIter=rounds).fit(vectors)


def tune(features: DataFrame, regs: Sequence[float] = (0.001, 0.01, 0.1), seed: int = 42) -> LogisticRegressionModel:
    """The best of a grid on a held-out fifth, by area under the curve."""
    vectors = features.withColumn("v", array_to_vector("features"))
    model = LogisticRegression(featuresCol="v", labelCol="target", weightCol="weight", maxIter=50)
    grid = ParamGridBuilder().addGrid(model.regParam, list(regs)).build()
    split = TrainValidationSplit(estimator=model, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="target"), trainRatio=0.8, seed=seed)
    return split.fit(vectors).bestModel


def weights_of(model: LogisticRegressionModel) -> tuple[np.ndarray, float]:
    """What ``estimators.classify`` takes."""
    return np.array(model.coefficients.toArray()), float(model.intercept)


# A network of three 3 x 3 convolutions, two pools over frequency, an adaptive pool to 16 x 1, a dense layer and two heads.

_CHANNELS = (1, 32, 64, 128)


def new_network(classes: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Random weights by name; 618,758 numbers for five classes."""
    rng = np.random.default_rng(seed)
    shapes = {f"conv{i}": (_CHANNELS[i + 1], _CHANNELS[i], 3, 3) for i in range(3)} | {"dense": (256, 2048), "classes": (classes, 256), "leak": (1, 256)}
    out = {}
    for name, shape in shapes.items():
        out[name] = rng.normal(0, np.sqrt(2 / np.prod(shape[1:])), shape)
        out[f"{name}_bias"] = np.zeros(shape[0])
    return out


def _conv(x: np.ndarray, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1))), (3, 3), axis=(2, 3))
    return np.maximum(np.einsum("nchwij,ocij->nohw", view, w, optimize=True) + bias[:, None, None], 0)


def forward(net: dict[str, np.ndarray], mel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``mel``: [n, mels, frames]. Logits of the classes and of the leak head."""
    x = mel[:, None].astype(float)
    for i in range(3):
        x = _conv(x, net[f"conv{i}"], net[f"conv{i}_bias"])
        if i < 2:
            x = x[:, :, : x.shape[2] // 2 * 2].reshape(*x.shape[:2], -1, 2, x.shape[3]).max(axis=3)
    edges = [(x.shape[2] * i // 16, -(-x.shape[2] * (i + 1) // 16)) for i in range(16)]
    pooled = np.stack([x[:, :, a:b].mean(axis=(2, 3)) for a, b in edges], axis=2).reshape(len(x), -1)
    h = np.maximum(pooled @ net["dense"].T + net["dense_bias"], 0)
    return h @ net["classes"].T + net["classes_bias"], (h @ net["leak"].T + net["leak_bias"])[:, 0]


def probabilities(classes: np.ndarray, leak: np.ndarray, index: int, mode: str = "blend") -> np.ndarray:
    """Chance of the leak class: softmax, sigmoid of the leak head, or the mean of both."""
    e = np.exp(classes - classes.max(axis=1, keepdims=True))
    soft, sig = (e / e.sum(axis=1, keepdims=True))[:, index], 1 / (1 + np.exp(-leak))
    return {"softmax": soft, "sigmoid": sig, "blend": (soft + sig) / 2}[mode]


def network_scores(mel: Column, net: dict[str, np.ndarray], mels: int, index: int, mode: str = "blend", batch: int = 256) -> Column:
    """Chance of a leak for each flattened [mels, frames] array, in micro-batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(x), batch):
            block = np.stack(x.iloc[i : i + batch].to_list()).reshape(-1 if len(x.iloc[i : i + batch]) else 0, mels, len(x.iloc[i]) // mels)
            out.append(probabilities(*forward(net, block), index, mode))
        return pd.Series(np.concatenate(out) if out else [])

    return run(mel)
