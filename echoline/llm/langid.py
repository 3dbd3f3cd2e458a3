"""Language identification by multilingual mixture inference.

A document is a bag of letter trigrams (of the UTF-8 bytes of the lower-cased text;
ASCII other than letters is a blank) drawn from a mixture of languages. Expectation-
maximisation estimates the proportions; languages are then taken out one by one, smallest
share first, as long as the likelihood penalised by the number of languages rises. The
prediction is the language with the largest share, and the score that share times the
chance that it beats the best single rival.

Training: trigram counts of each language over a sample of the labelled rows of the
training fold, about ``per_lang`` rows a language, drawn by a digest of id and text. That
bound is the only sampling, and what bounds the model: it holds every trigram of the sample,
one row a language on its way to the driver. Prediction reads whole texts of every row.

Cases: a null text or one without a letter is ``und`` with score 0; a text with letters
but no known trigram gets the most frequent language with its share of the sample; with
nothing to learn from, everything is ``und``; ties go to the language first by name; a null
id counts as the empty text for the folds; extra columns pass through, but those named
like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoline.llm.common import fresh, held_out, slices
from echoline.llm.mixing import uniform

UND = "und"
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_BLANKS = 0x202020


def grams(text: str) -> np.ndarray:
    """Byte trigrams of the text as integers, without all-blank ones."""
    plain = f" {text.lower()} ".encode("utf-8", "surrogatepass").translate(_LETTERS)
    at = np.frombuffer(plain, np.uint8).astype(np.int32)
    codes = at[:-2] << 16 | at[1:-1] << 8 | at[2:]
    return codes[(codes & 0xFFFF != 0x2020) & (codes >> 8 != 0x2020)]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    """Log-probabilities of trigrams by language, and the mixture inference."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], rows: dict[str, int], smoothing: float = 0.5, penalty: float = 3.0):
        self.langs = sorted(rows)
        self.penalty = penalty
        total = sum(rows.values())
        self.prior = np.array([rows[x] / total for x in self.langs])
        known = np.unique(np.concatenate([np.empty(0, np.int32), *(g for g, _ in counts.values())]))
        self.known = known
        table = np.full((len(known), len(self.langs)), smoothing)
        for i, x in enumerate(self.langs):
            gram, n = counts.get(x, ((), ()))
            table[np.searchsorted(known, gram), i] += n
        self.p = table / table.sum(axis=0, keepdims=True)
        self.index: np.ndarray | None = None

    def _features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if self.index is None:
            #: Places from 1; memory that holds zeros alone is never touched.
            self.index = np.zeros(1 << 24, np.int32)
            self.index[self.known] = np.arange(1, len(self.known) + 1)
        found = np.bincount(self.index[grams(text)], minlength=len(self.known) + 1)[1:]
        at = np.flatnonzero(found)
        return at, found[at].astype(float)

    def _fit(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood of the mixture of the columns of ``p``, once the likelihood, which never falls, has settled."""
        share = np.full(p.shape[1], 1 / p.shape[1])
        if p.shape[1] == 1:
            return share, float(n @ np.log(p[:, 0]))
        total, last = n.sum(), -np.inf
        for step in count():
            mixed = p @ share
            if step % 4 == 3:
                now = float(n @ np.log(mixed))
                if now - last < 1e-3 * abs(now) / 100:
                    break
                last = now
            share = share * ((n / mixed) @ p) / total
        return share, float(n @ np.log(np.maximum(p @ share, 1e-300)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UND, 0.0
        at, n = self._features(text)
        if not len(at):
            best = int(np.argmax(self.prior))
            return self.langs[best], float(self.prior[best])
        p = self.p[at]
        #: A letter is in three trigrams, so a trigram weighs a third.
        weight, cost = 1 / 3, self.penalty * np.log(n.sum() + 1)
        single = (n @ np.log(p)) * weight
        order = np.argsort(-single, kind="stable")
        rival = single[order[0]] - single[order[1]] if len(order) > 1 else np.inf
        sure = 1 / (1 + np.exp(-min(rival, 50.0)))
        chosen = np.arange(len(self.langs))
        share, like = self._fit(p, n)
        best_set, best_share, best_value = order[:1], np.ones(1), single[order[0]] - cost
        while len(chosen) > 1:
            value = like * weight - cost * len(chosen)
            if value > best_value:
                best_set, best_share, best_value = chosen, share, value
            if like * weight - 2 * cost <= best_value:  # a subset's likelihood is not higher
                break
            keep = np.sort(np.argsort(-share, kind="stable")[:-1])
            chosen = chosen[keep]
            share, like = self._fit(p[:, chosen], n)
        top = int(np.argmax(best_share))
        alone = len(best_set) == 1
        return self.langs[int(best_set[top])], float(best_share[top] * (sure if alone else 1.0))


def train(docs: DataFrame, per_lang: int = 1500, **options) -> Model:
    """Learns from text and non-null lang of the training fold (crc32 of the id modulo 4 is not 2)."""
    fold = docs.filter(~held_out(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = {r[0]: r[1] for r in fold.groupBy("lang").count().collect()}
    if not rows:
        return Model({}, {})
    names = sorted(rows)
    chance = fold.sparkSession.createDataFrame([(x, min(1.0, per_lang / rows[x])) for x in names], "lang_name string, chance double")
    drawn = fold.select("lang", "text", uniform("langid", F.col("doc_id"), F.md5("text")).alias("u"))
    sample = drawn.join(F.broadcast(chance), F.col("lang") == F.col("lang_name")).filter("u <= chance").select("lang", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, []).append(grams(text))
        for lang, parts in found.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int32()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    def packed(table: pa.Table) -> pa.Table:
        return pa.table({"lang": table["lang"][:1], "gram": [table["gram"].to_numpy().tobytes()], "n": [table["n"].to_numpy().tobytes()]})

    counted = sample.mapInArrow(tally, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang = counted.groupBy("lang").applyInArrow(packed, "lang string, gram binary, n binary").collect()
    return Model({r[0]: (np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.int64)) for r in by_lang}, rows, **options)


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, which replace columns of those names; only the text is read."""
    passed = [c for c in docs.columns if c.lower() not in {lang.lower(), score.lower()}]
    (body,) = fresh(docs, "body")
    at = len(passed)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in slices(batches):
            found = [judge.predict(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *new], names=[*batch.schema.names[:at], lang, score])

    slim = docs.select(*passed, F.col("text").alias(body))
    schema = T.StructType([*slim.drop(body).schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return slim.mapInArrow(run, schema)


def judged(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    slim = docs.select("doc_id", "text")
    out = predict(slim, train(docs, **options))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def filter_language(docs: DataFrame, min_score: float = 0.4, **options) -> DataFrame:
    """The rows whose main language holds ``min_score`` of the text at least; ``und`` goes. Columns as in ``docs``."""
    lang, score = fresh(docs, "lang_pred", "score")
    out = predict(docs, train(docs, **options), lang, score)
    return out.filter((F.col(lang) != UND) & (F.col(score) >= min_score)).select(*docs.columns)
