"""A quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

1. Each whole text becomes the statistics of `FEATURES`, in one scan that keeps numbers only.
2. Labelled documents are split by a hash of doc_id: CALIBRATION of them calibrate, the rest fit. At most FIT_ROWS of
   these, chosen by the hash, are used.
3. Standardised statistics x become sqrt(2 / DIMENSIONS) cos(W x + b) with Gaussian W and uniform b, whose dot products
   approximate a Gaussian kernel of width WIDTH (Rahimi and Recht, 2007). Each partition sums its part of Z'Z and Z'y;
   the sums of these give the ridge weights.
4. On the calibration documents, scores in SCORE_BINS bins and the labels give rising levels by pool adjacent violators.
   The probability of being good is the straight line between the levels at the mean scores of their blocks.
5. All documents are scored from the table of statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize, scratch
from . import quality_rules
from . import textkit as tk
from .common import id_kind, need, own_id, texts

FEATURES = ("log_chars", "word_chars", "variety", "line_words", "spaces", "stops", "accents", "ones", "markup", "upper", "digits", "echo", "relines")
FIT_ROWS, CALIBRATION, DIMENSIONS, WIDTH, RIDGE, SEED, SCORE_BINS, KEEP = 400_000, 0.3, 256, 4.0, 1e-3, 7, 10_000, 0.5
_PART_ROWS = 20_000
_TYPES = ", ".join(f"{c} double" for c in FEATURES)


def statistics(column: pa.Array) -> np.ndarray:
    """n x len(FEATURES): of each text, log(1 + characters), mean characters a word, distinct share of words, words a line / 100,
    shares of characters that are white space, stops (. , ; : ?) or beyond ASCII, share of one-letter words, and the shares of the quality rules."""
    shares = quality_rules.measure(column)
    data, offsets = tk.utf8(column)
    w = tk.words(column)
    n = len(offsets) - 1
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    chars = tk.row_sums((data & 0xC0) != 0x80, offsets)
    words = np.bincount(w.doc, minlength=n)
    lead = np.append(0, np.cumsum((w.data & 0xC0) != 0x80))
    long = lead[w.end] - lead[w.start]
    order = np.lexsort((w.hash, w.doc))
    doc, h = w.doc[order], w.hash[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    stop = np.isin(np.arange(256), [46, 44, 59, 58, 63])
    own = {
        "log_chars": np.log1p(chars),
        "word_chars": ratio(np.bincount(w.doc, weights=long, minlength=n), words),
        "variety": ratio(np.bincount(doc[new], minlength=n), words),
        "line_words": words / (1 + tk.row_sums(data == 10, offsets)) / 100,
        "spaces": ratio(tk.row_sums((data == 32) | (data == 10) | (data == 9) | (data == 13), offsets), chars),
        "stops": ratio(tk.row_sums(stop[data], offsets), chars),
        "accents": ratio(tk.row_sums(data >= 0xC0, offsets), chars),
        "ones": ratio(np.bincount(w.doc, weights=long == 1, minlength=n), words),
        **shares,
    }
    return np.stack([own[f] for f in FEATURES], axis=1)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.chunks(batch, "text"):
            x = statistics(part.column(part.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["doc_id", *FEATURES])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of each row with a doc_id and a text."""
    return texts(docs).mapInArrow(_featured, f"doc_id {id_kind(docs)}, {_TYPES}")


@dataclass(frozen=True)
class Model:
    """mean, scale: of the statistics; waves, phase: of the features; weights (the last is the constant); centres, levels: the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.scale) @ self.waves + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.features(x) @ self.weights, 6) + 0.0

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.centres, self.levels)


def _bin(score: np.ndarray) -> np.ndarray:
    """0 to SCORE_BINS - 1 for scores from -0.5 to 1.5."""
    return np.clip(np.floor((score + 0.5) / 2 * SCORE_BINS), 0, SCORE_BINS - 1).astype(np.int64)


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The rising sequence closest to total / weight in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, t in zip(weight.tolist(), total.tolist()):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.repeat([b[1] / b[0] for b in blocks], [int(b[2]) for b in blocks])


def calibration(weight: np.ndarray, total: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, levels): of each block of equal level its mean score and its level. weight, total, score: documents, good ones and summed scores by bin."""
    level = isotonic(weight, total)
    first = np.flatnonzero(np.append(True, level[1:] != level[:-1]))
    return np.add.reduceat(score, first) / np.add.reduceat(weight, first), level[first]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1)


def _normal(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(model.phase) + 1
        left, right = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                z = model.features(_matrix(piece))
                left += z.T @ z
                right += z.T @ piece.column(piece.schema.get_field_index("good")).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], ["a", "b"])

    return run


def _scored(model: Model, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                piece = batch.slice(at, 8192)
                score = model.scores(_matrix(piece))
                p = model.probabilities(score)
                yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("doc_id")), pa.array(score), pa.array(p), pa.array(p >= keep)], ["doc_id", "score", "probability", "keep"])

    return run


def _labelled(table: DataFrame, labels: DataFrame) -> DataFrame:
    known = need(labels, ("doc_id", "quality")).where("doc_id is not null and quality is not null").groupBy(own_id(labels)).agg((F.min("quality") >= 1).cast("double").alias("good"))
    return table.join(known, "doc_id").withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30))


def train(table: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, dimensions: int = DIMENSIONS, width: float = WIDTH, ridge: float = RIDGE) -> Model | None:
    """A model from `featured` documents and labels (doc_id, quality); None without labelled documents to fit and calibrate.

    A doc_id is good if all its labels that aren't null are; each of its rows counts.
    """
    known = materialize(_labelled(table, labels), "classifier-labelled")
    n = known.where(F.col("draw") >= CALIBRATION).count()
    share = min(1.0, fit_rows / n) if n else 0.0
    fit = known.where((F.col("draw") >= CALIBRATION) & (F.col("draw") < CALIBRATION + (1 - CALIBRATION) * share))
    first = fit.agg(F.count("*").alias("n"), *(f(c).alias(f"{m}_{c}") for c in FEATURES for m, f in (("mean", F.avg), ("scale", F.stddev_pop)))).first()
    if not first["n"]:
        return None
    rng = np.random.default_rng(SEED)
    scale = np.array([first[f"scale_{c}"] for c in FEATURES])
    none = np.zeros(0)
    model = Model(np.array([first[f"mean_{c}"] for c in FEATURES]), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / width, (len(FEATURES), dimensions)), rng.uniform(0, 2 * np.pi, dimensions), none, none, none)
    parts = max(1, -(-first["n"] // _PART_ROWS))
    sums = fit.repartition(parts, "doc_id").mapInArrow(_normal(model), "a binary, b binary").collect()  # at most FIT_ROWS / _PART_ROWS
    d = dimensions + 1
    left = sum(np.frombuffer(s["a"]).reshape(d, d) for s in sums)
    right = sum(np.frombuffer(s["b"]) for s in sums)
    weights = np.linalg.solve(left + ridge * first["n"] / d * np.eye(d), right)
    model = Model(model.mean, model.scale, model.waves, model.phase, weights, none, none)
    held = known.where(F.col("draw") < CALIBRATION)
    binned = held.mapInArrow(_binned(model), "bin long, score double, good double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("score").alias("score")).orderBy("bin").collect()  # SCORE_BINS at most
    if not binned:
        return None
    centres, levels = calibration(*(np.array([r[c] for r in binned], dtype=float) for c in ("n", "good", "score")))
    return Model(model.mean, model.scale, model.waves, model.phase, weights, centres, levels)


def _binned(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.scores(_matrix(batch))
                yield pa.RecordBatch.from_arrays([pa.array(_bin(score)), pa.array(score), batch.column(batch.schema.get_field_index("good"))], ["bin", "score", "good"])

    return run


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **options) -> DataFrame:
    """A row for each row of docs with a doc_id and a text: doc_id, score, probability (of being good), keep (probability >= keep).

    Empty texts are scored like others, by statistics of 0. Repeated rows get equal rows. Other columns play no part. Without labels to
    learn from, score and probability are null and keep is true. An empty table gives no rows. doc_id is as in `common.id_kind`.
    """
    table = materialize(featured(docs), "classifier-statistics", keep=True)
    with scratch(docs.sparkSession):
        model = train(table, labels, **options)
    if model is None:
        return table.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("probability"), F.lit(True).alias("keep"))
    return table.mapInArrow(_scored(model, keep), f"doc_id {id_kind(table)}, score double, probability double, keep boolean")
