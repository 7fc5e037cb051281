"""Quality classifier: random Fourier features, ridge from summed normal equations, isotonic calibration."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_keep, arrow_map, store, table

#: The statistics of a text that a score may use; they don't know doc_id, source, lang or labels.
STATISTICS = (
    "log_bytes", "upper", "lower", "digits", "blanks", "newlines", "stops", "quotes", "pipes", "symbols", "beyond_ascii",
    "log_words", "mean_word", "distinct_words", "adjacent_repeats", "distinct_lines", "log_mean_line", "ended_lines", "symbol_ends", "upper_starts",
)

#: Up to so many ids (16 bytes each) are broadcast.
BROADCAST_IDS = 1_000_000


def statistics(text: str | None) -> np.ndarray:
    """STATISTICS of the whole text; null and empty texts are all zero."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(len(STATISTICS))
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    share = lambda chars: float(hist[list(chars)].sum())
    words = raw.split()
    n_words = max(1, len(words))
    lines = raw.split(b"\n")
    ends = b"".join(w[-1:] for w in words)
    starts = b"".join(w[:1] for w in words)
    symbols = b"!#$%&*+/<=>@[\\]^_`{}~"
    return np.array([
        np.log1p(n), hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum(), share(b" \t"), hist[10], share(b".,;:?"), share(b"\"'()-"), hist[124], share(symbols), hist[128:].sum(),
        np.log1p(len(words)), sum(map(len, words)) / n_words, len(set(words)) / n_words, sum(map(operator.eq, words, words[1:])) / n_words,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(x.endswith((b".", b"?", b"!")) for x in lines) / len(lines),
        sum(map(ends.count, (bytes([c]) for c in symbols))) / n_words, sum(65 <= c <= 90 for c in starts) / n_words,
    ])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and statistics (array<double>) of every row."""

    def kernel(cols: dict):
        yield {"doc_id": cols["doc_id"], "statistics": [statistics(t).tolist() for t in cols["text"]]}

    return arrow_map(docs.select("doc_id", "text"), kernel, "doc_id long, statistics array<double>", batch_rows=256)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, whose products approximate exp(-|a-b|^2 / (2 width^2)), and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phases
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z), np.ones((len(x), 1))])

    def ridge_scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge_scores(x), *self.knots), 0.0, 1.0)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and block means, both rising."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(scores[order], labels[order], strict=True):
        blocks.append([s, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            s2, y2, n2 = blocks.pop()
            s1, y1, n1 = blocks[-1]
            n = n1 + n2
            blocks[-1] = [(s1 * n1 + s2 * n2) / n, (y1 * n1 + y2 * n2) / n, n]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def fit(training: DataFrame, n_features: int = 256, width: float = 4.0, ridge: float = 1e-3, max_rows: int = 200_000, seed: int = 20) -> QualityModel:
    """Fit on rows of (doc_id, statistics, label in 0..1).

    At most about max_rows rows take part, those whose hash of doc_id is smallest; all do if there are no more.  Each
    partition sums its part of the normal equations, and the driver adds the sums of at most 16 partitions (each
    (n_features + 1)^2 numbers) and solves them.  The ridge scores of the same bounded rows fit the calibration.
    Without training rows every score is 0.5; with one class every score is that class.
    """
    n_rows = training.count()
    if n_rows > max_rows:
        training = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n_rows))
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(d, n_features)) / width, rng.uniform(0, 2 * np.pi, n_features)
    blank = QualityModel(np.zeros(d), np.ones(d), directions, phases, np.zeros(n_features + 1), (np.array([0.0]), np.array([0.5])))
    training = store(training.repartition(16, "doc_id").select("statistics", F.col("label").cast("double").alias("label")), "quality-training")

    def sums(rows: DataFrame, of, size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    total += of(np.array(b.column(0).to_pylist()), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        return sum((np.frombuffer(r.total) for r in rows.mapInArrow(run, "total binary").collect()), np.zeros(size))

    moments = sums(training, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    n, positive = moments[:2]
    if not n:
        return blank
    if positive in (0, n):
        return QualityModel(**{**blank.__dict__, "knots": (np.array([0.0]), np.array([positive / n]))})
    mean = moments[2 : 2 + d] / n
    spread = np.sqrt(np.maximum(moments[2 + d :] / n - mean**2, 0))
    model = QualityModel(**{**blank.__dict__, "mean": mean, "scale": np.where(spread > 1e-9, spread, 1.0)})

    m = n_features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    total = sums(training, normal, m * m + m)
    weights = np.linalg.solve(total[: m * m].reshape(m, m) + ridge * n * np.eye(m) / n_features, total[m * m :])
    model = QualityModel(**{**model.__dict__, "weights": weights})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.ridge_scores(np.array(b.column(0).to_pylist()))), b.column(1)], ["score", "label"])

    rows = np.array(training.mapInArrow(scored, "score double, label double").collect())
    return QualityModel(**{**model.__dict__, "knots": isotonic(rows[:, 0], rows[:, 1])})


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def truths(labels: DataFrame) -> DataFrame:
    """doc_id and label of the labelled documents that aren't held out."""
    return labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("label"))


def learn(docs: DataFrame, labels: DataFrame, **fitting) -> tuple[DataFrame, QualityModel]:
    """doc_id, held_out and statistics of every row of docs, and the model that score_quality() describes."""
    found = store(document_statistics(docs), "quality-statistics")
    model = fit(found.join(truths(labels), "doc_id").select("doc_id", "statistics", "label"), **fitting)
    return found.select("doc_id", held_out().alias("held_out"), "statistics"), model


def learn_only(docs: DataFrame, labels: DataFrame, max_rows: int = 200_000, **fitting) -> QualityModel:
    """The model of learn(), from statistics of its training rows alone: their ids are chosen before any text is read.

    These are about max_rows ids at most, so that they are broadcast unless max_rows exceeds BROADCAST_IDS.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").count().join(truths(labels), "doc_id")
    n_rows = ids.agg(F.sum("count")).first()[0] or 0
    if n_rows > max_rows:  # as fit() does, which then finds nothing more to leave out
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n_rows))
    ids = store(ids.select("doc_id", "label"), "quality-ids")
    chosen = ids.select("doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen) if max_rows <= BROADCAST_IDS else chosen, "doc_id", "left_semi")
    found = store(document_statistics(texts), "quality-statistics")
    return fit(found.join(ids, "doc_id").select("doc_id", "statistics", "label"), max_rows=max_rows, **fitting)


def good_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **fitting) -> DataFrame:
    """The rows of docs that score_quality() predicts to be good, with all their columns, each decided by its own text.

    Statistics are computed once of each row, and once more of the rows to learn from.
    """
    model = learn_only(docs, labels, **fitting)
    return arrow_keep(docs, ("text",), lambda cols: (model.scores(np.array([statistics(t) for t in cols["text"]])) >= cut).tolist())


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **fitting) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: better) and predicted (1 if score >= cut).

    The model learns from the documents that labels.quality marks and whose crc32(doc_id as text) mod 4 is not 2; the
    others are held out.  Several labels of a document count as their mean, null labels as none.

    Null and empty texts get the score of an empty text.  Rows without doc_id have no label and are not held out;
    repeated doc_ids are rows like others.  Only doc_id and text, and doc_id and quality, are read, so that other
    columns may have any name.  An empty table gives an empty result; without labels every score is 0.5.
    """
    found, model = learn(docs, labels, **fitting)

    def kernel(cols: dict):
        scores = model.scores(np.array(cols["statistics"])) if cols["doc_id"] else np.zeros(0)
        yield {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": scores, "predicted": (scores >= cut).astype(np.int32)}

    return arrow_map(found, kernel, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
