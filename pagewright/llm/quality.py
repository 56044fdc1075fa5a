"""Operator 9: a quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text. Pairs (better, worse) of labelled
documents teach the weights: the logistic loss of the difference of their features, so that
sigmoid(score difference) is the probability that one is preferred. The threshold is a quantile of the scores of
all documents. Its level is the share of poor documents that is to be expected among all of them: the mean, over all rows, of the probability
of being poor that a logistic curve, fitted to the labelled sample, gives to the score.

The weights and the curve are fitted on the driver to at most `max_labelled` labelled documents drawn by a hash of
their id. Scores, their quantile and the level cover all rows. Every row is scored once: what is kept is chosen by the scores that the
quantile was taken from.

Defined cases: null and empty texts score as a text without any letter, and a null text is dropped
where junk is; labels that are null or of no document play no part; without labels of both kinds everything is kept;
repeated rows are scored each; extra columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import finished, fresh, give_back, materialise, projected, scratch, small_batches

MAX_LABELLED = 4_000
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOUD = b"!#$%&*|<>{}\\^~=@"


def text_features(texts: list[str | None]) -> np.ndarray:
    """A row of features for each text: its bytes' kinds, its words' lengths and how much they repeat."""
    out = np.zeros((len(texts), 14))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        n = max(len(raw), 1)
        h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper, lower = h[65:91].sum(), h[97:123].sum() + h[128:].sum()
        words = (t or "").split()
        k = max(len(words), 1)
        kinds = len(set(words))
        loud = [h[b] / n for b in _LOUD]
        packed = len(zlib.compress(raw, 1)) if raw else 0
        out[i] = (
            upper / max(upper + lower, 1), (upper + lower) / n, h[48:58].sum() / n, sum(h[b] for b in _SIGNS) / n, sum(loud), max(loud),
            (h[32] + h[9]) / n, h[10] / n, kinds / k, packed / n, min(n / k, 50.0), np.log1p(n), kinds / k**0.75, packed / n**0.85,
        )
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    curve: tuple[float, float] | None  # slope and offset of the log odds of being poor; None: everything is good
    threshold: float = -np.inf

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Added up feature by feature, so that a text's score is the same to the last bit whatever texts are scored with it."""
        z = np.clip((text_features(texts) - self.mean) / self.scale, -8, 8)
        return sum((z[:, k] * w for k, w in enumerate(self.weights)), np.zeros(len(z)))


def fit(texts: list[str | None], good: np.ndarray, pairs: int = 40_000, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> QualityModel:
    """Weights from preference pairs drawn among the labelled texts, and the curve of being poor."""
    x = text_features(texts)
    good = np.asarray(good, bool)
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(14), np.ones(14))
    if not good.any() or good.all():
        return QualityModel(mean, scale, np.zeros(len(mean)), None)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(np.nonzero(good)[0], pairs), rng.choice(np.nonzero(~good)[0], pairs)
    d = z[better] - z[worse]
    w = np.zeros(z.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = ((1 - p) @ d) / pairs - decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return QualityModel(mean, scale, w, _curve(z @ w, good))


def _curve(score: np.ndarray, good: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the log odds of being poor, by Newton's method; the ridge keeps them finite where the kinds part wholly."""
    middle, spread = score.mean(), score.std() + 1e-9
    x, y, w = np.stack(((score - middle) / spread, np.ones(len(score))), 1), (~good).astype(float), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return projected(labels, lid=id_col, y=label_col).where("lid is not null and y is not null").groupBy("lid").agg(F.max("y").alias("y"))


def fit_labelled(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED,
) -> QualityModel:
    """The model of at most max_labelled labelled documents, without a threshold."""
    texts = projected(docs, id=id_col, text=text_col)
    here = texts.select(F.col("id").alias("lid")).distinct()
    drawn = _known(labels, id_col, label_col).join(here, "lid", "left_semi").orderBy(F.xxhash64("lid"), "lid").limit(max_labelled)
    rows = texts.join(F.broadcast(drawn), texts["id"] == drawn["lid"]).select("lid", "text", "y").dropDuplicates(["lid"]).collect()
    rows.sort(key=lambda r: str(r["lid"]))
    return fit([r["text"] for r in rows], np.array([r["y"] == 1 for r in rows], bool))


def with_threshold(model: QualityModel, scored: DataFrame, score_col: str = "score") -> QualityModel:
    """The model with its threshold, a quantile of the scores of all rows of a scored table."""
    if model.curve is None:
        return model
    own, (slope, offset) = projected(scored, s=score_col), model.curve
    level = own.agg(F.avg(1 / (1 + F.exp(-(F.col("s") * slope + offset))))).first()[0]
    found = own.agg(F.percentile_approx("s", float(level), 100_000)).first()[0] if level else None
    return replace(model, threshold=-np.inf if found is None else found)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED,
) -> QualityModel:
    """The model with its threshold, for other documents."""
    model = fit_labelled(docs, labels, id_col, text_col, label_col, max_labelled)
    with scratch(docs.sparkSession):
        own = "score" + "_" * (id_col.lower() == "score")
        scored, _ = materialise(score(docs, model, id_col, text_col), "quality-scores")
        return with_threshold(model, scored, own)


def _scoring(docs: DataFrame, model: QualityModel, text_col: str, score_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for b in slices(whole, at, 8_000_000):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(b.column(at).to_pylist()))], names=schema.names)
        whole = b = None
        give_back()

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row. If the id column is called score, the added one gets an underscore."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = projected(docs, id=id_col, text=text_col)
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("score" + "_" * (id_col.lower() == "score"), T.DoubleType())])

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1, 8_000_000):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()))], names=schema.names)

    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs at or above a model's threshold, all columns kept."""
    own = fresh(docs.columns, "score")
    return _scoring(docs, model, text_col, own).where(F.col(own) >= F.lit(float(model.threshold))).drop(own)


def filter_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """The rows of docs at or above the threshold that they give themselves, all columns kept. They are written with their scores, and
    then chosen."""
    model = fit_labelled(docs, labels, id_col, text_col, label_col, max_labelled)
    if model.curve is None:
        return docs
    own = fresh(docs.columns, "score")
    with small_batches(docs.sparkSession):
        scored, _ = materialise(_scoring(docs, model, text_col, own), "quality-scored")
    model = with_threshold(model, scored, own)
    return scored.where(F.col(own) >= F.lit(float(model.threshold))).drop(own)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score) of all documents that are kept."""

    def make() -> DataFrame:
        docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
        model = fit_labelled(docs, labels)
        scored, _ = materialise(score(docs, model), "quality-scores")
        return scored.where(F.col("score") >= F.lit(float(with_threshold(model, scored).threshold)))

    return finished(spark, make, "quality")
