"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its words' features (the
word itself and its beginnings); a document's is the noisy-or of its sentences'. Only documents are
labelled: the weights are found by gradient ascent on the documents' likelihood through the noisy-or, which
lays the blame on the sentences that explain it. Those sentences are then located.

The model is fitted on the driver to at most `max_labelled` labelled documents, drawn by a hash of their
id; it scores all documents where they lie, without a shuffle. Features may speak for toxicity or against it; a sentence in which none
speaks for it has probability 0, so that length alone makes no document toxic.

Defined cases: null, empty and wordless texts score 0 and are kept; labels that are null, or of documents
that aren't there, play no part; without labels of both kinds nothing is toxic; repeated rows are scored
each; extra columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import col, give_back, projected

MAX_LABELLED = 6_000
PREFIXES = (3, 4, 5, 6)
_SENTENCE = re.compile(r"[^.!?\n]*[^.!?\s][^.!?\n]*[.!?]*")
_EDGE = re.compile(r"^\W+|\W+$")


def features(token: str) -> list[str]:
    """The word within a token, and its beginnings."""
    word = _EDGE.sub("", token)
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)] if word else []


def sentences(text: str) -> list[tuple[int, str]]:
    """Sentences and where they start."""
    return [(m.start(), m.group()) for m in _SENTENCE.finditer(text)]


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    threshold: float


class _Scores(dict):
    """A token's weight and whether any of its features speaks for toxicity, worked out when it is first met."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __missing__(self, token: str) -> tuple[float, bool] | None:
        found = [self.weights[f] for f in features(token) if f in self.weights]
        if len(self) > 400_000:
            self.clear()
        self[token] = value = (sum(found), max(found) > 0) if found else None
        return value


class _Numbers(dict):
    """The model's features of a token, worked out when it is first met."""

    def __init__(self, number: dict[str, int]) -> None:
        self.number = number

    def __missing__(self, token: str) -> tuple[int, ...]:
        self[token] = value = tuple(self.number[f] for f in features(token) if f in self.number)
        return value


def located(text: str | None, scores: _Scores, bias: float) -> tuple[float, list[tuple[int, int, str, float]]]:
    """A document's probability, and (number, start, sentence, probability) of the sentences with features."""
    if not text:
        return 0.0, []
    low = text.lower()
    if len(low) != len(text):  # a letter that lower case makes longer: places must stay
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    if not any(x and x[1] for x in map(scores.__getitem__, set(low.split()))):
        return 0.0, []
    out, no = [], 1.0
    for k, (start, sentence) in enumerate(sentences(low)):
        found = [x for x in map(scores.__getitem__, sentence.split()) if x]
        if any(x[1] for x in found):
            p = 1 / (1 + np.exp(-np.clip(bias + sum(x[0] for x in found), -30, 30)))
            no *= 1 - p
            out.append((k, start, text[start : start + len(sentence)], float(p)))
    return float(1 - no), out


def likelihood(w: np.ndarray, b: float, feature: np.ndarray, sentence: np.ndarray, document: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The mean log likelihood of documents' labels under the noisy-or of their sentences, and its slopes for the weights and the
    bias. feature and sentence: each occurrence's; document: each sentence's. A document without any sentence adds nothing."""
    n = len(document)
    p = 1 / (1 + np.exp(-np.clip(b + np.bincount(sentence, w[feature], n), -30, 30)))
    none = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-9)), len(toxic))
    doc_p = np.maximum(-np.expm1(none), 1e-9)
    slope = np.where(toxic[document], p * ((1 - doc_p) / doc_p)[document], -p)  # at each sentence's score
    known = np.bincount(document, minlength=len(toxic)) > 0
    total = np.where(toxic, np.log(doc_p), none)[known].sum()
    return total / len(toxic), np.bincount(feature, slope[sentence], len(w)) / len(toxic), slope.sum() / len(toxic)


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 5e-5, least: int = 4, z_least: float = 3.5) -> ToxicityModel:
    """Fit the weights, and on a fifth of the documents that is held out the threshold."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return ToxicityModel({}, 0.0, 1.0)
    held = np.arange(len(texts)) % 5 == 4
    if not (toxic & held).any() or not (toxic & ~held).any() or (toxic | held).all() or (toxic | ~held).all():
        held[:] = False
    with_, without = Counter(), Counter()
    for t, y, h in zip(texts, toxic, held):
        if not h:
            (with_ if y else without).update({f for w in set(t.lower().split()) for f in features(w)})
    n1, n0 = int((toxic & ~held).sum()), int((~toxic & ~held).sum())
    chosen: dict[str, bool] = {}
    for f in {*with_, *without}:
        a, b = with_[f], without[f]
        if a + b >= least:
            p = (a + b) / (n1 + n0)
            z = (a / n1 - b / n0) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
            if abs(z) > z_least:
                chosen[f] = bool(z > 0)
    number = {f: i for i, f in enumerate(sorted(chosen))}
    if not any(chosen.values()):
        return ToxicityModel({}, 0.0, 1.0)
    accuses = np.array([chosen[f] for f in number])
    del with_, without
    numbers = _Numbers(number)
    feature, sentence, document = [], [], []
    for d, t in enumerate(texts):
        if held[d]:
            continue
        for _, s in sentences(t.lower()):
            hits = [k for w in s.split() for k in numbers[w]]
            if hits and accuses[hits].any():
                feature += hits
                sentence += [len(document)] * len(hits)
                document.append(d)
    feature, sentence, document = map(np.array, (feature, sentence, document))
    w, b = np.zeros(len(number)), -2.0
    g2, gb2, m, mb = np.zeros(len(number)), 0.0, np.zeros(len(number)), 0.0
    for t in range(1, rounds + 1):
        _, g, gb = likelihood(w, b, feature, sentence, document, toxic)
        g = g - decay * np.sign(w)
        m, mb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb
        g2, gb2 = 0.999 * g2 + 0.001 * g * g, 0.999 * gb2 + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w = w + rate * (m / fix) / (np.sqrt(g2 / fix2) + 1e-8)
        b = b + rate * (mb / fix) / (np.sqrt(gb2 / fix2) + 1e-8)
    weights = {f: round(float(w[i]), 4) for f, i in number.items() if abs(w[i]) > 0.05}
    scores = _Scores(weights)
    among = held if held.any() else ~held
    p = np.array([located(t, scores, b)[0] for t, h in zip(texts, among) if h])
    return ToxicityModel(weights, float(b), _cut(p, toxic[among]))


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1, half-way to the next score below."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # equal scores go together
    k = int(np.argmax(f1))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(max((p[order][k] + below) / 2, 1e-6))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED,
) -> ToxicityModel:
    """The model of at most max_labelled labelled documents."""
    known = projected(labels, lid=id_col, y=label_col).where("lid is not null and y is not null").groupBy("lid").agg(F.max("y").alias("y"))
    drawn = known.orderBy(F.xxhash64("lid"), "lid").limit(max_labelled)
    texts = projected(docs, id=id_col, text=text_col).where("text is not null")
    rows = texts.join(F.broadcast(drawn), texts["id"] == drawn["lid"]).select("lid", "text", "y").dropDuplicates(["lid"]).collect()
    rows.sort(key=lambda r: str(r["lid"]))
    return fit([r["text"] for r in rows], np.array([r["y"] == 1 for r in rows], bool))


def _mapped(docs: DataFrame, text_col: str, model: ToxicityModel, schema: T.StructType, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        scores = _Scores(model.weights)
        for whole in batches:
            for b in slices(whole, at):
                yield from make(b, [located(t, scores, model.bias) for t in b.column(at).to_pylist()], model)
        whole = b = None
        scores.clear()
        give_back()

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs under the threshold, all columns kept."""

    def make(b, found, model):
        yield b.filter(pa.array([p < model.threshold for p, _ in found], pa.bool_()))

    return _mapped(docs, text_col, model, docs.schema, make)


def locate(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, doc_score, sentence_no, start, sentence, score) of the offending sentences of each toxic document:
    those of at least probability `least`, and the worst one in any case."""
    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *(T.StructField(n, t) for n, t in (
        ("doc_score", T.DoubleType()), ("sentence_no", T.IntegerType()), ("start", T.IntegerType()), ("sentence", T.StringType()), ("score", T.DoubleType())))])

    def make(b, found, model):
        rows, take = [], []
        for i, (p, parts) in enumerate(found):
            if p >= model.threshold:
                worst = max(x[3] for x in parts)
                for k, start, sentence, q in parts:
                    if q >= least or q == worst:
                        rows.append((p, k, start, sentence, q))
                        take.append(i)
        columns = [b.column(0).take(pa.array(take, pa.int32()))]
        columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _mapped(source, "text", model, schema, make)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offending sentences of all toxic documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return locate(docs, train(docs, labels))
