"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Model: P(grade >= k | x) = sigmoid(w.x - t_k) for k = 1..K-1 with one weight vector w for
all thresholds and t_1 < t_2 < ...; the output is the expected severity, the sum of these
probabilities.  w and t maximise the likelihood of the grades, P(grade = k) being the
difference of neighbouring probabilities, less an L1 penalty that leaves a short list of
weights (proximal gradient steps with momentum and a line search).

Features are the words of a text and their first PREFIXES letters; the value of one is its
share of the text's words, so long texts don't gather severity by chance, and w.x is a sum
over words.  A feature is learned from if LEAST_DOCS training documents have it.

Grades are whole numbers in order, however many there are; labels have the two of `toxic`, 0
and 1.  The classifier is fitted on a bounded sample: SAMPLE documents of the least grade and
SAMPLE of the others at most, chosen by a hash of the id (of a doc_id with several texts,
one); each counts for as many as it stands for, so probabilities are those of all labelled
documents and not of the sample.

Cases: a text without a word (null, empty) has severity 0; with no labelled row, or only one
grade, every severity is 0.  Labels without a grade or doc_id are not used.  A document with
several labels trains once for each.  One output row for each input row; ties cannot arise.
Other columns of docs are kept, but for one of the name __toxicity, which is replaced.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 4_000
PREFIXES = range(3, 9)
LEAST_DOCS = 3
STEPS = 300
L1 = 1e-4
SETTLED = 1e-6  # relative change of the loss that ends the fit
SCALE = 30.0  # a word in so many has the value 1
CUT = 0.5  # of P(grade >= k) for the reported grade
KNOWN_WORDS = 400_000
BLOCK = 500  # documents

SCORED = "severity double, p_toxic double, grade int, toxic boolean"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    names = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in names]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    grades: tuple[int, ...] = ()

    def weight(self, word: str) -> float:
        return sum(self.weights.get(h, 0.0) for h in features(word))

    def score(self, text: str | None, known: Words) -> tuple[float, float, int, bool]:
        """known: this model's weights of the words met so far."""
        words = words_of(text) if self.thresholds else []
        if not words:
            return 0.0, 0.0, 0, False
        link = SCALE * sum(map(known.__getitem__, words)) / len(words)
        above = _sigmoid(link - np.array(self.thresholds))
        return float(above.sum()), float(above[0]), int((above >= CUT).sum()), bool(above[0] >= CUT)


class Words(dict):
    """Word to its weight, for one model."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > KNOWN_WORDS:
            self.clear()
        out = self[word] = self.model.weight(word)
        return out


class Sample:
    """Texts as a sparse matrix of words, and words as one of features: x = (docs by words) (words by features)."""

    def __init__(self, texts: Iterable[Counter[str]]) -> None:
        at: dict[str, int] = {}
        doc, word, share = array("i"), array("i"), array("f")
        self.n = 0
        for counts in texts:
            scale = SCALE / sum(counts.values())
            for w, c in counts.items():
                doc.append(self.n)
                word.append(at.setdefault(w, len(at)))
                share.append(c * scale)
            self.n += 1
        self.n_words = len(at)
        self.doc, self.word, self.share = np.frombuffer(doc, np.int32), np.frombuffer(word, np.int32), np.frombuffer(share, np.float32)
        hashes, sizes = array("I"), array("i")
        for w in at:
            own = features(w)
            hashes.extend(own)
            sizes.append(len(own))
        del at
        names, feature = np.unique(np.frombuffer(hashes, np.uint32), return_inverse=True)
        feature, of = feature.astype(np.int32), np.repeat(np.arange(self.n_words, dtype=np.int32), np.frombuffer(sizes, np.int32))
        # how many documents have a feature, some documents at a time
        start, docs = np.searchsorted(of, np.arange(self.n_words + 1)), np.zeros(len(names), np.int64)
        for low in range(0, self.n, BLOCK):
            part = slice(*np.searchsorted(self.doc, (low, low + BLOCK)))
            words = self.word[part]
            size = start[words + 1] - start[words]
            offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pairs = feature[np.repeat(start[words], size) + offset].astype(np.int64) * BLOCK + np.repeat(self.doc[part] - low, size)
            docs += np.bincount(np.unique(pairs) // BLOCK, minlength=len(names))
        keep = docs >= min(LEAST_DOCS, max(1, self.n // 20))
        place = (np.cumsum(keep) - 1).astype(np.int32)
        used = keep[feature]
        self.names, self.of, self.feature = names[keep], of[used], place[feature[used]]

    def link(self, w: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.of, weights=w[self.feature], minlength=self.n_words)
        return np.bincount(self.doc, weights=self.share * by_word[self.word], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        """The gradient of w from that of the link."""
        by_word = np.bincount(self.word, weights=self.share * r[self.doc], minlength=self.n_words)
        return np.bincount(self.feature, weights=by_word[self.of], minlength=len(self.names))


def likelihood(link: np.ndarray, t: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Minus the weighted log-likelihood of grades y (0..K-1), and its gradients by link and by thresholds."""
    if len(t) > 1 and not (np.diff(t) > 0).all():
        return np.inf, np.zeros_like(link), np.zeros_like(t)
    cuts = np.concatenate([[-np.inf], t, [np.inf]])
    low, high = link - cuts[y], link - cuts[y + 1]  # P = sigmoid(low) - sigmoid(high)
    a, b = _sigmoid(low), _sigmoid(high)
    p = np.maximum(np.where(y == 0, 1 - b, np.where(y == len(t), a, a - b)), 1e-15)
    da, db = a * (1 - a), b * (1 - b)
    da[y == 0], db[y == len(t)] = 0.0, 0.0
    by_link = -weight * (da - db) / p
    by_t = np.bincount(y, weights=weight * da / p, minlength=len(t) + 1)[1:] - np.bincount(y, weights=weight * db / p, minlength=len(t) + 1)[:-1]
    return float(-(weight * np.log(p)).sum()), by_link, by_t


def fit(rows: Iterable[tuple[int, Counter[str]]], stands_for: dict[bool, float] | None = None) -> Model:
    """A model of (grade, word counts) rows; stands_for: how many rows each one of the least grade (False) or above (True) stands for."""
    of: list[int] = []

    def texts() -> Iterator[Counter[str]]:
        for grade, counts in rows:
            if counts:
                of.append(grade)
                yield counts

    x = Sample(texts())
    grades = sorted(set(of))
    if len(grades) < 2:
        return Model()
    y = np.searchsorted(grades, of)
    weight = np.array([(stands_for or {}).get(g > grades[0], 1.0) for g in of])
    weight /= weight.sum()
    above = np.array([weight[y > k].sum() for k in range(len(grades) - 1)])
    t = -np.log(above / (1 - above))
    w = np.zeros(len(x.names))
    w0, t0, m0, step = w, t, 1.0, 1.0
    last = np.inf
    for _ in range(STEPS):
        loss, by_link, gt = likelihood(x.link(w), t, y, weight)
        gw = x.back(by_link)
        while True:  # the longest step that the quadratic bound allows
            w1 = w - step * gw
            w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * L1, 0)
            t1 = t - step * gt
            new, _, _ = likelihood(x.link(w1), t1, y, weight)
            dw, dt = w1 - w, t1 - t
            if new <= loss + gw @ dw + gt @ dt + (dw @ dw + dt @ dt) / (2 * step) + 1e-12 or step < 1e-9:
                break
            step /= 2
        m1 = (1 + np.sqrt(1 + 4 * m0 * m0)) / 2
        whole = new + L1 * float(np.abs(w1).sum())
        if whole > last:  # start the momentum anew
            m0 = m1 = 1.0
        if abs(last - whole) < SETTLED * max(1.0, whole):
            w0, t0 = w1, t1
            break
        w, t = w1 + (m0 - 1) / m1 * (w1 - w0), t1 + (m0 - 1) / m1 * (t1 - t0)
        if len(t) > 1 and not (np.diff(t) > 0).all():
            t = t1
        w0, t0, m0, last = w1, t1, m1, whole
        step *= 1.5
    kept = np.flatnonzero(np.abs(w0) > 1e-6)
    return Model({int(x.names[i]): float(w0[i]) for i in kept}, tuple(float(v) for v in t0), tuple(grades))


def _packed(text: str | None) -> bytes:
    return zlib.compress("\n".join(f"{w} {n}" for w, n in sorted(Counter(words_of(text)).items())).encode("utf-8", "surrogatepass"), 1)


def _unpacked(data: bytes) -> Counter[str]:
    rows = (line.rsplit(" ", 1) for line in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n") if line)
    return Counter({w: int(n) for w, n in rows})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic: the grade)."""
    h = F.xxhash64("doc_id")
    graded = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("__doc"), F.col("toxic").cast("int").alias("__grade"), h.alias("__h"))
    graded = graded.distinct()
    (least,) = graded.agg(F.min("__grade")).first()
    if least is None:
        return Model()
    graded = graded.withColumn("__above", F.col("__grade") > least)
    sizes = {r["__above"]: r["n"] for r in graded.groupBy("__above").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    # a threshold on the hash thins the rows before the exact cut, so no task ranks all of them
    cut = {k: 1_000_003 * min(1.0, 1.3 * sample / n + 40 / n) for k, n in sizes.items()}
    thin = graded.where(F.pmod("__h", F.lit(1_000_003)) < F.when(F.col("__above"), cut[True]).otherwise(cut[False]))
    place = F.row_number().over(Window.partitionBy("__above").orderBy("__h", "__doc", "__grade"))
    chosen = thin.withColumn("__r", place).where(F.col("__r") <= sample).select("__doc", "__grade")
    # 2 * sample rows at most
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc"))
    texts = texts.groupBy("__doc", "__grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("__grade", "x.text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"grade": batch["__grade"].astype("int32"), "x": [_packed(t) for t in batch["text"]]})

    rows = sorted((int(r["grade"]), bytes(r["x"])) for r in texts.mapInPandas(counted, "grade int, x binary").collect())
    return fit(((g, _unpacked(x)) for g, x in rows), {k: n / min(n, sample) for k, n in sizes.items()})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a struct column __toxicity (severity, p_toxic, grade, toxic); p_toxic is P(grade >= 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf(SCORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = pickle.loads(sent.value)
        known = Words(own)
        for batch in batches:
            yield pd.DataFrame([own.score(t, known) for t in batch], columns=["severity", "p_toxic", "grade", "toxic"])

    return docs.withColumn("__toxicity", run("text"))
