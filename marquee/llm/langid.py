"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (per-coordinate
rates, elastic-net penalty), then temperature calibration.

Learns only from ``text`` and non-null ``lang`` of training-fold rows. Document
frequencies cover the whole training fold. The weights are fitted on at most
about ``FIT_ROWS`` rows a language and the temperature on ``CALIBRATION_ROWS``
others, drawn by a hash of the id; whole texts everywhere.

Null texts, texts without a letter and tables without a training row give
``und`` and score 0. Repeated rows are scored alike; other columns than the
named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import rows_pass, share_below, text_pass, train_fold

BITS = 15  # n-grams are hashed to 2**BITS features, the last one being the bias
FIT_ROWS = 1000
CALIBRATION_ROWS = 250
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
#: Documents whose calibrated score is lower are rejected by ``recognised``.
LEAST_SCORE = 0.4

_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers and sublinear counts of a text's letter 1-, 2- and
    3-grams (other characters become one blank each); None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    c = np.concatenate((np.array([32], dtype=np.uint32), c, np.array([32], dtype=np.uint32)))
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    shift = np.uint32(32 - BITS)
    hashed = np.concatenate([(g * np.uint32(0xC2B2AE35)) >> shift for g in (c, two, three)])
    counts = np.bincount(hashed, minlength=1 << BITS)
    counts[-1] = 1
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


@dataclass
class Model:
    """``weights``: languages x features; ``idf`` per feature."""
    langs: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    temperature: float = 1.0

    def inputs(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        x[-1] = 0  # the bias stays out of the length
        x /= max(np.linalg.norm(x), 1e-12)
        if at[-1] == (1 << BITS) - 1:
            x[-1] = 1
        return x

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ self.inputs(at, tf)

    def predict(self, text: str | None) -> tuple[str, float]:
        f = features(text) if self.langs else None
        if f is None:
            return "und", 0.0
        p = softmax(self.logits(*f) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """FTRL-proximal over the rows in a fixed shuffled order."""
    k, d = len(model.langs), 1 << BITS
    z, n = np.zeros((k, d)), np.zeros((k, d))

    def current(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            at, tf, y = rows[r]
            x = model.inputs(at, tf)
            zs, ns = z[:, at], n[:, at]
            w = current(zs, ns)
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x
            z[:, at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[:, at] = ns + g * g
    model.weights = current(z, n).astype(np.float32)


def fit_temperature(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature of least log loss, by golden-section search on its log."""
    if not rows:
        return
    logits = np.array([model.logits(at, tf) for at, tf, _ in rows])
    ys = np.array([y for *_, y in rows])

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(ys)), ys]))

    a, b, ratio = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    model.temperature = float(np.exp((a + b) / 2))


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents with a letter, and how many have each feature; one
    partial count per task, a fixed number of totals to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << BITS) + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                f = features(text)
                if f is not None:
                    seen[f[0]] += 1
                    seen[-1] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"f": at.astype(np.int32), "n": seen[at]})

    total = rows.select("text").mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
    out = np.zeros((1 << BITS) + 1)
    for r in total.collect():
        out[r.f] = r.n
    return int(out[-1]), out[:-1]


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    rows = docs.select("doc_id", "text", "lang").where(
        train_fold(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model()
    n_docs, df = document_frequencies(rows)
    if not n_docs:
        return Model()
    wanted = fit_rows + calibration_rows
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, wanted / n))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    # the calibration rows are a share of the drawn ones, by another hash
    drawn = drawn.withColumn("check", share_below(F.col("doc_id"), calibration_rows / wanted).cast("int"))
    schema = T.StructType([T.StructField("f", T.BinaryType()), T.StructField("tf", T.BinaryType())])

    def start():
        def one(text: str | None) -> tuple:
            f = features(text)
            return (None, None) if f is None else (f[0].astype(np.int32).tobytes(), f[1].astype(np.float32).tobytes())
        return one

    sample = [r for r in text_pass(drawn, schema, start, ["doc_id", "lang", "check"]).orderBy("doc_id").collect() if r.f]
    model = Model(sorted({r.lang for r in sample}), np.log((1 + n_docs) / (1 + df)) + 1)
    number = {lang: i for i, lang in enumerate(model.langs)}
    if not sample:
        return Model()
    known = [(np.frombuffer(r.f, np.int32), np.frombuffer(r.tf, np.float32).astype(np.float64), number[r.lang]) for r in sample]
    fit = [x for x, r in zip(known, sample, strict=True) if not r.check]
    fit_ftrl(model, fit or known)
    fit_temperature(model, [x for x, r in zip(known, sample, strict=True) if r.check])
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: fold, predicted language, calibrated probability."""
    model = model or train(docs)
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    named = docs.select("doc_id", "text", (~train_fold(F.col("doc_id"))).alias("held_out"))
    return text_pass(named, schema, lambda: model.predict, ["doc_id", "held_out"])


def recognised(docs: DataFrame, model: Model | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is recognised: not ``und`` and with a
    calibrated score of ``least`` or more."""
    model = model or train(docs)

    def start():
        def edit(batch: pa.RecordBatch) -> pa.RecordBatch:
            said = map(model.predict, batch.column("text").to_pylist())
            return batch.filter(pc.equal(pa.array([lang != "und" and p >= least for lang, p in said]), True))
        return edit

    return rows_pass(docs, start)
