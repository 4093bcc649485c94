"""Toxicity by a weighted finite-state pattern grammar.

A word transducer turns words into classes: *insult* (learned words and word
beginnings with their weights), *threat*, *target*, *negation*, *report*, or
none. Small transducers read the classes of one clause: from left to right,
negation marks a following insult or threat as negated and reported speech
marks it as reported (composed into one machine); then, in both directions,
target marks those anywhere in its clause as aimed. The output is the kind of
each matched pattern. A clause adds its weights to the totals of the kinds it
matched; a logistic model learned from the labels weighs those totals, so
whether negated or reported abuse counts, or even lowers the score, is learned
rather than assumed. Strongest clause and pattern count leave negated and
reported matches out. An insult without a target is a pattern of its own kind
(*plain*); a threat without one matches nothing.

Learned only from labelled training-fold rows: at most about ``TOXIC_ROWS`` and
``PLAIN_ROWS`` of them, drawn by a hash of the id (even draws teach the word
weights, odd ones the logistic model); whole texts everywhere. Null and empty
texts match nothing and get the model's base rate; without any label of both
classes the score is 0 everywhere. A null label row is skipped; a document
labelled twice is learned from twice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import stored, text_pass, train_fold

TOXIC_ROWS = 3000
PLAIN_ROWS = 9000
#: A lexicon entry needs this many toxic documents, this log-likelihood ratio
#: and this log odds; at most LEXICON entries (the strongest) are kept.
LEAST_TOXIC, LEAST_RATIO, LEAST_ODDS, LEXICON = 4, 20.0, 2.5, 5000
#: A word beginning is dropped if one whole word has this share of its texts.
ONE_WORD = 0.7
#: Word beginnings of these lengths compete with whole words.
BEGINNINGS = (4, 5, 6, 7)

# Fixed function-word lists of the grammar (English, German, French, Spanish).
THREAT = "kill hurt destroy burn punch beat stab shoot töten umbringen schlagen tuer frapper matar golpear".split()
TARGET = "you your yours yourself u du dich dir dein deine ihr euch tu toi te ton ta vous votre tú tu ti usted ustedes".split()
NEGATION = "not no never nobody isn't aren't don't nicht kein keine nie ne pas jamais aucun non ni nunca jamás".split()
REPORT = "said says say wrote called claims quote quoted sagte sagt schrieb dit disait dijo dice llamó".split()

NONE, INSULT, THREATS, TARGETS, NEGATIONS, REPORTS = range(6)
#: How far, in words, a negation or a report reaches.
REACH = 3

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n|]+")


@dataclass
class Transducer:
    """A deterministic transducer: ``moves[state][symbol] = (state, output)``."""
    moves: list[list[tuple[int, int]]]

    def then(self, other: Transducer) -> Transducer:
        """Composition: feed this one's outputs to ``other``."""
        states = list(product(range(len(self.moves)), range(len(other.moves))))
        number = {s: i for i, s in enumerate(states)}
        moves = []
        for a, b in states:
            row = []
            for a2, mid in self.moves[a]:
                b2, out = other.moves[b][mid]
                row.append((number[a2, b2], out))
            moves.append(row)
        return Transducer(moves)


# Symbols between the machines: class + 6 * marks, marks being bits.
NEGATED, REPORTED, AIMED = 1, 2, 4
SYMBOLS = 6 * 8


def _marker(trigger: int, mark: int, reach: int | None) -> Transducer:
    """Adds ``mark`` to insults and threats within ``reach`` words after a
    ``trigger`` word (None: anywhere after it); the state is how many words of
    its reach are left."""
    moves, step = [], 0 if reach is None else 1
    reach = reach or 1
    for left in range(reach + 1):
        row = []
        for symbol in range(SYMBOLS):
            marks, cls = divmod(symbol, 6)
            if cls == trigger:
                row.append((reach, symbol))
            else:
                hit = cls in (INSULT, THREATS) and left
                row.append((max(left - step, 0), cls + 6 * (marks | mark) if hit else symbol))
        moves.append(row)
    return Transducer(moves)


AIM = _marker(TARGETS, AIMED, None)
#: From left to right; ``AIM`` alone reads the outputs again from right to left.
GRAMMAR = _marker(NEGATIONS, NEGATED, REACH).then(_marker(REPORTS, REPORTED, 2 * REACH)).then(AIM)
#: Totals kept per text: weight by pattern kind, then strongest clause and pattern count.
KINDS = ("plain", "negated", "reported", "aimed", "threat")
FEATURES = (*KINDS, "strongest", "patterns")
#: Only these totals may lower a score.
FREE = [1 + KINDS.index(k) for k in ("negated", "reported")]

_FIXED = ({w: THREATS for w in THREAT} | {w: REPORTS for w in REPORT} | {w: NEGATIONS for w in NEGATION}
          | {w: TARGETS for w in TARGET})


def keys_of(word: str) -> list[str]:
    """A word's lexicon keys: itself, and its longer-than-key beginnings."""
    return ["=" + word, *[word[:n] for n in BEGINNINGS if len(word) > n]]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray | None = None
    known: dict[str, float] = field(default_factory=dict)

    def insult(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > 200_000:
                self.known.clear()
            w = self.known[word] = max((self.lexicon.get(k, 0.0) for k in keys_of(word)), default=0.0)
        return w

    def totals(self, text: str | None) -> list[float]:
        """The features of a text: weights of the patterns matched by its clauses."""
        out = dict.fromkeys(FEATURES, 0.0)
        lowered = (text or "").lower()
        words = set(WORD.findall(lowered))
        hits = {w for w in words if self.insult(w) > 0}
        if not hits and words.isdisjoint(THREAT):
            return list(out.values())
        for clause in CLAUSE.split(lowered):
            found = [(self.insult(w), _FIXED.get(w, NONE)) for w in WORD.findall(clause)]
            state, symbols = 0, []
            for weight, cls in found:
                state, symbol = GRAMMAR.moves[state][INSULT if weight > 0 else cls]
                symbols.append(symbol)
            state, score = 0, 0.0
            for symbol, (weight, _) in zip(reversed(symbols), reversed(found), strict=True):
                state, symbol = AIM.moves[state][symbol]
                marks, cls = divmod(symbol, 6)
                if cls == THREATS and marks & AIMED:
                    kind, weight = "threat", 1.0
                elif cls == INSULT:
                    kind = "aimed" if marks & AIMED else "plain"
                else:
                    continue
                if marks & (NEGATED | REPORTED):
                    kind = "negated" if marks & NEGATED else "reported"
                else:
                    out["patterns"] += cls == INSULT
                    score += weight
                out[kind] += weight
            out["strongest"] = max(out["strongest"], score)
        return list(out.values())

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(_design([self.totals(text)]) @ self.weights, -50, 50)))[0])


def _design(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))
    return np.hstack([np.ones((len(rows), 1)), np.log1p(x), x[:, [-1]] > 0])


def fit_weights(rows: list[list[float]], labels: list[int], weights: list[float]) -> np.ndarray:
    """Ridge logistic regression by Newton steps; totals of abuse that is neither
    negated nor reported cannot lower the score (their weights are kept at zero
    or more)."""
    x, y, s = _design(rows), np.array(labels, dtype=float), np.array(weights)
    b = np.zeros(x.shape[1])
    bound = np.ones(len(b), dtype=bool)
    bound[[0, *FREE]] = False

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(s @ (np.logaddexp(0, z) - y * z) + 0.05 * b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        grad = x.T @ (s * (p - y)) + 0.1 * b
        hess = (x * (s * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        move = ~(bound & (b <= 0) & (grad > 0))  # weights held at zero take no part in the step
        step = np.zeros(len(b))
        step[move] = np.linalg.solve(hess[np.ix_(move, move)], grad[move])
        for share in 0.5 ** np.arange(20):
            new = b - share * step
            new[bound] = np.maximum(new[bound], 0)
            if loss(new) < loss(b):
                break
        else:
            break
        b = new
    return b


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, plain_rows: int) -> DataFrame:
    """(doc_id, text, toxic, weight, half) of a hash-drawn share of each class;
    ``weight`` undoes the shares. Only the drawn ids, bounded by the two row
    parameters, meet the texts."""
    rows = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        train_fold(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, most / max(1, counts.get(c, 0))) for c, most in ((1, toxic_rows), (0, plain_rows))}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30))
    wanted = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    drawn = rows.where(draw < wanted * (1 << 30)).select(
        "doc_id", "toxic", (1 / wanted).alias("weight"),
        F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"))
    return stored(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "toxic-sample")


def learn_lexicon(sample: DataFrame, entries: int = LEXICON) -> dict[str, float]:
    """Words and word beginnings that mark toxic texts, with their log odds.
    Equal texts of one label count once (copies are no evidence)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                seen[toxic].update({k for w in words for k in keys_of(w)})
        rows = [(k, seen[1][k], seen[0][k]) for k in seen[0].keys() | seen[1].keys()]
        yield pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in rows], pa.string()),
                                          "a": pa.array([r[1] for r in rows], pa.int64()),
                                          "b": pa.array([r[2] for r in rows], pa.int64())})

    once = sample.select("text", "toxic", F.xxhash64("toxic", "text").alias("h")).dropDuplicates(["h", "toxic"])
    sizes = {r.toxic: r.n for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {}
    n1, n0 = float(sizes[1]), float(sizes[0])
    a, b = F.col("a"), F.col("b")
    share = (a + b) / (n1 + n0)

    def part(n, total, p):
        return F.when(n > 0, n * F.log(n / (total * p))).otherwise(0.0)

    ratio = 2 * (part(a, n1, share) + part(n1 - a, n1, 1 - share) + part(b, n0, share) + part(n0 - b, n0, 1 - share))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    counted = once.mapInArrow(run, "key string, a bigint, b bigint").groupBy("key").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    best = counted.where(a >= LEAST_TOXIC).select("key", "a", ratio.alias("ratio"), odds.alias("odds")).where(
        (F.col("ratio") >= LEAST_RATIO) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("ratio"), "key").limit(entries)
    found = {r.key: r for r in best.collect()}
    # a beginning that one whole word accounts for says nothing about other words
    owed = {k[1:1 + n]: found[k].a for n in BEGINNINGS for k in sorted(found, key=lambda k: found[k].a)
            if k[0] == "=" and len(k) > n + 1}
    return {k: r.odds for k, r in found.items() if k[0] == "=" or owed.get(k, 0) < ONE_WORD * r.a}


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, plain_rows: int = PLAIN_ROWS) -> Model:
    sample = labelled_sample(docs, labels, toxic_rows, plain_rows)
    model = Model(learn_lexicon(sample.where("half = 0")))
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = text_pass(sample.where("half = 1"), schema, lambda: lambda t: (model.totals(t),), ["toxic", "weight"]).collect()
    if len({r.toxic for r in rows}) == 2:
        model.weights = fit_weights([r.x for r in rows], [r.toxic for r in rows], [r.weight for r in rows])
    model.known = {}
    return model


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: fold, probability of a toxic label, decision at one half."""
    model = model or train(docs, labels)
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def start():
        def one(text: str | None) -> tuple:
            p = model.score(text)
            return p, int(p >= 0.5)
        return one

    named = docs.select("doc_id", "text", (~train_fold(F.col("doc_id"))).alias("held_out"))
    return text_pass(named, schema, start, ["doc_id", "held_out"])


def matched_clauses(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, weight) of every clause that matches a pattern, in
    code points."""
    def start():
        def one(text: str | None) -> tuple:
            text, found, at = text or "", [], 0
            bounds = [0, *[m.end() for m in CLAUSE.finditer(text)], len(text)]
            for at, end in pairwise(bounds):
                weight = sum(model.totals(text[at:end])[:len(KINDS)])
                if weight > 0:
                    found.append({"start": at, "end": end, "weight": weight})
            return (found,)
        return one

    clause = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                           T.StructField("weight", T.DoubleType())])
    spans = text_pass(docs, T.StructType([T.StructField("c", T.ArrayType(clause))]), start, ["doc_id"])
    return spans.select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.*")
