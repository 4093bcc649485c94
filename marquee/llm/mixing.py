"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table gives every document its posterior
over the domains. Rates per document (zero or more) are then fitted by
projected-gradient least squares so that the expected token totals of the
domains, ``sum(rate * tokens * posterior)``, match the targets. With residuals
weighted by the inverse second moment of the posteriors, a unit step is stable
and each iteration is one distributed sum; the gradient at a document depends
on its posterior alone, so iterations run over posterior cells and a document's
rate is read off the residual history. A cell (posterior rounded to ``DIGITS``)
only says which documents share a rate: its mass per domain is the sum of
unrounded posteriors, and so are all totals held against the targets. Where the
iterations end with a domain further than ``TOLERANCE`` of all tokens from its
target (one that no nonnegative rates reach, say), a warning says so and
``off_target`` carries the largest gap.

Classifier: naive Bayes over binned style ratios and over counts of learned
domain words, fitted on at most about ``FIT_ROWS`` labelled documents a domain
(drawn by a hash of the id), priors from the whole labelled table. Everything
runs on built-in column functions.

Null texts have no token and no say in the totals; a null label is skipped;
documents whose id is null share one draw for the fraction of their rate;
repeated rows are rated alike. A document labelled several times teaches once
per label row.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import let, stored
from marquee.llm.quality import CAPITALS, SYMBOLS, occurrences

FIT_ROWS = 3000
#: Learned words (and 5-letter word beginnings) per domain.
DOMAIN_WORDS = 200
BINS = 24
DIGITS = 2
ITERATIONS, TOLERANCE = 40, 5e-4
#: Target share of all tokens per domain of the ``labels`` table.
TARGETS = {"plain": 0.92, "low": 0.06, "toxic": 0.02}
STYLE = ("length", "word_length", "symbols", "capitals", "distinct", "lines")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else low quality, else plain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "plain")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")


def _bin(x: Column, step: float) -> Column:
    return F.least(F.greatest(F.floor(F.coalesce(x, F.lit(0.0)) / step), F.lit(0)), F.lit(BINS - 1)).cast("int")


def tokens(text: Column) -> Column:
    """Lower-case words of a text, cut at white space and sentence punctuation."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D.,;:!?]+"), "")


def style_and_words(text: Column, lists: list[list[str]]) -> Column:
    """Struct of ``n`` (tokens) and ``bins``: one bin number per style ratio,
    then per list how many of its words (``=word``) or beginnings occur."""
    text = F.coalesce(text, F.lit(""))
    whole = [[e[1:] for e in entries if e[0] == "="] for entries in lists]
    begin = [[e for e in entries if e[0] != "="] for entries in lists]

    def among(d: Column, groups: list[list[str]]) -> Column:
        known = sorted({e for g in groups for e in g})
        return F.array_intersect(d, F.array(*map(F.lit, known))) if known else F.array().cast("array<string>")

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        chars = F.greatest(F.length(text) - n, F.lit(1))

        def counted(d: Column) -> Column:
            style = [_bin(F.log2(n), 1.0), _bin(chars / n, 0.5), _bin(occurrences(text, SYMBOLS) / n, 0.1),
                     _bin(occurrences(text, CAPITALS) / chars, 0.05), _bin(F.size(d) / n, 0.05),
                     _bin(occurrences(text, "\n") / n, 0.01)]
            hits = let(among(d, whole), lambda x: let(among(F.transform(d, lambda v: F.left(v, F.lit(5))), begin), lambda y: F.array(*[
                F.least(F.size(among(x, [g])) + F.size(among(y, [b])), F.lit(BINS - 1)).cast("int") for g, b in zip(whole, begin, strict=True)])))
            bins = F.concat(F.array(*style), hits) if lists else F.array(*style)
            return F.struct(F.size(w).cast("bigint").alias("n"), bins.alias("bins"))

        return let(F.array_distinct(w), counted)

    return let(tokens(text), of)


def _doubles(values: list) -> Column:
    """A constant (nested) array of doubles."""
    def text(v: list | float) -> str:
        return f"array({', '.join(map(text, v))})" if isinstance(v, list) else f"{v!r}D"
    return F.expr(text(values))


@dataclass
class Classifier:
    domains: list[str]
    priors: list[float]
    lists: list[list[str]]
    #: [feature][domain][bin] log probabilities
    tables: list[list[list[float]]]

    def posterior(self, text: Column) -> Column:
        """Struct of ``n`` (tokens), ``q`` (posterior per domain) and ``p`` (its cell: the posterior rounded)."""
        def from_bins(s: Column) -> Column:
            scores = []
            for d in range(len(self.domains)):
                total = F.lit(self.priors[d])
                for f, table in enumerate(self.tables):
                    total = total + F.get(_doubles(table[d]), F.get(s["bins"], F.lit(f)))
                scores.append(total)
            return let(F.array(*scores), lambda x: let(
                F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: let(
                    F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)), lambda q: F.struct(
                        s["n"].alias("n"), q.alias("q"), F.transform(q, lambda v: F.round(v, DIGITS)).alias("p")))))
        return let(style_and_words(text, self.lists), from_bins)


def learn(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier | None:
    """``labelled``: (doc_id, domain). None without a labelled document."""
    counts = {r.domain: r.n for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    domains = sorted(counts)
    share = F.create_map(*[F.lit(x) for d in domains for x in (d, min(1.0, fit_rows / counts[d]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30))
    drawn = labelled.where(draw < share[F.col("domain")] * (1 << 30)).select("doc_id", "domain")
    # the drawn ids are bounded by fit_rows and the number of domains
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("domain", "text"), "mix-sample")
    sizes = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    lists = domain_words(sample, domains, sizes)
    bins = sample.select("domain", F.posexplode(style_and_words(F.col("text"), lists)["bins"]).alias("f", "bin"))
    seen = {(r.f, r.domain, r.bin): r.n for r in bins.groupBy("f", "domain", "bin").agg(F.count("*").alias("n")).collect()}
    tables = [[[math.log((seen.get((f, d, b), 0) + 0.1) / (sizes.get(d, 0) + 0.1 * BINS)) for b in range(BINS)]
               for d in domains] for f in range(len(STYLE) + len(domains))]
    total = sum(counts.values())
    return Classifier(domains, [math.log(counts[d] / total) for d in domains], lists, tables)


def domain_words(sample: DataFrame, domains: list[str], sizes: dict[str, int], most: int = DOMAIN_WORDS) -> list[list[str]]:
    """Per domain the words and beginnings that occur in far more of its
    documents than of the others'."""
    bare = F.array_distinct(tokens(F.col("text")))
    keys = F.array_distinct(F.concat(F.transform(bare, lambda x: F.concat(F.lit("="), x)),
                                     F.transform(F.filter(bare, lambda x: F.length(x) > 5), lambda x: F.left(x, F.lit(5)))))
    per = sample.select("domain", F.explode(keys).alias("key")).groupBy("key").agg(
        *[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    per = stored(per, "mix-words")
    total = sum(sizes.values())
    out = []
    for i, d in enumerate(domains):
        inside, outside = sizes.get(d, 0), total - sizes.get(d, 0)
        rest = sum((F.col(f"n{j}") for j in range(len(domains)) if j != i), F.lit(0))
        odds = F.log((F.col(f"n{i}") + 0.5) / (inside + 1)) - F.log((rest + 0.5) / (outside + 1))
        rows = per.select("key", F.col(f"n{i}").alias("n"), odds.alias("odds")).where(
            (F.col("n") >= max(5, inside // 200)) & (F.col("odds") > 2.5)).orderBy(F.desc("n"), "key").limit(most).collect()
        out.append([r.key for r in rows if len(r.key) > 1])
    return out


@dataclass
class Plan:
    classifier: Classifier
    targets: list[float]
    total: int
    steps: list[list[float]] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)

    @property
    def off_target(self) -> float:
        """Largest gap between a domain's total and its target, as a share of all tokens."""
        return max((abs(a - b) for a, b in zip(self.reached, self.targets)), default=0.0)

    def rate(self, p: Column) -> Column:
        """A document's rate: its start, 1, taken through all projected steps."""
        return self.state(p)["r"]

    def state(self, p: Column) -> Column:
        """The rate ``r`` and the guess ``y`` ahead of it where the next gradient is taken."""
        start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
        return F.aggregate(_doubles(self.steps), start, lambda s, v: self._step(p, s, v)) if self.steps else start

    def _step(self, p: Column, s: Column, v: Column) -> Column:
        """One projected step: ``v`` holds the weighted residual per domain and
        the momentum; ``s`` the rate and the guess the gradient was taken at."""
        down = F.aggregate(F.transform(p, lambda x, i: x * F.get(v, i)), F.lit(0.0), lambda a, b: a + b)
        return let(F.greatest(F.lit(0.0), s["y"] - down), lambda r: F.struct(
            r.alias("r"), (r + F.element_at(v, -1) * (r - s["r"])).alias("y")))


def scores(docs: DataFrame, classifier: Classifier, columns: list[str]) -> DataFrame:
    """``columns`` with the token count ``n``, the posterior ``q`` and its cell ``p``."""
    return docs.select(*columns, classifier.posterior(F.col("text")).alias("s")).select(*columns, "s.n", "s.q", "s.p")


def fit(classifier: Classifier, scored: DataFrame, targets: dict[str, float], iterations: int = ITERATIONS) -> Plan:
    """Rates for the documents whose ``n``, ``q`` and ``p`` are given."""
    k = len(classifier.domains)
    cells = stored(scored.groupBy("p").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col("q")[i]).alias(f"m{i}") for i in range(k)]),
                   "posterior-cells")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = cells.agg(F.sum("n").alias("n"), *[F.sum(F.col(f"m{i}") * F.col("p")[j]) for i, j in pairs]).first()
    total = moments[0] or 0
    plan = Plan(classifier, [targets.get(d, 0.0) for d in classifier.domains], total)
    if not total:
        return plan
    gram = np.zeros((k, k))
    for (i, j), v in zip(pairs, moments[1:], strict=True):
        gram[i, j] = gram[j, i] = v / total
    weigh = np.linalg.inv(gram + 1e-4 * np.eye(k))
    wanted = np.array(plan.targets)
    pace = 1.0
    for step in range(iterations + 1):  # accelerated: the gradient is taken a little ahead of the rates
        ends = cells.withColumn("s", plan.state(F.col("p")))
        sums = ends.agg(*[F.sum(F.col(f"m{i}") * F.col(f"s.{x}")) for x in "ry" for i in range(k)]).first()
        plan.reached = [v / total for v in sums[:k]]
        if plan.off_target < TOLERANCE or step == iterations:
            break
        following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        plan.steps.append([*(weigh @ (np.array(sums[k:]) / total - wanted)).tolist(), (pace - 1) / following])
        pace = following
    if plan.off_target >= TOLERANCE:
        warnings.warn(f"mixing ends {plan.off_target:.4f} of all tokens off its targets: "
                      f"{dict(zip(classifier.domains, plan.reached, strict=True))}", stacklevel=2)
    return plan


def _named(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _copies(rate: Column, doc_id: Column) -> Column:
    """The rate's whole part, and one more with the probability of the rest."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Per document: tokens, rate, copies (drawn by a hash of the id) and the plan's largest gap (null without labels)."""
    classifier = learn(docs, label_domains(labels))
    if classifier is None:
        out, off = docs.select("doc_id", F.size(tokens(F.col("text"))).cast("bigint").alias("n_tokens"), F.lit(1.0).alias("rate")), None
    else:
        scored = stored(scores(docs, classifier, ["doc_id"]), "mix-scores")
        plan = fit(classifier, scored, targets)
        out = scored.select("doc_id", F.col("n").alias("n_tokens"), F.round(plan.rate(F.col("p")), 6).alias("rate"))
        off = round(plan.off_target, 6)
    return out.select("*", _copies(F.col("rate"), F.col("doc_id")).alias("copies"), F.lit(off).cast("double").alias("off_target"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The documents with at least one copy, each with its rate and copies."""
    classifier = learn(docs, label_domains(labels))
    r_name, c_name = _named("rate", docs.columns), _named("copies", docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    if classifier is None:
        rows = docs.select(row, F.lit(1.0).alias("r"))
    else:
        plan = fit(classifier, scores(docs, classifier, []), targets)
        rows = docs.select(row, classifier.posterior(F.col("text")).alias("s")).select(
            "row", F.round(plan.rate(F.col("s.p")), 6).alias("r"))
    out = rows.select("row.*", F.col("r").alias(r_name), _copies(F.col("r"), F.col("row.doc_id")).alias(c_name))
    return out.where(F.col(c_name) > 0)
