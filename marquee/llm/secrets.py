"""Secret scans with inferred credential grammars.

Base patterns (assignments, access keys, long hex runs) label credentials. From
a bounded, hash-drawn sample of the labelled values of each kind a
probabilistic automaton is inferred: the prefix tree's states are merged as
long as a Hoeffding test finds their symbol and stop frequencies compatible,
down to the last descendant. Two more automata of the same make describe
ordinary long tokens with and without digits. Every token of 12 or more characters that base spans do
not cover whole is then scored by how much likelier the best credential grammar
makes it, per character, than the better ordinary one; tokens beyond the margin that
nearly all labelled credentials reach are added as kind ``format``, also where
they reach into a base span. Base spans always stay.

Spans are in code points, end exclusive; an assignment's span is its whole
match. Null and empty texts have no span; repeated rows are scanned one by one.
Symbol and stop frequencies are smoothed towards a uniform draw, so that a kind
with a single labelled value has a (weak) grammar too; with no labelled value at
all nothing is added. An unlabelled format that makes up most ordinary tokens
with digits is learned as ordinary.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import rows_pass, stored, text_pass

KINDS = ("assign", "access", "hex", "format")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal either way, so the length may stand in the pattern.
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
ALPHABET = 68  # symbols of a candidate

#: What ``extract`` calls an untouched candidate, and one that reaches into a base
#: span (scored alike, but no example of an ordinary token); ``infer`` tells
#: untouched ones with digits (addresses, numbers) from the much commoner others.
FREE, TOUCHING, NUMBERED = 3, 4, 5
#: Sampled values per labelled kind, sampled ordinary tokens without and with
#: digits each, and their greatest length.
SAMPLE, ORDINARY, LONGEST = 400, 1000, 200
#: Significance of the merge test.
MERGE_ALPHA = 0.05
#: The margin, in nats per character, stands a ``SLACK`` share of the way from
#: the gain that all but ``MISSED`` of the held-back credentials reach towards the
#: gain that a ``USUAL`` share of held-back ordinary tokens stays
#: under; a credential grammar must be the likelier one.
MISSED, USUAL, SLACK, LEAST_MARGIN = 0.02, 0.98, 0.5, 0.0
REDACTED = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential value) of the base patterns, in order."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(start, ``FREE`` or ``TOUCHING``, end, token) of the long tokens that base
    spans (sorted by start) do not cover whole."""
    found = [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text)]
    if not base:
        return [(a, FREE, b, token) for a, b, token in found]
    covered: list[list[int]] = []  # the base spans' union
    for a, _, b, _ in base:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    starts = [a for a, _ in covered]
    out = []
    for a, b, token in found:
        last = bisect.bisect_left(starts, b) - 1  # the last stretch that starts before the token's end
        if last < 0 or covered[last][1] <= a:
            out.append((a, FREE, b, token))
        elif not (starts[last] <= a and b <= covered[last][1]):
            out.append((a, TOUCHING, b, token))
    return out


class Grammar:
    """A probabilistic automaton inferred from example strings."""

    def __init__(self, examples: Iterable[str], alpha: float = MERGE_ALPHA):
        self.total, self.stop = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        for s in examples:
            self._insert(s)
        self._merge_states()

    def _insert(self, s: str) -> None:
        q = 0
        for ch in s:
            self.total[q] += 1
            if ch not in self.next[q]:
                self.next[q][ch] = len(self.total)
                self.total.append(0)
                self.stop.append(0)
                self.next.append({})
                self.count.append({})
            self.count[q][ch] = self.count[q].get(ch, 0) + 1
            q = self.next[q][ch]
        self.total[q] += 1
        self.stop[q] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, kept: int, new: int) -> bool:
        """``new`` roots a tree, so the walk ends."""
        pairs = [(kept, new)]
        while pairs:
            a, b = pairs.pop()
            na, nb = self.total[a], self.total[b]
            if self._differ(self.stop[a], na, self.stop[b], nb):
                return False
            for ch in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.count[a].get(ch, 0), na, self.count[b].get(ch, 0), nb):
                    return False
                if ch in self.next[a] and ch in self.next[b]:
                    pairs.append((self.next[a][ch], self.next[b][ch]))
        return True

    def _fold(self, kept: int, new: int) -> None:
        pairs = [(kept, new)]
        while pairs:
            a, b = pairs.pop()
            self.total[a] += self.total[b]
            self.stop[a] += self.stop[b]
            for ch, n in self.count[b].items():
                self.count[a][ch] = self.count[a].get(ch, 0) + n
                if ch in self.next[a]:
                    pairs.append((self.next[a][ch], self.next[b][ch]))
                else:
                    self.next[a][ch] = self.next[b][ch]

    def _merge_states(self) -> None:
        kept, is_kept = [0], {0}
        while True:
            fringe = [(-self.total[self.next[q][ch]], i, ch) for i, q in enumerate(kept)
                      for ch in sorted(self.next[q]) if self.next[q][ch] not in is_kept]
            if not fringe:
                return
            _, i, ch = min(fringe)
            new = self.next[kept[i]][ch]
            for q in kept:
                if self._compatible(q, new):
                    self.next[kept[i]][ch] = q
                    self._fold(q, new)
                    break
            else:
                kept.append(new)
                is_kept.add(new)

    def log_likelihood(self, s: str) -> float:
        """Of the string and its end, smoothed; an unseen symbol leaves the state as it is."""
        q, out = 0, 0.0
        for ch in s:
            out += math.log((self.count[q].get(ch, 0) + 0.5) / (self.total[q] + 0.5 * (ALPHABET + 1)))
            q = self.next[q].get(ch, q)
        return out + math.log((self.stop[q] + 0.5) / (self.total[q] + 0.5 * (ALPHABET + 1)))


@dataclass
class Model:
    credentials: list[Grammar] = field(default_factory=list)
    ordinary: list[Grammar] = field(default_factory=list)
    margin: float = math.inf

    def gain(self, value: str) -> float:
        """Nats per character in favour of a credential."""
        if not self.credentials:
            return -math.inf
        secret, plain = (max(g.log_likelihood(value) for g in of) for of in (self.credentials, self.ordinary))
        return (secret - plain) / (len(value) + 1)

    def secret(self, value: str) -> bool:
        return self.gain(value) >= self.margin

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """All spans of a text: (start, kind number, end), in order."""
        base = base_spans(text or "")
        added = [(a, 3, b) for a, _, b, value in candidates(text or "", base) if self.secret(value)]
        return sorted([s[:3] for s in base] + added)


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def extract(docs: DataFrame) -> DataFrame:
    """Per document its base spans and candidates with their values, stored."""
    found = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()),
                                      T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))

    def start():
        def one(text: str | None) -> tuple:
            base = base_spans(text or "")
            rows = base + candidates(text or "", base)
            return ([dict(zip(("start", "kind", "end", "value"), r, strict=True)) for r in rows],)
        return one

    return stored(text_pass(docs, T.StructType([T.StructField("found", found)]), start, ["doc_id"]), "secret-spans")


def infer(extracted: DataFrame, sample: int = SAMPLE, ordinary: int = ORDINARY) -> Model:
    """Infer the grammars from a hash-drawn sample of distinct values per kind."""
    kind = F.when((F.col("f.kind") == FREE) & F.col("f.value").rlike("[0-9]"), NUMBERED).otherwise(F.col("f.kind"))
    values = (extracted.select(F.explode("found").alias("f")).where("f.kind <> %d" % TOUCHING)
              .select(kind.alias("kind"), "f.value").where(F.length("value") <= LONGEST).distinct())
    counts = {r.kind: r.n for r in values.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model()
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (sample if k < FREE else ordinary) / n))])
    draw = F.pmod(F.xxhash64("value", F.lit("secret")), F.lit(1 << 30))
    drawn: dict[int, list[str]] = {}
    for r in values.where(draw < share[F.col("kind")] * (1 << 30)).orderBy("kind", "value").collect():
        drawn.setdefault(r.kind, []).append(r.value)
    return build(drawn)


def build(drawn: dict[int, list[str]]) -> Model:
    """Grammars of the labelled kinds and of ordinary tokens; the margin comes
    from values that were held back from the grammars (one in four; of a kind
    with one value, that value)."""
    kinds = [v for k, v in sorted(drawn.items()) if k < FREE and v]
    plain = [v for k, v in sorted(drawn.items()) if k >= FREE and v]
    if not kinds:
        return Model()

    def grammar(values: list[str]) -> Grammar:
        return Grammar([v for i, v in enumerate(values) if i % 4] or values)

    model = Model([grammar(v) for v in kinds], [grammar(v) for v in plain] or [Grammar([])])
    gains = sorted(model.gain(v) for values in kinds for v in values[::4])
    low = gains[int(MISSED * len(gains))]
    usual = sorted(model.gain(v) for values in plain for v in values[::4])
    high = usual[int(USUAL * (len(usual) - 1))] if usual else low
    model.margin = max(LEAST_MARGIN, low - SLACK * max(0.0, low - high))
    return model


def report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: counts of base spans, digest of them, and all spans."""
    extracted = extract(docs)
    model = infer(extracted, sample)
    schema = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]] +
                          [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    out = T.StructType([extracted.schema["doc_id"], *schema.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        target = to_arrow_schema(out)
        for batch in batches:
            rows = []
            for found in batch.column("found").to_pylist():
                base = [(f["start"], f["kind"], f["end"]) for f in found if f["kind"] < FREE]
                added = [(f["start"], 3, f["end"]) for f in found if f["kind"] >= FREE and model.secret(f["value"])]
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added))))
            if rows:
                columns = [pa.array(c, target.field(i + 1).type) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=target)

    return extracted.mapInArrow(run, out)


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with every span replaced by a mark, and ``n_chars`` (if it is an
    integer column) recounted where the text changed."""
    model = infer(extract(docs), sample)
    recount = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType)

    def start():
        def edit(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            lengths = batch.column("n_chars").to_pylist() if recount else []
            for i, text in enumerate(texts):
                if text and (spans := model.spans(text)):
                    out, at = [], 0
                    for a, _, b in spans:
                        if b > at:  # spans of different kinds may overlap
                            out += [text[at:a], REDACTED] if a >= at else []
                            at = b
                    texts[i] = "".join([*out, text[at:]])
                    if recount:
                        lengths[i] = len(texts[i])
            batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"),
                                     pa.array(texts, batch.schema.field("text").type))
            if recount:
                batch = batch.set_column(batch.schema.get_field_index("n_chars"), batch.schema.field("n_chars"),
                                         pa.array(lengths, batch.schema.field("n_chars").type))
            return batch
        return edit

    return rows_pass(docs, start)
