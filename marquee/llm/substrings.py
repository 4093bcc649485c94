"""Substring dedup with difference-cover anchors.

Every word that stands in a window of ``window`` consecutive words whose sequence
also starts in a document with a smaller id is taken out. A difference cover D
modulo a period p holds, for any two places, a shift under p after which both lie
in D; so two equal windows share a run of ``window - p + 1`` words that starts at
a cover place in both documents. Only runs at cover places are hashed over the
whole corpus (6 of 31). Runs found twice are anchors: they are extended, that is,
the windows around them (at most p - 1 words to the left) are hashed, and of each
window's documents the smallest id counts.

Texts are stored in bundles of a few MB. A bundle sends each different hash once,
in one message per hash range, whatever its documents share; a range answers each
message with one bit per hash: whether another bundle holds the anchor, or whether
the window starts elsewhere in a document with a smaller id. The bundle makes its
hashes again, in the same order, to read the bits; what only its own documents share
it finds by itself and does not send. No pairs are made, and a passage that very many
documents share is one entry per bundle. Ranges follow the number of words.

Null and empty texts have no words. A document with a null id is neither before
nor after another: nothing is taken from it, nor from others for it. Rows that
repeat an id do not count against each other, and each gets its own result. Texts
of any length are read whole; a text longer than a bundle is a bundle of its own.
``doc_id`` is an integer. Extra columns are not read. Anchors have 32-bit hashes in
their range, which holds a bounded number (a clash only costs a look); windows
128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import SPACE_CLASS, stored

WINDOW, PERIOD = 50, 31
# A perfect difference set modulo 31 (every difference but 0 occurs once).
COVER = (1, 5, 11, 24, 25, 27)
BUNDLE_BYTES, PIECE, RANGE_WORDS, LEAST_RANGE_WORDS = 4 << 20, 1 << 18, 4_000_000, 100_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd
ANCHORS, WINDOWS = 0, 1  # kinds of messages


def is_cover(cover: Iterable[int], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Hashes of stretches of a sequence: differences of its prefix sums, weighted
    with powers of an odd base modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = np.ones((2, 1), dtype=np.uint64)

    def stretches(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        if self.powers.shape[1] < n:
            steps = np.array([[self.base], [self.inverse]], dtype=np.uint64).repeat(n + n // 4, axis=1)
            steps[:, 0] = 1
            self.powers = np.multiply.accumulate(steps, axis=1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.powers[0, :n], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.powers[1][starts] + (ends - starts).astype(np.uint64))


class Texts:
    """A bundle: the words of its documents, hashed in place."""

    def __init__(self, row: dict, sums: list[Sums]):
        import zstandard
        self.data = zstandard.ZstdDecompressor().decompress(row["texts"])
        self.ids = np.array(row["ids"], dtype=np.int64)
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.of = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.place = np.arange(len(self.of)) - self.starts[self.of]
        self.sums = sums
        self.hashed: dict[int, np.ndarray] = {}

    def words(self, lane: int) -> np.ndarray:
        """Per word a 64-bit hash of its bytes."""
        if lane not in self.hashed:
            self.hashed[lane] = self._words(lane)
        return self.hashed[lane]

    def _words(self, lane: int) -> np.ndarray:
        data = np.frombuffer(self.data, dtype=np.uint8)
        ends = np.append(np.flatnonzero(data == 32), len(data))
        starts = np.concatenate(([0], ends[:-1] + 1))
        out, i = [], 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE)))
            piece = data[starts[i]:ends[j - 1]].astype(np.uint64) + np.uint64(1)
            out.append(self.sums[lane].stretches(piece, starts[i:j] - starts[i], ends[i:j] - starts[i]))
            i = j
        return np.concatenate(out)

    def runs(self, words: np.ndarray, k: int, lane: int, at: np.ndarray) -> np.ndarray:
        """The hash of the run of ``k`` words at each of the places ``at``."""
        return self.sums[lane].stretches(words, at, at + k)

    def at_cover(self, k: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
        """Cover places of the documents where a run of ``k`` words starts."""
        marks = np.zeros(period, dtype=bool)
        marks[list(cover)] = True
        return np.flatnonzero(marks[self.place % period] & (self.place + k <= self.sizes[self.of]))

    def covered(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words lie in one of the stretches."""
        steps = np.bincount(starts, minlength=len(self.of) + 1) - np.bincount(ends, minlength=len(self.of) + 1)
        return np.cumsum(steps[:len(self.of)]) > 0

    def windows(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self.runs(self.words(lane), k, lane, at) for lane in (0, 1))


def _sums() -> list[Sums]:
    return [Sums(base) for base in BASES]


def _ranges_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range of each hash, from its upper half; ranges ascend with the hashes."""
    return (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def _slices(of: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, start, end) of each stretch of equal ranges."""
    heads = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))[:len(of)])
    return [(int(of[a]), a, b) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(of)])]


def _grouped(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in ascending order: each key's entry with the smallest and with
    the largest id; and of each entry, which key it has."""
    order = np.lexsort((ids, *keys[::-1]))
    new = np.zeros(max(0, len(order) - 1), dtype=bool)
    for k in keys:
        k = k[order]
        new |= k[1:] != k[:-1]
    new = np.concatenate(([True], new))[:len(order)]
    heads = np.flatnonzero(new)
    key = np.empty(len(order), dtype=np.int64)
    key[order] = np.cumsum(new) - 1
    return order[heads], order[np.append(heads, len(order))[1:] - 1], key


def _narrow(ids: np.ndarray) -> tuple[int, bytes]:
    """The smallest id and the distances from it, in as few bytes each as the largest takes."""
    base = int(ids.min())
    steps = ids.view(np.uint64) - np.array(base).view(np.uint64)
    return base, steps.astype(np.min_scalar_type(steps.max())).tobytes()


def _wide(base: int, steps: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(steps, dtype=f"u{len(steps) // n}").astype(np.uint64)
    return (values + np.array(base, dtype=np.int64).view(np.uint64)).view(np.int64)


def _bundles(docs: DataFrame) -> DataFrame:
    """(bundle, ids, sizes, texts): long texts' words, compressed, a few MB in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=1)
        ids, sizes, texts, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                                               pa.array([pack.compress(" ".join(texts).encode())], pa.binary())],
                                              names=["ids", "sizes", "texts"])

        for batch in batches:
            for doc_id, n, words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "words"))):
                if ids and size + len(words) > BUNDLE_BYTES:
                    yield row()
                    ids, sizes, texts, size = [], [], [], 0
                ids.append(doc_id)
                sizes.append(n)
                texts.append(words)
                size += len(words)
        if ids:
            yield row()

    made = docs.mapInArrow(run, "ids array<bigint>, sizes array<bigint>, texts binary")
    return stored(made.withColumn("bundle", F.monotonically_increasing_id()), "substrings-texts")


def _table(columns: dict[str, list]) -> pa.Table:
    return pa.table({c: pa.array(v, pa.int64() if c in ("kind", "range", "bundle", "base") else pa.binary()) for c, v in columns.items()})


def _read(table: pa.Table, column: str, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A column of packed arrays as one array, and how many entries each row has."""
    parts = [np.frombuffer(x, dtype=kind) for x in table[column].to_pylist()]
    return np.concatenate([np.zeros(0, dtype=kind), *parts]), np.array([len(x) for x in parts], dtype=np.int64)


def _answers(kind: int, messages: pa.Table, yes: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """A bit for each entry of the messages; a message without a yes gets no answer."""
    out: dict[str, list] = {c: [] for c in ("kind", "range", "bundle", "bits")}
    for r, bundle, bits in zip(messages["range"].to_pylist(), messages["bundle"].to_pylist(), np.split(yes, np.cumsum(sizes)[:-1])):
        if bits.any():
            for c, v in zip(out, (kind, r, bundle, np.packbits(bits).tobytes())):
                out[c].append(v)
    return _table(out)


def _said(answers: pa.Table, kind: int, of: np.ndarray) -> np.ndarray:
    """The answers' bits for the keys that were sent, whose ranges are ``of``."""
    bits = {r: b for k, r, b in zip(*(answers[c].to_pylist() for c in ("kind", "range", "bits"))) if k == kind}
    out = np.zeros(len(of), dtype=bool)
    for r, a, b in _slices(of):
        if r in bits:
            out[a:b] = np.unpackbits(np.frombuffer(bits[r], dtype=np.uint8), count=b - a)
    return out


def _shared_anchors(messages: pa.Table) -> pa.Table:
    """A hash range's answer: which of a bundle's anchors another bundle has too."""
    keys, sizes = _read(messages, "keys", np.uint32)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    yes = np.zeros(len(keys), dtype=bool)
    yes[order[1:][same]] = yes[order[:-1][same]] = True
    return _answers(ANCHORS, messages, yes, sizes)


def _late(messages: pa.Table) -> pa.Table:
    """A hash range's answer: which of a bundle's windows start elsewhere in a document
    with a smaller id than all of the bundle's own."""
    (low, sizes), (high, _) = _read(messages, "low"), _read(messages, "high")
    least = np.concatenate([_wide(b, x, n) for b, x, n in zip(messages["base"].to_pylist(), messages["least"].to_pylist(), sizes.tolist())])
    first, _, key = _grouped(least, low, high)
    return _answers(WINDOWS, messages, least > least[first][key], sizes)


def removed(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text."""
    if not is_cover(cover, period) or not 0 < period < window:
        raise ValueError("cover must be a difference cover of a period below the window length")
    run_length = window - period + 1
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACE_CLASS}]+", " "))
    n_words = F.when(F.col("words") == "", F.lit(0)).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words.alias("words")).withColumn("n_words", n_words.cast("bigint"))
    long_enough = F.col("doc_id").isNotNull() & (F.col("n_words") >= window)
    texts = _bundles(base.where(long_enough))
    total = texts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, n: a + n))).first()[0] or 0
    ranges = max(1, total // RANGE_WORDS, min(3 * docs.sparkSession.sparkContext.defaultParallelism, total // LEAST_RANGE_WORDS))

    def anchors(t: Texts) -> tuple[np.ndarray, ...]:
        """Cover places, the different hashes there, which documents have the smallest
        and largest id of each, and which hash each place has."""
        at = t.at_cover(run_length, period, cover)
        hashes = t.runs(t.words(0), run_length, 0, at)
        keys = _ranges_of(hashes, ranges) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
        first, last, key = _grouped(t.ids[t.of[at]], keys)
        return at, keys[first], t.of[at[first]], t.of[at[last]], key

    def windows(t: Texts, answers: pa.Table) -> tuple[np.ndarray, ...]:
        """Places of the windows around anchors that occur twice, which of the different
        windows each has; of these the hashes, the smallest id and whether they are sent."""
        at, keys, first, last, anchor = anchors(t)
        far = _said(answers, ANCHORS, keys >> np.uint64(32))

        def near(which: np.ndarray) -> np.ndarray:
            a = at[which[anchor]]
            return t.covered(np.maximum(a - period + 1, t.starts[t.of[a]]), a + 1)

        places = np.flatnonzero(near(far | (t.ids[first] != t.ids[last])) & (t.place + window <= t.sizes[t.of]))
        low, high = t.windows(window, places) if len(places) else (np.zeros(0, dtype=np.uint64),) * 2
        ids = t.ids[t.of[places]]
        first, _, key = _grouped(ids, low, high)
        sent = np.zeros(len(first), dtype=bool)
        sent[key[near(far)[places]]] = True
        return places, key, low[first], high[first], ids[first], sent

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _sums()
        for batch in batches:
            for row in batch.to_pylist():
                keys = anchors(Texts(row, sums))[1]
                parts = _slices(keys >> np.uint64(32))
                keys = keys.astype(np.uint32)
                yield from _table({"range": [r for r, _, _ in parts], "bundle": [row["bundle"]] * len(parts),
                                   "keys": [keys[a:b].tobytes() for _, a, b in parts]}).to_batches()

    def ask_windows(bundle: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("range", "bundle", "low", "high", "base", "least")}
        for row in bundle.to_pylist() if answers.num_rows else ():
            _, _, low, high, least, sent = windows(Texts(row, _sums()), answers)
            low, high, least = low[sent], high[sent], least[sent]
            for r, a, b in _slices(_ranges_of(low, ranges)):
                for c, v in zip(out, (r, row["bundle"], low[a:b].tobytes(), high[a:b].tobytes(), *_narrow(least[a:b]))):
                    out[c].append(v)
        return _table(out)

    def cut(bundle: pa.Table, answers: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        for row in bundle.to_pylist():
            t = Texts(row, _sums())
            places, key, low, _, least, sent = windows(t, answers)
            late = np.zeros(len(low), dtype=bool)
            late[sent] = _said(answers, WINDOWS, _ranges_of(low[sent], ranges))
            places = places[late[key] | (least[key] < t.ids[t.of[places]])]
            gone = t.covered(places, places + window)
            words = t.data.decode().split(" ")
            for doc_id, a, b in zip(t.ids.tolist(), t.starts.tolist(), t.ends.tolist()):
                out = gone[a:b]
                kept = words[a:b] if not out.any() else [w for w, o in zip(words[a:b], out.tolist()) if not o]
                for c, v in zip(found, (doc_id, b - a, int(out.sum()), " ".join(kept))):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("doc_id", "n_words", "n_removed", "kept_text"), found, kinds)})

    answer = "kind bigint, range bigint, bundle bigint, bits binary"
    asked = texts.mapInArrow(ask_anchors, "range bigint, bundle bigint, keys binary")
    shared = stored(asked.groupBy("range").applyInArrow(_shared_anchors, answer), "substrings-shared")
    wanted = texts.groupBy("bundle").cogroup(shared.groupBy("bundle")).applyInArrow(
        ask_windows, "range bigint, bundle bigint, low binary, high binary, base bigint, least binary")
    answers = shared.unionByName(wanted.groupBy("range").applyInArrow(_late, answer))
    # Both cogroups read one exchange of the texts.
    judged = texts.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(
        cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
    return judged.unionByName(base.where(~F.coalesce(long_enough, F.lit(False))).select(
        "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("words").alias("kept_text")))


def report(docs: DataFrame) -> DataFrame:
    """The registered query: the digests of the kept texts."""
    return removed(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(words, s, s + 49), ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM d WHERE len(words) >= 50)
), f AS (
  SELECT h, min(doc_id) AS least FROM w GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, s + k AS i
  FROM (SELECT w.doc_id, w.s FROM w JOIN f USING (h) WHERE f.least < w.doc_id), range(50) AS r(k)
), k AS (
  SELECT x.doc_id, count(*) FILTER (WHERE gone.i IS NOT NULL) AS n_removed,
         coalesce(string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE gone.i IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) AS x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i
  GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
