"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other
numbers or names has the same template. Windows of ``WINDOW`` template words
(at least two of them words, not slots) are hash-joined between documents and
items. Before the join a document's windows are tested against a bitmap of the
items' windows; it has a fixed size whatever the benchmark's, and a false hit
only costs a row in the join.

Slot consistency: along one alignment (document place minus item place) every
item slot value must stand for one document value wherever it occurs;
alignments that break this are dropped. A document holds an item when the
windows of its consistent alignments cover ``LEAST_COVERAGE`` of the item's.

Items with the same template, equal slots in the same places, are looked for
once, under their smallest id (null if none has one). An item that is no longer
than a window is one window of its own length, so even one word counts as held
(``report`` has it; ``clean`` drops a document only for items of ``LEAST_WORDS``
words or more); it, and an item whose windows are all too full of slots, is also looked for by
windows of its literal words. Null and empty texts hold nothing and are never
found. Repeated document rows are reported once; documents without an id are
dropped by ``clean`` like others when they hold an item. Ids may be of any type;
extra columns, whatever their names, pass through ``clean``.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import free_names, row_key, stored
from marquee.llm.lexer import Lexer, windows

WINDOW = 5
LEAST_COVERAGE = 0.5
#: Words an item needs for ``clean`` to drop the documents that hold it.
LEAST_WORDS = 3
BITMAP_BITS = 24


def text_windows(lexer: Lexer, text: str | None, width: int, literal: bool) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Raw words, slot marks, and places and hashes (as signed longs) of the
    windows: all of the literal words', else those that hold two words or more."""
    raw, hashes, literals, slots = lexer.template(text or "")
    return raw, slots, *word_windows(literals if literal else hashes, slots, width, literal)


def word_windows(hashes: np.ndarray, slots: np.ndarray, width: int, literal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of :func:`text_windows`, from a text's word hashes (of
    the kind asked) and slot marks."""
    w = windows(hashes, width)
    if not len(w):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if literal:
        return np.arange(len(w)), (w ^ _kind_mask(width, True)).view(np.int64)
    upto = np.concatenate(([0], np.cumsum(slots)))
    at = np.flatnonzero(upto[width:] - upto[:-width] <= width - 2)
    return at, (w[at] ^ _kind_mask(width, False)).view(np.int64)


@cache
def _kind_mask(width: int, literal: bool) -> np.uint64:
    """Tells windows of different widths and kinds apart; zero for the usual ones."""
    return np.uint64(0 if (width, literal) == (WINDOW, False) else hash_text(np.array([width, literal])) & (1 << 64) - 1)


_SLOTS = pa.list_(pa.string())
_WINDOW = "pos int, h bigint, slots array<string>"


def _window_slots(raw: list[str], slots: np.ndarray, at: int, k: int) -> list[str | None]:
    """Per word of the window its value if it is a slot, else null."""
    return [raw[i].strip(".,;:!?\"'()").lower() if slots[i] else None for i in range(at, at + k)]


def template_key(lexer: Lexer, text: str | None) -> int:
    """Hash of an item's template and of which of its slots hold equal values."""
    raw, hashes, _, slots = lexer.template(text or "")
    ranks: dict[str, int] = {}
    equal = [ranks.setdefault(v, len(ranks)) for v in _window_slots(raw, slots, 0, len(raw)) if v is not None]
    return hash_text(np.concatenate([hashes, np.array(equal, dtype=np.uint64)]))


def item_windows(benchmark: DataFrame, k: int = WINDOW) -> DataFrame:
    """(template, item_id, n_items, n, width, literal, pos, h, slots) of every
    window of every distinct template."""
    def run(batches):
        lexer = Lexer()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                length = len(lexer.read(text or "")[0])
                if not length:
                    continue
                width = min(k, length)
                usual = text_windows(lexer, text, width, False)
                exact = length <= k or not len(usual[2])
                kinds = [(False, usual), *([(True, text_windows(lexer, text, width, True))] if exact else [])]
                n = len(kinds[-1][1][2])
                template = template_key(lexer, text)
                rows += [(item, template, n, width, literal, int(p), int(x), _window_slots(raw, slots, int(p), width))
                         for literal, (raw, slots, at, h) in kinds for p, x in zip(at, h, strict=True)]
            if rows:
                item, template, n, width, literal, pos, h, values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array(item, pa.int64()), "template": pa.array(template, pa.int64()),
                    "n": pa.array(n, pa.int32()), "width": pa.array(width, pa.int32()), "literal": pa.array(literal, pa.bool_()),
                    "pos": pa.array(pos, pa.int32()), "h": pa.array(h, pa.int64()), "slots": pa.array(values, _SLOTS)})

    rows = stored(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(
        run, "item_id bigint, template bigint, n int, width int, literal boolean, " + _WINDOW), "item-windows")
    # items without an id count as one
    first = rows.groupBy("template").agg(F.min("item_id").alias("least"), (
        F.count_distinct("item_id") + F.max(F.isnull("item_id").cast("int"))).alias("n_items"))
    named = rows.join(first, "template").where(F.col("item_id").eqNullSafe(F.col("least")))
    return stored(named.groupBy("template", "item_id", "n_items", "n", "width", "literal", "pos", "h").agg(
        F.first("slots").alias("slots")), "templates")


def hash_text(hashes: np.ndarray) -> int:
    import xxhash
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 3)).view(np.int64))


def bitmap(items: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bit for the top ``bits`` bits of every item window hash; at most
    ``2**(bits - 6)`` rows of 64 bits reach the driver, however many items."""
    top = F.shiftrightunsigned(F.col("h"), 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), top.bitwiseAND(F.lit(63)).cast("int"))
    rows = items.select(F.shiftrightunsigned(top, 6).cast("int").alias("w"), one.alias("b")).groupBy("w").agg(
        F.bit_or("b").alias("b")).collect()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    for r in rows:
        out[r.w] = r.b
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def document_windows(docs: DataFrame, items: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """Document windows (doc_id, row keys, pos, h, slots) that pass the bitmap,
    of the widths and kinds that the items have."""
    packed = np.packbits(bitmap(items, bits))
    kinds = sorted(tuple(r) for r in items.select("width", "literal").distinct().collect())

    def run(batches):
        lexer, known = Lexer(), np.unpackbits(packed).astype(bool)
        for batch in batches:
            out: dict[str, list] = {"i": [], "pos": [], "h": [], "slots": []}
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw, hashes, literals, slots = lexer.template(text or "")
                for width, literal in kinds:
                    at, h = word_windows(literals if literal else hashes, slots, width, literal)
                    hit = np.flatnonzero(known[h.view(np.uint64) >> np.uint64(64 - bits)])
                    for j in hit.tolist():
                        p = int(at[j])
                        out["i"].append(i)
                        out["pos"].append(p)
                        out["h"].append(int(h[j]))
                        out["slots"].append(_window_slots(raw, slots, p, width))
            if out["i"]:
                ids = pa.array(out["i"], pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(ids), "row_k1": batch.column("row_k1").take(ids),
                    "row_k2": batch.column("row_k2").take(ids), "pos": pa.array(out["pos"], pa.int32()),
                    "h": pa.array(out["h"], pa.int64()), "slots": pa.array(out["slots"], _SLOTS)})

    keyed = docs.select("doc_id", "text", *row_key(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, row_k1 bigint, row_k2 bigint, " + _WINDOW)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, row keys, item_id, n_items, coverage, first_word, end_word,
    item_words (at most ``k``), n_changed_slots): documents that hold an item's template with consistent slots."""
    items = item_windows(benchmark, k)
    d, b = document_windows(docs, items).alias("d"), items.alias("b")
    met = stored(d.join(b, F.col("d.h") == F.col("b.h")).select(
        "d.doc_id", "d.row_k1", "d.row_k2", "b.template", "b.item_id", "b.n_items", "b.n", "b.width", F.col("b.pos").alias("item_pos"),
        (F.col("d.pos") - F.col("b.pos")).alias("offset"),
        F.arrays_zip(F.col("b.slots").alias("asked"), F.col("d.slots").alias("found")).alias("slots")).distinct(), "window-matches")
    along = ["row_k1", "row_k2", "template", "offset"]
    values = met.select(*along, F.explode("slots").alias("s")).where("s.asked IS NOT NULL")
    per_value = values.groupBy(*along, F.col("s.asked").alias("asked")).agg(
        F.min("s.found").alias("least"), F.max("s.found").alias("most"))
    slots = per_value.groupBy(*along).agg(F.bool_and(F.col("least") == F.col("most")).alias("consistent"),
                                          F.count_if(F.col("asked") != F.col("least")).alias("n_changed"))
    good = met.drop("slots").join(slots, along, "left").where(F.coalesce("consistent", F.lit(True)))
    held = good.groupBy("doc_id", "row_k1", "row_k2", "template", "item_id").agg(
        F.first("n_items").alias("n_items"), (F.count_distinct("item_pos") / F.first("n")).alias("coverage"),
        F.min(F.col("offset") + F.col("item_pos")).alias("first_word"),
        F.max(F.col("offset") + F.col("item_pos") + F.col("width")).alias("end_word"), F.max("width").alias("item_words"),
        F.max(F.coalesce("n_changed", F.lit(0))).alias("n_changed_slots"))
    return held.where(F.col("coverage") >= least).drop("template")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item template it holds."""
    return contaminated(docs, benchmark).drop("row_k1", "row_k2", "item_words").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents that hold no item of at least ``least_words`` words (shorter
    ones stand in ordinary texts; ``report`` lists them all the same)."""
    names = free_names(docs, "row_k1", "row_k2")
    held = contaminated(docs.select("doc_id", "text"), benchmark).where(F.col("item_words") >= least_words)
    bad = stored(held.select(F.col("row_k1").alias(names[0]), F.col("row_k2").alias(names[1])).distinct(), "contaminated")
    return docs.select("*", *row_key(docs, names)).join(bad, list(names), "left_anti").select(*docs.columns)
