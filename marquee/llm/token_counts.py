"""Token counts by prefix dynamic programming.

For a piece of text that the tokenizer never merges across, the count of every
byte prefix comes from one left-to-right pass: the last token of prefix ``i``
is the longest vocabulary entry ending at ``i`` that byte-pair encoding would
leave beside the last token of what precedes it, so
``count[i] = count[i - len(last)] + 1``. Sums over pieces give the count at
every prefix of a whole text; budget and truncation questions read that table
and never encode again.

Nulls count as empty texts; empty texts have no token. Special strings inside
a text are one token each, as the tokenizer's default has it. Repeated rows
are counted one by one; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
from itertools import accumulate

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import text_pass

#: The pre-tokenizer's published pattern (a fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Largest number of remembered strings per table; a full one is emptied.
MEMORY = 800_000
#: Longer strings (code points) are counted anew each time, so a table's bytes are bounded too.
LONGEST = 64
TOKEN_LIMIT = 1024

_COUNTERS: dict[str, PrefixCounter] = {}


def _byte_alphabet() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable Latin-1 characters
    stand for themselves, the other bytes for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Counts of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_alphabet()
        added = [a["content"] for a in spec["added_tokens"]]
        as_bytes = lambda s: bytes(to_byte[ch] for ch in s)
        # numbers in merge order: the 256 bytes first, then each merge's result
        self.number = {bytes([b]): b for b in range(256)}
        self.left, self.right, self.merged = list(range(256)), list(range(256)), {}
        for a, b in spec["model"]["merges"]:
            x, y = self.number[as_bytes(a)], self.number[as_bytes(b)]
            z = self.number.setdefault(as_bytes(a + b), len(self.left))
            self.merged[x, y] = z
            if z == len(self.left):
                self.left.append(x)
                self.right.append(y)
        self.ending = ahocorasick.Automaton()  # finds every token that ends at each byte
        for token, n in self.number.items():
            self.ending.add_word(token.decode("latin-1"), (len(token), n))
        self.ending.make_automaton()
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pieces = regex.compile(PIECES)
        self.space = regex.compile(r"\s")
        self.inner_space = regex.compile(r"(?<=\S) (?=\S)")
        self.beside: dict[tuple[int, int], bool] = {}
        self.piece_counts: dict[str, int] = {}
        self.chunk_counts: dict[str, int] = {}

    def _stays_apart(self, a: int, b: int) -> bool:
        """Whether the encoder leaves token ``a`` before token ``b``. Undo both
        tokens' merges, latest first: a merge across the border that ranks
        before the one undone last would have been taken instead."""
        latest = 1 << 60
        while self.merged.get((a, b), latest) >= latest:
            whole_a, whole_b = a < 256, b < 256
            if whole_a and whole_b:
                return True
            if whole_b or a > b and not whole_a:
                latest, a = a, self.right[a]
            else:  # on a tie the left merge comes first, so equal ranks count as earlier
                latest, b = b + 1, self.left[b]
        return False

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token count of every byte prefix of one piece, the empty one first."""
        counts, last, solved = [0], [-1], 0
        beside = self.beside
        for at, (length, token) in self.ending.iter(piece.decode("latin-1")):
            if at < solved:
                continue
            start = at + 1 - length
            if start:
                pair = (last[start], token)
                apart = beside.get(pair)
                if apart is None:
                    if len(beside) >= MEMORY:
                        beside.clear()
                    apart = beside[pair] = self._stays_apart(*pair)
                if not apart:
                    continue
            counts.append(counts[start] + 1)
            last.append(token)
            solved = at + 1
        return counts

    def _piece(self, piece: str) -> int:
        if len(piece) > LONGEST:
            return self.prefix_counts(piece.encode())[-1]
        n = self.piece_counts.get(piece)
        if n is None:
            if len(self.piece_counts) >= MEMORY:
                self.piece_counts.clear()
            n = self.piece_counts[piece] = self.prefix_counts(piece.encode())[-1]
        return n

    def _chunks(self, chunks: list[str]) -> int | None:
        """Sum over chunks that were cut at single inner spaces (the space goes
        to the chunk after it); None if a cut was not at such a space."""
        known = self.chunk_counts
        counts = list(map(known.get, chunks))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    chunk = chunks[i]
                    n = known.get(chunk)
                    if n is None:
                        if not chunk or self.edge_space(chunk):
                            return None
                        n = self._chunk(chunk)
                    counts[i] = n
        return sum(counts)

    def _chunk(self, chunk: str) -> int:
        n = sum(map(self._piece, self.pieces.findall(" " + chunk)))
        if len(chunk) <= LONGEST:
            if len(self.chunk_counts) >= MEMORY:
                self.chunk_counts.clear()
            self.chunk_counts[chunk] = n
        return n

    def edge_space(self, chunk: str) -> bool:
        return self.space.match(chunk, 0) is not None or self.space.match(chunk, len(chunk) - 1) is not None

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return sum(map(self._plain, parts)) + len(parts) - 1
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        chunks = text.split(" ")
        if len(chunks) > 1 and (not chunks[0] or self.edge_space(chunks[0])):
            total = None
        else:
            total = self._chunks(chunks[1:])
        if total is None:  # some space stands beside another white space
            chunks = self.inner_space.split(text)
            total = 0
            for chunk in chunks[1:]:
                n = self.chunk_counts.get(chunk)
                total += self._chunk(chunk) if n is None else n
        return total + sum(map(self._piece, self.pieces.findall(chunks[0])))


class PrefixTable:
    """Exact token counts of every prefix (in code points) of one text.

    Kept per pre-token piece: where it ends and the count up to there; of the
    piece asked for last, the count of every prefix. A piece boundary is the
    same in the prefix ``text[:p]`` and in the text when the piece ends two or
    more characters before ``p`` (the pattern looks at most that far ahead), and
    from there to ``p`` inside the next piece is one piece.
    """

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.specials: list[tuple[int, int]] = []
        self.border: tuple[int, list[int]] = (-1, [])
        ends, counts, at = [0], [0], 0
        for segment, special in _segments(counter, text):
            if special:
                self.specials.append((at, at + len(segment)))
                at += len(segment)
                ends.append(at)
                counts.append(counts[-1] + 1)
                continue
            pieces = counter.pieces.findall(segment)
            ends.extend(accumulate((len(p) for p in pieces), initial=at))
            counts.extend(accumulate(map(counter._piece, pieces), initial=counts[-1]))
            at += len(segment)
        self.ends, self.counts = ends, counts

    def at(self, p: int) -> int:
        """Tokens of ``text[:p]``."""
        if p >= len(self.text):
            return self.counts[-1]
        reach = p - 2
        # a special string cut by the end of the prefix is ordinary text there
        m = bisect.bisect_left(self.specials, (p,)) - 1
        inside = m >= 0 and p < self.specials[m][1]
        if inside:
            reach = min(reach, self.specials[m][0] - 2)
        k = max(bisect.bisect_right(self.ends, reach) - 1, 0)
        if not inside and self.ends[k] <= reach and p <= self.ends[min(k + 1, len(self.ends) - 1)]:
            return self.counts[k + 1] if p == self.ends[k + 1] else self.counts[k] + self._within(k)[p - self.ends[k]]
        return self.counts[k] + self.counter.count(self.text[self.ends[k]:p])

    def _within(self, k: int) -> list[int]:
        """Token counts of the prefixes (in code points) of the piece after end ``k``."""
        if self.border[0] != k:
            piece = self.text[self.ends[k]:self.ends[k + 1]]
            counts = self.counter.prefix_counts(piece.encode())
            if not piece.isascii():
                counts = [counts[b] for b in accumulate((len(ch.encode()) for ch in piece), initial=0)]
            self.border = k, counts
        return self.border[1]

    def prefixes(self) -> list[int]:
        """The whole table: the tokens of every prefix, the empty one first."""
        return list(map(self.at, range(len(self.text) + 1)))

    def cut(self, budget: int) -> int:
        """The longest prefix, in code points, of at most ``budget`` tokens."""
        if self.counts[-1] <= budget:
            return len(self.text)
        k = bisect.bisect_right(self.counts, budget) - 1
        stop = self.ends[min(k + 2, len(self.ends) - 1)]
        for p in range(stop, self.ends[k], -1):
            if self.at(p) <= budget:
                return p
        return self.ends[k]


def _segments(counter: PrefixCounter, text: str):
    at = 0
    if counter.special is not None:
        for m in counter.special.finditer(text):
            if m.start() > at:
                yield text[at:m.start()], False
            yield m.group(), True
            at = m.end()
    if at < len(text):
        yield text[at:], False


def counter(path: str) -> PrefixCounter:
    """One counter per worker process and vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, limit: int = TOKEN_LIMIT, path: str | None = None) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, whether they exceed ``limit`` and the
    longest prefix (code points) within it."""
    schema = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("over_limit", T.BooleanType()), T.StructField("cut_chars", T.LongType())])

    def start():
        c = counter(path or vocabulary_path())

        def one(text: str | None) -> tuple:
            text = text or ""
            n = c.count(text)
            cut = len(text) if n <= limit else PrefixTable(c, text).cut(limit)
            return len(text.encode()), n, n > limit, cut
        return one

    return text_pass(docs, schema, start, ["doc_id"])


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored table itself, per document: the token count of every prefix
    (in code points, the empty one first), and piece ends and counts up to them."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("ends", ints), T.StructField("counts", ints), T.StructField("prefixes", ints)])

    def start():
        c = counter(path or vocabulary_path())

        def one(text: str | None) -> tuple:
            t = PrefixTable(c, text or "")
            return t.ends, t.counts, t.prefixes()
        return one

    return text_pass(docs, schema, start, ["doc_id"])


def within_budget(prefixes: DataFrame, budget: int) -> DataFrame:
    """From a stored prefix table: per document, its tokens, the longest prefix
    and the longest run of whole pieces within ``budget`` -- no text and no
    encoding needed."""
    fits = F.size(F.filter("counts", lambda c: c <= budget))
    cut = F.array_max(F.transform("prefixes", lambda c, p: F.when(c <= budget, p)))
    return prefixes.select("doc_id", F.element_at("counts", -1).alias("n_tokens"), cut.alias("cut_chars"),
                           F.element_at("ends", fits).alias("piece_cut_chars"))
