"""Word numbers for window hashing: each distinct word is looked up once and
texts become arrays of 64-bit word hashes with slot marks."""

from __future__ import annotations

import numpy as np

MEMORY = 300_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# Measuring units that a template may vary.
UNITS = frozenset("""mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t oz lb lbs pound pounds
gram grams ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours
day days week weeks month months year years dollar dollars euro euros cent cents usd eur gbp percent degree degrees
celsius fahrenheit mph kmh kph w kw watt watts v volt volts hz khz mhz ghz kb mb gb tb""".split())
PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”‘’…-–—|*#%&$"

WORD, NUMBER, UNIT = 0, 1, 2
NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = (np.uint64(x) for x in (11, 13, 17))


class Lexer:
    """Remembers per distinct raw word: hash of its lower-case form without outer
    punctuation (0: nothing left), kind, whether it is capitalised, and whether
    a sentence ends with it."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.hashes, self.kinds, self.capital, self.ends = [], [], [], []
        self._arrays, self._room, self._filled = None, None, 0

    def _grow(self) -> None:
        """Bring the arrays up to the lists; room doubles, so this costs little per new word."""
        n = len(self.hashes)
        lists = (self.hashes, self.kinds, self.capital, self.ends)
        kinds = (np.uint64, np.int8, bool, bool)
        if self._room is None or len(self._room[0]) < n:
            old = self._room
            self._room = [np.zeros(max(1024, 2 * n), dtype=k) for k in kinds]
            if old:
                for new, a in zip(self._room, old, strict=True):
                    new[:self._filled] = a[:self._filled]
        for a, values in zip(self._room, lists, strict=True):
            a[self._filled:n] = values[self._filled:n]
        self._filled = n
        self._arrays = [a[:n] for a in self._room]

    def _add(self, raw: str) -> None:
        import xxhash
        bare = raw.strip(PUNCTUATION)
        lower = bare.lower()
        # letters only (most words) hold no digit: one look at the word instead of one per character
        digits = not bare.isalpha() and any(ch.isdigit() for ch in bare)
        kind = NUMBER if digits and not any(ch.isalpha() for ch in bare) else UNIT if lower in UNITS else WORD
        self.number[raw] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(lower, 7) | 32 if lower else 0)
        self.kinds.append(kind)
        self.capital.append(len(bare) > 1 and bare[0].isupper() and bare[1:].islower())
        self.ends.append(raw.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":", "|") or raw[-1:] == "\n")

    def read(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Raw words with something left of them, and per word hash, kind,
        capital and start of sentence."""
        if len(self.number) > MEMORY:
            self.__init__()
        raw = text.split()
        if not raw:
            empty = np.zeros(0, dtype=np.uint64)
            return [], empty, empty, empty.astype(bool), empty.astype(bool)
        at = list(map(self.number.get, raw))
        if None in at:
            for w in set(raw):
                if w not in self.number:
                    self._add(w)
            at = list(map(self.number.__getitem__, raw))
        if self._arrays is None or len(self._arrays[0]) < len(self.hashes):
            self._grow()
        place = np.array(at, dtype=np.int64)
        hashes, kinds, capital, ends = (a[place] for a in self._arrays)
        first = np.concatenate(([True], ends[:-1]))
        keep = hashes != 0
        if not keep.all():
            raw = [w for w, k in zip(raw, keep.tolist(), strict=True) if k]
            hashes, kinds, capital, first = hashes[keep], kinds[keep], capital[keep], first[keep]
        return raw, hashes, kinds, capital, first

    def template(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Raw words, canonical hashes, literal hashes and slot marks: numbers, names
        (capitals inside a sentence) and units become typed placeholders."""
        raw, hashes, kinds, capital, first = self.read(text)
        name = capital & ~first & (kinds == WORD)
        out = np.where(kinds == NUMBER, NUMBER_SLOT, np.where(kinds == UNIT, UNIT_SLOT, np.where(name, NAME_SLOT, hashes)))
        return raw, out.astype(np.uint64), hashes, (kinds != WORD) | name


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A mixed polynomial hash of every run of ``k`` words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * MULTIPLIER + hashes[j:j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))
