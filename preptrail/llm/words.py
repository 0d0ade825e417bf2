"""Words of whole batches as numpy hashes; a word is ``[^\\x20\\x09-\\x0D]+``.

A hash is a polynomial over random 64-bit values modulo 2**64, so the hash of any range is a difference
of prefix sums. Two lanes with own values give 128 bits.
"""

import numpy as np

SLICE = 1 << 21
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Lane:
    """One family of hashes: values of bytes, and powers of two odd bases with their inverses."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.values = draw.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
        self.byte_base, self.word_base = (draw.integers(0, 2**64, 2, dtype=np.uint64, endpoint=False) | np.uint64(5)).tolist()
        self.powers: dict[tuple[int, bool], np.ndarray] = {}

    def power(self, base: int, count: int, inverse: bool = False) -> np.ndarray:
        """The first ``count`` powers of the base or of its inverse; computed once and grown."""
        known = self.powers.get((base, inverse))
        if known is None or len(known) < count:
            factor = pow(base, -1, 2**64) if inverse else base
            known = np.full(max(count, SLICE), factor, dtype=np.uint64)
            known[0] = 1
            known = np.multiply.accumulate(known)
            self.powers[base, inverse] = known
        return known[:count]

    def sums(self, values: np.ndarray, base: int) -> np.ndarray:
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.power(base, len(values)), out=out[1:])
        return out

    def words(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every word; the text is taken in slices, each of whole words."""
        out = np.empty(len(starts), dtype=np.uint64)
        first = 0
        while first < len(starts):
            begin = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + SLICE, side="right")))
            sums = self.sums(self.values[text[begin : ends[last - 1]]], self.byte_base)
            low, high = starts[first:last] - begin, ends[first:last] - begin
            out[first:last] = (sums[high] - sums[low]) * self.power(self.byte_base, int(low[-1]) + 1, True)[low]
            first = last
        return mix(out)


LANES = (Lane(1), Lane(2))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others (an invertible finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of words before it (one more
    entry than texts). ``bounds`` are the texts' places in the joined bytes; no word crosses one."""
    inside = ~SEPARATOR[text]
    edges = bounds[(bounds > 0) & (bounds < len(text))]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, bounds)


class Windows:
    """Hashes of ranges of consecutive words, by prefix sums over the words' hashes."""

    def __init__(self, lane: Lane, hashes: np.ndarray):
        self.lane, self.sums = lane, lane.sums(hashes, lane.word_base)

    def at(self, places: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """Hash of the ``width`` words from each place on."""
        if len(places) == 0:
            return np.zeros(0, dtype=np.uint64)
        inverse = self.lane.power(self.lane.word_base, int(places.max()) + 1, True)
        return mix((self.sums[places + width] - self.sums[places]) * inverse[places])


def slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbouring values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while 2 * span <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out
