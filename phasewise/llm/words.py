"""Word hashes of many texts at once, with numpy over UTF-8 bytes.

A word's hash is a polynomial over its bytes modulo 2**64, each byte replaced by a random
64-bit number, followed by a bit mixer. Prefix sums give the hashes of all words of a slice
of texts without a Python step per word; runs of words are hashed the same way. All
constants follow from a fixed seed, so every worker computes the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at a time; longer texts form a slice of their own.
SLICE = 1 << 18

_draw = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _draw.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASES = [0x9E3779B97F4A7C13 | 3, 0xC2B2AE3D27D4EB4B | 3]
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n, SLICE + 4096)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_POWERS = [_Powers(b) for b in _BASES]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def byte_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words between blanks: everything but space and the bytes 9 to 13.
BLANK_SEPARATED = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
#: Runs of ASCII digits, lower-case letters and all characters beyond ASCII.
ALPHANUMERIC = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold about ``SLICE`` bytes each."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > SLICE:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


class Words:
    """The words of consecutive texts: byte places, hashes, and the bounds of each text."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        # A newline between texts keeps words from growing together.
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        inside = table[raw]
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            change = np.concatenate(([0], change))
        self.starts, self.ends = change[0::2], change[1::2]
        self._values = _BYTES[raw]
        self.hashes = mix(_spans(self._values, self.starts, self.ends, 0))
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        limits = np.concatenate(([0], np.cumsum(lengths)))
        #: Word ``bounds[i]`` is the first of text i.
        self.bounds = np.searchsorted(self.starts, limits)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def run(self, begin: int, size: int) -> bytes:
        return b" ".join(self.word(i) for i in range(begin, begin + size))

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of at least ``size`` bytes, and a hash of their first ``size`` bytes."""
        own = np.flatnonzero(self.ends - self.starts >= size)
        begin = self.starts[own]
        return own, mix(_spans(self._values, begin, begin + size, 0) + _U(size))

    def run_hashes(self, size: int, second: bool = False) -> np.ndarray:
        """Hash of the ``size`` words from each word on; the last ``size - 1`` have none.

        Runs may reach into the next text; ``run_inside`` says which ones do not. The
        second hash is independent of the first given the words' own hashes.
        """
        n = len(self.hashes)
        if n < size:
            return np.empty(0, dtype=np.uint64)
        values = mix(self.hashes ^ _U(0xA0761D6478BD642F)) if second else self.hashes
        begin = np.arange(n - size + 1)
        return mix(_spans(values, begin, begin + size, 1 if second else 0) + _U(size))

    def run_inside(self, size: int) -> np.ndarray:
        n = len(self.hashes)
        if n < size:
            return np.empty(0, dtype=bool)
        end = self.bounds[1:][self.text_of_word()[: n - size + 1]]
        return np.arange(n - size + 1) + size <= end


def _spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    up, down = _POWERS[which].get(len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[end] - sums[begin]) * down[begin]


def utf8(texts) -> list[bytes]:
    """The texts of an Arrow column as bytes; null counts as empty."""
    import pyarrow as pa

    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
