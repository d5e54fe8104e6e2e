"""Words, spans and rolling fingerprints over whole batches of texts, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+``.  The delimiters are ASCII, so words can be found
on UTF-8 bytes; every function here works on one flat byte array that holds many
texts, each followed by a newline, so that no word crosses from one text to the next.
"""

from __future__ import annotations

import numpy as np

#: The SQL (and Spark) pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"

_DELIM = np.zeros(256, bool)
_DELIM[[9, 10, 11, 12, 13, 32]] = True

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur3's), vectorised."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MIX)


def flatten(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a newline after each, and each text's start (one more at the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    return flat, starts


def word_spans(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words in a flat byte array."""
    inside = np.concatenate(([False], ~_DELIM[flat], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


_K = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """K**i and K**-i modulo 2**64 for i up to n."""
    if len(_powers.get("up", ())) <= n:
        for name, k in (("up", _K), ("down", pow(_K, -1, 1 << 64))):
            p = np.full(2 * n + 2, k, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


class Fingerprints:
    """64-bit fingerprints of any spans of a symbol array (uint64).

    Differences of prefix sums of ``symbol * K**position`` are shifted back to position
    zero by the inverse of K, and mixed with the span's length.
    """

    def __init__(self, symbols: np.ndarray):
        up, self._down = _power(len(symbols))
        self._sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _MIX)

    def grams(self, n: int) -> np.ndarray:
        """Of every run of n symbols."""
        count = len(self._sums) - n
        if count <= 0:
            return np.zeros(0, np.uint64)
        raw = self._sums[n:] - self._sums[:-n]
        raw *= self._down[:count]
        raw += np.uint64(n * int(_MIX) % (1 << 64))
        return mix(raw)

    def without_each(self) -> np.ndarray:
        """Of all symbols but one, for each one left out."""
        n = len(self._sums) - 1
        raw = self._sums[:-1] + (self._sums[-1] - self._sums[1:]) * self._down[1]
        return mix(raw + np.uint64((n - 1) * int(_MIX) % (1 << 64)))


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word."""
    return Fingerprints(_BYTE[flat]).spans(starts, ends)


def byte_symbols(flat: np.ndarray) -> np.ndarray:
    return _BYTE[flat]
