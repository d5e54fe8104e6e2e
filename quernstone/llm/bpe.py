"""Byte-level BPE: encoding and decoding by batched numpy merge rounds.

The distinct pre-tokens of a batch that are not cached yet lie in one flat symbol
array.  Each round looks up the ranks of all adjacent pairs by binary search over
the sorted pair keys, finds the lowest rank of every word, applies it wherever it
stands in that word, and drops the words that have no pair left.

Defined results: a null text encodes as an empty text; an empty text has no ids;
the text of a special token becomes that token's id; other columns are kept as they
are, whatever their names (only the output column must be new).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import sliced, unused

#: Fixed pattern of the byte-level pre-tokenizer; white space is Unicode's property.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

_BITS = 20  # of a symbol id in a pair key
_NONE = np.int64(1 << 40)
#: Pre-tokens cached in one worker; the cache starts anew beyond that.
CACHE = 250_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Arrays made of a tokenizer file's vocabulary and merges."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        if size >= 1 << _BITS:
            raise ValueError("vocabulary too large for the pair keys")
        self.text_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.text_of[i] = as_bytes(token)
        for token, i in self.special.items():
            self.text_of[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << _BITS) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pretoken = regex.compile(PRETOKEN)
        self.cache: dict[str, bytes] = {}
        special = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.split = regex.compile(f"({special})") if special else None

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``_NONE`` where the pair does not merge."""
        key = (left << _BITS) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian uint32) of each word."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[flat]
        owner = np.repeat(np.arange(len(words)), sizes)
        done: list[bytes] = [b""] * len(words)

        def retire(symbols: np.ndarray, owner: np.ndarray) -> None:
            if not len(owner):
                return
            cuts = np.flatnonzero(np.diff(owner)) + 1
            packed = symbols.astype("<u4").tobytes()
            bounds = [0, *(4 * cuts).tolist(), len(packed)]
            for w, a, b in zip(owner[np.concatenate(([0], cuts))].tolist(), bounds, bounds[1:]):
                done[w] = packed[a:b]

        def ranked(at: np.ndarray) -> np.ndarray:
            """Rank of the pair that begins at each of these places."""
            at = at[at + 1 < len(symbols)]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self.lookup(symbols[at], symbols[at + 1])

        rank = np.full(len(symbols), _NONE)
        ranked(np.arange(len(symbols)))
        while len(symbols):
            first = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
            best = np.minimum.reduceat(rank, first)
            of = np.repeat(best, np.diff(np.concatenate((first, [len(symbols)]))))
            open_ = of < _NONE
            if not open_.all():
                retire(symbols[~open_], owner[~open_])
                symbols, owner, rank, of = symbols[open_], owner[open_], rank[open_], of[open_]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == of)
            # Equal pairs can overlap (aaa): of a run of neighbours, every other one merges.
            run = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(owner[hit]) != 0)))
            start = hit[run][np.cumsum(run) - 1]
            hit = hit[(hit - start) % 2 == 0]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols[hit] = self.made[of[hit]]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            at = hit - np.arange(len(hit))
            before = at[at > 0] - 1
            rank[at] = _NONE
            ranked(at)
            ranked(before)
        return done

    def _pieces(self, text: str) -> Iterator[str]:
        if self.split is None or "<" not in text and not self.split.search(text):
            yield text
        else:
            yield from self.split.split(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for token, i in self.special.items():
            cache[token] = np.array([i], "<u4").tobytes()
        found: list[list[str]] = []
        known: list[list] = []
        for text in texts:
            parts: list[str] = []
            for piece in self._pieces(text):
                if piece in self.special:
                    parts.append(piece)
                elif piece:
                    parts += self.pretoken.findall(piece)
            found.append(parts)
            known.append(list(map(cache.get, parts)))
        fresh = list({w for parts, ids in zip(found, known) if None in ids for w, x in zip(parts, ids) if x is None})
        for at in range(0, len(fresh), 200_000):
            group = fresh[at : at + 200_000]
            cache.update(zip(group, self.merge([w.encode() for w in group])))
        return [b"".join(map(cache.__getitem__, parts) if None in ids else ids) for parts, ids in zip(found, known)]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        known = self.text_of
        return b"".join(map(known.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(raw: str) -> Vocabulary:
    """One vocabulary and word cache for each worker process."""
    if raw not in _loaded:
        _loaded.clear()
        _loaded[raw] = Vocabulary(raw)
    return _loaded[raw]


def _slices(batches: Iterator[pa.Array], most: int = 500_000) -> Iterator[list]:
    """Runs of values of about ``most`` characters or bytes, so that memory does not follow the Arrow batch."""
    for values in sliced(batches):
        part: list = []
        held = 0
        for v in values:
            part.append(v.as_py())
            held += len(part[-1] or "")
            if held >= most:
                yield part
                part, held = [], 0
        if part:
            yield part


class ByteBPE:
    """A tokenizer file on the driver, sent once to each executor (its size is fixed)."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            self._raw = spark.sparkContext.broadcast(f.read())

    def encode(self, text: Column | str) -> Column:
        """The ids of a text column: packed little-endian uint32, as binary."""
        raw = self._raw

        @F.arrow_udf("binary")
        def bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vocab = _vocabulary(raw.value)
            for part in _slices(batches):
                yield pa.array(vocab.encode([t or "" for t in part]), pa.binary())

        return bpe_encode(text)

    def decode(self, ids: Column | str) -> Column:
        """The text of a column of packed ids (null: empty)."""
        raw = self._raw

        @F.arrow_udf("string")
        def bpe_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vocab = _vocabulary(raw.value)
            for part in _slices(batches):
                yield pa.array([vocab.decode(x or b"") for x in part], pa.string())

        return bpe_decode(ids)

    def round_trip(self, text: Column | str) -> Column:
        """Struct (ids, decoded): the ids of a text column and the text decoded from them, in one worker."""
        raw = self._raw

        @F.arrow_udf("struct<ids binary, decoded string>")
        def bpe_round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vocab = _vocabulary(raw.value)
            for part in _slices(batches):
                ids = vocab.encode([t or "" for t in part])
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([vocab.decode(x) for x in ids], pa.string())], ["ids", "decoded"])

        return bpe_round_trip(text)


def tokenize(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column of packed ids and, if named, one of the text decoded from them."""
    codec = ByteBPE(docs.sparkSession, path)
    if decoded is None:
        return docs.withColumn(ids, codec.encode(F.col(text)))
    pair = unused("pair", docs.columns)
    both = docs.withColumn(pair, codec.round_trip(F.col(text)))
    return both.withColumns({ids: F.col(pair)["ids"], decoded: F.col(pair)["decoded"]}).drop(pair)


def n_tokens(ids: Column | str) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")
