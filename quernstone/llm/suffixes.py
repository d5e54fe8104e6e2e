"""Byte-level substring dedup by a distributed merge sort of suffixes.

Each block sorts the suffixes at its shared anchors and sends them front-coded: the
length of the prefix shared with the one before, and the bytes after it.  A group joins
the runs with a loser tree whose losers remember the prefix they share with the last
winner, so two suffixes are compared only from there on, and the merged order comes with
its common prefix lengths.

Defined results: a null text has no bytes; a document shorter than a window keeps all;
rows with equal ids do not remove each other's bytes; ``kept`` is binary, since cuts
can fall inside a character; very long texts are treated in parts, with the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import HOT, PART, Block, Plan, find, runs_of


def _words(keys: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 8-byte words, padded with zeros at the end."""
    pad = -keys.shape[1] % 8
    return np.ascontiguousarray(np.pad(keys, ((0, 0), (0, pad))) if pad else keys).view(">u8").astype(np.uint64)


def front_coded(keys: np.ndarray) -> tuple[np.ndarray, dict[str, bytes]]:
    """Rows of bytes -> their order, shared prefix lengths (head) and remaining bytes (body)."""
    order = np.lexsort(_words(keys).T[::-1])
    keys = keys[order]
    shared = np.zeros(len(keys), np.int64)
    differ = keys[1:] != keys[:-1]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    rest = np.arange(keys.shape[1]) >= shared[:, None]
    return order, {"head": shared.astype(np.uint8).tobytes(), "body": keys[rest].tobytes()}


def unfolded(head: bytes, body: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a front-coded run, and their shared prefix lengths."""
    shared = np.frombuffer(head, np.uint8).astype(np.int64)
    own = np.arange(width) >= shared[:, None]
    place = np.where(own, np.cumsum(own).reshape(own.shape) - 1, -1)
    return np.frombuffer(body, np.uint8)[np.maximum.accumulate(place, axis=0)], shared


class LoserTree:
    """Merges sorted runs of equally long strings, each given as a list of 8-byte words.

    A loser keeps the length of the prefix that it shares with the string that beat it.
    Of two candidates, the one that shares more with the last winner is smaller; only if
    they share equally much are they compared, from the word on in which that prefix ends.
    """

    def __init__(self, runs: list[list[list[int]]], shared: list[list[int]], width: int):
        self.runs, self.shared, self.width = runs, shared, width

    def merged(self) -> tuple[list[int], list[int], list[int]]:
        """Run and place of each string in order, and the prefix it shares with the one before."""
        runs, shared, width = self.runs, self.shared, self.width
        size = 1 << max(0, (len(runs) - 1).bit_length())
        last = -(-width // 8)
        end = [1 << 64] * last  # a run that has ended: above every string
        at = [0] * size
        loser, loser_shares = [-1] * size, [0] * size
        head = [runs[r][0] if r < len(runs) and runs[r] else end for r in range(size)]

        def meet(x: list[int], y: list[int], known: int) -> tuple[bool, int]:
            """Whether x is not above y, and the prefix they share, given that they share ``known`` bytes."""
            i = known >> 3
            while i < last:
                a, b = x[i], y[i]
                if a != b:
                    return a < b, (i << 3) + 8 - (((a ^ b).bit_length() + 7) >> 3)
                i += 1
            return True, width

        level = [(r, 0) for r in range(size)]
        node = size
        while len(level) > 1:
            node >>= 1
            above = []
            for i in range(0, len(level), 2):
                (r, rs), (s, ss) = level[i], level[i + 1]
                first, same = meet(head[r], head[s], 0)
                w, x = (r, s) if first else (s, r)
                loser[node + i // 2], loser_shares[node + i // 2] = x, max(0, same)
                above.append((w, 0))
            level = above
        r, rs = level[0]
        order_run, order_at, lcp = [], [], []
        while head[r] is not end:
            order_run.append(r)
            order_at.append(at[r])
            lcp.append(rs)
            k = at[r] = at[r] + 1
            if k < len(runs[r]):
                x, rs = runs[r][k], shared[r][k]
            else:
                x, rs = end, -1
            head[r] = x
            node = (r + size) >> 1
            while node:
                ss = loser_shares[node]
                if ss > rs:
                    loser_shares[node] = rs
                    rs = ss
                    r, loser[node] = loser[node], r
                elif ss == rs:
                    s = loser[node]
                    first, same = meet(head[r], head[s], rs if rs > 0 else 0)
                    loser_shares[node] = same
                    if not first:
                        r, loser[node] = s, r
                node >>= 1
        return order_run, order_at, lcp


def _merge(rows: pd.DataFrame, width: int, symbols) -> tuple[np.ndarray, object, np.ndarray]:
    keys, runs, shares = [], [], []
    for head, body in zip(rows["head"], rows["body"]):
        k, s = unfolded(head, body, width)
        keys.append(k)
        runs.append(_words(k).tolist())
        shares.append(s.tolist())
    run, at, lcp = LoserTree(runs, shares, width).merged()
    base = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    order = base[np.array(run, np.int64)] + np.array(at, np.int64)
    return order, runs_of(symbols(np.minimum(np.array(lcp, np.int64), width))), np.concatenate(keys)[order]


def _finish(block: Block, ids: list, removed: np.ndarray) -> pa.RecordBatch:
    gone = np.concatenate(([0], np.cumsum(removed)))
    begins = removed & ~np.concatenate(([False], removed[:-1]))
    starts = np.concatenate(([0], np.cumsum(begins)))
    lows, highs = (block.lows, block.highs) if block.core is None else (np.array([x]) for x in block.core)
    kept = []
    for i, (low, high) in enumerate(zip(lows.tolist(), highs.tolist())):
        kept.append(block.texts[i] if gone[high] == gone[low] and block.core is None else block.flat[low:high][~removed[low:high]].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array((highs - lows).astype(np.int64)), pa.array((gone[highs] - gone[lows]).astype(np.int64)), pa.array((starts[highs] - starts[lows]).astype(np.int64)), pa.array(kept, pa.binary())],
        ["id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def drop_repeated_bytes(docs: DataFrame, n: int = 50, key: str = "doc_id", text: str = "text", hot: int = HOT, part: int = PART) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept) without the bytes of repeated n-byte windows."""
    plan = Plan(n, max(1, n * 24 // 50), False)
    return find(docs, plan, front_coded, _merge, _finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary", key, text, hot, part)
