"""Word-level substring dedup with prefix-partitioned suffix trees.

Suffixes that begin with the same anchor words form a group, and a prefix too common for
memory is extended to the whole window, so prefixes vary in length and groups fit in
memory.  Of a group's sorted suffixes a suffix tree is built; its internal nodes at or
below the window's depth (counted from the window's start) are the repeats, and the
leaves below each are the suffixes that share them.

Defined results: a null text has no words; a document shorter than a window keeps all;
kept words are joined by one space; rows with equal ids do not remove each other's words; very long texts are treated in
parts, with the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import HOT, PART, Block, Plan, find


def _code(keys: np.ndarray) -> tuple[np.ndarray, dict[str, bytes]]:
    return np.arange(len(keys)), {"head": b"", "body": keys.tobytes()}


class SuffixTree:
    """Internal nodes of the tree of sorted suffixes: their depth, that of their parent, and the interval of their leaves."""

    def __init__(self, lcp: np.ndarray):
        """``lcp``: symbols that each suffix shares with the one before it."""
        depth, above, low, high = [], [], [], []
        path: list[tuple[int, int]] = [(0, 0)]  # open nodes from the root down: depth, first leaf
        heights = lcp.tolist()
        for leaf in range(1, len(heights) + 1):
            h = heights[leaf] if leaf < len(heights) else 0
            first = leaf - 1
            while path[-1][0] > h:
                d, first = path.pop()
                depth.append(d)
                above.append(max(h, path[-1][0]))
                low.append(first)
                high.append(leaf)
            if h > path[-1][0]:
                path.append((h, first))
        self.depth, self.above, self.low, self.high = (np.array(x, np.int64) for x in (depth, above, low, high))

    def repeats(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves below the highest nodes of at least this depth, and each one's node: suffixes that share so many symbols."""
        nodes = np.flatnonzero((self.depth >= length) & (self.above < length))
        sizes = self.high[nodes] - self.low[nodes]
        leaves = np.repeat(self.low[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return leaves, np.repeat(nodes, sizes)


def _tree(rows: pd.DataFrame, width: int, symbols) -> tuple[np.ndarray, object, np.ndarray]:
    """The group's suffixes in order, and the classes that the nodes of their tree make."""
    keys = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, width) for x in rows.body])
    order = np.lexsort(np.ascontiguousarray(keys).view(">u8").T[::-1])
    keys = keys[order]
    differ = keys[1:] != keys[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, SuffixTree(symbols(np.concatenate(([0], shared)))).repeats, keys


def _finish(block: Block, ids: list, removed: np.ndarray) -> pa.RecordBatch:
    flat = block.flat.tobytes()
    lows, highs = (block.lows, block.highs) if block.core is None else (np.array([x]) for x in block.core)
    kept_at = np.flatnonzero(~removed)
    starts, ends = block.starts.tolist(), block.ends.tolist()
    bounds = np.searchsorted(kept_at, np.append(lows, highs[-1:]))
    gone = np.concatenate(([0], np.cumsum(removed)))
    begins = np.concatenate(([0], np.cumsum(removed & ~np.concatenate(([False], removed[:-1])))))
    texts = []
    for i, (low, high) in enumerate(zip(lows, highs)):
        if gone[high] == gone[low] and block.core is None:
            words = block.texts[i].split()
        else:
            words = [flat[starts[j] : ends[j]] for j in kept_at[bounds[i] : bounds[i + 1]].tolist()]
        texts.append(b" ".join(words).decode())
    # A document that begins with a removed word begins a span, whatever the one before it ended with.
    first = np.array([removed[x] and x > 0 and removed[x - 1] if x < len(removed) and block.core is None else False for x in lows], np.int64)
    spans = begins[highs] - begins[lows] + np.where(highs > lows, first, 0)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array((highs - lows).astype(np.int64)), pa.array((gone[highs] - gone[lows]).astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(texts, pa.string())],
        ["id", "n_words", "n_removed", "n_spans", "kept"],
    )


def drop_repeated_words(docs: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text", hot: int = HOT, part: int = PART) -> DataFrame:
    """Rows (id, n_words, n_removed, n_spans, kept) without the words of repeated n-word windows."""
    plan = Plan(n, max(1, n * 8 // 13), True)
    return find(docs, plan, _code, _tree, _finish, "id long, n_words long, n_removed long, n_spans long, kept string", key, text, hot, part)
