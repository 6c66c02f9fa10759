"""Numpy kernels over byte texts: window routing by minimizers, and common prefixes through a BWT."""

from __future__ import annotations

import numpy as np

#: Bytes of the substrings whose hashes route windows. Shorter: fewer, longer runs; longer: fewer chance meetings.
GRAM = 24

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes that start at each position (three 8-byte words)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))
    out = np.zeros(n, np.uint64)
    for k in range(GRAM // 8):
        out ^= words[8 * k : 8 * k + n]
        out *= _MIX[k]
        out ^= out >> np.uint64(29)
    out *= _MIX[0]
    out ^= out >> np.uint64(32)
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def window_runs(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one text that share the smallest gram hash inside them.

    `data` holds texts one after another, `ends` where each ends. Equal windows have equal hashes wherever they
    stand, so grouping by the hash brings all equal windows together. Returns first window, window count, text
    number and hash of each run. Windows never cross texts.
    """
    if len(data) < width:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    least = _sliding_min(gram_hashes(data), width - GRAM + 1)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(least)]
    inside = np.arange(width, len(least) + width) <= ends[text]
    change = np.empty(len(least), bool)
    change[0] = True
    change[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    change[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(change)
    count = np.diff(first, append=len(least))
    keep = inside[first]
    first, count = first[keep], count[keep]
    return first, count, text[first], least[first]


def prefix_classes(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a cyclic text, and which of them start a new class of `depth` equal leading bytes.

    The order comes from doubling ranks until it covers `depth` bytes. The classes come from the Burrows-Wheeler
    transform: the row of byte + suffix is the LF image of the suffix's row. Level by level, rows that are still
    unsplit are extended backward by their byte, and a row whose neighbour's extension fell into another interval
    gets that level as its common prefix. Levels rise by one and end at `depth`: longer prefixes are never computed.
    """
    n = len(data)
    wrapped = np.concatenate([data, data[:8]]) if n >= 8 else np.resize(data, n + 8)
    key = np.ndarray((n,), np.dtype(">u8"), np.ascontiguousarray(wrapped), strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable").astype(np.int32)
    starts = np.ones(n, bool)
    ordered = key[order]
    starts[1:] = ordered[1:] != ordered[:-1]
    level, reach = 8, 8
    first = starts.copy()
    rank = np.empty(n, np.int32)
    while reach < depth:
        group = np.cumsum(starts, dtype=np.int32) - 1
        rank[order] = group
        open_ = np.flatnonzero(~(starts & np.append(starts[1:], True)))  # rows in groups of two and more
        if not len(open_):
            break
        rows = order[open_]
        key = (group[open_].astype(np.uint64) << np.uint64(32)) | rank[(rows.astype(np.int64) + reach) % n].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        order[open_] = rows[by]
        key = key[by]
        same = np.zeros(len(open_), bool)
        same[1:] = key[1:] == key[:-1]
        starts[open_] = ~same
        reach *= 2
    rank[order] = np.arange(n, dtype=np.int32)
    follow = rank[(order.astype(np.int64) + 1) % n]  # inverse of LF: the row reached by dropping the leading byte
    starts = first
    live = np.flatnonzero(~starts)
    while level < depth and len(live):
        interval = np.cumsum(starts, dtype=np.int32)
        split = interval[follow[live]] != interval[follow[live - 1]]
        starts[live[split]] = True
        live = live[~split]
        level += 1
    return order, starts
