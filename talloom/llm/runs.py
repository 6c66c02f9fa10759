"""Periodic runs of words, found in a Re-Pair grammar of the word ids.

A run is a stretch of words with smallest period q, at least `MIN_LENGTH` words and `MIN_TIMES` periods long, that no
neighbouring word extends. Re-Pair replaces word pairs that repeat by nonterminals, round after round; a period that
comes k times ends as about log k nonterminals. A run lies across the boundary between the two halves of some node of
the derivation (the lowest node that holds it), and it is whole there: so the runs across the boundary of each
nonterminal are computed once, on its own expansion, and translated to all places where the nonterminal is derived.
What reaches an end of an expansion is a piece of a longer run that a higher node holds; intervals of one period that
overlap by a period or more are merged to the maximal ones.

Details. Every pair of neighbouring words inside a run occurs in it `MIN_PAIRS` times, so only pairs that frequent
become nonterminals, and only stretches whose word triples are all that frequent can hold a run: the grammar is
built over these stretches. A round replaces all frequent pairs that rank above both neighbouring pairs by (count,
pair); that depends on the neighbourhood alone, so equal stretches get equal nonterminals. Documents of an Arrow batch
share the rounds, their symbols do not. What Re-Pair leaves of a stretch, its start rule, is paired in balanced form.

Defined cases: a null or empty text has no words and no runs; rows with equal ids are separate rows; a text is handled
whole, in memory in proportion to its length; an empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talloom.llm.common import give_back, prepared

MIN_LENGTH = 6
MIN_TIMES = 4
#: Times that each pair and triple of neighbouring words occurs in a run of MIN_LENGTH words and MIN_TIMES periods.
MIN_PAIRS = 3

_NONE = np.empty(0, np.int64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def stretches(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches in which every three neighbouring words occur MIN_PAIRS times in their text."""
    if len(ids) < MIN_LENGTH:
        return _NONE, _NONE
    _, pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)
    _, triple, count = np.unique(pair[:-1] << 32 | ids[2:], return_inverse=True, return_counts=True)
    good = (count[triple] >= MIN_PAIRS) & (text[:-2] == text[2:])  # no triple lies in two texts, so no stretch does
    edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 2
    long_ = end - start >= MIN_LENGTH
    return start[long_], end[long_]


class Grammar:
    """Re-Pair over stretches of symbols: rules `left`, `right` from symbol `first` on, and what is left of the stretches."""

    def __init__(self, symbols: np.ndarray, stretch: np.ndarray):
        """symbols: ids that differ between texts; stretch: the number of the stretch of each."""
        self.first = int(symbols.max()) + 1 if len(symbols) else 0
        self.left, self.right = [], []
        at = np.arange(len(symbols))
        rules = self.first
        while len(symbols) > 1:
            same = stretch[1:] == stretch[:-1]
            key = symbols[:-1] << 32 | symbols[1:]
            pairs, pair, count = np.unique(key, return_inverse=True, return_counts=True)
            # in a chain of one symbol every second pair counts
            twin = same & (symbols[:-1] == symbols[1:])
            chain = np.flatnonzero(twin & ~np.concatenate([[False], twin[:-1]]))
            odd = np.zeros(len(key), bool)
            if len(chain):
                here = np.flatnonzero(twin)
                odd[here] = (here - chain[np.searchsorted(chain, here, "right") - 1]) % 2 == 1
            count = np.bincount(pair[same & ~odd], minlength=len(pairs))
            rank = np.empty(len(pairs), np.int64)
            # equal counts are ranked by a hash: ids follow each other in a text, and would rise along a stretch
            rank[np.lexsort((pairs.view(np.uint64) * _MIX >> np.uint64(16), count))] = np.arange(len(pairs))
            rank[count < MIN_PAIRS] = -1
            place = np.where(same & ~odd, rank[pair], -1)
            around = np.concatenate([[-1], place, [-1]])
            take = (place >= 0) & (place > around[:-2]) & (place > around[2:])
            if not take.any():
                break
            chosen = np.flatnonzero(take)
            used, name = np.unique(pair[chosen], return_inverse=True)
            self.left.append(pairs[used] >> 32)
            self.right.append(pairs[used] & 0xFFFFFFFF)
            symbols = symbols.copy()
            symbols[chosen] = rules + name
            rules += len(used)
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, stretch, at = symbols[keep], stretch[keep], at[keep]
        self._balance(symbols, stretch, at, rules)

    def _balance(self, symbols, stretch, at, rules) -> None:
        """Pairs neighbours of each stretch until one symbol is left of it; these nodes are derived once each."""
        while len(symbols) > 1:
            begin = np.searchsorted(stretch, stretch)
            first = (np.arange(len(symbols)) - begin) % 2 == 0
            chosen = np.flatnonzero(first[:-1] & (stretch[1:] == stretch[:-1]))
            if not len(chosen):
                break
            self.left.append(symbols[chosen])
            self.right.append(symbols[chosen + 1])
            symbols = symbols.copy()
            symbols[chosen] = rules + np.arange(len(chosen))
            rules += len(chosen)
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, stretch, at = symbols[keep], stretch[keep], at[keep]
        self.left = np.concatenate(self.left) if self.left else _NONE
        self.right = np.concatenate(self.right) if self.right else _NONE
        self.top, self.at = symbols, at


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix, compared in growing pieces."""
    n, done, step = min(len(a), len(b)), 0, 32
    while done < n:
        differ = a[done : done + step][: n - done] != b[done : done + step][: n - done]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + step, 4 * step
    return n


def _square_starts(v: np.ndarray) -> np.ndarray:
    """Possible q for which v begins with two equal parts of q words: their first words agree."""
    half = len(v) // 2
    if not half:
        return _NONE
    q = np.flatnonzero(v[1 : half + 1] == v[0]) + 1
    for j in (1, 2, 3, 5, 7, 11):
        if len(q) < 8:
            break
        q = q[(q <= j) | (v[np.minimum(q + j, len(v) - 1)] == v[min(j, len(v) - 1)])]
    return q


def _right_runs(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int, int]]:
    """(left, right, q) of the stretches that reach into v by two periods or more, from the boundary of u and v."""
    found, covered = [], 0
    back = None
    for q in _square_starts(v).tolist():
        if 2 * q <= covered:
            continue  # two parts of q words lie inside a stretch of smaller period: q is a multiple of it
        reach = q + _common(v, v[q:])
        if reach < 2 * q:
            continue
        covered = reach
        # the words before the boundary, last first, against those a period later
        if back is None:
            back = u[::-1]
        left = _common(back[:q], v[:q][::-1])
        if left == q:
            left += _common(back[q:], back)
        found.append((left, reach, q))
    return found


def boundary_runs(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int, int]]:
    """(left, right, q): runs that lie across the boundary of u and v, as words on its left and right.

    A run has MIN_TIMES >= 4 periods, so two of them lie on one side of the boundary.
    """
    found = set(_right_runs(u, v)) | {(a, b, q) for b, a, q in _right_runs(v[::-1], u[::-1])}
    return [x for x in found if x[0] and x[1] and x[0] + x[1] >= max(MIN_LENGTH, MIN_TIMES * x[2])]


def grammar_runs(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all maximal runs inside the stretches."""
    lengths = ends - starts
    if not len(lengths):
        return np.empty((0, 3), np.int64)
    stretch = np.repeat(np.arange(len(starts)), lengths)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(begin - starts, lengths)  # place in the whole of each word
    words = symbols[place]
    _, named = np.unique(words, return_inverse=True)
    g = Grammar(named.astype(np.int64), stretch)
    rules = len(g.left)

    # A first place of each rule, so that its expansion is a slice of the words. Rules are numbered upward: lengths
    # come from below, places from above.
    lefts, rights = g.left.tolist(), g.right.tolist()
    length = [1] * g.first + [0] * rules
    for k in range(rules):
        length[g.first + k] = length[lefts[k]] + length[rights[k]]
    at = [0] * (g.first + rules)
    for s, p in zip(g.top.tolist(), g.at.tolist()):
        at[s] = p
    for k in range(rules - 1, -1, -1):
        p, left = at[g.first + k], lefts[k]
        at[left], at[rights[k]] = p, p + length[left]

    local = {}
    for k in range(rules):
        n = length[g.first + k]
        if n >= MIN_LENGTH:
            p, m = at[g.first + k], length[lefts[k]]
            runs = boundary_runs(named[p : p + m], named[p + m : p + n])
            if runs:
                local[k] = [(m - a, m + b, q) for a, b, q in runs]
    if not local:
        return np.empty((0, 3), np.int64)
    spans = []
    for k, where in _derivations(g, length, local):
        for a, b, q in local[k]:
            spans.append(np.stack([where + a, where + b, np.full(len(where), q)], axis=1))
    merged = _merged(np.concatenate(spans))
    first = place[merged[:, 0]]  # a run lies inside one stretch, and stretches are whole in `place`
    return np.stack([first, first + merged[:, 1] - merged[:, 0], merged[:, 2]], axis=1)


def _derivations(g: Grammar, length: list[int], wanted: dict):
    """All places of each wanted rule: the places of a rule follow from those of the rules that use it."""
    lefts, rights = g.left.tolist(), g.right.tolist()
    needed = [False] * (g.first + len(lefts))  # rules below which a wanted rule stands
    for k in range(len(lefts)):
        needed[g.first + k] = k in wanted or needed[lefts[k]] or needed[rights[k]]
    places: dict[int, list[np.ndarray]] = {}
    for s, p in zip(g.top.tolist(), g.at.tolist()):
        if needed[s]:
            places.setdefault(s, []).append(np.array([p]))
    for k in range(len(lefts) - 1, -1, -1):
        if not needed[g.first + k]:
            continue
        where = np.concatenate(places.pop(g.first + k))
        left, right = lefts[k], rights[k]
        if needed[left]:
            places.setdefault(left, []).append(where)
        if needed[right]:
            places.setdefault(right, []).append(where + length[left])
        if k in wanted:
            yield k, where


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal intervals: spans of one period that overlap by a period or more become one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0], spans[:, 2]))]
    period = spans[:, 2]
    # the furthest end so far within a period: ends are lifted by period so that one running maximum serves all
    lift = np.cumsum(np.concatenate([[0], np.diff(period) != 0])) * (int(spans[:, 1].max()) + 1)
    reach = np.maximum.accumulate(spans[:, 1] + lift)
    new = np.ones(len(spans), bool)
    new[1:] = (period[1:] != period[:-1]) | (spans[1:, 0] + period[1:] > reach[:-1] - lift[1:])
    begin = np.flatnonzero(new)
    end = np.maximum.reduceat(spans[:, 1], begin)
    return np.stack([spans[begin, 0], end, period[begin]], axis=1)


def batch_runs(ids: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, end, period), by start and then period, of every text of word ids."""
    size = np.array([len(x) for x in ids], np.int64)
    begin = np.cumsum(size) - size
    text = np.repeat(np.arange(len(ids)), size)
    words = np.concatenate(ids) if len(ids) else _NONE
    if not len(words):
        return [np.empty((0, 3), np.int64) for _ in ids]
    _, own = np.unique(text << 32 | words, return_inverse=True)  # a word of two texts is two symbols
    own = own.astype(np.int64)
    runs = grammar_runs(own, *stretches(own, text))
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    cut = np.searchsorted(runs[:, 0], np.append(begin, len(words)))
    return [runs[a:b] - np.array([p, p, 0]) for a, b, p in zip(cut[:-1], cut[1:], begin)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def with_periodic_end(words: list, doc_id: str | None) -> list:
    """Words whose end repeats with a period, for one document of ten, chosen by id. Test material, not detection."""
    if not isinstance(doc_id, str) or not words:
        return words
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


_RETURNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _report(words: list[bytes], runs: np.ndarray) -> tuple:
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs.tolist())
    kept = words
    best = (None,) * 4
    if len(runs):
        kept = [w for w, k in zip(words, kept_words(len(words), runs).tolist()) if k]
        a, b, q = min(runs.tolist(), key=lambda r: (r[0] - r[1], r[0], r[2]))
        best = (a, b - a, q, 1000 * (b - a) // q)
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def document_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", periodic_end: bool = False) -> DataFrame:
    """doc_id, the number of runs, the longest one, and digests of all runs and of the words that stay.

    periodic_end: first repeat the end of every tenth document, see `with_periodic_end`.
    """
    prepared(docs.sparkSession)

    @F.pandas_udf(_RETURNS)
    def of(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        at = 0
        texts, ids = texts.tolist(), ids.tolist()
        while at < len(texts):  # about a million words at a time
            words, known, named, total = [], {}, [], 0
            while at < len(texts) and total < 1 << 20:
                own = texts[at].encode("utf-8", "surrogatepass").split() if isinstance(texts[at], str) else []
                if periodic_end:
                    own = with_periodic_end(own, ids[at])
                words.append(own)
                named.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)))
                total, at = total + len(own), at + 1
            out += [_report(w, r) for w, r in zip(words, batch_runs(named))]
        give_back()
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _RETURNS.split(", ")])
        whole = [c.split()[0] for c in _RETURNS.split(", ") if c.endswith(" long")]
        return frame.astype({c: "Int64" for c in whole})

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), of(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text}`").cast("string")).alias("_r"))
    return rows.select("doc_id", "_r.*")
