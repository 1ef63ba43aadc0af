"""Periodic runs of words, found in an enhanced suffix array by the branching-tandem test.

A square at word i with period p is *branching* when the suffixes i and i+p share exactly p words: the LCP interval of depth p
then holds both, in different children. Every run has one, its last square. So for each LCP interval only the suffixes of
its smaller children look up, in the inverse suffix array, whether the one ``depth`` words on or back is in the interval. A square
found is rotated to the left as far as it stays one, which gives the whole run. Intervals are pairs of neighbouring smaller
LCP values; no tree is built. Many texts share one array (their words count as different), so short texts cost no call each.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_PER_ARRAY = 200_000  # texts are put together up to so many words; a longer one gets an array of its own


def suffix_ranks(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by the first 1, 2, 4, ... words) by prefix doubling; only groups still equal are sorted again.

    ``codes`` are words as numbers; what ends a text must be unlike every other code. At level k two suffixes have equal
    ranks just if their first 2 ** k words are equal.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    levels, sorted_codes = [], codes[order]
    first = np.concatenate(([True], sorted_codes[1:] != sorted_codes[:-1]))
    while True:
        # a suffix's rank is the place where its group begins
        begins = np.maximum.accumulate(np.where(first, np.arange(n), 0)).astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[order] = begins
        levels.append(rank)
        alone = first & np.append(first[1:], True)
        if alone.all():
            return order, levels
        step = 1 << len(levels) - 1
        at = np.flatnonzero(~alone)
        who = order[at]
        key = begins[at].astype(np.int64) * (n + 1) + rank[np.minimum(who + step, n - 1)]
        by = np.argsort(key, kind="stable")
        order[at], key = who[by], key[by]
        first[at] = np.concatenate(([True], key[1:] != key[:-1]))


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal words from a and b on."""
    n, length = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = np.maximum(x, y) < n
        length += (inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])).astype(np.int64) << k
    return length


def _common_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal words that end before a and b (a < b)."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x = a - length - (1 << k)
        inside = x >= 0
        length += (inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, x + b - a, 1)])).astype(np.int64) << k
    return length


def _lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Equal words of each suffix and the one before it in the array; 0 at the first."""
    lcp = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    at = at[levels[0][order[at]] == levels[0][order[at - 1]]]
    for k in range(1, len(levels) + 1):  # those that differ within the first 2 ** k words need no higher level
        same = levels[k][order[at]] == levels[k][order[at - 1]] if k < len(levels) else np.zeros(len(at), bool)
        ends = at[~same]
        lcp[ends] = _common(levels[:k], order[ends - 1], order[ends])
        at = at[same]
    return lcp


def _smaller(lcp: np.ndarray, at: np.ndarray, strict: bool, jumps: int = 12) -> np.ndarray:
    """For each place the nearest one before it with a smaller LCP (``strict``) or one not larger. Place 0 has LCP 0.

    Candidates jump to each other's candidates; the few places left after some rounds descend a table of minima.
    """
    cand = np.maximum(np.arange(len(lcp)) - 1, 0)
    left = at
    for _ in range(jumps):
        over = lcp[cand[left]] >= lcp[left] if strict else lcp[cand[left]] > lcp[left]
        left = left[over]
        if not len(left):
            return cand[at]
        cand[left] = cand[cand[left]]
    table = [lcp]  # least of the 2 ** k values that end at a place
    while 1 << len(table) <= len(lcp):
        low, step = table[-1], 1 << len(table) - 1
        table.append(np.minimum(low, np.concatenate((low[:step], low[:-step]))))
    place = left - 1
    for k in range(len(table) - 1, -1, -1):
        can = place - (1 << k) + 1 >= 0
        least = table[k][np.maximum(place, 0)]
        over = can & (least >= lcp[left] if strict else least > lcp[left])
        place = np.where(over, place - (1 << k), place)
    cand[left] = np.maximum(place, 0)
    return cand[at]


def _spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the span, place) of every place in spans [begin, end)."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)


def branching_squares(order: np.ndarray, levels: list[np.ndarray], leaves: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the branching squares in LCP intervals of at least ``leaves`` suffixes."""
    rank, n = levels[-1], len(order)
    lcp = np.append(_lcp(order, levels), 0)  # 0 at both ends, seen from either side
    back = lcp[::-1]
    at = np.flatnonzero(lcp > 0)
    low, high = _smaller(lcp, at, True), n - _smaller(back, n - at, True)  # an interval is [low, high)
    wide = high - low >= leaves
    at, low, high = at[wide], low[wide], high[wide]
    ends, before = n - _smaller(back, n - at, False), _smaller(lcp, at, False)
    opens = lcp[before] < lcp[at]  # the interval's first mark also ends its first child
    # children [begin, end) of intervals named by their low and depth
    begin = np.concatenate((at, low[opens]))
    end = np.concatenate((ends, at[opens]))
    lo, hi, depth = (np.concatenate((x, x[opens])) for x in (low, high, lcp[at]))
    # all children of an interval but its largest
    by = np.lexsort((begin - end, depth, lo))
    largest = np.ones(len(by), bool)
    largest[1:] = (lo[by][1:] != lo[by][:-1]) | (depth[by][1:] != depth[by][:-1])
    small = by[~largest]
    which, place = _spans(begin[small], end[small])
    child = small[which]
    suffix, d = order[place], depth[child]
    found = []
    for other in (suffix + d, suffix - d):
        inside = (other >= 0) & (other < n)
        r = rank[np.where(inside, other, 0)]
        hit = inside & (r >= lo[child]) & (r < hi[child]) & ((r < begin[child]) | (r >= end[child]))
        found.append((np.minimum(suffix, other)[hit], d[hit]))
    place, period = (np.concatenate(x) for x in zip(*found))
    key = np.unique(place * (n + 1) + period)
    return key // (n + 1), key % (n + 1)


def find_runs(codes: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``codes``, by start and period.

    A run with ``periods`` whole periods puts as many suffixes into its interval, so narrower intervals are passed over.
    """
    order, levels = suffix_ranks(codes)
    place, period = branching_squares(order, levels, max(2, periods))
    turns = _common_before(levels, place, place + period)
    start, length = place - turns, 2 * period + turns
    # a run is also found with multiples of its period: the smallest counts
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    own = np.ones(len(start), bool)
    own[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    own &= length >= np.maximum(least, periods * period)
    start, length, period = start[own], length[own], period[own]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _scan(texts: list[str | None], least: int, periods: int) -> list[tuple[list[dict], str]]:
    """(runs, text without repetitions) of each text."""
    words = [t.encode().split() if t else [] for t in texts]
    codes, base, top = [], [0], 0
    for own in words:
        names: dict[bytes, int] = {}
        # numbers grow from text to text, so that no two share one; the last ends the text
        codes.append(np.array([names.setdefault(w, len(names)) for w in own] + [len(names)], np.int64) + top)
        base.append(base[-1] + len(own) + 1)
        top += len(names) + 1
    start, length, period = find_runs(np.concatenate(codes), least, periods)
    cuts = np.searchsorted(start, base)
    out = []
    for i, own in enumerate(words):
        a, b = cuts[i], cuts[i + 1]
        if a == b:
            out.append(([], b" ".join(own).decode()))
            continue
        s, le, p = start[a:b] - base[i], length[a:b], period[a:b]
        dropped = np.zeros(len(own) + 1, np.int64)
        np.add.at(dropped, s + p, 1)
        np.add.at(dropped, s + le, -1)
        kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
        found = [{"start": x, "length": y, "period": z} for x, y, z in zip(s.tolist(), le.tolist(), p.tolist())]
        out.append((found, b" ".join([own[k] for k in kept.tolist()]).decode()))
    return out


def with_runs(
    docs: DataFrame, text: str = "text", least: int = 6, periods: int = 4, runs: str = "runs", collapsed: str = "collapsed",
) -> DataFrame:
    """Adds each whole text's periodic runs, (start, length, period) by start and period, and the text without their repetitions.

    Words are stretches of other than ASCII white space, numbered from 0. A run has ``least`` words and ``periods`` times its
    smallest period at least and can't be extended. The collapsed text is all words joined by one space, without those that
    stand in a run after its first period. Nulls, empty texts and texts without words have no runs and collapse to
    the empty string. Rows are judged one by one: repeated rows and other columns stay; columns named like the two new ones are
    replaced. A text's array takes about 150 bytes a word, so a task's memory is bounded by its longest text.
    """
    kind = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
    held = pa.struct([
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    @F.arrow_udf(kind)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, part, size = [], [], 0
            for t in batch:
                part.append(t.as_py())
                size += len(part[-1] or "") // 6 + 1
                if size >= WORDS_PER_ARRAY:
                    found += _scan(part, least, periods)
                    part, size = [], 0
            if part:
                found += _scan(part, least, periods)
            yield pa.array([{"runs": r, "collapsed": c} for r, c in found], held)

    own = "_runs_of_text"
    while own in docs.columns:
        own = f"_{own}"
    kept = [c for c in docs.columns if c not in (runs, collapsed)]
    # the text stays visible to the function under any name, also one of the new columns'
    found = docs.withColumn(own, scan(F.col(text)))
    return found.select(*kept, F.col(f"{own}.runs").alias(runs), F.col(f"{own}.collapsed").alias(collapsed))
