"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as larger (L) or smaller (S) than the next one; an S
suffix behind an L suffix is leftmost-smaller (LMS).  LMS substrings, up to
the next LMS place, are sorted and named, and their order as suffixes is found by
recursion on the names.  All suffixes are then induced from it in two linear
scans.

A scan is sequential by nature: an entry places its left neighbour somewhere
ahead.  It is done in blocks: all entries of a block are placed at once, and
the block ends in front of the first place that one of its own entries fills,
so every entry is read after it was written.
"""

from __future__ import annotations

import numpy as np

_ZERO = np.zeros(1, np.int64)


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the sentinel at the end is."""
    n = len(t)
    differ = np.append(t[:-1] != t[1:], True)
    decided = np.where(differ, np.arange(n, dtype=np.int32), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return np.append(t[:-1] < t[1:], True)[decided]


def _scan(code: np.ndarray, sa: np.ndarray, places: np.ndarray, smaller: int) -> None:
    """Induce the S suffixes (from the right) or the L suffixes (from the
    left) into ``sa``.  ``code``: twice the symbol, plus 1 for an S suffix;
    ``places``: next free place of every symbol's bucket."""
    n, step = len(code), -1 if smaller else 1
    at, size = (n - 1 if smaller else 0), 2048
    while 0 <= at < n:
        block = sa[at::step][:size]
        done = len(block)
        rank = (block > 0).nonzero()[0]
        left = block.take(rank) - 1
        of = code.take(left)
        take = ((of & 1) == smaller).nonzero()[0]
        if len(take):
            bucket = of.take(take) >> 1
            order = bucket.argsort(kind="stable")
            bucket = bucket.take(order)
            order = take.take(order)
            left = left.take(order)
            heads = np.concatenate([_ZERO, (bucket[1:] != bucket[:-1]).nonzero()[0] + 1])
            symbols = bucket.take(heads)
            free = places.take(symbols)
            count = np.empty(len(heads), np.int64)
            np.subtract(heads[1:], heads[:-1], out=count[:-1])
            count[-1] = len(bucket) - heads[-1]
            # each goes to the free place of its bucket, the next ones behind it
            land = (free - step * heads).repeat(count)
            land += step * np.arange(len(bucket))
            # in front of the first place that this block fills itself
            nearest = int((free.min() - at) if step > 0 else (at - free.max()))
            if nearest < done:
                done = nearest
                keep = rank.take(order) < done
                bucket, left, land = bucket[keep], left[keep], land[keep]
                places[bucket] = land + step  # the last one placed of each bucket leaves its next free place
            else:
                places[symbols] = free + step * count
            sa[land] = left
        at += step * done
        size = max(256, size // 2) if 4 * done < size else min(2 * size, 1 << 15) if done >= size else size


def _names(code: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Rank of every LMS substring (one place each, in text order); equal ones
    share a rank.  With their types none is the beginning of another."""
    length = np.diff(lms, append=len(code) - 1) + 1
    bits = int(code.max()).bit_length()
    width = 63 // bits
    padded = np.append(code, np.zeros(width, code.dtype)).astype(np.int64)
    group = np.zeros(len(lms), np.int64)  # place of a group's first member in the order
    live = np.arange(len(lms))
    offset = 0
    while len(live):
        word = np.zeros(len(live), np.int64)
        for k in range(offset, offset + width):
            word <<= bits
            inside = length[live] > k
            if not inside.any():
                continue
            word += np.where(inside, padded[np.where(inside, lms[live] + k, 0)], 0)
        order = np.lexsort((word, group[live])) if offset else word.argsort(kind="stable")
        live, word = live[order], word[order]
        old = group[live]
        first = np.append(True, old[1:] != old[:-1])
        new = first | np.append(True, word[1:] != word[:-1])
        at = np.arange(len(live))
        size = np.diff(np.flatnonzero(new), append=len(live))
        start_old = np.maximum.accumulate(np.where(first, at, 0))
        start_new = np.maximum.accumulate(np.where(new, at, 0))
        group[live] = old + start_new - start_old
        offset += width
        tied = (np.repeat(size, size) > 1) & (length[live] > offset)
        live = live[tied]
    used = np.zeros(len(lms), np.int32)
    used[group] = 1
    return (np.cumsum(used) - 1)[group]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``t``: integers whose last is 0 and the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    small = _types(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    stop = np.cumsum(np.bincount(t)).astype(np.int32)
    start = np.append(np.int32(0), stop[:-1])
    kind = np.uint16 if int(t.max()) < 1 << 15 else np.int32
    code = t.astype(kind) * kind(2) + small.astype(kind)
    name = _names(code, lms)
    if name.max() + 1 < len(lms):
        order = lms[suffix_array(name)]
    else:
        order = np.empty(len(lms), np.int32)
        order[name] = lms
    sa = np.full(n, -1, np.int32)
    # LMS suffixes at the ends of their buckets
    bucket = t[order]
    size = np.bincount(bucket, minlength=len(stop))
    first = np.cumsum(size) - size
    sa[stop[bucket] - size[bucket] + np.arange(len(bucket)) - first[bucket]] = order
    _scan(code, sa, start, 0)
    _scan(code, sa, stop - 1, 1)
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, stops: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes, by place in the text: how many symbols, up to
    ``most``, the suffix at each place of the given stretches shares with the
    one before it in ``sa``, none of them 1 (the separator).  A place shares at
    least the count of the place before less one, so each stretch is compared
    once along; all stretches go in step."""
    before = np.empty(len(t), np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = len(t) - 1
    found = np.zeros(len(t), np.int16)
    padded = np.append(t, np.zeros(most + 1, t.dtype))
    live = stops > starts
    at, stop = starts[live].astype(np.int64), stops[live]
    have = np.zeros(len(at), np.int64)
    while len(at):
        mine = padded[at + have]
        more = (mine == padded[before[at] + have]) & (mine > 1) & (have < most)
        have += more
        end = ~more
        found[at[end]] = have[end]
        at += end
        have -= end & (have > 0)
        left = at < stop
        if not left.all():
            at, have, stop = at[left], have[left], stop[left]
    return found
