"""Simple-8b: a selector and as many equal-width ids as fit in each 64-bit word.

The upper four bits of a word select (ids, bits each).  Selector 0 is an escape:
its payload is a place in the escape list, which holds ids of more than 60 bits.
Every document starts at a word border, so the word offsets of a block let any
document be decoded alone, and all words of a block are decoded at once.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
# Ids per word and bits per id for selectors 2 to 15.
LAYOUT = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ESCAPE = 0
_COUNT = np.ones(16, dtype=np.int64)
for _s, (_c, _) in LAYOUT.items():
    _COUNT[_s] = _c


def encode(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each document (one more at the end), escape list."""
    ids = np.asarray(ids)
    counts = np.asarray(counts, dtype=np.int64)
    ends = np.cumsum(counts)
    n = len(ids)
    if n == 0:
        return np.zeros(0, dtype=U64), np.zeros(len(counts) + 1, dtype=np.int64), np.zeros(0, dtype=U64)
    top = int(ids.max())
    # ids left in the document, as far as a word can hold them
    room = np.full(n, 60, dtype=np.int8)
    for k in range(min(60, int(counts.max()))):
        room[(ends - 1 - k)[counts > k]] = k + 1
    selector = np.full(n, ESCAPE, dtype=np.int8)
    step = np.ones(n, dtype=np.int8)
    broken = np.zeros(n + 1, dtype=np.int32)
    # selectors that hold every id have no more to check than the narrowest of them
    enough = max((s for s, (_, bits) in LAYOUT.items() if top >> bits), default=1) + 1
    for s in range(min(15, enough), 1, -1):
        count, bits = LAYOUT[s]
        if top >> bits == 0:
            selector[:] = s
            step = np.minimum(room, np.int8(count))
            continue
        large = ids >= (1 << bits)
        start = np.flatnonzero(~large).astype(np.int32)
        if not len(start):
            break
        np.cumsum(large, out=broken[1:])
        size = np.minimum(room[start], np.int8(count))
        fits = broken[start + size] == broken[start]
        start = start[fits]
        selector[start] = s
        step[start] = size[fits]
    at = _word_starts(step, ends, counts)
    chosen = selector[at]
    out = np.zeros(len(at), dtype=U64)
    padded = np.concatenate([ids, np.zeros(64, dtype=ids.dtype)])
    for s, (count, bits) in LAYOUT.items():
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            first, size = at[mine], step[at[mine]].astype(np.int64)
            word = np.full(len(mine), U64(s) << U64(60))
            for k in range(count):
                word |= np.where(k < size, padded[first + k].astype(U64), U64(0)) << U64(bits * k)
            out[mine] = word
    escaped = np.flatnonzero(chosen == ESCAPE)
    out[escaped] = np.arange(len(escaped), dtype=U64)
    first_word = np.searchsorted(at, np.r_[0, ends])
    return out, first_word, ids[at[escaped]].astype(U64)


#: Documents below which words are followed one by one.
FEW = 12


def _word_starts(step: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """First id of every word: all documents take a step at once, the last few long ones by themselves."""
    opens = np.zeros(len(step), dtype=bool)
    own = counts > 0
    place, end = (ends - counts)[own], ends[own]
    while len(place) > FEW:
        opens[place] = True
        place = place + step[place]
        on = place < end
        if not on.all():
            place, end = place[on], end[on]
    for i, stop in zip(place.tolist(), end.tolist(), strict=True):
        jump, places, at = step[i:stop].tolist(), [], 0
        while at < len(jump):
            places.append(at)
            at += jump[at]
        opens[i + np.array(places, dtype=np.int64)] = True
    return np.flatnonzero(opens)


def decode(words: np.ndarray, first_word: np.ndarray, counts: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of all documents of a block."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    out = np.zeros(total + 64, dtype=U64)
    if total == 0:
        return out[:0]
    chosen = (words >> U64(60)).astype(np.int64)
    slots = np.cumsum(_COUNT[chosen]) - _COUNT[chosen]
    doc = np.searchsorted(first_word, np.arange(len(words)), side="right") - 1
    starts = np.cumsum(counts) - counts
    place = starts[doc] + slots - slots[first_word[doc]]
    # later words of a stream begin where a padded last word ends: writing in order of
    # ascending place lets each document's first word overwrite the padding before it
    limit = (starts + counts)[doc]
    for s, (count, bits) in LAYOUT.items():
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            word, at, most = words[mine], place[mine], limit[mine]
            mask = U64((1 << bits) - 1)
            for k in range(count):
                ok = at + k < most
                if ok.all():
                    out[at + k] = (word >> U64(bits * k)) & mask
                else:
                    out[at[ok] + k] = (word[ok] >> U64(bits * k)) & mask
    mine = np.flatnonzero(chosen == ESCAPE)
    if len(mine):
        out[place[mine]] = escapes[(words[mine] & U64((1 << 60) - 1)).astype(np.int64)]
    return out[:total]
