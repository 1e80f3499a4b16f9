"""BagMinHash signatures of shingle bags, in numpy.

An element of weight w draws points from Poisson processes over the weight axis:
one process per dyadic bin [0, 1), [1, 2), [2, 4), ..., with a rate of the bin's
width.  A point has a time, a place in the bin and a register; it counts if its
place lies below w.  Splitting a bin in halves, quarters, ... splits its points
by the leading bits of their places, so texts with different counts share the points of the
weight they share.  A register keeps its earliest point; registers of
two bags are equal with the probability of their weighted Jaccard similarity.
Only points up to a time by which the registers are full are drawn.
"""

from __future__ import annotations

import numpy as np

from hydroseries.llm.shingle import mix

G = np.uint64(0x9E3779B97F4A7C15)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _draw(sig, h, doc, w, limit, m):
    """Earliest points up to each text's time limit."""
    top = 0
    while (1 << top) < w.max():
        top += 1
    for b in range(top + 1):
        low, width = (0, 1) if b == 0 else (1 << (b - 1), 1 << (b - 1))
        own = np.nonzero(w > low)[0] if b else np.arange(len(h))
        state = mix(h[own] + np.uint64((b + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        d, t, time = doc[own], limit[doc[own]], np.zeros(len(own))
        place = w[own] - low
        while len(state):
            state = state + G
            r = mix(state)
            time = time - np.log(_unit(r)) / width
            go = time <= t
            state, d, t, time, r, place = state[go], d[go], t[go], time[go], r[go], place[go]
            if not len(state):
                break
            r = mix(r ^ np.uint64(0xE7037ED1A0B428DB))
            reg = (r >> np.uint64(32)).astype(np.int64) * m >> 32
            at = d * m + reg
            if b:
                y = (r & np.uint64(0xFFFFFFFF)).astype(np.float64) * (width / 4294967296.0)
                fits = y < place
                np.minimum.at(sig, at[fits], time[fits])
            else:
                np.minimum.at(sig, at, time)


def signatures(h: np.ndarray, doc: np.ndarray, w: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """(n_texts, m) earliest times; infinite for a text without elements."""
    sig = np.full(n_texts * m, np.inf)
    if not len(h):
        return sig.reshape(n_texts, m)
    total = np.bincount(doc, weights=w, minlength=n_texts)
    limit = m * (np.log(m) + 3.0) / np.maximum(total, 1)
    left = total > 0
    while left.any():
        own = left[doc]
        _draw(sig, h[own], doc[own], w[own], limit, m)
        left &= ~np.isfinite(sig.reshape(n_texts, m)).all(axis=1)
        limit = limit * 2
    return sig.reshape(n_texts, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_texts, bands) 64-bit keys; each band has keys of its own."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to((np.arange(1, bands + 1, dtype=np.uint64) * G)[None, :], (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key ^ bits[:, :, r]) + G
    return key.view(np.int64)
