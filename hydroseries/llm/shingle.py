"""Words and shingles of texts as 64-bit hashes, vectorised over blocks of texts.

A word is a maximal run of ASCII letters, digits, ``_`` and non-ASCII characters of the
lower-cased text.  A shingle is ``k`` consecutive words; a text of 1 to k - 1
words has one shingle of all its words, a text without words has none.
"""

from __future__ import annotations

import numpy as np

P = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
BLOCK = 1 << 20

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    WORD_BYTE[_c] = True

_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def powers(n: int):
    """P**i and its inverse mod 2**64, for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        both = []
        for base in (P, pow(P, -1, 1 << 64)):
            a = np.ones(size, dtype=np.uint64)
            step = 1
            while step < size:
                a[step:2 * step] = a[:step] * np.uint64(pow(base, step, 1 << 64))
                step *= 2
            both.append(a)
        _powers = tuple(both)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[str], size: int = BLOCK):
    """Slices of the list whose texts together have about ``size`` characters (one text at least)."""
    k = 0
    while k < len(texts):
        e, n = k, 0
        while e < len(texts) and (e == k or n + len(texts[e]) <= size):
            n += len(texts[e])
            e += 1
        yield k, e
        k = e


def words(texts: list[str]):
    """(hashes, text numbers, byte starts and ends in the text) of all words, in order."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    first = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]]) if raw else np.zeros(0, dtype=np.int64)
    is_word = WORD_BYTE[buf]
    edge = np.diff(is_word.astype(np.int8), prepend=0)
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    p, inv = powers(len(buf) + 1)
    run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:len(buf)], dtype=np.uint64)])
    h = mix((run[end] - run[start]) * inv[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(first, start, side="right") - 1
    return h, doc, start - first[doc], end - first[doc]


def shingles(h: np.ndarray, doc: np.ndarray, k: int = 5):
    """(hash, text number) of all shingles, in order."""
    if not len(h):
        return h, doc
    n = np.bincount(doc)
    short = (n > 0) & (n < k)
    mult = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    out_h, out_d = [], []
    if len(h) >= k:
        full = doc[k - 1:] == doc[:len(doc) - k + 1]
        s = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for j in range(k):
            s += h[j:len(h) - k + 1 + j] * mult[j]
        out_h.append(mix(s[full]))
        out_d.append(doc[:len(s)][full])
    if short.any():
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        for d in np.nonzero(short)[0]:
            own = h[at[d]:at[d] + n[d]]
            s = np.uint64(0)
            for j, x in enumerate(own):
                s = np.uint64((int(s) + int(x) * int(mult[j])) & MASK)
            out_h.append(mix(np.array([s ^ np.uint64(len(own))], dtype=np.uint64)))
            out_d.append(np.array([d]))
    a, b = np.concatenate(out_h), np.concatenate(out_d)
    if short.any():
        o = np.argsort(b, kind="stable")
        a, b = a[o], b[o]
    return a, b


def bags(h: np.ndarray, doc: np.ndarray):
    """Distinct (hash, text number, count), by text."""
    key = h + mix(doc.astype(np.uint64) + np.uint64(1))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    o = np.argsort(doc[first], kind="stable")
    return h[first][o], doc[first][o], count[o]


def sequence_keys(h: np.ndarray, doc: np.ndarray, n_texts: int):
    """Two 64-bit hashes of each text's word sequence."""
    n = np.bincount(doc, minlength=n_texts) if len(doc) else np.zeros(n_texts, dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    p, inv = powers(len(h) + 1)
    out = []
    for salt in (0x632BE59BD9B4E019, 0x2545F4914F6CDD1D):
        run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(h ^ np.uint64(salt)) * p[:len(h)], dtype=np.uint64)])
        out.append(mix((run[at[1:]] - run[at[:-1]]) * inv[at[:-1]] + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1], n


def bag_of(text: str, k: int = 5):
    """(sorted distinct shingle hashes, counts) of one text."""
    h, doc, _, _ = words([text])
    s, _ = shingles(h, doc, k)
    return np.unique(s, return_counts=True)


def pack(bag) -> bytes:
    """A bag as bytes: its hashes, sorted, then its counts."""
    return bag[0].tobytes() + bag[1].astype(np.uint32).tobytes()


def unpack(data: bytes):
    n = len(data) // 12
    return np.frombuffer(data, dtype=np.uint64, count=n), np.frombuffer(data, dtype=np.uint32, offset=8 * n)


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two bags: shared over joint counts."""
    (ha, ca), (hb, cb) = a, b
    total = int(ca.sum()) + int(cb.sum())
    if not total:
        return 0.0
    i = np.searchsorted(ha, hb)
    same = ha[np.minimum(i, len(ha) - 1)] == hb
    shared = int(np.minimum(ca[i[same]], cb[same]).sum())
    return shared / (total - shared)
