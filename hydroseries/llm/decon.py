"""Benchmark decontamination with SimHash windows.

A benchmark item is looked for with fingerprints of windows of its size class (the largest power of two that
fits twice): every window of the item and the window at every word of a document.  Items too short
for that (up to 14 words) use the two windows that leave out their last or first word.  Fingerprints are 64-bit
SimHashes of the words, weighted by their counts.  Their four blocks of 16 bits index the item windows, each
entered under its block and the 16 blocks one bit away: of fingerprints within Hamming
distance 7 some block differs in one bit at most, so all are found.

Edits in all of its windows may take a passage farther than 7 bits.  An exact search finds the rest: a window
of similarity ``threshold`` lacks at most a share of ``1 - threshold`` of the item's shingles, so of any more than that
it holds one.  Each item enters so many, those that stand in the fewest items, and every shingle of a document is looked up.

The windows of the item's length about a candidate are verified: the weighted Jaccard similarity of the
five-word shingles of the item and of the window must be at least ``threshold``.  A window beyond the text's first
or last word is cut there.  What is returned is what a comparison of each item with all windows of all texts gives.

An item found several times in a document gives several matches, the best ones
that do not overlap (of equal ones the first).

Items are taken in blocks of ``item_rows``, each block one pass over the
documents whose result is written before the next, so what a task or the driver holds is one
block's index; documents are not shuffled.

Defined results: null or wordless texts and items match nothing; an item
without an id matches nothing; of repeated rows of an item one counts, and texts that share an item_id are one item
with several texts; repeated rows of a document each match; empty tables give an empty table; long texts
are searched whole.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.llm import shingle
from hydroseries.llm.common import cut, text_or_empty, with_column

SHIFT, RADIUS = 3, 7
MOST = 16384  # words of a window, so that 16-bit counts suffice
PART, PAIRS = 1 << 15, 1 << 20  # windows looked up at once, item windows compared at once
HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()),
                                 T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def size_class(n: int) -> int:
    """Window length for an item of n words."""
    if n > 14:
        return min(MOST, 1 << (((n + 1) // 2).bit_length() - 1))
    return n - 1 if n > 5 else n


def fingerprints(h: np.ndarray, sizes) -> dict[int, np.ndarray]:
    """Per size the SimHash of so many words at every word that has them: the majority of each bit."""
    bits = np.unpackbits(shingle.mix(h ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1)
    sums, w, out = {1: bits}, 1, {}
    while 2 * w <= min(max(sizes), len(h)):  # counts of the bits of 1, 2, 4, ... words
        x = sums[w] if w < 128 else sums[w].astype(np.uint16)
        sums[2 * w] = x[w:] + x[:-w]
        w *= 2
    for size in sizes:
        n, at, total = len(h) - size + 1, 0, None
        if n <= 0:
            out[size] = np.zeros(0, dtype=np.uint64)
            continue
        for w, x in sums.items():
            if size & w:
                part = x[at:at + n] if size < 256 else x[at:at + n].astype(np.uint16)
                total, at = part if total is None else total + part, at + w
        out[size] = np.packbits(total > size // 2, axis=1).view(np.uint64).ravel()
    return out


class Items:
    """Index of a block of items: per size class the 16-bit blocks of its windows' fingerprints, and the shingles
    of which a window of at least ``threshold`` holds one."""

    def __init__(self, items: list[tuple[int, str]], k: int = 5, threshold: float = 0.8):
        self.k, self.threshold, self.bags = k, threshold, []
        found: dict = {}
        for item_id, text in items:
            h, _, _, _ = shingle.words([text or ""])
            if item_id is None or not len(h):
                continue
            own = len(self.bags)
            keys, counts = self.bag(h)
            self.bags.append((item_id, len(h), keys, counts, int(counts.sum())))
            size = size_class(len(h))
            fp, rows = found.setdefault(size, ([], []))
            fp.append(fingerprints(h, [size])[size])
            rows.extend((own, s) for s in range(len(fp[-1])))
        near = np.concatenate([np.zeros(1, dtype=np.uint16), np.uint16(1) << np.arange(16, dtype=np.uint16)])
        self.classes = {}
        for key, (fp, rows) in found.items():
            fp = np.concatenate(fp)
            blocks = fp.view(np.uint16).reshape(-1, 4)
            owner, begin = [], []
            for j in range(4):
                entered = (blocks[:, j, None] ^ near).ravel()
                order = np.argsort(entered, kind="stable")
                owner.append((order // len(near)).astype(np.int32))
                begin.append(np.searchsorted(entered[order], np.arange(65_537)).astype(np.int32))
            self.classes[key] = (fp, np.array(rows), owner, begin)
        self.enter()

    def enter(self) -> None:
        """The shingles looked up by the exact search: of each item so many that a match cannot lack them all."""
        bags = [(own, b) for own, b in enumerate(self.bags) if b[1] >= self.k]
        keys = np.concatenate([b[2] for _, b in bags] or [np.zeros(0, dtype=np.uint64)])
        counts = np.concatenate([b[3] for _, b in bags] or [np.zeros(0, dtype=np.int64)])
        owner = np.repeat([own for own, _ in bags], [len(b[2]) for _, b in bags]).astype(np.int64)
        lacking = np.zeros(len(self.bags), dtype=np.int64)
        for own, b in bags:
            lacking[own] = b[4] - max(1, int(np.ceil(self.threshold * b[4] - 1e-9)))
        _, which, items = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.lexsort((keys, items[which], owner))
        keys, counts, owner = keys[order], counts[order], owner[order]
        before = np.cumsum(counts) - counts  # occurrences entered before a shingle, of its own item
        before -= before[np.searchsorted(owner, owner)] if len(owner) else before
        entered = before <= lacking[owner]
        order = np.argsort(keys[entered], kind="stable")
        self.keys, self.owner = keys[entered][order], owner[entered][order]
        bits = max(16, int(16 * len(self.keys)).bit_length())
        self.drop = np.uint64(64 - bits)  # a bit per leading bits of a shingle, as most shingles are in no item
        self.sieve = np.zeros(1 << bits, dtype=bool)
        self.sieve[self.keys >> self.drop] = True

    def bag(self, h: np.ndarray):
        s, _ = shingle.shingles(h, np.zeros(len(h), dtype=np.int64), self.k)
        return np.unique(s, return_counts=True)

    def near(self, fp: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) pairs within the radius, each once."""
        have, _, owner, begin = self.classes[key]
        blocks = fp.view(np.uint16).reshape(-1, 4)
        found = []
        for j in range(4):
            lo = begin[j][blocks[:, j]]
            upto = np.concatenate([[0], np.cumsum(begin[j][1:][blocks[:, j]] - lo, dtype=np.int64)])
            x = 0
            while x < len(fp):  # so many windows at once as meet about PAIRS item windows
                y = max(x + 1, int(np.searchsorted(upto, upto[x] + PAIRS, side="right")) - 1)
                n, at = np.diff(upto[x:y + 1]), upto[x:y] - upto[x]
                i = owner[j][np.repeat((lo[x:y] - at).astype(np.int32), n) + np.arange(upto[y] - upto[x], dtype=np.int32)]
                ok = np.nonzero(np.bitwise_count(np.repeat(fp[x:y], n) ^ have[i]) <= RADIUS)[0]
                found.append((x + np.searchsorted(upto[x + 1:y + 1] - upto[x], ok, side="right")) * len(have) + i[ok])
                x = y
        pairs = np.unique(np.concatenate(found or [np.zeros(0, dtype=np.int64)]))
        return pairs // len(have), pairs % len(have)

    def shared(self, s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, item) pairs: the shingle at the word is one entered for the item."""
        pos = np.nonzero(self.sieve[s >> self.drop])[0]
        pos = pos[doc[pos] == doc[pos + self.k - 1]]
        lo, hi = np.searchsorted(self.keys, s[pos]), np.searchsorted(self.keys, s[pos], side="right")
        n = hi - lo
        return np.repeat(pos, n), self.owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def verified(self, h: np.ndarray, s: np.ndarray, first: int, last: int, low: int, high: int, own: int, threshold: float):
        """(similarity, start, end) of the item-sized windows from ``low`` to ``high`` that reach the threshold; ``s`` holds
        the shingle that starts at each word, looked up in the item's bag once for all windows."""
        k, (_, n, keys, counts, total) = self.k, self.bags[own]
        lo, hi = max(first, low), min(last, high + n)
        if n >= k:
            part = s[lo:max(lo, hi - k + 1)]
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            hit = keys[at] == part
            if np.count_nonzero(hit) < max(1, threshold * total - 1e-9):
                return
        b = np.arange(low, high + 1)
        b, t = np.maximum(first, b), np.minimum(last, b + n)
        wide = t - b >= min(n, k)
        b, t = b[wide], t[wide]
        if n < k:  # one shingle of all its words
            for x, y in zip(b.tolist(), t.tolist()):
                got = shingle.similarity((keys, counts), self.bag(h[x:y]))
                if got >= threshold - 1e-12:
                    yield got, x, y
            return
        run = np.concatenate([[0], np.cumsum(hit)])
        joint, most = total + t - b - k + 1, run[t - k + 1 - lo] - run[b - lo]
        for w in np.nonzero(most >= (threshold - 1e-12) * (joint - most))[0]:
            i, j = int(b[w]) - lo, int(t[w]) - k + 1 - lo
            shared = int(np.minimum(np.bincount(at[i:j][hit[i:j]], minlength=len(keys)), counts).sum())
            got = shared / (int(joint[w]) - shared)
            if got >= threshold - 1e-12:
                yield got, int(b[w]), int(t[w])

    def search(self, texts: list[str], threshold: float) -> list[list[tuple]]:
        """Per text its matches: item_id, similarity, first word, word after the last."""
        if threshold < self.threshold:
            raise ValueError(f"the index was made for a threshold of {self.threshold}")
        out: list[list[tuple]] = [[] for _ in texts]
        length = np.array([b[1] for b in self.bags], dtype=np.int64)
        for a, e in shingle.blocks(texts, 1 << 17):
            h, doc, _, _ = shingle.words(texts[a:e])
            first = np.searchsorted(doc, np.arange(e - a))
            last = np.searchsorted(doc, np.arange(e - a), side="right")
            if not len(h):
                continue
            seen = []  # item, text, first and last start of the windows to verify
            for c in range(0, len(h), PART) if self.classes else ():
                for size, fp in fingerprints(h[c:c + PART + max(self.classes) - 1], self.classes).items():
                    rows = self.classes[size][1]
                    win, itm = self.near(fp[:PART], size)
                    win = win + c
                    inside = doc[win] == doc[win + size - 1]
                    win, own, at = win[inside], rows[itm[inside], 0], rows[itm[inside], 1]
                    seen.append((own, doc[win], win - at - SHIFT, win - at + SHIFT))
            s, _ = shingle.shingles(h, np.zeros(len(h), dtype=np.int64), self.k)
            if len(h) >= self.k:
                pos, own = self.shared(s, doc)
                seen.append((own, doc[pos], pos - length[own] + self.k, pos))
            found: dict = {}
            for d, own, low, high in joined(*map(np.concatenate, zip(*seen))) if seen else []:
                for got, b, t in self.verified(h, s, int(first[d]), int(last[d]), low, high, own, threshold):
                    found.setdefault((d, int(self.bags[own][0])), set()).add((-got, b, t))
            for (d, item_id), windows in sorted(found.items()):
                kept: list = []
                for minus, b, t in sorted(windows):
                    if all(t <= x or y <= b for _, x, y in kept):
                        kept.append((minus, b, t))
                for minus, b, t in sorted(kept, key=lambda w: w[1]):
                    out[a + d].append((item_id, -minus, int(b - first[d]), int(t - first[d])))
        return out


def joined(own: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, first, last) of the ranges, those of a text and item that meet as one."""
    order = np.lexsort((low, doc, own))
    out: list = []
    for o, d, x, y in zip(*(v[order].tolist() for v in (own, doc, low, high))):
        if out and out[-1][:2] == (d, o) and x <= out[-1][3] + 1:
            out[-1] = (d, o, out[-1][2], max(y, out[-1][3]))
        else:
            out.append((d, o, x, y))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, item_rows: int = 10_000) -> DataFrame:
    """The columns of docs and ``hits`` (array<item_id, similarity, start, end>, words counted from 0)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = max(1, -(-items.count() // item_rows))
    cols = [c for c in docs.columns if c != "hits"]
    text, new = f"_text_{uuid.uuid4().hex}", f"_hits_{uuid.uuid4().hex}"
    got = docs.select(*cols, text_or_empty().alias(text), F.array().cast(HITS).alias("hits"))
    for b in range(blocks):
        # a block of items has item_rows rows on average, whatever the size of the benchmark
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        index = Items(sorted((r["item_id"], r["text"]) for r in own), k, threshold)
        got = with_column(got, new, HITS, lambda index=index: lambda texts: index.search(texts, threshold), [text])
        got = got.withColumn("hits", F.concat("hits", new)).drop(new)
        if b + 1 < blocks:  # one index at a time in a task and in the plan
            got = cut(got)
    return got.drop(text)


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per match: doc_id, item_id, similarity, start, end."""
    hit = contaminated(docs.select("doc_id", "text"), benchmark, **options).select("doc_id", F.explode("hits").alias("h"))
    return hit.select("doc_id", "h.item_id", "h.similarity", "h.start", "h.end")
