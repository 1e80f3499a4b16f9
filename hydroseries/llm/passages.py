"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept at minimisers only: of each ``SPAN`` neighbouring positions the one whose hash of
three words is least, so a passage has the same ones wherever it stands.  Every
window of ``min_words`` words belongs to one of them, the minimiser of its first ``SPAN``
positions, and holds the suffix's head, its first ``min_words`` - SPAN words.  Suffixes whose head
is met in two texts are sorted by the words that follow (head, then each next word, then the words
before, backwards) over all tasks by ranges; a passage of very many texts is many tasks' rows.
Neighbours in that order are compared word by word, to the right and to the left, and the matches extended
over all windows of the suffix that both words cover: a run of neighbours that agree on a window and are not
all of one text repeat it.

Sorted by the words after, neighbours agree least on the words before; and a run may be cut by
the end of a task or a batch.  So one window of each repeated run, and every window
that no neighbour repeated, is taken up once more by its whole content: one that
occurs in two texts, or in a repeated run, repeats too.  That leaves nothing to the order: every repeated window is found.

Result: one row per document with a repeated passage of at least ``min_words`` words.

Defined results: null texts are empty and repeat nothing; repeats inside one text do
not count; rows that repeat a doc_id and text count as copies, and copies repeat as a whole; a null doc_id comes back
null; equal texts (by MD5) are one text; words are compared by 64-bit hashes, heads and whole
windows by 128-bit ones; an empty table gives an empty table; long texts are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.llm import shingle
from hydroseries.llm.common import bounded_batches, cut, slices, text_or_empty

GRAM, SPAN = 3, 16
SALTS = 0x632BE59BD9B4E019, 0x2545F4914F6CDD1D  # of the two hashes of a sequence
AT = T.ArrayType(T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("pos", T.IntegerType()),
                               T.StructField("n", T.IntegerType()), T.StructField("off", T.IntegerType())]))
SORTED = ["k1", "k2", "after", "before", "t", "pos"]


def least_of_each(h: np.ndarray, span: int) -> np.ndarray:
    """Of each ``span`` neighbouring positions the first whose hash of GRAM words is least."""
    n = len(h) - GRAM + 1
    low = h[:n].copy()
    for j in range(1, GRAM):
        low = low * np.uint64(shingle.P) + h[j:n + j]
    low, at, have = shingle.mix(low), np.arange(n), 1
    while have < span:  # running minimum by doubling
        step = min(have, span - have)
        later = low[step:] < low[:-step]
        low, at, have = np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step]), have + step
    return at


def running(h: np.ndarray, salt: int):
    """lo, hi -> hashes of the words lo to hi - 1."""
    p, inv = shingle.powers(len(h) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(shingle.mix(h ^ np.uint64(salt)) * p[:len(h)], dtype=np.uint64)])
    return lambda lo, hi: shingle.mix((sums[hi] - sums[lo]) * inv[lo])


def suffixes(texts: DataFrame, min_words: int) -> DataFrame:
    """k1, k2 (head), t, pos (first window), n (windows), off (words from the first window to the
    minimiser) of the kept suffixes of each text (t, text)."""
    def run(batches):
        import pyarrow as pa
        for b in (s for whole in batches for s in slices(whole)):
            ts = b.column(b.schema.get_field_index("t"))
            raw = b.column(b.schema.get_field_index("text")).to_pylist()
            for a, e in shingle.blocks(raw):
                h, doc, _, _ = shingle.words(raw[a:e])
                if len(h) < min_words:
                    continue
                own = np.nonzero(doc[min_words - 1:] == doc[:len(doc) - min_words + 1])[0]  # first words of whole windows
                if not len(own):
                    continue
                at = least_of_each(h, SPAN)[own]
                new = np.nonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[own[1:]] != doc[own[:-1]])]))[0]
                n = np.diff(np.append(new, len(own)))
                begin, anchor = own[new], at[new]
                first = np.searchsorted(doc, np.arange(e - a))[doc[begin]]
                keys = [running(h, salt)(anchor, anchor + min_words - SPAN).view(np.int64) for salt in SALTS]
                small = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), ts.take(pa.array(a + doc[begin])), small(begin - first),
                                                  small(n), small(anchor - begin)], ["k1", "k2", "t", "pos", "n", "off"])

    bounded_batches(texts.sparkSession)
    return texts.select("t", "text").mapInArrow(run, "k1 long, k2 long, t binary, pos int, n int, off int")


def contexts(texts: DataFrame, min_words: int) -> DataFrame:
    """Per suffix of ``at`` of each text (t, text, at) the words (8 bytes each, big-endian) after
    its head and, backwards, before it, as far as its windows reach."""
    head = min_words - SPAN

    def run(batches):
        import pyarrow as pa
        for b in (s for whole in batches for s in slices(whole)):
            for t, text, at in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("t", "text", "at")]):
                h = shingle.words([text])[0].astype(">u8")
                after, before = [], []
                for x in at:
                    anchor = x["pos"] + x["off"]
                    after.append(h[anchor + head:x["pos"] + x["n"] - 1 + min_words].tobytes())
                    before.append(h[x["pos"]:anchor][::-1].tobytes())
                column = lambda c, kind: pa.array([x[c] for x in at], type=kind)
                yield pa.RecordBatch.from_arrays(
                    [column("k1", pa.int64()), column("k2", pa.int64()), pa.array([t] * len(at), type=pa.binary()), column("pos", pa.int32()),
                     column("n", pa.int32()), column("off", pa.int32()), pa.array(after, type=pa.binary()), pa.array(before, type=pa.binary())],
                    ["k1", "k2", "t", "pos", "n", "off", "after", "before"])

    return texts.select("t", "text", "at").mapInArrow(run, "k1 long, k2 long, t binary, pos int, n int, off int, after binary, before binary")


def _codes(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) word codes, zeros behind a row's words, and the rows' numbers of words."""
    size = 8 * width
    data = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in column), dtype=">u8").reshape(-1, width)
    return data.astype(np.uint64), np.array([len(x) // 8 for x in column])


def _common(codes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Words that each row and the one before it have in common from their start on (0 for the first row)."""
    width = codes.shape[1]
    both = np.minimum(count[1:], count[:-1])
    same = (codes[1:] == codes[:-1]) & (np.arange(width) < both[:, None])
    return np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(axis=1)])


def compared(rows: DataFrame, min_words: int) -> DataFrame:
    """Neighbours of the sorted suffixes, compared and extended.  Rows t, start, end are stretches whose windows all
    repeat (w1 null), or single windows to be taken up again by their content (w1, w2), ``sure`` if they repeat already."""
    head = min_words - SPAN

    def hashes(key, codes_a, codes_b, salt):
        """Per left length l the hash of the window: head, SPAN - l words after it, l words before it."""
        m = [np.uint64(salt | 1) * np.uint64(pow(shingle.P, j + 1, 1 << 64)) for j in range(2 * SPAN)]
        pre = [np.cumsum(np.concatenate([np.zeros((len(key), 1), dtype=np.uint64),
                                         np.stack([shingle.mix(c[:, j] ^ np.uint64(salt)) * m[j + k * SPAN] for j in range(c.shape[1])], axis=1)], axis=1),
                         axis=1, dtype=np.uint64) for k, c in enumerate((codes_a, codes_b))]
        return lambda i, l: shingle.mix(key[i].view(np.uint64) + pre[0][i, SPAN - l] + pre[1][i, l] + np.uint64(shingle.P) * l.astype(np.uint64))

    def run(batches):
        import pyarrow as pa
        for b in (s for whole in batches for s in slices(whole, 1 << 14, 64 << 20)):
            get = lambda c: b.column(b.schema.get_field_index(c))
            k1, k2, pos, n, off = (get(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "pos", "n", "off"))
            t = get("t").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            after, n_after = _codes(get("after").to_pylist(), SPAN)
            before, n_before = _codes(get("before").to_pylist(), SPAN - 1)
            same = np.concatenate([[False], (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])])
            right, left = head + _common(after, n_after), _common(before, n_before)
            low, high = off - n + 1, off  # words before the minimiser, over the suffix's windows
            mine = (np.arange(SPAN) >= low[:, None]) & (np.arange(SPAN) <= high[:, None])
            there = np.concatenate([np.zeros((1, SPAN), dtype=bool), mine[1:] & mine[:-1]])
            length = np.arange(SPAN)
            agree = there & same[:, None] & (left[:, None] >= length) & (right[:, None] >= min_words - length)
            repeats, leads = np.zeros_like(mine), np.zeros_like(mine)
            differ = np.concatenate([[False], t[1:] != t[:-1]])
            for l in range(SPAN):
                run_id = np.cumsum(~agree[:, l])  # a row that does not agree with the one before begins a run
                mixed = np.bincount(run_id, weights=agree[:, l] & differ, minlength=len(t) + 1) > 0
                repeats[:, l] = mine[:, l] & mixed[run_id]
                leads[:, l] = mine[:, l] & ~agree[:, l]
            edge = np.zeros((len(t), 1), dtype=bool)
            i, l0 = np.nonzero(repeats & ~np.hstack([edge, repeats[:, :-1]]))
            _, l1 = np.nonzero(repeats & ~np.hstack([repeats[:, 1:], edge]))
            anchor = pos + off
            again = mine & (~repeats | leads)
            j, l = np.nonzero(again)
            w = [hashes(k, after, before, salt)(j, l).view(np.int64) for k, salt in ((k1, SALTS[0]), (k2, SALTS[1]))]
            none = np.zeros(len(i), dtype=np.int64)
            mask = np.concatenate([np.ones(len(i), dtype=bool), np.zeros(len(j), dtype=bool)])
            start = np.concatenate([anchor[i] - l1, anchor[j] - l])
            end = np.concatenate([anchor[i] - l0, anchor[j] - l]) + min_words
            yield pa.RecordBatch.from_arrays(
                [get("t").take(pa.array(np.concatenate([i, j]))), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
                 *[pa.array(np.concatenate([none, x]), mask=mask) for x in w], pa.array(np.concatenate([np.ones(len(i), dtype=bool), repeats[j, l]]))],
                ["t", "start", "end", "w1", "w2", "sure"])

    return rows.mapInArrow(run, "t binary, start int, end int, w1 long, w2 long, sure boolean")


def repeated(docs: DataFrame, min_words: int = 50, max_broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, n_passages, repeated_words, spans (first word:word after the last, comma-joined)."""
    d = docs.select("doc_id", text_or_empty().alias("text")).withColumn("t", F.unhex(F.md5(F.col("text").cast("binary"))))
    suf = cut(suffixes(d, min_words))
    # written, so that both sides of the join are dealt out for it and a hot head may be split
    crowded = cut(suf.groupBy("k1", "k2").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi").select("k1", "k2"))
    near = suf.join(crowded, ["k1", "k2"]).select("k1", "k2", "t", "pos", "n", "off")
    # at most the suffixes of a text: copies of it bring the same ones
    wanted = cut(near.groupBy("t").agg(F.collect_set(F.struct("k1", "k2", "pos", "n", "off")).cast(AT).alias("at")))
    ids = wanted.select("t")
    texts = d.join(F.broadcast(ids) if ids.count() <= max_broadcast_rows else ids, "t").groupBy("t").agg(F.first("text").alias("text"))
    around = contexts(texts.join(wanted, "t"), min_words)
    met = cut(compared(around.repartitionByRange(*SORTED).sortWithinPartitions(*SORTED), min_words))
    win = met.where("w1 IS NOT NULL")
    again = (win.groupBy("w1", "w2").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max("sure").alias("sure"), F.min("sure").alias("all"))
             .where("(lo < hi OR sure) AND NOT all").select("w1", "w2"))
    found = met.where("w1 IS NULL").select("t", "start", "end").union(win.where("NOT sure").join(again, ["w1", "w2"]).select("t", "start", "end"))
    # copies of a text repeat it whole, up to the end of its last window
    copies = d.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t")
    ends = suf.groupBy("t").agg(F.max(F.col("pos") + F.col("n")).alias("m")).join(copies, "t")
    found = found.union(ends.select("t", F.lit(0).alias("start"), (F.col("m") + F.lit(min_words - 1)).alias("end"))).distinct()
    by_start = Window.partitionBy("t").orderBy("start", "end")
    past = by_start.rowsBetween(Window.unboundedPreceding, -1)
    island = found.withColumn("new", F.when(F.col("start") <= F.max("end").over(past), 0).otherwise(1)).withColumn("i", F.sum("new").over(by_start))
    joined = island.groupBy("t", "i").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    one = (joined.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
           .select("t", F.size("s").cast("long").alias("n_passages"),
                   F.aggregate("s", F.lit(0), lambda acc, x: acc + x["end"] - x["start"]).cast("long").alias("repeated_words"),
                   F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans")))
    return d.select("doc_id", "t").join(one, "t").select("doc_id", "n_passages", "repeated_words", "spans")
