"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``width`` bytes run over the UTF-8 bytes of the whole text.  A text is
covered by chunks of ``2 * half`` bytes that overlap by half; each filter is
rectified and max-pooled per chunk, and a document's features are, per filter,
the maximum and the mean over its chunks.  A logistic layer combines them into
one probability.  A filter's weight for a byte is the sum of a weight for the
byte's class (letter case, digit, space, ...) and one for the byte itself.

Training takes a bounded sample of labelled rows (``per_class`` of each class,
balanced, the intercept corrected to the classes' counts among all training
rows) on the driver; scoring is one pass of ``mapInArrow`` without a shuffle.

Defined results: a null or empty text has features 0; repeated rows get equal
scores; an empty table gives an empty table; a long text is worked on in blocks,
so memory is bounded by the longest single text.  With labels of one class or none, every
score is that class (none: 1.0).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.llm.common import fold, labelled_sample, text_or_empty, with_column

WIDTH, FILTERS, HALF, CLASSES = 6, 16, 256, 8
BLOCK = 1 << 18  # bytes worked on at a time


def byte_classes() -> np.ndarray:
    c = np.full(256, 5)  # other punctuation
    c[ord("a"):ord("z") + 1] = 0
    c[ord("A"):ord("Z") + 1] = 1
    c[ord("0"):ord("9") + 1] = 2
    c[128:] = 3
    c[[32, 9, 13]] = 4
    c[10] = 6
    c[0] = 7  # padding between texts
    return c


def layout(texts: list[bytes], half: int = HALF):
    """One buffer with padding after each text, start and end of all half chunks
    (the padding belongs to none), and the number of half chunks of each text."""
    pad = b"\0" * WIDTH
    buf = np.frombuffer(pad.join(texts) + pad, dtype=np.uint8)
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lens + WIDTH)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    n = np.maximum(1, -(-lens // half))
    starts = np.repeat(first, n) + half * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return buf, starts, np.minimum(starts + half, np.repeat(first + lens, n)), n


def tables(vc: np.ndarray, vb: np.ndarray) -> np.ndarray:
    """(width / 2, 65536, filters): what each pair of neighbouring bytes adds."""
    w = (vc[:, byte_classes()] + vb).astype(np.float32)
    return np.stack([(w[j][:, None] + w[j + 1][None, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)])


def convolve(buf: np.ndarray, t: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter outputs at every position that has ``WIDTH`` bytes."""
    pair = buf[:-1].astype(np.int32) * 256 + buf[1:]
    n = len(buf) - WIDTH + 1
    z = t[0][pair[:n]]
    for j in range(1, len(t)):
        z += t[j][pair[2 * j:2 * j + n]]
    z += bias
    return z


def pooled(z: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maxima over [start, end) (an empty range gives the value at its start)."""
    return np.maximum.reduceat(z, np.stack([starts, ends], axis=1).ravel(), axis=0)[::2]


def chunk_pairs(n: np.ndarray):
    """Indices of the two halves of each overlapping chunk, and the text of each chunk."""
    chunks = np.maximum(1, n - 1)
    text = np.repeat(np.arange(len(n)), chunks)
    first = np.repeat(np.cumsum(n) - n, chunks) + np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    second = np.minimum(first + 1, np.repeat(np.cumsum(n) - 1, chunks))
    return first, second, text, chunks


def features(texts: list[bytes], m: dict) -> np.ndarray:
    """(texts, 2 * filters): maximum and mean over the chunks of each text."""
    out = np.zeros((len(texts), 2 * FILTERS), dtype=np.float32)
    k = 0
    while k < len(texts):
        # texts together fill a block; a longer one is cut into blocks of whole half chunks
        e, size = k, 0
        while e < len(texts) and (e == k or size + len(texts[e]) <= BLOCK):
            size += len(texts[e])
            e += 1
        part = texts[k:e]
        if len(part) == 1 and size > BLOCK:
            h = []
            for i in range(0, size, BLOCK):
                # a block sees the bytes that its last windows need; they open no half chunk of their own
                buf, starts, ends, _ = layout([part[0][i:i + BLOCK + WIDTH - 1]])
                h.append(pooled(convolve(buf, m["t"], m["bias"]), starts, ends)[:BLOCK // HALF])
            h = np.concatenate(h)
            n = np.array([len(h)])
        else:
            buf, starts, ends, n = layout(part)
            h = pooled(convolve(buf, m["t"], m["bias"]), starts, ends)
        np.maximum(h, 0, out=h)
        a, b, _, chunks = chunk_pairs(n)
        c = np.maximum(h[a], h[b])
        at = np.cumsum(chunks) - chunks
        out[k:e, :FILTERS] = np.maximum.reduceat(c, at, axis=0)
        out[k:e, FILTERS:] = np.add.reduceat(c, at, axis=0) / chunks[:, None]
        empty = np.array([not t for t in part])
        out[k:e][empty] = 0
        k = e
    return out


def score(texts: list[bytes], m: dict) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    if "constant" in m:
        return np.full(len(texts), float(m["constant"]))
    m = ready(m)
    x = features(texts, m).astype(np.float64) @ m["out"] + m["b"]
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(sample: list[tuple[str, int]], counts: dict[int, int], epochs: int = 10, batch: int = 32, rate: float = 0.05,
          seed: int = 7) -> dict:
    """Adagrad on the logistic loss; gradients reach a filter through the byte
    windows at which its maxima lie."""
    got = {y for _, y in sample}
    if len(got) < 2:
        return {"constant": float(got.pop()) if got else 1.0}
    rng = np.random.default_rng(seed)
    vc, vb = rng.normal(0, 0.4, (WIDTH, CLASSES, FILTERS)), np.zeros((WIDTH, 256, FILTERS))
    bias, out, b = np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0
    acc = [np.full(p.shape, 1e-2) for p in (vc, vb, bias, out)] + [1e-2]
    cls = byte_classes()
    data = [(t.encode("utf-8", "replace"), y) for t, y in sample]
    ys = np.array([y for _, y in data], dtype=float)
    weight = np.where(ys == 1, 0.5 / ys.mean(), 0.5 / (1 - ys.mean()))
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for s in range(0, len(order), batch):
            own = order[s:s + batch]
            texts = [data[i][0] or b" " for i in own]
            buf, starts, ends, n = layout(texts)
            t = (vc[:, cls] + vb).astype(np.float32)
            m = len(buf) - WIDTH + 1
            z = t[0][buf[:m]]
            for j in range(1, WIDTH):
                z += t[j][buf[j:j + m]]
            z += bias.astype(np.float32)
            h = pooled(z, starts, ends)
            a, c2, text, chunks = chunk_pairs(n)
            c = np.maximum(np.maximum(h[a], h[c2]), 0)
            at = np.cumsum(chunks) - chunks
            x = np.concatenate([np.maximum.reduceat(c, at, axis=0), np.add.reduceat(c, at, axis=0) / chunks[:, None]], axis=1).astype(float)
            p = 1 / (1 + np.exp(-np.clip(x @ out + b, -30, 30)))
            g = (p - ys[own]) * weight[own] / len(own)
            g_out, g_b, g_x = x.T @ g + 1e-4 * out, g.sum(), g[:, None] * out[None, :]
            # to chunks: the mean reaches all, the maximum the chunk that holds it
            g_c = (g_x[:, FILTERS:] / chunks[:, None])[text]
            is_max = c >= x[text, :FILTERS] - 1e-12
            g_c += np.where(is_max, g_x[text, :FILTERS], 0) / np.maximum(1, np.add.reduceat(is_max.astype(float), at, axis=0))[text]
            g_c = np.where(c > 0, g_c, 0)
            # to half chunks
            g_h = np.zeros(h.shape)
            left = h[a] >= h[c2]
            np.add.at(g_h, a, np.where(left, g_c, 0))
            np.add.at(g_h, c2, np.where(left, 0, g_c))
            # to the byte window at the half chunk's maximum (first position)
            i, f = np.nonzero(g_h)
            best = first_max(z, h, starts, ends)
            pos, gv = best[i, f], g_h[i, f]
            g_vc, g_vb, g_bias = np.zeros(vc.shape), np.zeros(vb.shape), np.zeros(FILTERS)
            np.add.at(g_bias, f, gv)
            for j in range(WIDTH):
                byte = buf[pos + j]
                np.add.at(g_vb[j], (byte, f), gv)
                np.add.at(g_vc[j], (cls[byte], f), gv)
            for k, (param, grad) in enumerate(((vc, g_vc), (vb, g_vb), (bias, g_bias), (out, g_out))):
                acc[k] += grad * grad
                param -= rate * grad / np.sqrt(acc[k])
            acc[4] += g_b * g_b
            b -= rate * g_b / np.sqrt(acc[4])
    prior = np.log(max(counts.get(1, 0), 1) / max(counts.get(0, 0), 1))
    return {"vc": vc, "vb": vb, "bias": bias.astype(np.float32), "out": out, "b": b + prior}


def ready(m: dict) -> dict:
    """The model with its lookup tables, which are a hundred times its size: made where it scores, not shipped."""
    return m if "t" in m or "constant" in m else m | {"t": tables(m["vc"], m["vb"])}


def first_max(z: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position of each half chunk's maximum, per filter."""
    size = ends - starts
    seg = np.repeat(np.arange(len(starts)), size)
    pos = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    hit = z[pos] >= h[seg]
    r, f = np.nonzero(hit)
    best = np.zeros(h.shape, dtype=np.int64)
    # written backwards, so the first position stays
    best[seg[r[::-1]], f[::-1]] = pos[r[::-1]]
    return best


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> dict:
    """Model from at most ``per_class`` labelled rows of each class of the training folds."""
    sample, counts = labelled_sample(docs, labels, "quality", 3, 1, per_class)
    return train(sample, counts)


def classify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted per row; other columns of docs stay."""
    def start():
        own = ready(model)
        return lambda texts: score([t.encode("utf-8", "replace") for t in texts], own).tolist()

    got = docs.drop("_text", "held_out", "predicted").withColumn("_text", text_or_empty())
    got = with_column(got, "score", T.DoubleType(), start, ["_text"], [c for c in got.columns if c not in ("_text", "score")])
    return got.withColumn("held_out", fold("doc_id", 3) == 1).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
