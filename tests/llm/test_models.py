"""The learned parts of the operators computed a second time, plainly."""

import collections
import math
import random
import re

import numpy as np
import pytest

from hydroseries.llm import cnn, mix, secrets

DOCS = "doc_id long, text string, source string"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10_000)}" for _ in range(n)]


def plain_probability(text: bytes, m) -> float:
    """Filters slid over every byte, maxima per chunk of two halves, logistic layer: loops only."""
    if not text:
        x = [0.0] * (2 * cnn.FILTERS)
    else:
        padded = text + b"\0" * cnn.WIDTH
        z = []
        for p in range(len(text)):
            one = m["bias"].astype(float).copy()
            for j in range(0, cnn.WIDTH, 2):
                one += m["t"][j // 2][padded[p + j] * 256 + padded[p + j + 1]]
            z.append(np.maximum(one, 0))
        halves = [np.max(z[i:i + cnn.HALF], axis=0) for i in range(0, len(z), cnn.HALF)]
        chunks = [np.maximum(halves[i], halves[min(i + 1, len(halves) - 1)]) for i in range(max(1, len(halves) - 1))]
        x = [*np.max(chunks, axis=0), *np.mean(chunks, axis=0)]
    return 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, m["out"]) + m["b"])))))


def test_quality_network_equals_plain_convolution():
    good = [" ".join(words(40, i)) + ". Then more." for i in range(60)]
    bad = ["!! ".join(words(40, i)).upper() for i in range(60)]
    m = cnn.ready(cnn.train([(t, 1) for t in good] + [(t, 0) for t in bad], {0: 60, 1: 60}, epochs=2))
    texts = [b"", b"a", "é漢 ".encode() * 90, good[0].encode() * 5, bad[1].encode(), b"x" * 256, b"y" * 257, b"z" * 513, b"w. " * 700]
    got = cnn.score(texts, m)
    for t, p in zip(texts, got):
        assert p == pytest.approx(plain_probability(t, m), abs=1e-5)


def test_mix_rates_are_exponentially_tilted(spark):
    """Per source the rates under the cap are exp(a * size) for one a, and give the target."""
    r = random.Random(6)
    rows = [(i, " ".join(words(r.randrange(1, 120), i)), r.choice(["a", "b", "c", None])) for i in range(500)]
    by_source = collections.defaultdict(list)
    for g in mix.mix(spark.createDataFrame(rows, DOCS)).collect():
        by_source[g["source"]].append(g)
    tilted = 0
    for got in by_source.values():
        assert sum(g["rate"] * g["size"] for g in got) == pytest.approx(got[0]["target"], rel=1e-6)
        slopes = [math.log(g["rate"]) / g["size"] for g in got if g["rate"] < 2 - 1e-9]
        if slopes:
            assert max(slopes) - min(slopes) < 1e-9
            tilted += 1
            # documents at the cap are there because the same tilt would take them past it
            assert all(slopes[0] * g["size"] >= math.log(2) - 1e-6 for g in got if g["rate"] >= 2 - 1e-9)
    assert tilted >= 2


def test_secret_model_and_spans_equal_plain(spark):
    r = random.Random(5)
    rand = lambda n: "".join(r.choice(secrets.ALPHABET[:62]) for _ in range(n))
    texts = [f"the thing and other words token={rand(24)} more ordinary_identifier_name2 here" for _ in range(90)]
    texts += [f"plain words stand here {' '.join(words(20, i))}" for i in range(90)]
    texts += [f"see {rand(28)}a1B and {rand(20)}Z9 here", "ordinary_identifier_name_again1 here", "", None]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    table = secrets.train(df.where("doc_id < 180"))

    base = re.compile(f"{secrets.ASSIGN.replace('(?i)', '(?i:', 1).replace('key)', 'key))', 1)}|{secrets.ACCESS}|{secrets.HEX}", re.A)
    k = secrets.OTHER + 1
    symbol = lambda c: secrets.ALPHABET.find(c) if c in secrets.ALPHABET else secrets.OTHER
    counts = [collections.Counter(), collections.Counter()]  # random strings, ordinary tokens
    for t in texts[:180]:
        for m in base.finditer(t or ""):
            value = m[2] or m[0]
            counts[0].update(zip(value, value[1:]))
        for m in re.finditer(secrets.WORD, base.sub(" ", t or "")):
            counts[1].update(zip(m[0], m[0][1:]))
    logs = []
    for c in counts:
        n = np.zeros((k, k))
        for (x, y), v in c.items():
            n[symbol(x), symbol(y)] += v
        single = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * k)
        logs.append(np.log((n + 8 * single) / (n.sum(axis=1, keepdims=True) + 8)))
    want = (logs[0] - logs[1]).ravel()
    assert np.allclose(table, want, atol=1e-4)

    found = {g["doc_id"]: g["spans"] for g in secrets.digest(secrets.scan(df, table)).collect()}
    for i, t in enumerate(texts):
        taken = [m.span() for m in base.finditer(t or "") if m[2] is None or len(m[2]) >= 6]
        spans = []
        for m in re.finditer(secrets.TOKEN, t or ""):
            v = m[0]
            mixed = (re.search("[0-9]", v) and re.search("[A-Za-z]", v)) or re.search("[a-z][A-Z]", v)
            ratio = sum(table[symbol(x) * k + symbol(y)] for x, y in zip(v, v[1:])) / max(1, len(v) - 1)
            if mixed and not any(a < m.end() and m.start() < b for a, b in taken) and ratio >= 1.0:
                spans.append(f"markov:{m.start()}:{m.end()}")
        assert [s for s in found[i].split(",") if s.startswith("markov")] == spans
    assert any("markov" in s for s in found.values())


def test_batches_are_bounded_by_bytes(spark):
    from hydroseries.llm import common
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    try:
        for kept, want in (("64m", "4194304b"), ("1m", "1m"), ("4194304b", "4194304b"), ("100", "100")):
            spark.conf.set(name, kept)
            common.bounded_batches(spark)
            got = spark.conf.get(name)
            assert common._bytes(got) == common._bytes(want)
    finally:
        spark.conf.set(name, old)
