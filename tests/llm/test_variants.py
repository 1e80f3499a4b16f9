"""Spelling variants against SQL and against a plain edit-distance check."""

import collections
import random
import re
import zlib

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from hydroseries.llm import variants

COLUMNS = "doc_id long, text string, wid string, word string, n string, id string, run string, h string"


def texts():
    r = random.Random(8)
    stems = ["".join(r.choice("abcdeéß") for _ in range(r.randrange(4, 8))) for _ in range(30)]
    long = "".join(r.choice("abc") for _ in range(300))
    words = stems * 3 + [long, long[:150] + "d" + long[150:], long[:-1] + "é", "x" * 40, "x" * 41, "y" * 33 + "z", "y" * 34]
    for s in stems:
        i = r.randrange(len(s))
        words += [s[:i] + r.choice("abÉ×") + s[i:], s[:i] + s[i + 1:], s[:i] + "z" + s[i + 1:], s.upper()]
    out = [" ".join(r.choice(words) for _ in range(120)) for _ in range(60)]
    return out + [out[0]] * 3 + ["", None, "...", "abcde1abcdE,abcde", f"{long} " * 40]


def plain(rows):
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    count = {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    found, form = {}, {}
    for w, n in count.items():
        others = [v for v in count if v != w and near(w, v)]
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 2 * n else None
        found[w] = [n, len(others)]
    for w in found:
        root = w
        while form[root]:
            root = form[root]
        found[w] = (form[w], root, *found[w], form[w] and count[form[w]])
    return found


def test_equal_plain_and_sql(spark):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], COLUMNS)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.group_variants(df).collect()}
    assert got == plain(rows)
    assert any(len(w) == 300 and v[3] for w, v in got.items()) and any(v[0] for v in got.values())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert {r[0]: r[1:] for r in con.sql(variants.ORACLE).fetchall()} == got
    assert variants.group_variants(df.limit(0)).count() == 0


def test_pairs_stay_linear_in_the_letters(spark):
    """Many words that differ in one letter share one pair; no row per pair of words is made."""
    letters = [chr(c) for c in range(0xC0, 0x100)]
    words = spark.createDataFrame([(i, f"abcd{c}fgh", 10 + i) for i, c in enumerate(letters)], "wid long, word string, n long")
    assert variants.pairs(words).count() <= len(letters) * (8 + 9)  # deep nodes of one word alone give none
    got = variants.neighbours(words).orderBy("wid").collect()
    assert [g["n_near"] for g in got] == [len(letters) - 1] * len(letters)
    assert got[0]["best"]["wid"] == len(letters) - 1 and got[-1]["best"]["wid"] == len(letters) - 2


def test_roots_follow_chains(spark):
    links = spark.range(0, 37).select(F.col("id").alias("wid"), (F.col("id") + 1).alias("form"))
    assert {r["root"] for r in variants.roots(links).collect()} == {37}
