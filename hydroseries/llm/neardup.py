"""Near-duplicate classes by BagMinHash, banding and verification.

Texts are bags of ``k``-word shingles; two texts are linked if the weighted
Jaccard similarity of their bags is at least ``threshold``; a class is a
connected component of links.  Texts with equal word sequences are collapsed
first.  Signatures are cut into bands; rows that share a band's key meet in a
bucket.  First every member is compared with the bucket's most central one
(which meets most others over all bands: the original of a group of copies).
Then buckets of at most ``small`` members compare all members of different classes; large ones
join most of their classes in ``rounds`` rounds, where members of different classes that agree in one more band
drawn anew each round are compared with a few others.  What is still in different classes after that is compared in
full: all pairs of a bucket, unless their sketches prove them too far apart.
A sketch holds the parity of the shingles that fall on each of ``BITS`` bits, so two sketches differ in at
most as many bits as the bags in shingles, and no link is lost by it.
Pairs are verified on the exact bags.

With bands of 5 of 125 registers a pair at similarity 0.8 shares no band with
a probability of 5e-5, at 0.9 of less than 1e-9.

Defined results: a null text is empty; texts without words are copies of each
other only if equal; rows that repeat a doc_id with other texts are separate
rows; a null doc_id sorts after others when a class is named; an empty table gives an empty
table; extra columns are not read; a long text is worked on whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.llm import bagminhash, shingle
from hydroseries.llm.common import cut, discard, text_or_empty, with_column
from hydroseries.llm.components import components, merge

BANDS, ROWS = 25, 5
BITS = 1024
SIGNED = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("size", T.IntegerType()),
                       T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])
KEYS = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])


def wordless_key(text: str) -> tuple[int, int]:
    """Keys of a text without words, which equals equal texts only."""
    d = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def row_keys(texts: list[str]) -> list[dict]:
    """Keys of the word sequence of each text."""
    out = []
    for a, e in shingle.blocks(texts):
        h, doc, _, _ = shingle.words(texts[a:e])
        k1, k2, n = shingle.sequence_keys(h, doc, e - a)
        out += [dict(zip(("k1", "k2"), (int(x), int(y)) if m else wordless_key(t))) for t, x, y, m in zip(texts[a:e], k1, k2, n)]
    return out


def sketches(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text the parity of the shingles (each copy its own) on each of BITS bits: (texts, BITS / 64)."""
    copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    bit = shingle.mix(np.repeat(h, count) + copy.astype(np.uint64) * np.uint64(shingle.P)) % np.uint64(BITS)
    odd = np.bincount(np.repeat(doc, count) * BITS + bit.astype(np.int64), minlength=n_texts * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n_texts, BITS), axis=1).view(np.int64)


def sign(texts: list[str], k: int) -> list[dict]:
    """Keys of the word sequence, number of shingles, band keys and sketch of each text."""
    out = []
    for a, e in shingle.blocks(texts):
        part = texts[a:e]
        h, doc, _, _ = shingle.words(part)
        k1, k2, n = shingle.sequence_keys(h, doc, len(part))
        s, sd = shingle.shingles(h, doc, k)
        size = np.bincount(sd, minlength=len(part)) if len(sd) else np.zeros(len(part), dtype=int)
        bags = shingle.bags(s, sd)
        sig = bagminhash.signatures(*bags, len(part), BANDS * ROWS)
        keys = bagminhash.band_keys(sig, BANDS, ROWS)
        odd = sketches(*bags, len(part)) if len(sd) else None
        for i, t in enumerate(part):
            if n[i]:
                out.append({"k1": int(k1[i]), "k2": int(k2[i]), "size": int(size[i]), "keys": keys[i].tolist(), "sketch": odd[i].tolist()})
            else:
                x, y = wordless_key(t)
                out.append({"k1": x, "k2": y, "size": 0, "keys": [], "sketch": []})
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    base = docs.select("doc_id", text_or_empty().alias("_text")).withColumn("mark", F.xxhash64("_text"))
    got = with_column(base, "s", SIGNED, lambda: lambda texts: sign(texts, k), ["_text"], ["doc_id", "mark"])
    return got.select("doc_id", "mark", "s.k1", "s.k2", "s.size", "s.keys", "s.sketch")


def node_bags(docs: DataFrame, nodes: DataFrame, k: int, max_broadcast_rows: int = 100_000) -> DataFrame:
    """node, size, bag of the nodes (node, k1, k2, rep, size): the packed
    shingles of the text that stands for the node, found by id and by a hash of the text, so
    that null and repeated ids bring no other texts along; equal rows count once."""
    few = nodes.count() <= max_broadcast_rows
    want = nodes.select("node", "k1", "k2", "size", F.col("rep.doc_id").alias("_first"), F.col("rep.mark").alias("_mark"))
    here = docs.select("doc_id", text_or_empty().alias("text"))
    met = here.withColumn("mark", F.xxhash64("text")).join(
        F.broadcast(want) if few else want, F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("mark") == F.col("_mark")))
    met = met.groupBy("node", "size", "k1", "k2", "mark", "text").agg(F.lit(1).alias("_one"))

    def start():
        def bags(texts, k1, k2):
            got = []
            for a, e in shingle.blocks(texts):
                h, doc, _, _ = shingle.words(texts[a:e])
                x, y, _ = shingle.sequence_keys(h, doc, e - a)
                # texts of one hash are told apart by the node's keys
                got += [shingle.pack(shingle.bag_of(t, k)) if int(p) == q and int(r) == s else None
                        for t, p, q, r, s in zip(texts[a:e], x, k1[a:e], y, k2[a:e])]
            return got
        return bags

    met = with_column(met.select("node", "size", "text", "k1", "k2"), "bag", T.BinaryType(), start, ["text", "k1", "k2"], ["node", "size"])
    return met.where("bag IS NOT NULL").groupBy("node").agg(F.first("size").alias("size"), F.first("bag").alias("bag"))


def verify(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bags are similar enough.  a may be in very many
    pairs: both joins have one row per node on their other side, so Spark may split
    the pairs of a hot node."""
    def start():
        def check(xs, ys):
            return [shingle.similarity(shingle.unpack(x), shingle.unpack(y)) >= threshold - 1e-12 for x, y in zip(xs, ys)]
        return check

    bag = bags.select("node", "size", "bag")
    both = (pairs.join(bag.toDF("b", "nb", "bag_b"), "b").join(bag.toDF("a", "na", "bag_a"), "a")
            .where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-12)).select("a", "b", "bag_a", "bag_b"))
    return with_column(both, "similar", T.BooleanType(), start, ["bag_a", "bag_b"], ["a", "b"]).where("similar").select("a", "b")


def _small_pairs(open_: DataFrame) -> DataFrame:
    """All pairs of different classes inside small buckets."""
    left, right = open_.select("key", F.col("node").alias("a"), F.col("comp").alias("ca")), open_.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"))
    return left.join(right, "key").where("a < b AND ca <> cb").select("a", "b")


def _large_pairs(open_: DataFrame, keys: DataFrame, r: int, reps: int = 8) -> DataFrame:
    """Candidates of one round inside large buckets, at most ``reps`` + 1 per member.

    A bucket is split into runs by one more band of its members (drawn by the bucket and the round), where
    similar members meet again.  Members outside the run's largest class are compared with ``reps`` of its
    members, and with the member before them."""
    band = F.element_at("keys", (F.pmod(F.xxhash64("key", F.lit(r)), F.lit(BANDS)) + 1).cast("int"))
    run = cut(open_.join(keys, "node").select("key", band.alias("run"), "comp", "node", F.xxhash64("node", "key", F.lit(r)).alias("h")))
    sizes = run.groupBy("key", "run", "comp").agg(F.count("*").alias("n"))
    largest = (sizes.groupBy("key", "run").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("classes"))
               .where("classes > 1").select("key", "run", F.col("top.comp").alias("lead_comp")))
    rank = F.row_number().over(Window.partitionBy("key", "run", "comp").orderBy("h", "node"))
    some = (run.withColumn("o", rank).where(F.col("o") <= reps).join(largest, ["key", "run"]).where("comp = lead_comp")
            .select("key", "run", F.col("node").alias("lead")))
    rest = run.join(largest, ["key", "run"]).where("comp <> lead_comp").select("key", "run", "comp", "node", "h")
    w = Window.partitionBy("key", "run").orderBy("h", "node")
    before = (rest.withColumn("lead", F.lag("node").over(w)).withColumn("lead_comp", F.lag("comp").over(w))
              .where("lead_comp <> comp").select("lead", "node"))
    return (rest.join(some, ["key", "run"]).select("lead", "node").union(before)
            .select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")))


def _open_pairs(open_: DataFrame, nodes: DataFrame, threshold: float, part_rows: int = 256) -> DataFrame:
    """All pairs of different classes inside the buckets whose sketches leave room for a link.

    A bucket's members are dealt into parts of about ``part_rows``; those outside its largest class meet each part."""
    sizes = open_.groupBy("key", "comp").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top")).select("key", F.col("top.comp").alias("lead_comp"))
    own = (open_.join(nodes.select("node", "size", "sketch"), "node").join(largest, "key")
           .withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int")))
    left = (own.where("comp <> lead_comp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("key", "part", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("na"), F.col("sketch").alias("sa")))
    right = own.select(F.col("key").alias("kb"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("pb"), F.col("node").alias("b"),
                       F.col("comp").alias("cb"), F.col("size").alias("nb"), F.col("sketch").alias("sb"), (F.col("comp") == F.col("lead_comp")).alias("led"))
    apart = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(BITS // 64)), F.lit(0))
    # J >= t of bags of na and nb shingles: at most (na + nb)(1 - t) / (1 + t) shingles are in one of them only
    room = (F.col("na") + F.col("nb")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)
    met = left.join(right, (F.col("key") == F.col("kb")) & (F.col("part") == F.col("pb")) & (F.col("ca") != F.col("cb"))
                    & (F.col("led") | (F.col("a") < F.col("b"))) & (apart <= room))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def classes(docs: DataFrame, k: int = 5, threshold: float = 0.8, small: int = 16, rounds: int = 3) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, copies (rows of
    equal words), k1, k2 (keys of the words), comp (names the class, also of rows
    that share a doc_id or have none); one row per input row."""
    s = cut(signed(docs, k))
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")  # a null id stands after all others
    exact = s.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.min(rep).alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"),
                                      F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    exact = cut(exact.withColumn("node", F.monotonically_increasing_id()))  # fixed, as it is written
    rows = exact.select("node", F.explode("keys").alias("key"))
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(rows.join(crowded, "key").select("key", "node", "n"))
    # a node that meets many others leads first: the original of a group of copies is near to most of them
    weight = members.groupBy("node").agg(F.sum("n").alias("met"))
    bags = cut(node_bags(docs, exact.join(weight, "node").select("node", "k1", "k2", "rep", "size"), k))
    best = (members.join(weight, "node").groupBy("key")
            .agg(F.max(F.struct(F.col("met"), (-F.col("node")).alias("minus"))).alias("best")))
    pairs = (members.join(best.select("key", (-F.col("best.minus")).alias("lead")), "key").where("node <> lead")
             .select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct())
    tried = cut(pairs)
    label = components(cut(verify(tried, bags, threshold)))
    keys = exact.select("node", "keys")
    for r in range(rounds + 1):
        known = members.join(label, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
        split = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        open_ = cut(known.join(split, "key", "left_semi"))
        if r and not open_.where(F.col("n") > small).limit(1).count():
            break
        if r < rounds:
            new = _large_pairs(open_.where(F.col("n") > small), keys, r)
        else:  # what the rounds left open, whole
            new = _open_pairs(open_.where(F.col("n") > small), exact, threshold)
        if r == 0:
            new = new.union(_small_pairs(open_.where(F.col("n") <= small)))
        new = cut(new.distinct().join(tried, ["a", "b"], "left_anti"))
        found = cut(verify(new, bags, threshold))
        discard(open_)
        tried = cut(tried.union(new))
        if found.limit(1).count():
            label = merge(label, found)
    named = (exact.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    total = (named.groupBy("comp").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size")))
    final = named.join(total, "comp").select("k1", "k2", "class_id", "class_size", "copies", "comp")
    return s.select("doc_id", "k1", "k2").join(final, ["k1", "k2"]).select("doc_id", "class_id", "class_size", "copies", "k1", "k2", "comp")
