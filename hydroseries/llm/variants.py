"""Spelling variants by a trie-node pair dictionary.

All words stand in a trie and, reversed, in a second one, and their nodes are
numbered.  Skipping position i of a word leaves the pair (node of the prefix
before i, reversed node of the suffix after i); splitting it at i without
skipping leaves (node before, node from i).  Words that share a pair, both
skipping, differ by one replaced code point; a skipping word and a whole one
that share a pair differ by one inserted code point.  Joining on pairs of
integers thus finds exactly the neighbours, and a pair holds at most one
skipping word per letter of the alphabet (90) and one whole word: that bounds every group.

Numbers: a node whose text has at most 7 bytes is the number of these bytes; a
deeper node that several words share has an id in a dictionary.  A node that
only one word reaches can be in no shared pair and has none.

Defined results: a null text has no words; a null doc_id reads as empty text;
extra columns are not read; repeated rows count again; no words, no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import cut, discard
from hydroseries.llm.sqlparts import CRC_TABLE, crc32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT = 5, 3
BYTES, BLOCK = 7, 32


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: runs of whole texts, one code point less where 97 divides the run's hash."""
    low = F.translate(F.col("text"), UPPER, LOWER)
    run, h = F.col("run"), F.col("h")
    # shorter runs cannot give words of MIN_CHARS; a longer match is always a maximal run
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(low, F.lit(r"[a-zÀ-ÿ]{%d,}" % MIN_CHARS), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (h % F.length(run)).cast("int")
    left_out = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return (hashed.select(F.when(h % 97 == 0, left_out).otherwise(run).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where((F.length("word") >= MIN_CHARS) & (F.col("n") >= MIN_COUNT)))


def _head(word: str | Column, depth: Column) -> Column:
    return F.substring(word, F.lit(1), depth.cast("int"))


def deep_nodes(words: DataFrame, word: str) -> DataFrame:
    """wid, deep: map depth -> id of the shared nodes of more than BYTES bytes on the path of ``word``.

    Very long words: how deep a word shares nodes is first bounded by hashes of
    its heads of 32, 64, ... code points (a collision only loosens the bound), so
    that heads are written out no deeper than that."""
    ids = words.select("wid", F.col(word).alias("w"), F.length(word).alias("len"))
    long = ids.where(F.col("len") >= BLOCK).select("wid", F.explode(F.expr(
        f"transform(sequence(1, len div {BLOCK}), k -> struct(k, xxhash64(k, substring(w, 1, k * {BLOCK})) AS h))")).alias("x")).select("wid", "x.*")
    many = long.groupBy("k", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k", "h")
    bound = long.join(many, ["k", "h"]).groupBy("wid").agg(((F.max("k") + 1) * BLOCK - 1).alias("bound"))
    heads = (ids.join(bound, "wid", "left")
             .withColumn("depth", F.explode(F.sequence(F.lit(1), F.least("len", F.coalesce("bound", F.lit(BLOCK - 1))))))
             .select("wid", "depth", _head("w", F.col("depth")).alias("head")).where(F.octet_length("head") > BYTES))
    shared = heads.groupBy("head").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    numbered = cut(shared.select("head", (F.monotonically_increasing_id() + 1).alias("node")))
    return (heads.join(numbered, "head").groupBy("wid")
            .agg(F.map_from_entries(F.collect_list(F.struct("depth", "node"))).alias("deep")))


def _node(word: str, deep: str, depth: Column) -> Column:
    """Number of the node of ``word`` at ``depth``: 0 for the root, below 0 by bytes, above 0 by dictionary, else null."""
    head = _head(word, depth)
    return (F.when(depth == 0, F.lit(0).cast("long"))
            .when(F.octet_length(head) <= BYTES, -F.conv(F.hex(head), 16, 10).cast("long"))
            .otherwise(F.try_element_at(F.col(deep), depth.cast("int"))))


def pairs(words: DataFrame) -> DataFrame:
    """wid, n, p, s, full, own: a row per skipped position (full false) and per split (full true).

    ``own``: the skipped letter differs from the one before it, so that of the
    positions in a run of one letter, which leave the same word, one counts."""
    both = (words.withColumn("back", F.reverse("word")).select("wid", "n", "word", "back", F.length("word").alias("len")))
    told = (both.join(deep_nodes(both, "word").withColumnRenamed("deep", "deep_p"), "wid", "left")
            .join(deep_nodes(both, "back").withColumnRenamed("deep", "deep_s"), "wid", "left"))
    letter = lambda i: F.substring("word", i.cast("int"), F.lit(1))
    skip = F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda i: F.struct(
        _node("word", "deep_p", i).alias("p"), _node("back", "deep_s", F.col("len") - 1 - i).alias("s"), F.lit(False).alias("full"),
        ((i == 0) | (letter(i + 1) != letter(i))).alias("own")))
    split = F.transform(F.sequence(F.lit(0), F.col("len")), lambda i: F.struct(
        _node("word", "deep_p", i).alias("p"), _node("back", "deep_s", F.col("len") - i).alias("s"), F.lit(True).alias("full"), F.lit(False).alias("own")))
    return told.select("wid", "n", F.explode(F.concat(skip, split)).alias("x")).select("wid", "n", "x.*").where("p IS NOT NULL AND s IS NOT NULL")


def neighbours(words: DataFrame) -> DataFrame:
    """wid, n_near, best (minus n, wid): how many near words, and the one of largest n (ties: smallest wid)."""
    key = lambda m: F.struct((-m["n"]).alias("minus"), m["wid"].alias("wid"))
    member = F.struct((-F.col("n")).alias("minus"), "wid", "own")
    group = (pairs(words).groupBy("p", "s")
             .agg(F.sort_array(F.collect_list(F.when(~F.col("full"), member))).alias("skips"),
                  F.max(F.when(F.col("full"), F.struct("wid", "n"))).alias("whole"))
             .where((F.size("skips") > 1) | ((F.size("skips") == 1) & F.col("whole").isNotNull())))
    name = lambda m: F.struct(m["minus"].alias("minus"), m["wid"].alias("wid"))
    skips, whole, has = F.col("skips"), F.col("whole"), F.col("whole").isNotNull()
    none = F.lit(None).cast("struct<minus: bigint, wid: bigint>")
    other = lambda m: F.when(m["wid"] != skips[0]["wid"], name(skips[0])).when(F.size("skips") > 1, name(F.get("skips", F.lit(1)))).otherwise(none)
    each = F.transform("skips", lambda m: F.struct(
        m["wid"].alias("wid"), (F.size("skips") - 1 + (m["own"] & has).cast("int")).alias("near"),
        F.array_min(F.array(other(m), F.when(m["own"] & has, key(whole)).otherwise(none))).alias("best")))
    inserts = F.filter("skips", lambda m: m["own"])
    one = F.struct(whole["wid"].alias("wid"), F.size(inserts).alias("near"), name(F.get(inserts, F.lit(0))).alias("best"))
    found = group.select(F.explode(F.concat(each, F.when(has & (F.size(inserts) > 0), F.array(one)).otherwise(F.expr(
        "cast(array() AS array<struct<wid: bigint, near: int, best: struct<minus: bigint, wid: bigint>>>)")))).alias("x")).select("x.*")
    return (found.where("near > 0").groupBy("wid").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """wid, root (wid) of rows (wid, form): links are followed in doubling steps.  A form has
    at least twice the count, so chains are short and have no loops."""
    links = cut(forms.select("wid", F.col("form").alias("root")))
    while True:
        step = links.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        new = cut(links.join(step, "root", "left").select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        discard(links)
        links, path = new.select("wid", "root"), new._cut_path
        links._cut_path = path
        if not moved:
            return links


def group_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs`` (doc_id, text)."""
    # word ids in code-point order: the smaller id is the smaller word
    words = cut(counted_words(docs).orderBy("word").select(F.monotonically_increasing_id().alias("wid"), "word", "n"))
    near = words.join(neighbours(words), "wid", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    likely = -F.col("best.minus") >= 2 * F.col("n")
    near = cut(near.select("wid", "word", "n", "n_near", F.when(likely, F.col("best.wid")).alias("form"), F.when(likely, -F.col("best.minus")).alias("form_n")))
    linked = near.where("form IS NOT NULL")
    name = lambda c: words.select(F.col("wid").alias(c), F.col("word").alias(f"{c}_word"))
    told = (linked.select("wid", "form").join(roots(linked), "wid").join(name("form"), "form").join(name("root"), "root")
            .select("wid", "form_word", "root_word"))
    return near.join(told, "wid", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT id, run, count(*) AS m FROM (
           SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate("text", '{UPPER}', '{LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run
           FROM documents) GROUP BY id, run),
hashed AS (SELECT run, m, ({crc32("id || ':' || run")})::BIGINT AS h FROM runs, crc_table),
words AS (SELECT word, sum(m)::BIGINT AS n FROM (
            SELECT m, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(m) >= {MIN_COUNT}),
cuts AS (SELECT word, n, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
         UNION SELECT x.word, w.word, w.n FROM cuts x JOIN words w ON w.word = x.a || x.b
         UNION SELECT w.word, x.word, x.n FROM cuts x JOIN words w ON w.word = x.a || x.b),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
          FROM words w LEFT JOIN best b ON b.word = w.word),
follow AS (SELECT word, word AS root, form AS next FROM forms
           UNION ALL SELECT f.word, g.word, g.form FROM follow f JOIN forms g ON g.word = f.next)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN follow r ON r.word = f.word AND r.next IS NULL
"""
