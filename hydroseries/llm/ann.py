"""Approximate nearest neighbours by cosine over robust-pruned graphs.

Equal vectors are collapsed first (a vector keeps its k + 1 smallest ids, which
is all that a result of k can name).  The distinct vectors are dealt by hash into
shards of about ``shard_rows``; each shard builds its graph in one task and the
graphs are cut.  Clumps of near copies enter a graph as one leader each, and a
search that finds the leader looks at all of them.  The stated queries, in blocks of ``block_rows``, meet every
shard, up to ``pack`` shards at a time: a cell (pack of shards, block) is one task of bounded size that takes its block
through one graph after another, scores what it found on the original vectors in double precision and keeps the
best.  So the index is copied once a block and a query once a pack; packs are smaller only where there would be
fewer of them than cores, which changes no result.  The best of all cells are merged.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without a vec_id; rows that repeat a vec_id and
vector count once, and a query never finds its own vec_id; ties go to the smaller vec_id; vectors are
compared with those of their own length only; fewer candidates than k are all
returned; an empty table gives an empty table.  Shards that are not larger than
the beam are searched whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.llm import graph
from hydroseries.llm.common import cut, shuffle_partitions


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .where(fine & F.exists("v", lambda c: c != 0)))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # large or tiny components must not overflow
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each row of c with q, in double precision, the same for equal rows."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        s = (c * q).sum(axis=1) / (np.sqrt((c * c).sum(axis=1)) * np.sqrt((q * q).sum()))
    if not np.isfinite(s).all():
        c, q = c / np.abs(c).max(axis=1, keepdims=True), q / np.abs(q).max()
        s = (c * q).sum(axis=1) / (np.sqrt((c * c).sum(axis=1)) * np.sqrt((q * q).sum()))
    return s


def _top(ids: list[list[int]], scores: np.ndarray, k: int) -> list[tuple[int, float]]:
    got = [(i, float(s)) for row, s in zip(ids, scores) for i in row]
    return sorted(set(got), key=lambda t: (-t[1], t[0]))[:k]


def search_all(rows: DataFrame, k: int = 5, every: int = 50, shard_rows: int = 4096, block_rows: int = 16_384, degree: int = 32,
               beam: int = 64, query_beam: int = 96, pack: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    # the key of a vector: two hashes, so equal vectors meet without shipping them twice
    v = (valid_vectors(rows).withColumn("dim", F.size("v"))
         .withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v")))
    first = F.row_number().over(Window.partitionBy("k1", "k2", "dim").orderBy("vec_id"))
    once = v.dropDuplicates(["vec_id", "k1", "k2"])
    reps = cut(once.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("k1", "k2", "dim")
               .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.max_by("v", -F.col("r")).alias("v")))
    ask = once.where(F.col("vec_id") % every == 0)
    n, nq = reps.count(), ask.groupBy("k1", "k2", "dim").agg(F.lit(1).alias("one")).count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // block_rows))
    cores = shuffle_partitions(rows.sparkSession)
    pack = max(1, min(pack, shards * blocks // cores))
    packs = -(-shards // pack)

    def make(key, pdf):
        pdf = pdf.sort_values(["k1", "k2"]).reset_index(drop=True)
        x = _unit(np.stack(pdf["v"].to_numpy()))
        lead = graph.leaders(x)
        own = np.nonzero(lead == np.arange(len(x)))[0]
        nbr, start = graph.build(x[own], degree, beam)
        edges: list[list[int]] = [[] for _ in range(len(x))]
        for i, r in zip(own, nbr):
            edges[i] = own[r[r >= 0]].tolist()
        return pd.DataFrame({"shard": key[0], "dim": key[1], "node": np.arange(len(x)), "lead": lead, "start": int(own[start]),
                             "ids": pdf["ids"], "v": pdf["v"], "nbr": edges})

    index = cut(reps.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int")).groupBy("shard", "dim")
                .applyInPandas(make, "shard int, dim int, node int, lead int, start int, ids array<long>, v array<double>, nbr array<int>"))

    def find(key, nodes, asked):
        cols = ["k1", "k2", "dim", "vec_id", "score"]
        if not len(nodes) or not len(asked):
            return pd.DataFrame({c: [] for c in cols})
        keys = list(zip(asked["k1"], asked["k2"], asked["dim"]))
        best: list[list] = [[] for _ in keys]
        for _, one in nodes.groupby("shard"):
            for had, new in zip(best, through(one, asked)):
                had += new
        out = [(*key, i, s) for key, found in zip(keys, best) for i, s in sorted(set(found), key=lambda t: (-t[1], t[0]))[:k + 1]]
        return pd.DataFrame(out, columns=cols)

    def through(nodes, asked):
        """Per query its best of one shard: (vec_id, score)."""
        nodes = nodes.sort_values("node")
        raw, ids = np.stack(nodes["v"].to_numpy()), [list(x) for x in nodes["ids"]]
        x, n_own = _unit(raw), len(nodes)
        nbr = np.full((n_own, degree), -1, dtype=np.int64)
        for i, r in enumerate(nodes["nbr"]):
            nbr[i, :len(r)] = r
        q_raw = np.stack(asked["v"].to_numpy())
        q, start, out = _unit(q_raw), int(nodes["start"].iloc[0]), []
        lead = nodes["lead"].to_numpy()
        by_lead = np.argsort(lead, kind="stable")
        begin, end = np.searchsorted(lead[by_lead], np.arange(n_own)), np.searchsorted(lead[by_lead], np.arange(n_own), "right")
        for at in range(0, len(q), 256):
            if n_own <= query_beam:
                found = np.broadcast_to(np.arange(n_own), (len(q[at:at + 256]), n_own))
            else:
                found, _ = graph.search(x, nbr, start, q[at:at + 256], query_beam)
            for j, row in enumerate(found):
                if n_own > query_beam:
                    row = np.concatenate([by_lead[begin[i]:end[i]] for i in row[row >= 0][:4 * (k + 1)]])
                out.append(_top([ids[i] for i in row], cosine(q_raw[at + j], raw[row]), k + 1))
        return out

    queries = (ask.groupBy("k1", "k2", "dim").agg(F.first("v").alias("v"))
               .withColumn("block", F.pmod("k2", F.lit(blocks)).cast("int"))
               .withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))))
    cells = index.withColumn("pack", F.floor(F.col("shard") / pack).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = (cells.groupBy("pack", "dim", "block").cogroup(queries.groupBy("pack", "dim", "block"))
           .applyInPandas(find, "k1 long, k2 long, dim int, vec_id long, score double"))
    # per distinct query vector the best k + 1 of all shards; a query then leaves out its own id
    best = F.row_number().over(Window.partitionBy("k1", "k2", "dim").orderBy(F.desc("score"), "vec_id"))
    top = (met.withColumn("r", best).where(F.col("r") <= k + 1).groupBy("k1", "k2", "dim")
           .agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top")))
    own = (ask.select(F.col("vec_id").alias("query_id"), "k1", "k2", "dim").join(top, ["k1", "k2", "dim"])
           .withColumn("top", F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)))
    return (own.select("query_id", F.posexplode("top").alias("rank", "t"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), "t.vec_id", "t.score"))
