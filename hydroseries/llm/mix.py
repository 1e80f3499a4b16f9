"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (expected copies) between 0 and ``max_copies``.  For
each source the rates minimise the relative entropy to one copy each, subject
to the token constraint ``sum(rate * size) = target``.  The convex dual has one
multiplier per source and the rates are exponentially tilted by size:
``rate = min(max_copies, exp(lambda * size / mean_size))``.  Newton steps with a
bracket solve all duals at once; each step is one Spark aggregation over the
histogram ``(source, size, count)``.  Rates are then rounded into whole copies:
per (source, size) cell by cumulative rounding, with the rest of the words made
up by the shortest texts, and within a cell by the order of a hash of doc_id.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; size 0 is taken 0; an empty table gives an empty table; rows
with equal doc_id, source and size are separate documents; other columns of the
input pass by unused.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.llm.common import cut, discard, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"


def text_size(col="text"):
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), total_ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: ``sid`` (order by code point, null last), source_size,
    n_docs, weight, target.  The weights share ``total_ratio`` of all sizes; a
    target stops at ``cap`` times its source's size and the excess goes to the
    others by weight.  Sorting by cap/weight makes the stopped sources a
    prefix, so running sums give the level at which the rest shares."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    k = len(weights)
    per = per.withColumn("sid", rn).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(k)) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(total_ratio)))
           .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                       / F.sum("weight").over(rest))
           .withColumn("stopped", F.col("cap") <= F.col("level") * F.col("weight"))
           .withColumn("share", F.first(F.when(~F.col("stopped"), F.col("level")), ignorenulls=True).over(everything)))
    return per.select("sid", "source", "source_size", "n_docs", "weight",
                      F.when(F.col("stopped"), F.col("cap")).otherwise(F.col("share") * F.col("weight")).alias("target"))


def _rate(cap: float):
    """Rate of a cell given its dual multiplier; a null multiplier means every document at the cap."""
    return F.when(F.col("lam").isNull(), F.lit(cap)).otherwise(
        F.least(F.lit(cap), F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0)))))


def solve_dual(cells: DataFrame, targets: DataFrame, cap: float, tol: float = 1e-7, max_steps: int = 60) -> DataFrame:
    """Multiplier ``lam`` per source id.  cells: sid, size, n, x (size over the
    source's mean size).  A source whose target is its cap or 0 needs no steps."""
    full = F.col("target") >= F.col("source_size") * F.lit(cap) * F.lit(1 - 1e-12)
    state = cut(targets.select("sid", "target", F.when(full, F.lit(None)).otherwise(F.lit(0.0)).cast("double").alias("lam"),
                               F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                               full.alias("done")))
    for _ in range(max_steps):
        if not state.where(~F.col("done")).limit(1).count():
            break
        rate, mass = _rate(cap), F.col("n") * F.col("size")
        got = (cells.join(state.where(~F.col("done")).select("sid", "lam"), "sid")
               .groupBy("sid").agg(F.sum(mass * rate).alias("f"),
                                   F.sum(F.when(rate < cap, mass * F.col("x") * rate).otherwise(0.0)).alias("g")))
        s = state.join(got, "sid", "left")
        gap = F.col("target") - F.col("f")
        s = (s.withColumn("ok", F.col("done") | (F.abs(gap) <= F.col("target") * F.lit(tol)))
             .withColumn("lo", F.when(gap > 0, F.col("lam")).otherwise(F.col("lo")))
             .withColumn("hi", F.when(gap < 0, F.col("lam")).otherwise(F.col("hi")))
             .withColumn("step", F.when(F.col("g") > 0, F.col("lam") + gap / F.col("g"))))
        inside = (F.col("step").isNotNull() & (F.col("lo").isNull() | (F.col("step") > F.col("lo")))
                  & (F.col("hi").isNull() | (F.col("step") < F.col("hi"))))
        # outside the bracket: halve it, or double outwards while one side is open
        other = (F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2)
                 .when(F.col("lo").isNotNull(), F.abs(F.col("lam")) * 2 + 1).otherwise(-F.abs(F.col("lam")) * 2 - 1))
        new = cut(s.select("sid", "target",
                           F.when(F.col("ok"), F.col("lam")).when(inside, F.col("step")).otherwise(other).alias("lam"),
                           "lo", "hi", F.col("ok").alias("done")))
        discard(state)
        state = new
    return state.select("sid", "lam")


def round_cells(cells: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Whole copies per (sid, size) cell.  Running sums of the fractions, longest
    texts first, keep the words within one text of the target; the shortest
    texts then add or give up copies until the rest is used."""
    n_rate = F.col("n") * _rate(float(cap))
    c = cells.withColumn("want", n_rate).withColumn("low", F.floor(F.col("want") + 1e-9))
    frac = F.greatest(F.col("want") - F.col("low"), F.lit(0.0))
    down = Window.partitionBy("sid").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("frac", frac).withColumn("run", F.sum("frac").over(down))
    c = c.withColumn("copies", F.col("low") + F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("frac") + 0.5))
    c = c.withColumn("copies", F.least(F.greatest(F.col("copies"), F.lit(0)), F.col("n") * cap))
    whole = Window.partitionBy("sid")
    up = Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("rest", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole))
    c = c.withColumn("spare", F.when(F.col("rest") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies")))
    c = c.withColumn("used", F.coalesce(F.sum(F.col("spare") * F.col("size")).over(up), F.lit(0)))
    room = F.floor((F.abs(F.col("rest")) - F.col("used")) / F.greatest(F.col("size"), F.lit(1)) + 0.5)
    shift = F.least(F.greatest(room, F.lit(0)), F.col("spare")) * F.signum(F.col("rest"))
    return c.select("sid", "size", "n", (F.col("copies") + F.when(F.col("size") > 0, shift).otherwise(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights=(5, 2, 1), total_ratio: float = 1.5, max_copies: int = 2,
        rows_per_bucket: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken per document.

    A cell (source, size) may hold a third of all rows, so its documents are
    ranked inside hash buckets, and bucket counts give each bucket its offset."""
    sized = cut(docs.select("doc_id", "source", text_size().alias("size")))
    targets = cut(source_targets(sized, weights, total_ratio, float(max_copies)))
    total = targets.agg(F.sum("n_docs")).collect()[0][0] or 0
    cells = (sized.groupBy("source", "size").agg(F.count("*").alias("n"))
             .join(targets, sized["source"].eqNullSafe(targets["source"]))
             .select("sid", "size", "n", "target",
                     (F.col("size") / F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9))).alias("x")))
    cells = cut(cells)
    lam = solve_dual(cells.select("sid", "size", "n", "x"), targets, float(max_copies))
    tilted = cells.join(lam, "sid")
    copies = (round_cells(tilted, targets, max_copies)
              .join(tilted.select("sid", "size", _rate(float(max_copies)).alias("rate")), ["sid", "size"]))
    buckets = max(1, int(total) // rows_per_bucket)
    t = targets.select("sid", F.col("source").alias("_s"), "source_size", "target")
    d = (sized.withColumn("h", F.xxhash64("doc_id")).withColumn("b", F.pmod("h", F.lit(buckets)))
         .join(t, sized["source"].eqNullSafe(F.col("_s"))).drop("_s"))
    counts = d.groupBy("sid", "size", "b").agg(F.count("*").alias("m"))
    prior = Window.partitionBy("sid", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("offset", F.coalesce(F.sum("m").over(prior), F.lit(0)))
               .join(copies, ["sid", "size"]).select("sid", "size", "b", "offset", "n", "copies", "rate")
               .withColumnRenamed("copies", "cell_copies"))
    rank = F.row_number().over(Window.partitionBy("sid", "size", "b").orderBy("h", F.col("doc_id").asc_nulls_first()))
    ranked = d.withColumn("r", rank).join(offsets, ["sid", "size", "b"])
    each = F.floor(F.col("cell_copies") / F.col("n"))
    one = F.when(F.col("offset") + F.col("r") <= F.col("cell_copies") - each * F.col("n"), 1).otherwise(0)
    n_copies = (each + one).cast("int")
    return ranked.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"),
                         F.col("target").cast("double").alias("target"), "rate", n_copies.alias("copies"),
                         (n_copies * F.col("size")).cast("long").alias("taken"))
