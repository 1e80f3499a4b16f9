"""Stages of ``corpus_pipeline``: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``documents``, whatever they are called: an operator
sees the columns it knows only, the caller's others ride beside them in a struct of
an unused name and come back unchanged.  Rows whose text is null
are read as empty by each operator; repeated rows are rows of their own; an empty table passes as one."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroseries.llm import cnn, decon, neardup, secrets
from hydroseries.llm.common import cut, packed, read_table, text_or_empty, unpacked, with_column
from hydroseries.llm.mix import mix

KNOWN = ["doc_id", "text"]


def good_quality(spark, docs, sf_dir):
    """Drops documents that the classifier rejects (score under 0.5)."""
    model = cnn.fit(docs, read_table(spark, sf_dir, "labels"))
    seen, rest = packed(docs, KNOWN)
    return unpacked(cnn.classify(seen, model).where("predicted = 1"), rest, docs.columns, KNOWN)


def one_of_each(spark, docs, sf_dir, max_broadcast_rows: int = 200_000):
    """Keeps one row of each near-duplicate class: that of the smallest doc_id
    (a null one after all others), of several the one of the smallest keys of its words, of rows equal in both any one."""
    seen, rest = packed(docs, KNOWN)
    return unpacked(_one_of_each(seen, max_broadcast_rows), rest, docs.columns, KNOWN)


def _one_of_each(docs, max_broadcast_rows):
    found = cut(neardup.classes(docs).select("doc_id", "k1", "k2", "comp"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    best = cut(found.groupBy("comp").agg(F.min(row).alias("best")).select("comp", "best.doc_id", "best.k1", "best.k2"))
    named = found.join(best.select("comp", F.struct("doc_id", "k1", "k2").alias("best")), "comp")
    stays = F.struct("doc_id", "k1", "k2").eqNullSafe(F.col("best")).cast("int")
    # most ids have one row; only rows of the other ids are told apart by their words
    ids = named.groupBy("doc_id").agg(F.sum(stays).alias("stay"), F.count("*").alias("n")).where("stay = 0 OR n > 1")
    marks = cut(ids.select(F.col("doc_id").alias("_id"), F.when(F.col("stay") == 0, "gone").otherwise("some").alias("_mark")))
    small = marks.count() <= max_broadcast_rows
    marked = docs.join(F.broadcast(marks) if small else marks, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    kept = marked.where("_mark IS NULL").select(*docs.columns)
    if marks.where("_mark = 'some'").limit(1).count():
        some = marked.where("_mark = 'some'").select(*docs.columns, text_or_empty().alias("_mark_text"))
        some = with_column(some, "_mark_keys", neardup.KEYS, lambda: neardup.row_keys, ["_mark_text"])
        some = some.withColumns({"_mark_k1": F.col("_mark_keys.k1"), "_mark_k2": F.col("_mark_keys.k2")})
        own = best.select(F.col("doc_id").alias("_id"), F.col("k1").alias("_b1"), F.col("k2").alias("_b2"))
        some = some.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark_k1") == F.col("_b1")) & (F.col("_mark_k2") == F.col("_b2")), "left_semi")
        kept = kept.union(some.dropDuplicates(["doc_id", "_mark_k1", "_mark_k2"]).select(*docs.columns))
    return kept


def decontaminate(spark, docs, sf_dir):
    """Drops documents that hold a benchmark passage."""
    seen, rest = packed(docs, KNOWN)
    found = decon.contaminated(seen, read_table(spark, sf_dir, "benchmark"))
    return unpacked(found.where(F.size("hits") == 0), rest, docs.columns, KNOWN)


def redact_secrets(spark, docs, sf_dir):
    """Replaces every secret by a mark; other texts stay as they are."""
    known = [*KNOWN, "n_chars"]
    seen, rest = packed(docs, known)
    return unpacked(secrets.redact(secrets.scan(seen, secrets.train(docs))), rest, docs.columns, known)


def mix_sources(spark, docs, sf_dir):
    """Copies and words taken of every document left."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
