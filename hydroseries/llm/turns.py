"""Conversations of any length as sorted blocks of turns, and digests over the blocks.

A conversation of at most ``max_rows`` rows is one block.  Longer ones are found
by a count, put in order by a range-partitioned global row index and cut into
blocks of ``max_rows`` rows, so that no task collects one, whatever its turns
are (ties, nulls and repeated rows included)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import cut
from hydroseries.operators.rowindex import row_index

ORDER = ["turn", "role", "text"]


def placed(rows: DataFrame, max_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of short conversations, rows of long ones or None), both with ``block``
    and ``pos``; (block, pos) orders the rows of a long conversation by turn (nulls
    first), role and text, those of a short one are in block 0 at pos 0."""
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows)
    long = cut(counts.select(F.col("conv_id").alias("_conv"), F.lit(True).alias("_long")))
    here = {"block": F.lit(0).cast("long"), "pos": F.lit(0).cast("long")}
    if long.isEmpty():
        return rows.withColumns(here), None
    marked = rows.join(long, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    names = rows.columns
    short = marked.where("_long IS NULL").select(*names).withColumns(here)
    indexed = row_index(marked.where("_long").select(*names), ["conv_id", *ORDER], "pos")
    return short, indexed.withColumn("block", F.floor(F.col("pos") / max_rows)).select(*names, "block", "pos")


def gathered(rows: DataFrame, fields: list[str]) -> DataFrame:
    """conv_id, block, rows: structs of ``fields`` sorted by pos, turn, role and text."""
    struct = F.struct("pos", *ORDER, *[f for f in fields if f not in ("pos", *ORDER)])
    return rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(struct)).alias("rows"))


def joined_sha256(parts: DataFrame, columns: list[str], sep: str = "") -> DataFrame:
    """conv_id and, per column, the lowercase hex SHA-256 of its non-null values in
    order of block, joined by ``sep``.  A digest is sequential, so a conversation
    is one task's work, but its parts stream through sorted batches: memory does
    not grow with its length."""
    schema = parts.select("conv_id").schema
    for c in columns:
        schema = schema.add(c, "string")

    def run(batches):
        import pyarrow as pa
        fields, key, state = ["conv_id", *columns], None, None
        out = []

        def close():
            if state is not None:
                out.append([key, *[h.hexdigest() for h, _ in state]])
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in fields]
            for i in range(b.num_rows):
                k = cols[0][i].as_py()
                if state is None or k != key:
                    close()
                    key, state = k, [[hashlib.sha256(), False] for _ in columns]
                for s, col in zip(state, cols[1:]):
                    v = col[i].as_py()
                    if v is not None:
                        s[0].update((sep if s[1] else "").encode() + v.encode())
                        s[1] = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], type=t) for j, t in enumerate(types)], names=fields)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], type=t) for j, t in enumerate(types)], names=fields)

    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in schema]
    return (parts.select("conv_id", "block", *columns).repartition("conv_id")
            .sortWithinPartitions("conv_id", "block").drop("block").mapInArrow(run, schema))
