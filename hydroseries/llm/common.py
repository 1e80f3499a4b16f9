"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hydroseries.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the plan: write the rows as a table in the shared folder and read it.

    A checkpoint() would keep the size estimate and constraints of its whole
    plan, and both grow exponentially in a loop of joins; a table starts anew."""
    spark = df.sparkSession
    path = scratch_path(spark, f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    remove_at_end(spark, path)
    got = spark.read.schema(df.schema).parquet(path)
    got._cut_path = path
    return got


def discard(df: DataFrame) -> None:
    """Delete the table of a ``cut`` that nothing reads any more."""
    remove_folder(df.sparkSession, df._cut_path)


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of our own when the application ends (its file system is closed)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a scratch folder of our own through the cluster's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches to Python workers of at most ``size`` bytes (one row at least), unless the session has a smaller
    bound.  It stays set, since a result is computed after the operator returns: JVM and worker hold batches outside the heap,
    at the default of 64 MB a batch some hundred MB an executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name)
    if kept != f"{size}b" and _bytes(kept) > size:
        spark.conf.set(name, f"{size}b")


def _bytes(text: str) -> float:
    """Number of a size setting such as 64m; infinite if none is set."""
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    digits = text.strip().lower().rstrip("bkmg")
    if not digits.isdigit() or not int(digits):
        return float("inf")
    return int(digits) * units.get(text.strip().lower()[len(digits):] or "b", 1 << 20)


def slices(batch, rows: int = 512, size: int = 4 << 20):
    """Pieces of an Arrow batch of at most ``rows`` rows and about ``size`` bytes (one row at least), so that what
    Python holds at once does not follow the session's batch size."""
    per_row = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, min(rows, size // per_row))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def with_column(df: DataFrame, name: str, kind: T.DataType, start, inputs: list[str], keep: list[str] | None = None) -> DataFrame:
    """Adds a column computed in Python from the ``inputs`` of each row.

    ``start()`` runs once per task and returns a function from lists of values
    to a list of results.  Columns pass as Arrow, so integers with nulls stay
    exact; only ``keep`` (all by default) is returned."""
    df = df.drop(name)
    keep = list(keep) if keep is not None else df.columns
    bounded_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa
        fn = start()
        for b in (s for whole in batches for s in slices(whole)):
            got = pa.array(fn(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs]), type=arrow)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], got], [*keep, name])

    arrow = to_arrow_type(kind)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind)])
    return df.mapInArrow(run, schema)


def packed(docs: DataFrame, known: list[str]) -> tuple[DataFrame, str]:
    """``docs`` with only the ``known`` columns in sight; all others ride in one struct whose
    name no caller uses (returned), so an operator's own names cannot clash with theirs."""
    name = f"_rest_{uuid.uuid4().hex}"
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in known]
    return docs.select(*[c for c in docs.columns if c in known], F.struct(*rest, F.lit(True).alias(name)).alias(name)), name


def unpacked(df: DataFrame, name: str, columns: list[str], known: list[str]) -> DataFrame:
    """The caller's ``columns`` in their order."""
    return df.select(*[F.col(c) if c in known else F.col(f"{name}.`{c}`") for c in columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col="text"):
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(doc_id="doc_id", k: int = 3):
    """crc32 of the decimal text of doc_id, mod k (a null id reads as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, k: int, held: int,
                    per_class: int) -> tuple[list, dict[int, int]]:
    """At most ``per_class`` labelled texts of each class from the training
    folds (crc32 mod k is not ``held``), and the class counts of all training
    rows.  The rows are those whose id has the smallest hash; only their ids
    are chosen first, so texts of other rows do not move.  Rows without a
    label, id or text are left out; of several labels of one id the largest
    counts."""
    lab = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
           .where(fold("doc_id", k) != held)
           .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")))
    counts = {int(r["y"]): int(r["n"]) for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = None
    for y in sorted(counts):
        part = lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    if ids is None:
        return [], counts
    # bounded by 2 * per_class rows of two numbers
    rows = (docs.where(F.col("text").isNotNull()).select("doc_id", "text")
            .join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
            .collect())
    rows = sorted(((int(r["doc_id"]), r["text"], int(r["y"])) for r in rows))
    return [(t, y) for _, t, y in rows], counts
