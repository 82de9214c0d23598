"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches stay within these bounds, so that a Python worker's memory doesn't grow with the table.
MAX_BATCH_ROWS = 2000
MAX_BATCH_BYTES = 8 << 20
#: Characters of the texts that a function of map_texts() gets at a time; one text may be longer.
PART_CHARS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of later Python stages by rows and by bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > MAX_BATCH_ROWS:
        spark.conf.set(key, MAX_BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", MAX_BATCH_BYTES)


_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset (local runs only), a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="roundhouse-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _made.append((spark, folder))
    return folder


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    Each row is computed once, and an executor that is lost takes nothing with it. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/roundhouse-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table that written() made and that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1].split(":")[-1].rstrip("/") != path.split("://")[-1].rstrip("/")]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may have gone first
            return


def unit_hash(key: Column, seed: str) -> Column:
    """A uniform number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))).substr(1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 52))


def clean_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row for each key that has a label 0 or 1: contradictory rows of one key count as 1; null keys and other labels are left out."""
    return labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias(label))


def sampled_labels(labels: DataFrame, key: str, label: str, per_class: int, seed: str) -> DataFrame:
    """A sample of about per_class keys of each label 0 and 1, with the weight that undoes it (rows of its class / rows drawn).

    Keys and labels are those of clean_labels().
    """
    clean = clean_labels(labels, key, label)
    sizes = {r[label]: r["n"] for r in clean.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {c: min(1.0, per_class / max(1, sizes.get(c, 0))) for c in (0, 1)}
    of = lambda x: F.when(F.col(label) == 1, F.lit(x[1])).otherwise(F.lit(x[0]))
    return clean.where(unit_hash(F.col(key), seed) < of(rate)).withColumn("weight", of({c: 1.0 / rate[c] for c in (0, 1)}))


def parts_of(texts: Sequence[str | None], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Starts and ends of parts of a list that have about most characters (PART_CHARS), or one longer text."""
    start, most = 0, most or PART_CHARS
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars + len(texts[end] or "") <= most):
            chars += len(texts[end] or "")
            end += 1
        yield start, end
        start = end


def release_memory() -> None:
    """Give memory that a Python worker has freed back to the system: workers outlive their tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(docs: DataFrame, text: str, new: T.StructType, make: Callable[[], Callable[[list[str | None]], list[pa.Array]]], keep_text: bool = True, keep: Sequence[str] | None = None) -> DataFrame:
    """docs with new columns, made from one text column by make()'s function on the executors.

    make is called once in a task; its function gets some texts at a time, whole, and returns one Arrow array for each new
    column. Other columns (keep, or all) pass through as they are; columns of the new names are replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*new.names)
    names = [c for c in (docs.columns if keep is None else keep) if keep_text or c != text]
    schema = T.StructType([docs.schema[c] for c in names] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            for start, end in parts_of(texts):
                rest = batch.slice(start, end - start).select(names)
                yield pa.RecordBatch.from_arrays([*rest.columns, *work(texts[start:end])], names + new.names)
        release_memory()

    return docs.mapInArrow(run, schema)


def numbered(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but own named by number, so that no name clashes; and what gives a result its columns' names and order back.

    Columns that the result has besides follow.
    """
    names = {c: c if c in own else f"column_{i}" for i, c in enumerate(docs.columns)}

    def named(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(n).alias(c) for c, n in names.items()], *[c for c in out.columns if c not in names.values()])

    return docs.toDF(*names.values()), named
