"""Layers of tables by session, text and JSON sources, manifests and payloads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compat import first_by


def save_layer(tables: dict[str, DataFrame], folder: str, partition: str = "match_id") -> None:
    """One parquet table each, partitioned by session, so that a session can be read or replaced alone."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(partition).parquet(f"{folder}/{name}")


def load_layer(spark: SparkSession, folder: str, schemas: dict[str, T.StructType], optional: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Tables with the schemas given; an optional one that isn't there is empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for name, schema in schemas.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        missing = name in optional and not path.getFileSystem(conf).exists(path)
        out[name] = spark.createDataFrame([], schema) if missing else spark.read.schema(schema).parquet(f"{folder}/{name}")
    return out


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns that some lack are null there, and types are brought to the widest."""
    out = frames[0]
    for df in frames[1:]:
        for c in set(out.columns) & set(df.columns):
            a, b = out.schema[c].dataType, df.schema[c].dataType
            if a != b:
                wide = T.StringType() if T.StringType() in (a, b) else T.DoubleType() if isinstance(a, T.FractionalType) or isinstance(b, T.FractionalType) else T.LongType()
                out, df = out.withColumn(c, F.col(c).cast(wide)), df.withColumn(c, F.col(c).cast(wide))
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated text with a header and lines of comments."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, comment="#")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def discovered(spark: SparkSession, folder: str, pattern: str, seen: DataFrame | None = None, edge: int = 4 << 20) -> DataFrame:
    """(path, length, fingerprint): files whose size and both ends aren't among the fingerprints seen, one of each.

    Names and sizes are listed without the contents; of each file only both ends are read, where it is fingerprinted.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")

    def fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, length in zip(batch["path"], batch["length"], strict=True):
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as f:
                    head = f.read(edge)
                    f.seek(max(0, length - edge))
                    tail = f.read(edge)
                found.append(hashlib.sha256(str(length).encode() + head + tail).hexdigest()[:20])
            yield batch.assign(fingerprint=found)

    found = first_by(files.mapInPandas(fingerprints, "path string, length long, fingerprint string"), ["fingerprint"], "path")
    return found if seen is None else found.join(seen.select("fingerprint"), "fingerprint", "left_anti")


def grouped_parts(files: DataFrame, pattern: str = r"^(.*?)(?:[-_]p(\d+))?(\.[^.]+)$") -> DataFrame:
    """(name, parts): paths of the parts of one recording, in the order of their numbers."""
    base = F.element_at(F.split("path", "/"), -1)
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(base, pattern, 2), F.lit("")), F.lit("999999")).cast("int"), F.lit(0))
    rows = files.select(F.regexp_extract(base, pattern, 1).alias("name"), F.struct(number.alias("number"), "path").alias("part"))
    return rows.groupBy("name").agg(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["path"]).alias("parts"))


def upserted(manifest: DataFrame, rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The latest version of each key of both, of equal ones the new row."""
    both = manifest.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_by(both, keys, F.desc_nulls_last(version), F.desc("_new")).drop("_new")


def stale(manifest: DataFrame, versions: dict[str, int]) -> DataFrame:
    """Rows made by an older version of anything, with what is older."""
    older = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c) < v), F.lit(c)) for c, v in versions.items()]))
    return manifest.withColumn("older", older).where(F.size("older") > 0)


def payload(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "json") -> DataFrame:
    """One JSON document for each key: its rows in order. A key's rows come together, so keys are to be sessions, not more."""
    rest = [c for c in df.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order])))
    return df.groupBy(*keys).agg(F.to_json(rows).alias(name))


def interned(df: DataFrame, column: str, name: str) -> tuple[DataFrame, DataFrame]:
    """df with a number in place of each string, and the strings by number, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    names = counts.select(column, (F.row_number().over(Window.orderBy(F.desc("_n"), column)) - 1).alias(name))
    return df.join(names, df[column].eqNullSafe(names[column]), "left").drop(column), names
