"""Schemas of many Parquet files, read from their footers in tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Footers that one task reads.
FOOTERS_PER_TASK = 256

# How many directories have their schema inferred by Spark at the same time,
# where tasks cannot open the files themselves.
FOOTER_READERS = 16

Group = tuple[T.StructType, list[str]]


def _signature(path: str) -> str | None:
    """What a file's footer says about its columns; None if it can't be opened outside of Spark."""
    try:
        if path.startswith("file:"):
            files, place = pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            files, place = pyarrow.fs.FileSystem.from_uri(path)
        with files.open_input_file(place) as opened:
            # the first line names the object
            return str(pq.ParquetFile(opened).schema).partition("\n")[2]
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return None


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_signature(path) for path in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "signature"])


def file_signatures(files: DataFrame, number: int) -> DataFrame:
    """``directory, path`` of ``number`` files with their ``signature``; one job reads all footers."""
    dealt = files.select("directory", "path").repartition(-(-number // FOOTERS_PER_TASK) or 1, "path")
    return dealt.mapInArrow(_signatures, "directory string, path string, signature string")


def merged(schemas: Sequence[T.StructType]) -> T.StructType | None:
    """All columns of the schemas, or None if one has different types in two of them."""
    fields: dict[str, T.StructField] = {}
    for schema in schemas:
        for field in schema:
            known = fields.setdefault(field.name.lower(), field)
            if known.dataType != field.dataType or known.name != field.name:
                return None
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()])


def schema_groups(spark: SparkSession, files: DataFrame, by_file: bool = False) -> list[Group]:
    """The schemas among ``files`` (directory, path), each with the directories (or files) that have it.

    Footers are read in tasks, all in one job, and reduced there to the distinct
    sets of schemas in a directory. The driver gets those, the names of the
    directories, and Spark's schema of one file for each distinct footer. The
    files of a directory may differ in columns: its schema is that of all of
    them. Where they differ in types, its files are grouped instead. Directories
    on a file system that tasks cannot open by themselves are left to Spark's
    inference, a job for each.
    """
    number = files.count()
    found = file_signatures(files, number).persist()
    try:
        examples = found.groupBy("signature").agg(F.min("path").alias("path")).collect()
        known = {r.signature: spark.read.parquet(r.path).schema for r in examples if r.signature is not None}
        unit = "path" if by_file else "directory"
        sets = found.groupBy(unit).agg(
            F.array_sort(F.collect_set("signature")).alias("signatures"), F.count_if(F.col("signature").isNull()).alias("unread")
        )
        together = sets.groupBy("signatures", F.col("unread") > 0).agg(F.array_sort(F.collect_set(unit)).alias("places")).collect()
        units: list[tuple[T.StructType, list[str]]] = []
        closed: list[str] = []
        apart: list[str] = []
        for signatures, unread, places in together:
            schema = None if unread else merged([known[s] for s in signatures])
            if unread:
                closed += places
            elif schema is None:
                apart += places
            else:
                units.append((schema, places))
        if apart:
            named = found.join(F.broadcast(spark.createDataFrame([(p,) for p in apart], "directory string")), "directory")
            each = named.groupBy("signature").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()
            units += [(known[r.signature], r.paths) for r in each]
    finally:
        found.unpersist()
    with ThreadPoolExecutor(FOOTER_READERS) as pool:
        units += [(schema, [path]) for part in pool.map(lambda p: _inferred(spark, p), closed) for path, schema in part]
    groups: dict[str, Group] = {}
    for schema, places in units:
        # letter case and nullability aside, equal columns are one group
        plain = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        groups.setdefault(plain.json(), (plain, []))[1].extend(places)
    return [(schema, sorted(places)) for _, (schema, places) in sorted(groups.items())]


def _inferred(spark: SparkSession, place: str) -> list[tuple[str, T.StructType]]:
    """A directory with its merged schema, or its files each with their own if types differ."""
    try:
        return [(place, spark.read.option("mergeSchema", True).parquet(place).schema)]
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
    files = spark.read.format("binaryFile").load(place).where("length > 0").select("path")
    return [(r.path, spark.read.parquet(r.path).schema) for r in files.orderBy("path").collect()]
