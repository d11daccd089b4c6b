"""Landing of reading documents as they arrive."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfare.schemas import READING_DOCUMENT
from skyfare.sources.landing import tag_provenance

BROKEN = "_broken"
# A run's batches, all of whose counts are added up.
BATCHES_REPORTED = 100_000


class Landed(NamedTuple):
    """What one run did: documents it landed, and files it could not read, in order."""

    documents: int
    broken: list[str]


def stream_documents(spark: SparkSession, landing: str, files_per_batch: int = 10_000) -> DataFrame:
    """The documents below ``landing/date=.../`` as a stream, each file once.

    The column ``_broken`` holds the text of a file that is no such document, else NULL.
    """
    return (
        spark.readStream.schema(T.StructType([*READING_DOCUMENT, T.StructField(BROKEN, T.StringType())]))
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(landing)
    )


def land_available(spark: SparkSession, landing: str, destination: str, checkpoint: str) -> Landed:
    """Land every document not landed before, then stop; return what was landed.

    The checkpoint is the ingestion state: a rerun lands nothing twice, a run
    that was cut short goes on where it stopped, and a late document for an old
    day is still picked up. ``checkpoint`` and ``destination`` belong together.

    A file that can't be read holds up no other: it is reported by the run that
    meets it, and lands once it is put there again under another name.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.numRecentProgressUpdates", BATCHES_REPORTED)
    broken = F.col(BROKEN).isNotNull()
    tagged = tag_provenance(stream_documents(session, landing))
    # at most one file name for each file of a batch
    counted = tagged.observe(
        "landing",
        F.count_if(~broken).alias("documents"),
        F.collect_list(F.when(broken, F.col("provenance.endpoint"))).alias("broken"),
    )
    query = (
        counted.filter(~broken)
        .drop(BROKEN)
        .writeStream.format("parquet")
        .partitionBy("date")
        .option("path", destination)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batches = [p.observedMetrics["landing"] for p in query.recentProgress if "landing" in p.observedMetrics]
    return Landed(sum(b.documents for b in batches), sorted(f for b in batches for f in b.broken))
