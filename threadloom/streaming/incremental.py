"""Structured Streaming: de-duplication, counters, quarantine, listeners, and an index that grows by batches."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.functions.text import html_strip
from threadloom.operators.index import SIMPLE, Analyzer, Index, _terms, build, replies_of

Handler = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, *handlers: Handler) -> DataFrame:
    """Handlers one after the other; each is a DataFrame to a DataFrame."""
    for h in handlers:
        df = df.transform(h)
    return df


def unique(key: str, event_time: str | None = None, delay: str = "1 day") -> Handler:
    """Keeps the first row of each key; with an event time, state is dropped after the delay."""
    if event_time:
        return lambda df: df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return lambda df: df.dropDuplicates([key])


def stripped(column: str) -> Handler:
    return lambda df: df.withColumn(column, html_strip(F.col(column)))


def counts(key: str) -> Handler:
    return lambda df: df.groupBy(key).agg(F.count("*").alias("n"))


def counted(observation: Observation) -> Handler:
    """Counts the rows that pass, beside the query that uses them: observation.get["rows"]. For batches; streams report it to their listeners."""
    return lambda df: df.observe(observation, F.count("*").alias("rows"))


def shown(rows: int = 20, width: int = 50) -> Handler:
    """Prints the first rows and passes all of them on. For batches."""

    def handler(df: DataFrame) -> DataFrame:
        df.show(rows, width)
        return df

    return handler


def swallowed(df: DataFrame) -> None:
    """Computes all rows and keeps none."""
    df.write.format("noop").mode("overwrite").save()


def quarantined(fine: Column, folder: str) -> Handler:
    """Passes rows on for which the condition holds; the others, those included for which it is null, are appended to a table. For batches, so inside foreachBatch of a stream."""

    def handler(df: DataFrame) -> DataFrame:
        ok = F.coalesce(fine, F.lit(False))
        df.where(~ok).write.mode("append").parquet(folder)
        return df.where(ok)

    return handler


def listened(df: DataFrame, checkpoint: str, *listeners: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Every listener gets each batch of a stream, with its number."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            for call in listeners:
                call(rows, number)
        finally:
            rows.unpersist()

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a growing index keeps of each batch; terms are global, so they are computed from what is stored.
KEPT = ("docs", "postings", "replies")


def grow(docs: DataFrame, path: str, checkpoint: str, analyzer: Analyzer = SIMPLE) -> StreamingQuery:
    """Appends each batch's documents, postings and replies under path. docs: a stream of cid, text and, if there are threads, parent_cid.

    A batch writes to a folder of its own number, so a batch that is repeated replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        build(df, analyzer).save(f"{path}/batch={number}", KEPT)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grown(spark: SparkSession, path: str, analyzer: Analyzer = SIMPLE) -> Index:
    """The index over all batches that grow() wrote. Of a comment that came in several batches the last one counts."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)]
    numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    read = lambda kind: spark.read.option("basePath", path).parquet(*(f"{path}/batch={n}/{kind}" for n in numbers))
    docs, postings, replies = (read(kind) for kind in KEPT)
    last = docs.groupBy("cid").agg(F.max("batch").alias("batch"), F.min("batch").alias("first"))
    if last.where("first < batch").limit(1).count():
        last = last.drop("first")
        docs, postings = docs.join(last, ["cid", "batch"], "left_semi"), postings.join(last, ["cid", "batch"], "left_semi")
        replies = replies_of(docs)
    docs, postings, replies = (x.drop("batch") for x in (docs, postings, replies))
    n = docs.count()
    return Index(docs, postings, _terms(postings, n), replies, analyzer, n)
