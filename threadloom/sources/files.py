"""Readers and writers of comment files."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import escape_newlines, html_strip, int_or, unescape_newlines

#: The columns of the comment files, in their order.
COMMENT_COLUMNS = ("cid", "article_id", "author_id", "text", "time", "parent", "upvotes", "downvotes")


def _csv(spark: SparkSession, path: str | list[str], columns: tuple[str, ...], delimiter: str = ",") -> DataFrame:
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("escape", '"').option("sep", delimiter).csv(path)


def read_comments(spark: SparkSession, comments: str | list[str], articles: str | None = None, authors: str | None = None, delimiter: str = ",") -> DataFrame:
    """Comment records of one or more files; rows without integer ids are left out. Votes read as 0. With articles and authors, their names are joined on."""
    c = _csv(spark, comments, COMMENT_COLUMNS, delimiter)
    none = F.lit(None).cast("bigint")
    out = c.select(int_or(F.col("cid"), none).alias("commentId"), int_or(F.col("article_id"), none).alias("article_id"), F.col("author_id").alias("comment_author"), unescape_newlines(F.col("text")).alias("comment_text"), F.col("time").alias("timestamp"), int_or(F.col("parent"), none).alias("parent_comment_id"), F.lit(0).alias("upvotes"), F.lit(0).alias("downvotes"))
    out = out.where("commentId is not null and article_id is not null")
    if authors:
        names = read_authors(spark, authors).select(F.col("author_id").cast("string").alias("comment_author"), F.col("author").alias("name"))
        out = out.join(names, "comment_author", "left").withColumn("comment_author", F.coalesce("name", F.lit(""))).drop("name")
    if articles:
        out = out.join(read_articles(spark, articles), "article_id")
    return out


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ("article_id", "article_url")).select(F.col("article_id").try_cast("bigint").alias("article_id"), "article_url").where("article_id is not null")


def read_authors(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ("author_id", "author")).select(F.col("author_id").try_cast("bigint").alias("author_id"), "author").where("author_id is not null")


def read_legacy(spark: SparkSession, path: str, version: int, with_file: bool = False) -> DataFrame:
    """Version 2 has one column of votes, version 3 two and texts that may hold HTML."""
    votes = {2: ("votes",), 3: ("upvotes", "downvotes")}.get(version)
    if votes is None:
        raise ValueError(f"no reader for version {version}")
    c = _csv(spark, path, ("cid", "article_url", "author", "text", "time", "parent", *votes, "article_id"))  # fixed columns of the older files
    up = F.col(votes[0]).try_cast("int")
    down = F.col("downvotes").try_cast("int") if version == 3 else F.lit(0)
    more = [F.col("_metadata.file_name").alias("file")] if with_file else []
    return c.select(*more, "cid", "article_id", "author", html_strip(unescape_newlines(F.col("text"))).alias("text"), "time", "parent", F.coalesce(up, F.lit(0)).alias("upvotes"), F.coalesce(down, F.lit(0)).alias("downvotes"))


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_comments(comments: DataFrame, path: str) -> None:
    _write_csv(comments.withColumn("text", escape_newlines(F.col("text"))).select(*COMMENT_COLUMNS), path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """etl.comment_tables() as files: comments in their order, and the maps of comment ids, articles and authors (fixed column names)."""
    ordered = tables["comments"].repartitionByRange("seq").sortWithinPartitions("seq")
    write_comments(ordered, f"{folder}/comments")
    _write_csv(tables["comment_ids"].select("cid", "orig_comment_id"), f"{folder}/comment_ids")
    _write_csv(tables["articles"].select("article_id", F.col("article_url").alias("arcticle_url")), f"{folder}/articles")
    _write_csv(tables["authors"].select("author_id", "author"), f"{folder}/authors")


def merge_files(spark: SparkSession, paths: list[str], out: str) -> None:
    """Comment files of many articles as one."""
    c = _csv(spark, paths, COMMENT_COLUMNS)
    _write_csv(c.where(F.col("cid").try_cast("bigint").isNotNull()), out)


def migrate(spark: SparkSession, path: str, version: int, out: str) -> None:
    """Files of an older version, with two columns of votes and texts without HTML."""
    c = read_legacy(spark, path, version)
    _write_csv(c.withColumn("text", escape_newlines(F.col("text"))), out)


def read_raw_folder(spark: SparkSession, folder: str, version: int = 2) -> DataFrame:
    """Files of one article each, with file (their name). Files with a NUL in them are left out whole."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("file"))
    bad = lines.where(F.contains("value", F.lit("\x00"))).select("file").distinct()
    rows = read_legacy(spark, folder, version, with_file=True)
    return rows.join(bad, "file", "left_anti")


def without_nul_lines(spark: SparkSession, path: str, out: str) -> int:
    """Copies a text file without the lines that hold a NUL; how many there were."""
    lines = spark.read.text(path)
    bad = F.contains("value", F.lit("\x00"))
    lines.where(~bad).write.mode("overwrite").text(out)
    return lines.where(bad).count()


def write_packed(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """kind: parquet, or json (an object a line)."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"no packed form {kind!r}")
    df.write.mode("overwrite").format(kind).save(path)


def read_packed(spark: SparkSession, path: str, schema: str | None = None, kind: str = "parquet") -> DataFrame:
    if kind not in ("parquet", "json"):
        raise ValueError(f"no packed form {kind!r}")
    return (spark.read.schema(schema) if schema else spark.read).format(kind).load(path)


def read_queries(path: str) -> tuple[str | None, list[str]]:
    """The file to index, if the first line names one, and the queries."""
    with open(path, encoding="utf-8") as f:
        lines = [x.strip() for x in f.read().splitlines()]
    lines = [x for x in lines if x]
    if lines and lines[0].startswith("Index:"):
        return lines[0].removeprefix("Index:"), lines[1:]
    return None, lines


def write_results(results: DataFrame, folder: str, number: int, ids_only: bool) -> str:
    """query{number}.txt with ids, or ids and texts; for results that a person reads. Batches go to write.partitionBy."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"query{number}.txt")
    with open(path, "w", encoding="utf-8") as f:
        for r in results.toLocalIterator():
            f.write(f"{r['cid']}\n" if ids_only else f"{r['cid']}, {(r['text'] or '').replace(chr(10), chr(92) + 'n')}\n")
    return path
