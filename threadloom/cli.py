"""python -m threadloom.cli QUERYFILE | Index:COMMENTS [--topN K] [--printIdsOnly] [--index DIR] [--out DIR]

python -m threadloom.cli crawl [--new RESPONSES] [--old RESPONSES] [--out DIR]
"""

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadloom.operators.etl import cleaned, comment_tables
from threadloom.operators.index import TREEBANK, build
from threadloom.operators.search import SearchEngine
from threadloom.sources.api import crawled
from threadloom.sources.files import read_comments, read_queries, write_results, write_tables


def crawl(args: list[str]) -> list[str]:
    """Comment files from the APIs' responses, as they were stored line by line (sources/api.py)."""
    p = argparse.ArgumentParser(prog="crawl", description=crawl.__doc__)
    p.add_argument("--new", help="responses of the newer API")
    p.add_argument("--old", help="responses of the older API")
    p.add_argument("--out", default="data")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    write_tables(comment_tables(cleaned(crawled(spark, a.new, a.old))), a.out)
    return [a.out]


def main(args: list[str] | None = None) -> list[str]:
    if (args if args is not None else sys.argv[1:])[:1] == ["crawl"]:
        return crawl((args if args is not None else sys.argv[1:])[1:])
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("query")
    p.add_argument("--topN", type=int)
    p.add_argument("--printIdsOnly", action="store_true")
    p.add_argument("--index", default="index")
    p.add_argument("--out", default=".")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    source, queries = (a.query.removeprefix("Index:"), []) if a.query.startswith("Index:") else read_queries(a.query)
    if source:
        c = read_comments(spark, source)
        build(c.select(F.col("commentId").alias("cid"), F.col("comment_text").alias("text"), F.col("parent_comment_id").alias("parent_cid")), TREEBANK).save(a.index)
    if not queries:
        return []
    with SearchEngine.open(spark, a.index, TREEBANK) as engine:
        return [write_results(engine.search(q, ids_only=a.printIdsOnly, top_k=a.topN), a.out, i, a.printIdsOnly) for i, q in enumerate(queries)]


if __name__ == "__main__":
    main()
