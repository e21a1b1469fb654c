"""The comment APIs: paging as a Spark data source, and their responses as records.

No network code is here. ``fetch`` is any function that takes a request (a dict) and gives the decoded response; it is named as
``module:function``, so that executors can import it. Responses may as well be stored beforehand, one JSON object a line.
"""

import importlib
import json
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from threadloom.operators.etl import flatten_threads, old_api_rows
from threadloom.storage import numbered

Fetch = Callable[[dict], dict]

#: A stored response: which article, the order of pages, the comment that its roots answer, the response itself.
PAGES = "url string, page bigint, parent string, body string"
RECORDS = ("seq", "article_id", "article_url", "comment_id", "comment_author", "comment_text", "timestamp", "parent_comment_id", "upvotes", "downvotes")


def graphql_pages(fetch: Fetch, url: str) -> Iterator[tuple]:
    """(url, page, parent, body) of an article of the newer API: its pages by cursor, and of comments with more replies the further pages of these, under their own parent, to any depth."""
    page = 0
    body = fetch({"url": url})
    asset = body["data"]["asset"]
    todo = [(asset["comments"], None)]
    yield url, page, None, json.dumps(body)
    while todo:
        listing, parent = todo.pop()
        if listing.get("hasNextPage"):
            page += 1
            body = fetch({"asset_id": asset["id"], "cursor": listing["endCursor"], "parent_id": parent})
            yield url, page, parent, json.dumps({"asset_id": asset["id"], **body})
            todo.append((body["data"]["comments"], parent))
        for node in listing["nodes"]:
            if node.get("replies"):
                todo.append((node["replies"], node["id"]))


def rest_pages(fetch: Fetch, url: str) -> Iterator[tuple]:
    """(url, page, parent, body) of an article of the older API: its pages, and the replies of each entry that tells of some."""
    page, todo = 0, [{"childrenof": url}]
    while todo:
        request = todo.pop()
        body = fetch(request)
        yield url, page, None, json.dumps(body)
        page += 1
        if body.get("hasMoreChildren") == "true":
            todo.append({**request, "pageAfter": body["nextPageAfter"]})
        for e in body["entries"]:
            if e["object"].get("accumulators", {}).get("repliesCount") and "pageAfter" in e:
                todo.append({"childrenof": e["object"]["id"], "itemsPerPage": e["object"]["accumulators"]["repliesCount"], "pageAfter": e["pageAfter"]})


class _Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Url(u) for u in json.loads(self.options["urls"])]

    def read(self, partition: _Url) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        yield from {"new": graphql_pages, "old": rest_pages}[self.options["api"]](fetch, partition.url)


class CommentApi(DataSource):
    """spark.read.format("comment_api").option("api", "new" or "old").option("urls", a JSON list).option("fetch", "module:function"): one task an article, a row a response."""

    @classmethod
    def name(cls) -> str:
        return "comment_api"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        for x in ("api", "urls", "fetch"):
            if x not in self.options:
                raise ValueError(f"option {x} is missing")
        return _Reader(dict(self.options))


def fetch_pages(spark: SparkSession, api: str, urls: list[str], fetch: str) -> DataFrame:
    spark.dataSource.register(CommentApi)
    return spark.read.format("comment_api").option("api", api).option("urls", json.dumps(urls)).option("fetch", fetch).load()


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """url: the pages that sitemap files name, once each."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url")).select(F.replace("url", F.lit("&amp;"), F.lit("&")).alias("url")).distinct()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses: objects of url, page, parent and body (a JSON text), one a line."""
    return spark.read.schema(PAGES).json(path)


_LISTING = "nodes: array<string>, hasNextPage: boolean, endCursor: string"
_NEW = f"asset_id string, data struct<asset: struct<id: string, comments: struct<{_LISTING}>>, comments: struct<{_LISTING}>>"
_OLD = (
    "entries array<struct<object: struct<id: string, content: string, published: string, accumulators: struct<likesCount: bigint, repliesCount: bigint>>,"
    " actor: struct<title: string>, targets: array<struct<conversationID: string>>, pageAfter: string>>"
)


def new_records(pages: DataFrame) -> DataFrame:
    """RECORDS (but seq) and path of the newer API's pages, replies of any depth included. Ordering by url and path is that of the crawl."""
    b = F.from_json("body", _NEW)
    rows = pages.select(F.col("url").alias("article_url"), "page", "parent", b.alias("b"))
    nodes = F.coalesce("b.data.asset.comments.nodes", "b.data.comments.nodes")
    roots = rows.select("article_url", F.coalesce("b.data.asset.id", "b.asset_id").alias("article_id"), "parent", "page", F.posexplode(nodes).alias("i", "node"))
    return flatten_threads(roots.select("article_url", "article_id", "parent", "node", F.array("page", F.col("i").cast("bigint")).alias("path")))


def old_records(pages: DataFrame) -> DataFrame:
    """RECORDS (but seq) and path of the older API's pages; an article's id is its URL."""
    rows = pages.select("url", "page", F.posexplode(F.from_json("body", _OLD)["entries"]).alias("i", "e"))
    rows = rows.select(F.col("url").alias("article_url"), F.col("url").alias("article_id"), F.array("page", F.col("i").cast("bigint")).alias("path"), "e.*")
    return old_api_rows(rows, ["article_url", "article_id", "path"])


def crawled(spark: SparkSession, new: str | None, old: str | None) -> DataFrame:
    """RECORDS of stored responses of either API or both; seq follows article and order of the crawl."""
    parts = [make(read_pages(spark, path)).withColumn("api", F.lit(i)) for i, (make, path) in enumerate(((new_records, new), (old_records, old))) if path]
    if not parts:
        raise ValueError("no responses are given")
    both = reduce(DataFrame.unionByName, parts)
    return numbered(both, ["api", "article_url", "path"], "seq").select(*RECORDS)
