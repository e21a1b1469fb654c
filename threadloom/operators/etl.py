"""From raw records to comments: de-duplication, surrogate ids, parents, flattened threads, vectors."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import html_strip, url_basename
from threadloom.storage import cut, numbered


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in (*order, *rest))).select(*df.columns)


def duplicate_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def appearance_ids(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """key -> dense id by first appearance, from 0. Distinct keys are numbered by ranges of their first appearance, in many tasks."""
    first = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.min(F.struct(*order)).alias("at"))
    return numbered(first, ["at"], name).select(key, name)


def run_ids(df: DataFrame, value: str, order: list[str], block: Column, name: str) -> DataFrame:
    """df with an id that goes up by one wherever value differs from the row before, from 0.

    block: an expression that doesn't fall along the order (an hour of a timestamp, say). Runs are counted within
    blocks in parallel; what crosses blocks goes through one row a block.
    """
    w = Window.partitionBy("__b").orderBy(*order)
    rows = df.withColumn("__b", block).withColumn("__last", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w))
    rows = rows.withColumn("__new", ((F.col("__n") > 1) & ~F.col(value).eqNullSafe(F.col("__last"))).cast("bigint"))
    blocks = rows.groupBy("__b").agg(F.sum("__new").alias("c"), F.min_by(value, "__n").alias("head"), F.max_by(value, "__n").alias("tail"))
    bw = Window.orderBy("__b")
    blocks = blocks.withColumn("opens", (F.lag("__b").over(bw).isNotNull() & ~F.col("head").eqNullSafe(F.lag("tail").over(bw))).cast("bigint"))
    upto = F.sum("opens").over(bw) + F.coalesce(F.sum("c").over(bw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("__b", upto.alias("__base"))
    within = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__w", within).join(blocks, "__b").withColumn(name, (F.col("__base") + F.col("__w")).cast("bigint")).drop("__b", "__last", "__n", "__new", "__w", "__base")


def comment_ids(df: DataFrame, run: str, orig: str, order: list[str], name: str) -> DataFrame:
    """run, orig -> dense id over all runs by first appearance within each; ids known in one run are new in the next. Empty ids get none."""
    first = df.where(F.col(orig).isNotNull() & (F.col(orig) != "")).groupBy(run, orig).agg(F.min(F.struct(*order)).alias("at"))
    return numbered(first, [run, "at"], name).select(run, orig, name)


def resolved_parents(comments: DataFrame) -> DataFrame:
    """comments (run, seq, orig_id, orig_parent) whose parents are known: those with no parent, or whose parent stands earlier in their run and is kept itself.

    Works from the roots down until a level is empty: a level's rows, which are written to the shared folder, are joined with all replies.
    So the number of jobs, and of times that replies are read, is the depth of the deepest thread.
    """
    level = kept = comments.where("orig_parent is null or orig_parent = ''").withColumn("depth", F.lit(0))
    rest = comments.where("orig_parent is not null and orig_parent <> ''")
    depth = 0
    while True:
        depth += 1
        up = level.select("run", F.col("orig_id").alias("orig_parent"), F.col("seq").alias("above"))
        level = rest.join(up, ["run", "orig_parent"]).where("above < seq").groupBy(*comments.columns).agg(F.lit(depth).alias("depth"))
        level = cut(level)
        if level.isEmpty():
            return kept
        kept = kept.unionByName(level)


def vote_count(actions: Column, kind: str = "LikeActionSummary") -> Column:
    """The count of the last action of a kind, else 0."""
    found = F.filter(actions, lambda a: a["__typename"] == kind)
    return F.coalesce(F.try_element_at(found, F.lit(-1))["count"], F.lit(0))


#: What is read of a comment of the newer API; replies stay JSON, so they may nest to any depth.
NODE = "id string, body string, created_at string, user struct<username: string>, action_summaries array<struct<__typename: string, count: bigint>>, replies struct<nodes: array<string>>"


def flatten_threads(nodes: DataFrame) -> DataFrame:
    """Nested comments to rows, to any depth: what nodes has besides, path, comment_id, comment_author, comment_text, timestamp, parent_comment_id, upvotes, downvotes.

    nodes: one row a root, node (its JSON), path (array<bigint>, where the root stands) and parent (of the root; null for none). Ordering by path is pre-order. A comment without replies is a
    leaf. Levels are written one by one until one is empty.
    """
    rest = [c for c in nodes.columns if c not in ("node", "path", "parent")]
    level, out, n = nodes.select(*rest, "node", "path", "parent"), None, F.col("n")
    while True:
        level = cut(level.withColumn("n", F.from_json("node", NODE)).drop("node"))
        if out is not None and level.isEmpty():
            return out
        row = level.select(*rest, "path", n["id"].alias("comment_id"), n["user"]["username"].alias("comment_author"), n["body"].alias("comment_text"), n["created_at"].alias("timestamp"), F.col("parent").alias("parent_comment_id"), vote_count(n["action_summaries"]).cast("bigint").alias("upvotes"), F.lit(0).cast("bigint").alias("downvotes"))
        out = row if out is None else out.unionByName(row)
        level = level.select(*rest, "path", n["id"].alias("parent"), F.posexplode(n["replies"]["nodes"]).alias("i", "node")).select(*rest, "node", F.concat("path", F.array(F.col("i").cast("bigint"))).alias("path"), "parent")


def count_threads(nodes: DataFrame, by: list[str]) -> DataFrame:
    """How many comments, replies of any depth included, stand under each value of ``by``."""
    return flatten_threads(nodes).groupBy(*by).agg(F.count("*").alias("comments"))


def old_api_rows(entries: DataFrame, rest: Sequence[str] = ()) -> DataFrame:
    """Activities of the older API to comment rows, beside columns ``rest`` of theirs. A parent that is the comment itself, or none, is null."""
    target = F.try_element_at(F.filter("targets", lambda t: t["conversationID"].isNotNull()), F.lit(1))["conversationID"]
    cid = url_basename(F.col("object.id"))
    return entries.select(*rest, cid.alias("comment_id"), F.col("actor.title").alias("comment_author"), F.col("object.content").alias("comment_text"), F.col("object.published").alias("timestamp"), F.nullif(url_basename(target), cid).alias("parent_comment_id"), F.coalesce(F.col("object.accumulators.likesCount"), F.lit(0)).cast("bigint").alias("upvotes"), F.lit(0).cast("bigint").alias("downvotes"))


def comment_tables(records: DataFrame) -> dict[str, DataFrame]:
    """What the comment files hold: comments, comment ids, articles and authors, with their numbers, from crawled records.

    records: seq (their order), article_id, article_url, comment_id, comment_author, comment_text, timestamp, parent_comment_id,
    upvotes, downvotes. An article gets a new number wherever it differs from the record before; authors are numbered by first
    appearance, also those whose comment is left out; comments whose parent isn't known earlier in their article are left out,
    and so are theirs; comment ids are numbered over the rest, anew in each article.
    """
    runs = cut(run_ids(records, "article_id", ["seq"], F.floor(F.col("seq") / 100_000), "run"))
    authors = cut(appearance_ids(runs, "comment_author", ["seq"], "author_id"))
    known = resolved_parents(runs.select("run", "seq", F.col("comment_id").alias("orig_id"), F.col("parent_comment_id").alias("orig_parent")))
    kept = runs.join(known.select("run", "seq"), ["run", "seq"], "left_semi")
    ids = cut(comment_ids(kept, "run", "comment_id", ["seq"], "cid"))
    parents = ids.select("run", F.col("comment_id").alias("parent_comment_id"), F.col("cid").alias("parent"))
    comments = kept.join(ids, ["run", "comment_id"], "left").join(parents, ["run", "parent_comment_id"], "left").join(authors, "comment_author", "left")
    comments = comments.select("seq", "cid", F.col("run").alias("article_id"), "author_id", F.col("comment_text").alias("text"), F.col("timestamp").alias("time"), "parent", "upvotes", "downvotes")
    articles = runs.groupBy("run").agg(F.min_by("article_url", "seq").alias("article_url")).select(F.col("run").alias("article_id"), "article_url")
    return {"comments": comments, "comment_ids": ids.select("cid", F.col("comment_id").alias("orig_comment_id")), "articles": articles, "authors": authors.select("author_id", F.col("comment_author").alias("author"))}


def cleaned(records: DataFrame) -> DataFrame:
    """Crawled records (seq, comment_id, comment_text and others) as the crawl leaves them: the first of each comment id, without HTML."""
    return first_of_each(records, "comment_id", ["seq"]).withColumn("comment_text", html_strip(F.col("comment_text")))


def without_nul(df: DataFrame, column: str) -> DataFrame:
    return df.where(~F.contains(F.col(column), F.lit("\x00")))


def cosine_to(df: DataFrame, column: str, query: list[float]) -> Column:
    x = F.transform(column, lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(x, F.array(*map(F.lit, query)), lambda a, b: a * b))
    return F.try_divide(dot, F.sqrt(total(F.transform(x, lambda v: v * v))) * sum(v * v for v in query) ** 0.5)


def euclid_to(df: DataFrame, column: str, query: list[float]) -> Column:
    x = F.transform(column, lambda v: v.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(x, F.array(*map(F.lit, query)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
