"""Queries compiled to DataFrame plans over an Index."""

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import contains_sequence
from threadloom.operators.index import SIMPLE, Analyzer, Index
from threadloom.plans.query import Query, QueryError, parse, reply_target


class SearchEngine:
    """search() gives a lazy DataFrame of comment ids; ranked kinds also have score and, with top_k, rank.

    strict_sets: boolean operands that match nothing count as empty sets; by default they are left out.
    """

    def __init__(self, index: Index, strict_sets: bool = False):
        self.index, self.strict = index, strict_sets
        self.spark: SparkSession = index.docs.sparkSession

    @staticmethod
    def open(spark: SparkSession, path: str, analyzer: Analyzer = SIMPLE, strict_sets: bool = False) -> "SearchEngine":
        """An engine over a saved index; close() gives back what it holds in memory."""
        return SearchEngine(Index.load(spark, path, analyzer).keep(), strict_sets)

    def close(self) -> None:
        self.index.close()

    def __enter__(self) -> "SearchEngine":
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def search(self, query: str, ids_only: bool = True, top_k: int | None = 10, keep: Column | DataFrame | None = None) -> DataFrame:
        """top_k: None or 0 for all; only keyword and prefix queries take it. keep: a condition on cid that ranked documents must meet, or a table of their cid."""
        _checked(top_k)
        q = parse(query)
        if q.kind == "keyword":
            hits = self.keyword(self.index.analyzer.terms_of(self.spark, q.text), top_k, keep)
        elif q.kind == "prefix":
            hits = self.prefix(q.text.replace("*", ""), top_k, keep)
        elif q.kind == "phrase":
            hits = self.phrase(q.text)
        elif q.kind == "reply":
            hits = self.reply(q.text)
        elif q.kind == "boolean":
            hits = self.boolean(q)
        else:
            hits = self._none()
        return hits if ids_only else self.with_text(hits)

    def search_many(self, queries: list[str], top_k: int | None = 10) -> DataFrame:
        """query_id, cid of all queries, in one plan. Keyword, prefix and reply queries are rows of tables: one join on term, whatever their number."""
        _checked(top_k)
        of: dict[str, list[tuple[int, str]]] = {}
        for i, text in enumerate(queries):
            q = parse(text)
            if q.kind == "reply":
                target = reply_target(q.text)
                of.setdefault("reply", []).extend([] if target is None else [(i, target)])
            else:
                of.setdefault(q.kind, []).append((i, q.text.replace("*", "") if q.kind == "prefix" else text))
        parts = []
        if of.get("keyword"):
            rows = self.index.analyzer.placed(self.spark.createDataFrame(of["keyword"], "query_id int, text string"))
            words = rows.select("query_id", F.posexplode_outer("placed.term").alias("ord", "term")).where("term <> ''")
            bags = words.groupBy("query_id", "term").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
            parts.append(self._ranked_many(bags.join(self.index.terms.select("term", "idf"), "term"), top_k))
        if of.get("prefix"):
            rows = F.broadcast(self.spark.createDataFrame(of["prefix"], "query_id int, prefix string"))
            found = self.index.terms.select("term", "idf").join(rows, F.col("term").startswith(F.col("prefix")))
            parts.append(self._ranked_many(found.select("query_id", "term", F.lit(1).alias("n"), F.col("term").alias("ord"), "idf"), top_k))
        if of.get("reply"):
            rows = F.broadcast(self.spark.createDataFrame(of["reply"], "query_id int, parent_cid bigint"))
            parts.append(self.index.replies.join(rows, "parent_cid").select("query_id", F.col("child_cid").alias("cid")))
        for i, text in [*of.get("phrase", []), *of.get("boolean", [])]:
            parts.append(self.search(text, top_k=top_k).select(F.lit(i).alias("query_id"), "cid"))
        return reduce(DataFrame.unionByName, parts) if parts else self._none().select(F.lit(0).alias("query_id"), "cid")

    def with_text(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.index.docs.select("cid", "text"), "cid")

    def _none(self) -> DataFrame:
        return self.index.docs.select("cid").where(F.lit(False))

    def _ranked(self, weights: DataFrame, norm: Column, top_k: int | None, keep: Column | DataFrame | None = None) -> DataFrame:
        """weights: cid, wd, wq, ord of each matching query term. Score: cosine over the query's terms."""
        if keep is not None:
            weights = weights.join(keep.select("cid"), "cid", "left_semi") if isinstance(keep, DataFrame) else weights.where(keep)
        sums = weights.groupBy("cid").agg(F.sum(F.col("wd") * F.col("wq")).alias("dot"), F.sqrt(F.sum(F.col("wd") * F.col("wd"))).alias("nd"), F.min("ord").alias("first"))
        hits = sums.select("cid", (F.col("dot") / (F.col("nd") * norm)).alias("score"), "first")
        order = [F.desc(F.round("score", 12)), F.asc("first"), F.asc("cid")]
        if not top_k:
            return hits.orderBy(*order).select("cid", "score")
        top = hits.orderBy(*order).limit(top_k)
        return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "score", "cid")

    def _ranked_many(self, bags: DataFrame, top_k: int | None) -> DataFrame:
        """bags: query_id, term, n, ord, idf of the queries' known terms. A query's weights: n by its number of terms, which every one of its scores has in common."""
        q = bags.select("query_id", "term", "ord", "idf", (F.col("n") * F.col("idf")).alias("wq"))
        got = self.index.postings.select("term", "cid", "tf").join(q, "term").withColumn("wd", F.col("tf") * F.col("idf"))
        sums = got.groupBy("query_id", "cid").agg(F.sum(F.col("wd") * F.col("wq")).alias("dot"), F.sqrt(F.sum(F.col("wd") * F.col("wd"))).alias("nd"), F.min("ord").alias("first"))
        if not top_k:
            return sums.select("query_id", "cid")
        norms = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("norm"))
        scored = sums.join(F.broadcast(norms), "query_id").withColumn("score", F.round(F.col("dot") / (F.col("nd") * F.col("norm")), 12))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "cid"))
        return scored.withColumn("rank", place).where(F.col("rank") <= top_k).select("query_id", "cid")

    def keyword(self, terms: list[str], top_k: int | None, keep: Column | DataFrame | None = None) -> DataFrame:
        if not terms:
            return self._none()
        bag = Counter(terms)
        known = {r["term"]: r["idf"] for r in self.index.terms.where(F.col("term").isin(*bag)).collect()}  # a query's terms only
        if not known:
            return self._none()
        weight = {t: bag[t] / len(terms) * idf for t, idf in known.items()}
        table = [(t, known[t], weight[t], i) for i, t in enumerate(bag) if t in known]
        q = self.spark.createDataFrame(table, "term string, idf double, wq double, ord int")
        got = self.index.postings.where(F.col("term").isin(*known)).join(F.broadcast(q), "term")
        norm = sum(w * w for w in weight.values()) ** 0.5
        return self._ranked(got.select("cid", (F.col("tf") * F.col("idf")).alias("wd"), "wq", "ord"), F.lit(norm), top_k, keep)

    def prefix(self, prefix: str, top_k: int | None, keep: Column | DataFrame | None = None) -> DataFrame:
        """Terms that begin with the prefix as it is written; each counts once, in order of term."""
        terms = self.index.terms.where(F.col("term").startswith(prefix)).select("term", "idf")
        n = terms.agg(F.count("*").alias("n")).scalar()
        norm = terms.agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("s")).scalar() / n
        got = self.index.postings.where(F.col("term").startswith(prefix)).join(terms, "term")
        return self._ranked(got.select("cid", (F.col("tf") * F.col("idf")).alias("wd"), (F.col("idf") / n).alias("wq"), F.col("term").alias("ord")), norm, top_k, keep)

    def prefix_ids(self, prefix: str) -> DataFrame:
        return self.index.postings.where(F.col("term").startswith(prefix)).select("cid").distinct()

    def term_ids(self, term: str) -> DataFrame:
        return self.index.postings.where(F.col("term") == term).select("cid").distinct()

    def phrase(self, text: str) -> DataFrame:
        """Documents where the phrase's tokens stand in a row, and its terms (without stopwords) at consecutive positions.

        A cid that stands on several rows brings all their positions together; the tokens then decide row by row.
        """
        words = text.strip().strip("'")
        terms, plain = self.index.analyzer.terms_of(self.spark, words), self.index.analyzer.terms_of(self.spark, words, plain=True)
        if not terms:
            return self._none()
        got = self.index.postings.where(F.col("term").isin(*terms)).groupBy("cid").agg(F.collect_list(F.struct("term", "positions")).alias("m"))  # entries of the phrase's terms only
        at = lambda t: F.flatten(F.transform(F.filter("m", lambda x: x["term"] == t), lambda x: x["positions"]))
        has = lambda t: F.exists("m", lambda x: x["term"] == t)
        held = reduce(Column.__and__, map(has, sorted(set(terms))))
        near = [F.arrays_overlap(F.transform(at(a), lambda p: p + 1), at(b)) for a, b in zip(terms, terms[1:])]
        got = got.where(held).where(reduce(Column.__and__, near, F.lit(True))).select("cid")
        docs = self.index.docs.select("cid", "toks").join(got, "cid", "left_semi")
        return docs.where(contains_sequence(F.col("toks"), F.array(*[F.lit(w) for w in plain]))).select("cid").distinct()

    def reply(self, text: str) -> DataFrame:
        target = reply_target(text)
        return self._none() if target is None else self.index.replied_to(target)

    def boolean(self, q: Query) -> DataFrame:
        """One grouping over all operands' ids, tagged with the operand; those without any ids are left out, unless strict."""
        sets = []
        for x in q.operands:
            if "*" in x:
                sets.append(self.prefix_ids(x.replace("*", "")))
            elif x.startswith("ReplyTo:"):
                sets.append(self.reply(x))
            elif x.startswith("'"):
                sets.append(self.phrase(x))
            else:
                terms = self.index.analyzer.terms_of(self.spark, x)
                if len(terms) != 1:
                    return self._none()
                sets.append(self.term_ids(terms[0]))
        return combine(q.operator, sets, self.strict)


def _checked(top_k: int | None) -> None:
    if top_k is not None and top_k < 0:
        raise QueryError("top_k is negative")


def combine(operator: str, sets: list[DataFrame], strict: bool = False) -> DataFrame:
    """AND, OR, or NOT (first without the others) of sets of cid."""
    tagged = reduce(DataFrame.union, (s.select("cid", F.lit(i).alias("i")) for i, s in enumerate(sets)))
    every = F.array(*map(F.lit, range(len(sets))))
    live = every if strict else tagged.agg(F.array_sort(F.collect_set("i")).alias("live")).scalar()
    by = tagged.groupBy("cid").agg(F.array_sort(F.collect_set("i")).alias("s"))
    keep = {"AND": F.col("s") == live, "OR": F.lit(True), "NOT": F.col("s") == F.array(F.element_at(live, 1))}[operator]
    return by.where(keep).select("cid")
