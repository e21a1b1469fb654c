"""The inverted index: documents, postings, terms and replies as four DataFrames."""

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import porter, porter2
from threadloom.functions.text import STOPWORDS, by_term, mapped, positioned, simple_tokens, term_starts, treebank_tokens, with_terms, without_comments
from threadloom.storage import clustered

#: Stemmers by name; any function of a word to a word may stand in for one.
STEMMERS: dict[str, Callable[[str], str]] = {"porter": porter.stem, "porter2": porter2.stem}


def lemmatizer(lemmas: dict[str, str]) -> Callable[[str], str]:
    """A stemmer's stand-in: words by a dictionary, others as they are."""
    return lambda word: lemmas.get(word, word)


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms: tokens, stopwords out, stems or lemmas, then the last steps.

    tokens: a Column function; stemmer: a name of STEMMERS, a function of a word, or None; steps: filters on
    array<struct<term, pos>>.
    """

    tokens: Callable[[Column], Column] = simple_tokens
    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    stemmer: str | Callable[[str], str] | None = None
    steps: tuple[Callable[[Column], Column], ...] = (without_comments,)

    def with_stopwords(self, *words: str, append: bool = False) -> "Analyzer":
        return Analyzer(self.tokens, (*self.stopwords, *words) if append else words, self.stemmer, self.steps)

    def with_step(self, step: Callable[[Column], Column]) -> "Analyzer":
        return Analyzer(self.tokens, self.stopwords, self.stemmer, (*self.steps, step))

    def plain(self, text: Column) -> Column:
        return F.filter(self.tokens(text), lambda w: ~w.startswith("//"))

    def stepped(self, placed: Column) -> Column:
        for step in self.steps:
            placed = step(placed)
        return placed

    def placed(self, rows: DataFrame, text: str = "text", name: str = "placed") -> DataFrame:
        """rows with array<struct<term, pos>> of a text. Stages are columns of their own, so each is evaluated once."""
        rows = rows.withColumn(name, positioned(self.tokens(F.col(text)), self.stopwords))
        if self.stemmer:
            rows = rows.withColumn(name, with_terms(F.col(name), mapped(F.col(f"{name}.term"), self.stem)))
        return rows.withColumn(name, self.stepped(F.col(name)))

    def terms_of(self, spark: SparkSession, text: str, plain: bool = False) -> list[str]:
        """A query's terms: the same expressions over a local row, which the optimizer evaluates without a job."""
        row = spark.sql("select * from values (:text) as t(text)", args={"text": text})
        if plain:
            return row.select(self.plain(F.col("text"))).first()[0]
        if self.steps != (without_comments,):
            return [t for t in self.placed(row).select("placed.term").first()[0] if t]
        words = [x["term"] for x in row.select(positioned(self.tokens(F.col("text")), self.stopwords)).first()[0]]
        terms = map(self.stem, words) if self.stemmer else words
        return [t for t in terms if t and not t.startswith("//")]

    @property
    def stem(self) -> Callable[[str], str]:
        return STEMMERS[self.stemmer] if isinstance(self.stemmer, str) else self.stemmer


SIMPLE, TREEBANK = Analyzer(), Analyzer(treebank_tokens, stemmer="porter")
TARGETS = ("docs", "postings", "terms", "replies")

#: Postings of one task, so that it sorts in memory however large the table is.
TASK_ROWS = 1_000_000

#: Documents, and the share of their postings, that the layout of tasks and files is chosen from. All rows are stored, whatever the layout.
LAYOUT_DOCS, LAYOUT_SHARE = 2_000, 0.1


@dataclass(frozen=True)
class Index:
    docs: DataFrame  # cid, text, toks array<string>, doc_len, parent_cid
    postings: DataFrame  # term, cid, tf, positions array<int>
    terms: DataFrame  # term, df, idf
    replies: DataFrame  # parent_cid, child_cid
    analyzer: Analyzer
    n_docs: int
    source: DataFrame | None = None  # cid, text, parent_cid that docs and postings are analysed from; None for stored ones

    def save(self, path: str, targets: Iterable[str] = TARGETS) -> None:
        """Postings and terms are clustered by term, so a term's lookup reads few row groups; replies by parent, docs by cid.

        Nothing is analysed in order to be sampled for ranges, or kept beside the targets: texts are dealt out before they
        are analysed, postings by bounds from some documents, and terms are counted from the stored postings.
        """
        targets = set(targets)
        if wrong := targets - set(TARGETS):
            raise ValueError(f"no such targets: {sorted(wrong)}")
        postings = self.postings
        if "docs" in targets:
            docs = self.docs.repartitionByRange("cid").sortWithinPartitions("cid") if self.source is None else _documents(clustered(self.source, "cid"), self.analyzer)
            docs.write.mode("overwrite").parquet(f"{path}/docs")
        if "postings" in targets:
            rows = postings.repartitionByRange("term", "cid") if self.source is None else postings.repartitionById(*self._ranges())
            rows.sortWithinPartitions("term", "cid").write.mode("overwrite").parquet(f"{path}/postings")
            postings = postings.sparkSession.read.schema(postings.schema).parquet(f"{path}/postings")
        if "terms" in targets:
            _terms(postings, self.n_docs).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        if "replies" in targets:
            self.replies.repartitionByRange("parent_cid").sortWithinPartitions("parent_cid").write.mode("overwrite").parquet(f"{path}/replies")

    def _seen(self) -> tuple[list[tuple[str, int]], float]:
        """(term, cid) of some postings, in order, and how many postings each of them stands for."""
        share = min(1.0, LAYOUT_DOCS / max(1, self.n_docs))
        some = self.source.sample(share, seed=1) if share < 1 else self.source
        got = postings_of(some, self.analyzer).select("term", "cid").sample(LAYOUT_SHARE, seed=1).collect()  # some tens of thousands
        return sorted((r["term"], r["cid"]) for r in got), 1 / share / LAYOUT_SHARE

    def tasks(self) -> int:
        """How many tasks the postings should be dealt out to."""
        seen, each = self._seen()
        return _tasks(self.docs.sparkSession, len(seen) * each)

    def _ranges(self) -> tuple[int, Column]:
        """A number of ranges of (term, cid), and the range of a row. A common term has several."""
        seen, each = self._seen()
        n = _tasks(self.docs.sparkSession, len(seen) * each)
        bounds = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []
        return len(bounds) + 1, _place(bounds, 0, len(bounds))

    @staticmethod
    def load(spark: SparkSession, path: str, analyzer: Analyzer = SIMPLE) -> "Index":
        docs, postings, terms, replies = (spark.read.parquet(f"{path}/{x}") for x in TARGETS)
        return Index(docs, postings, terms, replies, analyzer, docs.count())

    # Readers. Point lookups reach Parquet as pushed filters.

    def retrieve(self, term: str) -> DataFrame:
        """cid, tf, positions of a term, with its idf; no rows for an unknown term."""
        return self.postings.where(F.col("term") == term).join(F.broadcast(self.terms.where(F.col("term") == term).select("term", "idf")), "term").select("cid", "tf", "positions", "idf")

    def posting_list(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term).select("cid", "tf", "positions")

    def replied_to(self, cid: int) -> DataFrame:
        return self.replies.where(F.col("parent_cid") == cid).select(F.col("child_cid").alias("cid"))

    def tf(self, term: str, cid: int) -> float:
        p = self.postings.where((F.col("term") == term) & (F.col("cid") == cid)).first()
        return p["tf"] if p else 0.0

    def idf(self, term: str) -> float:
        t = self.terms.where(F.col("term") == term).first()
        return t["idf"] if t else 0.0

    def tf_idf(self, term: str, cid: int) -> tuple[float, float]:
        """(tf, idf); (0, 0) for an unknown term, (0, idf) where the document hasn't it."""
        return self.tf(term, cid), self.idf(term)

    def term_list(self) -> DataFrame:
        return self.terms.select("term")

    def parent_cids(self) -> DataFrame:
        return self.replies.select("parent_cid").distinct()

    def n_terms(self) -> int:
        return self.terms.count()

    def cids(self) -> DataFrame:
        return self.docs.select("cid")

    def documents(self, cids: list[int]) -> DataFrame:
        """Texts by comment id."""
        return self.docs.where(F.col("cid").isin(*cids)).select("cid", "text")

    def keep(self) -> "Index":
        """Holds terms and replies in the executors' memory for many lookups; close() lets go."""
        return replace(self, terms=self.terms.persist(), replies=self.replies.persist())

    def close(self) -> None:
        for x in (self.docs, self.postings, self.terms, self.replies):
            x.unpersist()

    def __enter__(self) -> "Index":
        return self

    def __exit__(self, *error) -> None:
        self.close()


def _tasks(spark: SparkSession, rows: float) -> int:
    """Tasks for so many rows: TASK_ROWS each at most, and all cores if there is enough to do."""
    return max(math.ceil(rows / TASK_ROWS), min(spark.sparkContext.defaultParallelism, int(rows) // 50_000), 1)


def _place(bounds: list[tuple[str, int]], low: int, high: int) -> Column:
    """How many of the ordered bounds aren't above a row's (term, cid), as a tree of comparisons; low and high are known to hold."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    term, cid = bounds[mid]
    below = (F.col("term") < term) | ((F.col("term") == term) & (F.col("cid") < cid))
    return F.when(below, _place(bounds, low, mid)).otherwise(_place(bounds, mid + 1, high))


def _terms(postings: DataFrame, n_docs: int) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.lit(float(n_docs)) / F.col("df"))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores at least: a file of one row group would be read, and so analysed, by one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def analysed(docs: DataFrame, analyzer: Analyzer = SIMPLE) -> DataFrame:
    """docs (cid, text and others) with doc_len, the number of terms after the analyzer's steps, and entries array<struct<term, positions>>.

    All of a document's terms are grouped on its row: sorted, then cut where the term changes. So nothing is shuffled
    before the postings are dealt out by term.
    """
    rows = analyzer.placed(spread(docs)).withColumn("doc_len", F.size("placed"))
    rows = rows.withColumn("placed", F.sort_array(F.filter("placed", lambda x: x["term"] != ""))).withColumn("starts", term_starts(F.col("placed")))
    return rows.withColumn("entries", by_term(F.col("placed"), F.col("starts"))).drop("placed", "starts")


def _flat(rows: DataFrame) -> DataFrame:
    """Postings of analysed rows. explode_outer, as for explode Spark would evaluate the analysis once more, to filter by it."""
    one = rows.select("cid", "doc_len", F.explode_outer("entries").alias("x")).where("x is not null")
    return one.select("x.term", "cid", (F.size("x.positions") / F.col("doc_len")).alias("tf"), "x.positions")


def postings_of(docs: DataFrame, analyzer: Analyzer = SIMPLE) -> DataFrame:
    """docs (cid, text) -> term, cid, tf, positions. The document's length counts its tokens after stopwords, before empty terms are dropped."""
    return _flat(analysed(docs.select("cid", "text"), analyzer))


def replies_of(docs: DataFrame) -> DataFrame:
    """Children by parent. Parents that are null, 0 or the comment itself don't count."""
    return docs.where("parent_cid is not null and parent_cid <> 0 and parent_cid <> cid").select("parent_cid", F.col("cid").alias("child_cid"))


def _documents(rows: DataFrame, analyzer: Analyzer) -> DataFrame:
    """rows (cid, text, parent_cid) with toks and doc_len."""
    docs = analyzer.placed(rows).withColumn("doc_len", F.size("placed")).withColumn("toks", analyzer.plain(F.col("text")))
    return docs.select("cid", "text", "toks", "doc_len", "parent_cid")


def build(docs: DataFrame, analyzer: Analyzer = SIMPLE) -> Index:
    """docs: cid, text and, if there are threads, parent_cid."""
    if "parent_cid" not in docs.columns:
        docs = docs.withColumn("parent_cid", F.lit(None).cast("bigint"))
    source = docs.select("cid", "text", "parent_cid")
    postings, n = postings_of(source, analyzer), docs.count()
    return Index(_documents(spread(source), analyzer), postings, _terms(postings, n), replies_of(source), analyzer, n, source)


#: Comment ids of one block of a posting list.
GAP_BLOCK = 1 << 16


def _blocked(postings: DataFrame, tasks: int | None) -> DataFrame:
    """term, cid, block of postings, dealt out by term and block: a common term's list goes to many tasks, each of which sorts its rows in memory if tasks (``Index.tasks``) is given."""
    rows = postings.select("term", "cid", F.floor(F.col("cid") / GAP_BLOCK).alias("block"))
    return rows.repartition(*([tasks] if tasks else []), "term", "block")


def gaps(postings: DataFrame, tasks: int | None = None) -> DataFrame:
    """term, cid, gap: comment ids as differences along each posting list. The first id of a block follows the last one of the block before; the others, their neighbour."""
    rows = _blocked(postings, tasks)
    inside = rows.withColumn("prev", F.lag("cid").over(Window.partitionBy("term", "block").orderBy("cid"))).where("prev is not null")
    ends = rows.groupBy("term", "block").agg(F.min("cid").alias("cid"), F.max("cid").alias("last"))
    firsts = ends.withColumn("prev", F.coalesce(F.lag("last").over(Window.partitionBy("term").orderBy("block")), F.lit(0)))
    return inside.select("term", "cid", "prev").union(firsts.select("term", "cid", "prev")).select("term", "cid", (F.col("cid") - F.col("prev")).alias("gap"))


def gap_blocks(postings: DataFrame, tasks: int | None = None) -> DataFrame:
    """term, block, first, gaps array<bigint>: the packed form of ids, in blocks of bounded size."""
    rows = _blocked(postings, tasks).groupBy("term", "block").agg(F.array_sort(F.collect_list("cid")).alias("c"))
    return rows.select("term", "block", F.get("c", 0).alias("first"), F.transform("c", lambda x, i: x - F.coalesce(F.get("c", i - 1), x)).alias("gaps"))


def from_gap_blocks(blocks: DataFrame) -> DataFrame:
    """term, cid from gap_blocks(): running sums within each block."""
    each = blocks.select("term", "block", "first", F.posexplode("gaps").alias("i", "gap"))
    return each.select("term", (F.col("first") + F.sum("gap").over(Window.partitionBy("term", "block").orderBy("i"))).alias("cid"))


def posting_lines(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """term, block, line: the older text form ``idf;cid|tf|p,p;...``, a line for each block of ids of a term."""
    one = F.concat_ws("|", F.col("cid").cast("string"), F.col("tf").cast("string"), F.array_join(F.col("positions").cast("array<string>"), ","))
    rows = postings.select("term", "cid", F.floor(F.col("cid") / GAP_BLOCK).alias("block"), one.alias("one"))
    lists = rows.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("cid", "one"))).alias("m")).join(terms.select("term", "idf"), "term")
    return lists.select("term", "block", F.concat_ws(";", F.col("idf").cast("string"), F.array_join("m.one", ";")).alias("line"))


def from_posting_lines(lines: DataFrame) -> DataFrame:
    """term, cid, tf, positions, idf of posting_lines()."""
    parts = lines.select("term", F.split("line", ";").alias("p")).select("term", F.get("p", 0).cast("double").alias("idf"), F.explode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("x"))
    f = F.split("x", r"\|")
    return parts.select("term", F.get(f, 0).cast("bigint").alias("cid"), F.get(f, 1).cast("double").alias("tf"), F.split(F.get(f, 2), ",").cast("array<int>").alias("positions"), "idf")
