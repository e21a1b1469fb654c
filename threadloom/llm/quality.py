"""Quality rules: statistics of every text, base rules, and isolation forests over the statistics.

One forest looks at symbols, one at word lengths, one at repetition. Nodes split a random feature at a random point of its range, and rows that are
isolated after few splits are anomalous. Every labelled row that passes the base rules has a part: by the hash of its doc_id, half of them grow the
forests, the others calibrate them. Each growing row is dealt to one of ``TREES`` trees at least, to more where a tree would have
fewer than ``LEAF_ROWS`` rows; more labels make larger shares, no row is left out. Each forest's threshold comes from all rows of the other half: the
lowest score at which at most ``LOSS`` of the good rows, and at most one good row for every ``GAIN`` bad ones, would go. A forest that has no such threshold,
and any forest without labels of both kinds, rejects nothing.

Trees are grown on executors, each from its own share, and have at most log2 ``LEAF_ROWS`` splits on a path, so that the model stays small; scores are
compared there too. The driver holds trees, counts, and of good rows the ``LOSS`` with the highest scores. Shares go by hashes, so reruns agree.

Defined cases: a null or empty text has no words and fails the base rules; long texts are read whole; repeated rows each get their result; a
row with a null doc_id is scored like any other; labels with null quality or for unknown documents are not used; of
several labels for one document the lowest counts; an empty table gives no rows. Columns of any names may stand beside doc_id and text; the stage returns them as they are.
"""

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import cut, give_back, small_side

TREES, LEAF_ROWS, SEED = 100, 256, 11
LOSS, GAIN = 0.0005, 20.0
LEAST_WORDS, REPEAT_PERCENT = 10, 20

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_DROP_SPACE = {c: None for c in (9, 10, 11, 12, 13, 32)}
_SYMBOLS = "#*$%&|<>"


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one text. n_lines: its lines that hold a word."""
    if not text:
        return (0,) * len(STATS)
    words = text.encode().split()
    n = len(words)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip("\t\n\x0b\x0c\r "):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n >= 6:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            once: dict[tuple, int] = {}
            covered = bytearray(n)
            for i, w in enumerate(windows):
                first = once.setdefault(w, i)
                if first != i:
                    covered[i : i + 5] = b"\1\1\1\1\1"
                    covered[first : first + 5] = b"\1\1\1\1\1"
            repeat = sum(covered)
    chars = len(text) - sum(map(text.count, "\t\n\x0b\x0c\r "))
    return n, chars, sum(map(text.count, _SYMBOLS)), dup, repeat, lines


def stats(text: Column) -> Column:
    """A struct of STATS."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            rows = np.array([text_stats(t.as_py()) for t in a], np.int64).reshape(-1, len(STATS))
            yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATS))], list(STATS))

    return F.arrow_udf(run, ", ".join(f"{s} bigint" for s in STATS))(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def features(s: np.ndarray) -> dict[str, np.ndarray]:
    """For each forest, its features of rows of STATS."""
    n, chars, symbols, dup, repeat, lines = s.astype(float).T
    words, c = np.maximum(n, 1), np.maximum(chars, 1)
    return {"symbols": (symbols / c)[:, None], "word length": np.log1p(chars / words)[:, None], "repetition": np.stack([dup / np.maximum(lines, 1), repeat / words], 1)}


def _mean_path(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def tree(x: np.ndarray, rng: np.random.Generator) -> tuple:
    """Number of rows, depth, and arrays: feature (-1: a leaf), cut, left child (the right one is next), and the path length of a leaf.
    The order of rows has no effect."""
    most = max(1, int(np.ceil(np.log2(max(2, min(LEAF_ROWS, len(x)))))))
    feature, at, left, path = [-1], [0.0], [0], [0.0]
    todo = [(0, x, 0)]
    while todo:
        node, rows, depth = todo.pop()
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
        if depth >= most or len(rows) < 2 or not len(spread):
            path[node] = depth + _mean_path(len(rows))
            continue
        f = int(rng.choice(spread))
        c = rng.uniform(rows[:, f].min(), rows[:, f].max())
        feature[node], at[node], left[node] = f, c, len(feature)
        for _ in range(2):
            feature.append(-1), at.append(0.0), left.append(0), path.append(0.0)
        low = rows[:, f] <= c
        todo += [(left[node], rows[low], depth + 1), (left[node] + 1, rows[~low], depth + 1)]
    return len(x), most, np.array(feature), np.array(at), np.array(left), np.array(path)


def trees(rows: np.ndarray, k: int) -> list[tuple]:
    """Tree k of each forest, on its share of rows of STATS."""
    return [tree(x, np.random.default_rng([SEED, i, k])) for i, x in enumerate(features(rows).values())]


def shares(n: int) -> int:
    """To how many trees each of n rows is dealt, so that a tree has about LEAF_ROWS rows at least, or all there are."""
    return min(TREES, max(1, -(-TREES * LEAF_ROWS // max(n, 1))))


class Forest:
    def __init__(self, grown: list[tuple]):
        self.trees = grown
        self.rows = sum(t[0] for t in grown)
        self.unit = max(float(np.mean([_mean_path(t[0]) for t in grown])), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the paths, the higher."""
        total = np.zeros(len(x))
        for _, depth, feature, at, left, path in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, left[node] + (x[np.arange(len(x)), np.maximum(f, 0)] > at[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / self.unit)


def lost(good: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """How many of the ascending scores of good rows are as high as each of scores, or higher."""
    return len(good) - np.searchsorted(good, scores)


def threshold(n_good: int, levels: Iterable[tuple[int, int, float]]) -> float:
    """The lowest score t such that rejecting scores >= t keeps to LOSS and GAIN; infinity if there is none.

    levels: for each number of good rows that go with a bad row, how many bad rows it holds for, and the lowest score of these.
    """
    best, got = np.inf, 0
    for gone, bad, lowest in sorted(levels):
        got += bad
        if n_good and gone <= LOSS * n_good and gone * GAIN <= got:
            best = lowest
    return float(best)


class Verdict:
    """Fitted forests with their thresholds."""

    def __init__(self, rows: np.ndarray, quality: np.ndarray):
        """From arrays; ``fit`` does the same with tables."""
        self.forests: list[tuple[str, Forest, float]] = []
        fails = (rows[:, 0] < LEAST_WORDS) | (100 * rows[:, 4] > REPEAT_PERCENT * rows[:, 0]) if len(rows) else np.zeros(0, bool)
        rows, quality = rows[~fails], quality[~fails]
        if len(set(quality.tolist())) < 2:
            return
        rng = np.random.default_rng(SEED)
        grown, rest = np.array_split(rng.permutation(len(rows)), 2)
        first = rng.integers(0, TREES, len(grown))
        shared = [trees(rows[grown[(k - first) % TREES < shares(len(grown))]], k) for k in range(TREES)]
        for (name, x), own in zip(features(rows[rest]).items(), zip(*shared)):
            forest = Forest(list(own))
            s, good = forest.score(x), quality[rest] == 1
            gone, bad = lost(np.sort(s[good]), s[~good]), s[~good]
            self.forests.append((name, forest, threshold(int(good.sum()), [(g, int((gone == g).sum()), bad[gone == g].min()) for g in np.unique(gone)])))

    @classmethod
    def of(cls, forests: list[tuple[str, Forest, float]]) -> "Verdict":
        out = cls(np.zeros((0, len(STATS)), np.int64), np.zeros(0, np.int64))
        out.forests = forests
        return out

    def reject(self, rows: np.ndarray) -> np.ndarray:
        out, x = np.zeros(len(rows), bool), features(rows)
        for name, forest, t in self.forests:
            if np.isfinite(t):
                out |= forest.score(x[name]) >= t
        return out


def labelled(labels: DataFrame) -> DataFrame:
    """The labels that are used, one for a document."""
    return labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def grown(rows: DataFrame, n: int) -> list[Forest]:
    """The forests on all n rows: STATS and the first of the trees that a row is dealt to."""

    def run(share: pa.Table) -> pa.Table:
        k = share["tree"][0].as_py()
        own = trees(np.stack([share[s].to_numpy() for s in STATS], 1), k)
        return pa.table({"tree": pa.array([k], pa.int32()), "own": pa.array([pickle.dumps(own)], pa.binary())})

    each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(shares(n) - 1))).alias("more"), "*")
    dealt = each.select(F.pmod(F.col("first") + F.col("more"), F.lit(TREES)).cast("int").alias("tree"), *STATS).repartition(TREES // 2, "tree")
    got = dealt.groupBy("tree").applyInArrow(run, "tree int, own binary").collect()
    return [Forest(list(own)) for own in zip(*(pickle.loads(bytes(r["own"])) for r in sorted(got, key=lambda r: r["tree"])))]


def thresholds(forests: list[Forest], rows: DataFrame, n_good: int) -> list[float]:
    """Each forest's threshold, from all rows: quality and STATS."""
    names, most = [f"s{i}" for i in range(len(forests))], int(LOSS * n_good)

    def scores(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for b in batches:
            x = features(np.stack([np.asarray(c, np.int64) for c in b], 1))
            yield pa.StructArray.from_arrays([pa.array(f.score(v)) for f, v in zip(forests, x.values())], names)

    scored = cut(rows.select("quality", F.arrow_udf(scores, ", ".join(f"{s} double" for s in names))(*STATS).alias("s")).select("quality", "s.*"))

    def levels(s: str) -> list[tuple]:
        # no threshold is as low as the last of these
        good = np.sort([r[0] for r in scored.where("quality = 1").select(s).orderBy(F.desc(s)).limit(most + 1).collect()])

        def gone(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in arrays:
                yield pa.array(lost(good, np.asarray(a)).astype(np.int64))

        bad = scored.where("quality = 0").select(s, F.arrow_udf(gone, "bigint")(s).alias("gone")).where(F.col("gone") <= most)
        return [tuple(r) for r in bad.groupBy("gone").agg(F.count("*"), F.min(s)).collect()]

    return [threshold(n_good, levels(s)) for s in names]


def fit(rows: DataFrame, labels: DataFrame) -> Verdict:
    """rows: doc_id and STATS. Of several rows of a document the lowest counts."""
    h = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    one = rows.select("doc_id", F.struct(*STATS).alias("r")).groupBy("doc_id").agg(F.min("r").alias("r"))
    used = one.join(labelled(labels), "doc_id").select("quality", "r.*", (F.pmod(h, F.lit(2)) == 0).alias("grows"), F.pmod(F.shiftright(h, 1), F.lit(TREES)).alias("first"))
    used = cut(used.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))))
    n = {(r["grows"], r["quality"]): r["count"] for r in used.groupBy("grows", "quality").count().collect()}
    growing, good, bad = n.get((True, 0), 0) + n.get((True, 1), 0), n.get((False, 1), 0), n.get((False, 0), 0)
    if not growing or not good or not bad:
        return Verdict.of([])
    forests = grown(used.where("grows"), growing)
    names = features(np.zeros((0, len(STATS))))
    return Verdict.of(list(zip(names, forests, thresholds(forests, used.where(~F.col("grows")), good))))


def rejected(verdict: Verdict, columns: list[Column]) -> Column:
    """boolean: the forests' verdict on columns of STATS."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(verdict.reject(np.stack([np.asarray(x, np.int64) for x in b], 1)))

    return F.arrow_udf(run, "boolean")(*columns)


def passed(verdict: Verdict, text: Column) -> Column:
    """boolean: whether a text passes the base rules and the forests, by statistics that don't leave the worker."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            rows = np.array([text_stats(t.as_py()) for t in a], np.int64).reshape(-1, len(STATS))
            fails = (rows[:, 0] < LEAST_WORDS) | (100 * rows[:, 4] > REPEAT_PERCENT * rows[:, 0])
            yield pa.array(~fails & ~verdict.reject(rows))
        give_back()

    return F.arrow_udf(run, "boolean")(text)


def judged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (with doc_id and STATS, cut already) with base_failed and kept."""
    out = rows.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    no = rejected(fit(rows, labels), [F.col(s) for s in STATS])
    return out.withColumn("kept", ~F.col("base_failed") & ~no)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = cut(docs.select("doc_id", stats(F.col("text")).alias("s")).select("doc_id", "s.*"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judged(rows, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass. Statistics of labelled documents are computed once more for fitting: less than carrying texts along."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    picked = cut(labelled(labels))
    ids, some = picked.select("doc_id"), docs.select("doc_id", "text")
    side = small_side(ids)
    if side is not ids:  # else the numbers are shuffled, not the texts
        some = some.join(side, "doc_id", "left_semi")
    rows = cut(some.select("doc_id", stats(F.col("text")).alias("s")).select("doc_id", "s.*"))
    verdict = fit(rows, picked)
    return docs.where(passed(verdict, docs["text"]))
