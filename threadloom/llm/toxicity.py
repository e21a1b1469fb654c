"""Toxicity: subword-bag embeddings, averaged over windows of words, into a linear softmax.

A word is a bag of its character n-grams (NGRAMS, hashed to BUCKETS) and itself; its vector is their mean. Vectors
of WINDOW consecutive words are averaged and go into a softmax of two classes; a text scores as the highest of its
windows, so that a single insult in a very long text isn't averaged away. A text of fewer words is one window.
Embeddings and softmax are trained jointly in numpy by Adagrad on the cross entropy: first with the average over
the whole text, then with the highest window. A misspelt word shares most n-grams with the word as it was seen,
and so nearly its vector.

The model is fitted on at most SAMPLE_ROWS labelled documents, those with the lowest hash of doc_id among the
documents whose crc32(doc_id as text) mod 4 is not HELD_OUT. Training and scoring read whole texts; the sample comes
to the driver partition by partition and is held as word numbers.

Defined cases: a null or empty text, or one without words, gets the score of the softmax's bias alone; long texts are
read whole; a null doc_id is not held out and never trains; of several labels for one document the highest counts, of several rows of
one doc_id the text that sorts first trains; repeated rows each get their score; null labels are
not used; without labels of both kinds every score is 0; an empty table gives no rows; other columns don't matter.
"""

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import give_back

SAMPLE_ROWS = 6_000
HELD_OUT, PARTS = 2, 4
BUCKET_BITS, DIM, NGRAMS = 17, 8, (3, 4, 5)
BUCKETS = 1 << BUCKET_BITS
WINDOW, LARGEST_BATCH, STEPS = 8, 256, 24
AVERAGE_EPOCHS, WINDOW_EPOCHS, RATE, SEED = 3, 4, 0.3, 5
THRESHOLD = 0.3
#: Words that are hashed together, about, and whose logits a task keeps.
WORDS_AT_ONCE, WORDS_HELD = 50_000, 200_000
#: A word keeps the digits and symbols within it, by which insults are disguised; longer ones than LONGEST are taken in parts.
_WORD, LONGEST = re.compile(r"\w(?:\S*\w)?"), 64


_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and its n-grams, with < and > around it, for all words in a row; and how many each has.

    All characters of all words stand in one array, and grams of one length are hashed together.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    of, at = np.repeat(np.arange(len(words)), lengths), np.arange(len(c))
    left, inside = ends[of] - at, at - (ends - lengths)[of]
    power = np.ones(int(lengths.max()), np.uint64)
    power[1:] = _STEP
    whole = np.add.reduceat(c * np.cumprod(power)[inside], ends - lengths)
    hashes, owners = [whole * _SPREAD], [np.arange(len(words))]
    for n in NGRAMS:
        i = np.flatnonzero(left >= n)
        h = np.full(len(i), n, np.uint64)
        for k in range(n):
            h = h * _STEP + c[i + k]
        hashes.append((h ^ (h >> np.uint64(29))) * _SPREAD)
        owners.append(of[i])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(hashes)[order] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.bincount(owner, minlength=len(words))


def words_of(text: str | None) -> list[str]:
    words = _WORD.findall(text.lower()) if text else []
    if words and len(max(words, key=len)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def windows(values: np.ndarray) -> np.ndarray:
    """Averages of WINDOW consecutive values; of all, if there are fewer."""
    if len(values) <= WINDOW:
        return values.mean(keepdims=True) if len(values) else np.zeros(1)
    c = np.concatenate([[0.0], np.cumsum(values)])
    return (c[WINDOW:] - c[:-WINDOW]) / WINDOW


class Model:
    """vectors[bucket], out[2, DIM] and bias[2]; ``logit`` of a word is what it adds to class 1 over class 0."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.vectors = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.out = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.fitted = False

    def freeze(self) -> "Model":
        """Only what scoring needs: one number a bucket."""
        self.by_bucket = (self.vectors @ (self.out[1] - self.out[0])).astype(np.float32)
        self.offset = float(self.bias[1] - self.bias[0])
        del self.vectors
        return self

    def word_logits(self, words: list[str]) -> np.ndarray:
        flat, sizes = grams(words)
        return np.add.reduceat(self.by_bucket[flat].astype(np.float64), np.cumsum(sizes) - sizes) / sizes if words else np.zeros(0)

    def logit(self, word: str) -> float:
        return float(self.word_logits([word])[0])

    def score(self, logits: np.ndarray) -> float:
        if not self.fitted:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(windows(logits).max() + self.offset, -60, 60))))


def numbered(texts: Iterable[list[str]]) -> tuple[list[np.ndarray], list[str]]:
    """Each text as numbers of its words, and the words by number."""
    index: dict[str, int] = {}
    return [np.fromiter((index.setdefault(w, len(index)) for w in t), np.int32, len(t)) for t in texts], list(index)


def train(texts: Iterable[list[str]], toxic: np.ndarray) -> Model:
    return train_numbered(*numbered(texts), toxic)


def train_numbered(docs: list[np.ndarray], vocabulary: list[str], toxic: np.ndarray) -> Model:
    model = Model()
    if len(set(toxic.tolist())) < 2:
        return model.freeze()
    parts = [grams(vocabulary[i : i + WORDS_AT_ONCE]) for i in range(0, len(vocabulary), WORDS_AT_ONCE)]
    flat, sizes = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    del parts
    rng = np.random.default_rng(SEED)
    g_vec, g_out, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full_like(model.out, 1e-6), np.full(2, 1e-6, np.float32)
    use = np.array([len(d) > 0 for d in docs])
    for epoch in range(AVERAGE_EPOCHS + WINDOW_EPOCHS):
        batch_size = max(16, min(LARGEST_BATCH, int(use.sum()) // STEPS))
        order = rng.permutation(np.flatnonzero(use))
        if epoch >= AVERAGE_EPOCHS:
            per_bucket = model.vectors @ (model.out[1] - model.out[0])
            word_logit = np.add.reduceat(per_bucket[flat], starts[:-1]) / sizes
        for at in range(0, len(order), batch_size):
            batch, parts, times, lengths = order[at : at + batch_size], [], [], []
            for i in batch:
                d = docs[i]
                if epoch >= AVERAGE_EPOCHS and len(d) > WINDOW:
                    k = int(windows(word_logit[d]).argmax())
                    d = d[k : k + WINDOW]
                # A word counts as often as it stands there; so a batch needs room for distinct words only.
                w, c = np.unique(d, return_counts=True)
                parts.append(w)
                times.append(c)
                lengths.append(len(d))
            held = np.array([len(p) for p in parts])
            lengths, tokens, times = np.array(lengths), np.concatenate(parts), np.concatenate(times)
            doc_of = np.repeat(np.arange(len(parts)), held)
            words, of = np.unique(tokens, return_inverse=True)
            n = sizes[words]
            first = np.concatenate([[0], np.cumsum(n)])[:-1]
            buckets = flat[np.repeat(starts[words] - first, n) + np.arange(n.sum())]
            word_vec = np.add.reduceat(model.vectors[buckets], first) / n[:, None]
            x = np.add.reduceat(word_vec[of] * times[:, None], np.concatenate([[0], np.cumsum(held)])[:-1]) / lengths[:, None]
            z = x @ model.out.T + model.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), toxic[batch]] -= 1
            p /= len(batch)
            d_out, d_bias, d_x = p.T @ x, p.sum(0), (p @ model.out) / lengths[:, None]
            d_word = np.stack([np.bincount(of, d_x[doc_of, j] * times, len(words)) for j in range(DIM)], 1) / n[:, None]
            spread = np.repeat(d_word, n, 0)
            some, where = np.unique(buckets, return_inverse=True)
            d_vec = np.stack([np.bincount(where, spread[:, j], len(some)) for j in range(DIM)], 1)
            g_vec[some] += (d_vec**2).mean(1)
            g_out += d_out**2
            g_bias += d_bias**2
            model.vectors[some] -= (RATE * d_vec / np.sqrt(g_vec[some])[:, None]).astype(np.float32)
            model.out -= RATE * d_out / np.sqrt(g_out)
            model.bias -= RATE * d_bias / np.sqrt(g_bias)
    model.fitted = True
    return model.freeze()


def _training_text(text: Column) -> Column:
    """All the words of a text, which hold no space, with spaces between."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            yield pa.array([" ".join(words_of(t.as_py())) for t in a], pa.string())

    return F.arrow_udf(run, "string")(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % PARTS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels of documents that aren't held out. The sample is at most SAMPLE_ROWS whole texts."""
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", _training_text(F.col("text")).alias("t"))
    got = got.groupBy("doc_id").agg(F.min(F.struct("toxic", "t")).alias("r")).orderBy("doc_id").select("r.*")
    toxic: list[int] = []

    def texts() -> Iterator[list[str]]:
        for r in got.toLocalIterator():
            toxic.append(r["toxic"])
            yield r["t"].split()

    docs_of, vocabulary = numbered(texts())
    return train_numbered(docs_of, vocabulary, np.array(toxic, np.int64))


def scored(text: Column, model: Model, spark: SparkSession) -> Column:
    """double: 0 to 1, higher where label 1 is likelier."""
    shared = spark.sparkContext.broadcast(model)

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        known: dict[str, float] = {}

        def scores(texts: list[list[str]]) -> list[float]:
            new = list({w for t in texts for w in t if w not in known}) if m.fitted else []
            known.update(zip(new, m.word_logits(new).tolist()))
            out = [m.score(np.fromiter(map(known.__getitem__, t), np.float64, len(t)) if m.fitted else np.zeros(0)) for t in texts]
            if len(known) > WORDS_HELD:
                known.clear()
            return out

        for a in arrays:
            out, texts, held = [], [], 0
            for t in a:
                texts.append(words_of(t.as_py()))
                held += len(texts[-1])
                if held >= WORDS_AT_ONCE:
                    out += scores(texts)
                    texts, held = [], 0
            yield pa.array(out + scores(texts), pa.float64())
        known.clear()
        give_back()

    return F.arrow_udf(run, "double")(text)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(F.col("text"), fit(docs, labels), spark).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
