"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

ITQ is fitted on a sample (at most SAMPLE_ROWS vectors and SAMPLE_BYTES, those with the lowest hash of vec_id): principal directions, then
rotations that alternate with the codes until the bits are balanced. The first rotation takes ROUNDS steps; further ones
start elsewhere and take FEW, so that they stay apart from each other. All cuts go through the origin, as cosines are measured from there; codes
about the mean would tell the vectors of one narrow cone apart whether they link or not. A code is cut into pieces of equal width, and each piece is the key of a
table. Two vectors meet if some piece is equal; single vectors that meet are dropped beyond a Hamming radius, and the rest are reranked: linked are
those with a cosine of COSINE or more, in double precision on the original vectors.

Width and number of pieces follow from the sample and from the number of vectors: partners are made at exactly COSINE, and for each
width there is a least number of tables in which RECALL of them meet; of these pairs that one is taken which costs least, where
unlinked pairs of the sample tell how many candidates a table brings. So the width grows with the logarithm of the table's
size, few vectors share one bucket, and low dimensions and crowded directions are allowed for. What was chosen is then tried on the partners, and
tables are added until RECALL is met. Partners count as at least as far apart as random cuts would make them. The radius leaves out one partner in a thousand.

Equal vectors are one node with a weight. Groups of near copies aren't listed as pairs: each pair of pieces names a small bucket, in
which vectors are compared with one leader; what links so is joined, and those within half of the linking
angle of their cluster's mean form a ball, all of whose vectors are linked with each other. From then on balls are
met and compared through centre and radius; only pairs of balls that these can't decide are compared vector by
vector, in blocks of BLOCK by BLOCK that give counts, not pairs. Degrees and components follow from balls, so no table grows with the square of a group of copies.

Recall: at the threshold RECALL of pairs meet, nearer ones are surer.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths link with
nothing; rows that repeat a vec_id are separate vectors of one id (all take part); a null vec_id takes part in
nothing and gets a null component; an empty table gives no rows; columns besides vec_id and embedding don't matter.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import cut, small_side
from threadloom.llm.graph import components

COSINE, RECALL = 0.95, 0.97
SAMPLE_ROWS, SAMPLE_BYTES, FIT_ROWS, ROUNDS, FEW, SEED = 20_000, 64 << 20, 4096, 50, 3, 3
#: Partners and unlinked pairs by which tables are chosen; what a row of a table costs, in candidates; bounds of the choice.
PARTNERS, OTHERS, ROW_COST, WIDEST, MOST_TABLES, MOST_BITS = 2_000, 50_000, 4.0, 40, 512, 128
#: Members of a block in which open pairs of balls are compared; tasks that one ball's blocks go to, at most.
BLOCK, SPREAD = 256, 16


class Itq:
    """Codes whose pieces are table keys. x: a sample of unit vectors; count: the vectors that will be held; least: the cosine to find."""

    def __init__(self, x: np.ndarray, count: int = 0, least: float = COSINE):
        n, d = x.shape
        self.rng = np.random.default_rng(SEED)
        self.x, self.bits = x, min(MOST_BITS, d)
        _, vectors = np.linalg.eigh(x.T @ x) if n > 1 and d > 1 else (0, np.eye(d))
        self.main = vectors[:, ::-1][:, : self.bits]
        self.project = self._rotation(ROUNDS)
        a = x[self.rng.choice(n, min(n, PARTNERS), replace=False)] if n else x
        v = self.rng.normal(size=a.shape)
        v -= (v * a).sum(1, keepdims=True) * a
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        b = least * a + math.sqrt(1 - least * least) * v if d > 1 else a
        i, j = (self.rng.integers(0, n, OTHERS) for _ in range(2)) if n else (np.zeros(0, int), np.zeros(0, int))
        i, j = (k[(x[i] * x[j]).sum(1) < least] for k in (i, j))
        self._grow(64)
        apart = lambda y, z: (self._on(y) != self._on(z)).mean(1)
        # Bits fitted to few vectors hold these apart too well: partners count as at least as far as random cuts would make them.
        cuts = math.acos(least) / math.pi
        self.width, self.tables = self._cheapest(np.maximum(apart(a, b), cuts), apart(x[i], x[j]), count) if len(a) else (0, 1)
        while self.width and self._met(a, b) < RECALL:
            if self.tables >= MOST_TABLES:  # shorter pieces meet more often, and one of no bits always
                self.width, self.tables = self.width - 1, max(1, self.tables // 2)
            else:
                self.tables += 1 + self.tables // 8
        self._grow(max(64, self.tables * self.width))
        self.project = self.project[:, : max(64, self.tables * self.width)]
        near = np.bitwise_count(self.codes(a)[0] ^ self.codes(b)[0])
        self.radius = max(int(np.quantile(near, 0.999)) + 1, math.ceil(64 * cuts + 3.3 * (64 * cuts * (1 - cuts)) ** 0.5)) if len(a) else 64
        del self.x, self.main, self.rng

    def _rotation(self, rounds: int) -> np.ndarray:
        r = np.linalg.qr(self.rng.normal(size=(self.bits, self.bits)))[0]
        some = self.x[self.rng.choice(len(self.x), min(FIT_ROWS, len(self.x)), replace=False)] if len(self.x) else self.x
        y = some @ self.main
        for _ in range(rounds if len(some) else 0):
            u, _, v = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ v).T
        return self.main @ r

    def _grow(self, bits: int) -> None:
        while self.project.shape[1] < bits:
            self.project = np.concatenate([self.project, self._rotation(FEW)], 1)

    def _on(self, x: np.ndarray) -> np.ndarray:
        return x @ self.project >= 0

    @staticmethod
    def _cheapest(linked: np.ndarray, others: np.ndarray, count: int) -> tuple[int, int]:
        """Width and number of tables. linked, others: the share of differing bits of partners and of unlinked pairs."""
        best = (ROW_COST + count, 0, 1)
        for w in range(1, WIDEST + 1):
            one = (1 - linked) ** w
            miss = lambda t, one=one: ((1 - one) ** t).mean()
            if miss(MOST_TABLES) > 1 - RECALL:
                break
            t = next(t for t in range(1, MOST_TABLES + 1) if miss(t) <= 1 - RECALL)
            brings = max(2.0**-w, ((1 - others) ** w).mean() if len(others) else 0.0)
            best = min(best, (t * (ROW_COST + count * brings), w, t))
        return best[1:]

    def _met(self, a: np.ndarray, b: np.ndarray) -> float:
        self._grow(self.tables * self.width)
        same = (self._on(a) == self._on(b))[:, : self.tables * self.width].reshape(len(a), self.tables, self.width)
        return float(same.all(2).any(1).mean())

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first 64 bits of each code, and its table keys."""
        on = self._on(x)
        first = (on[:, :64].astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
        pieces = on[:, : self.tables * self.width].reshape(len(x), self.tables, self.width).astype(np.int64)
        keys = (pieces << np.arange(self.width)).sum(2) if self.width else np.zeros((len(x), 1), np.int64)
        return first, keys | (np.arange(keys.shape[1]) << WIDEST)


def _rows(a: pa.Array) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def unit(vector: Column, length: int) -> Column:
    """array<double> of ``length``: the vector by its norm, padded by zeros; null if it can't link."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            out = []
            for v in a.to_pylist():
                x = None if not v or any(e is None for e in v) else np.array(v, np.float64)
                if x is None or not np.isfinite(x).all() or not (top := np.abs(x).max()):
                    out.append(None)
                    continue
                x = x / top
                out.append(np.pad(x / np.linalg.norm(x), (0, length - len(x))))
            yield pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(vector)


def cosine(a: Column, b: Column) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array(np.einsum("ij,ij->i", _rows(x), _rows(y)))

    return F.arrow_udf(run, "double")(a, b)


def coded(u: Column, itq: Itq) -> Column:
    """A struct: the code's first 64 bits, and a key for each table."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            first, keys = itq.codes(_rows(a)) if len(a) else (np.zeros(0, np.uint64), np.zeros((0, 1), np.int64))
            offsets = pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32())
            yield pa.StructArray.from_arrays([pa.array(first.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["code", "keys"])

    return F.arrow_udf(run, "code bigint, keys array<bigint>")(u)


def _block_links(least: float, hu: Column, hn: Column, gu: Column, gn: Column) -> Column:
    """Two blocks of vectors u with weights n -> for each host, and for each guest, the weight of what it links with on the other side."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for hus, hns, gus, gns in batches:
            h, g = [], []
            for i in range(len(hus)):
                links = _rows(hus[i].values) @ _rows(gus[i].values).T >= least
                h.append(links @ np.asarray(gns[i].values))
                g.append(np.asarray(hns[i].values) @ links)
            yield pa.StructArray.from_arrays([pa.array(h, pa.list_(pa.int64())), pa.array(g, pa.list_(pa.int64()))], ["h", "g"])

    return F.arrow_udf(run, "h array<bigint>, g array<bigint>")(hu, hn, gu, gn)


def _bounds(angle: Column, ra: Column, rb: Column, most: float) -> tuple[Column, Column]:
    """Whether all, and whether some, pairs of two balls may link."""
    slack = 1e-9
    return angle + ra + rb <= most - slack, angle - ra - rb <= most + slack


def _blocks(rows: DataFrame, members: Column) -> DataFrame:
    """rows (host, id and others) -> host, block, blocks (of that host), m: arrays of about BLOCK members."""
    parts = rows.groupBy("host").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(parts, "host").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return rows.groupBy("host", "block", "blocks").agg(F.collect_list(members).alias("m"))


def opened(pairs: DataFrame, nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """pairs (host, guest) of balls that are compared vector by vector -> weights (id, w) and linked balls (a, b). nodes: ball, id, u, n."""
    of = nodes.select("ball", "id", "u", "n")
    guests = _blocks(pairs.join(of.withColumnRenamed("ball", "guest"), "guest"), F.struct("id", "u", "n", "guest"))
    hosts = _blocks(pairs.select("host").distinct().join(of.withColumnRenamed("ball", "host"), "host"), F.struct("id", "u", "n"))
    guests = cut(guests.withColumn("spread", F.least("blocks", F.lit(SPREAD))).select("host", "spread", F.pmod("block", "spread").alias("lane"), F.col("m").alias("g")))
    lanes = guests.select("host", "spread").distinct()
    hosts = hosts.join(lanes, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("lane"), F.col("m").alias("h"))
    met = hosts.join(guests.drop("spread"), ["host", "lane"]).withColumn("links", _block_links(least, F.col("h.u"), F.col("h.n"), F.col("g.u"), F.col("g.n")))
    sides = F.concat(
        F.zip_with("h", "links.h", lambda m, w: F.struct(m["id"].alias("id"), w.alias("w"), F.lit(None).cast(pairs.schema["guest"].dataType).alias("guest"))),
        F.zip_with("g", "links.g", lambda m, w: F.struct(m["id"].alias("id"), w.alias("w"), m["guest"].alias("guest"))),
    )
    got = cut(met.select("host", F.explode(F.filter(sides, lambda x: x["w"] > 0)).alias("x")).select("host", "x.*"))
    return got.select("id", "w"), got.where("guest is not null").select(F.col("host").alias("a"), F.col("guest").alias("b")).distinct()


def linked(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    length = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    length, most = max(1, length), math.acos(least)
    rows = vectors.select("vec_id", unit(F.col("embedding"), length).alias("u"), F.size("embedding").alias("dim"))
    rows = cut(rows.select("vec_id", "u", F.xxhash64("u", "dim").alias("h"), F.xxhash64(F.lit(1), "u", "dim").alias("h2"), "dim"))
    nodes = cut(rows.where("u is not null and vec_id is not null").groupBy("u", "dim", "h", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    # Where rows repeat a vec_id, two nodes may share it: such an id's nodes are told apart by a hash of the vector.
    nodes = nodes.withColumn("id", F.struct("node", "h"))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * length)))).select("u").toArrow()["u"].combine_chunks()
    itq = Itq(_rows(sample) if len(sample) else np.zeros((0, length)), nodes.count(), least)
    nodes = cut(nodes.withColumn("c", coded(F.col("u"), itq)).select("*", "c.code", "c.keys").drop("c"))

    # Leaders in the buckets of two pieces; clusters of what links with them.
    pairs_of = [(i, i + 1) for i in range(0, itq.tables - 1, 2)] or [(0, 0)]
    twos = [F.xxhash64("dim", F.get("keys", i), F.get("keys", j)) for i, j in pairs_of]
    spread = nodes.select("id", F.explode(F.array(*twos)).alias("key"))
    leaders = spread.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("c")).where("c > 1")
    stars = cut(spread.join(leaders.select("key", "lead"), "key").where("id <> lead").select("id", "lead").distinct())
    vec = nodes.select("id", "u")
    met = stars.join(vec, "id").join(vec.select(F.col("id").alias("lead"), F.col("u").alias("w")), "lead")
    comp = cut(components(cut(met.where(cosine(F.col("u"), F.col("w")) >= least).select(F.col("id").alias("u"), F.col("lead").alias("v")))))
    inside = cut(nodes.join(comp.select(F.col("node").alias("id"), "component"), "id").select("id", "n", "u", "component"))
    means = cut(means_of(inside, length).select("component", unit(F.col("mean"), length).alias("mean")).where("mean is not null"))
    near = inside.join(means, "component").select("id", "n", "component", "mean", cosine(F.col("u"), F.col("mean")).alias("c"))
    near = cut(near.where(F.col("c") >= math.cos(most / 2) + 1e-9))
    balls = cut(near.groupBy("component").agg(F.min("id").alias("ball"), F.sum("n").alias("weight"), F.max(F.acos(F.least("c", F.lit(1.0)))).alias("radius"), F.count("*").alias("members")).where("members > 1").join(means.withColumnRenamed("mean", "centre"), "component"))
    of_ball = near.select("id", "component").join(balls.select("component", "ball", "weight"), "component").select("id", "ball", "weight")
    nodes = cut(nodes.join(of_ball, "id", "left").withColumn("single", F.isnull("ball")).withColumn("weight", F.coalesce("weight", "n")).withColumn("ball", F.coalesce("ball", "id")))
    centres = nodes.where("single").select("ball", "weight", F.lit(0.0).alias("radius"), F.col("u").alias("centre"), F.lit(1).cast("bigint").alias("members"))
    centres = cut(centres.unionByName(balls.select("ball", "weight", "radius", "centre", "members")))

    # Balls that meet in a table.
    index = nodes.select("ball", F.when(F.col("single"), F.col("code")).alias("code"), "dim", F.explode("keys").alias("key")).distinct()
    index = index.select("ball", "code", F.xxhash64("dim", "key").alias("key"))
    pairs = index.join(index.select("key", F.col("ball").alias("other"), F.col("code").alias("code2")), "key").where("ball < other")
    pairs = pairs.where(F.coalesce(F.bit_count(F.col("code").bitwiseXOR(F.col("code2"))) <= itq.radius, F.lit(True)))
    pairs = cut(pairs.select(F.col("ball").alias("a"), F.col("other").alias("b")).distinct())
    side = lambda c: centres.select(F.col("ball").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("weight", "radius", "centre", "members")))
    told = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cos", cosine(F.col("centre_a"), F.col("centre_b")))
    angle = F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0)))
    every, some = _bounds(angle, F.col("radius_a"), F.col("radius_b"), most)
    ones = (F.col("members_a") == 1) & (F.col("members_b") == 1)
    larger = F.col("members_a") >= F.col("members_b")
    told = cut(told.select("a", "b", "weight_a", "weight_b", larger.alias("a_hosts"), F.when(ones, F.col("cos") >= least).otherwise(every).alias("every"), (~ones & ~every & some).alias("open")))

    # Pairs of balls that centre and radius leave open: vector by vector, the ball with more members as host.
    host = F.col("a_hosts")
    single, joined = opened(told.where("open").select(F.when(host, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(host, F.col("b")).otherwise(F.col("a")).alias("guest")), nodes, least)
    whole = told.where("every")
    by_ball = whole.select(F.col("a").alias("ball"), F.col("weight_b").alias("w")).union(whole.select("b", "weight_a")).groupBy("ball").agg(F.sum("w").alias("from_balls"))
    by_id = single.groupBy("id").agg(F.sum("w").alias("from_single"))
    graph = components(whole.select(F.col("a").alias("u"), F.col("b").alias("v")).union(joined).distinct())
    got = nodes.join(by_ball, "ball", "left").join(by_id, "id", "left").join(graph.select(F.col("node").alias("ball"), "component"), "ball", "left")
    links = F.col("weight") - 1 + F.coalesce("from_balls", F.lit(0)) + F.coalesce("from_single", F.lit(0))
    got = cut(got.select("h", "h2", links.alias("n_links"), F.coalesce("component.node", "ball.node").alias("component_id")))
    out = rows.select("vec_id", "h", "h2").join(got, ["h", "h2"], "left")
    known = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), F.when(known, F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def means_of(inside: DataFrame, length: int) -> DataFrame:
    """component, mean of inside (component, u). Averages are partial before the shuffle; of long vectors by component and place."""
    if length <= 256:
        return inside.groupBy("component").agg(F.array(*(F.avg(F.get("u", i)) for i in range(length))).alias("mean"))
    each = inside.select("component", F.posexplode("u").alias("i", "x")).groupBy("component", "i").agg(F.avg("x").alias("x"))
    return each.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).select("component", F.col("m.x").alias("mean"))


def op2_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP2_SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda e: e::double) as e from embeddings),
links as (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach(u, v) as (select vec_id, vec_id from v union select r.u, l.v from reach r join links l on r.v = l.u),
c as (select u, min(v) as component_id from reach group by u)
select c.u as vec_id, (select count(*) from links l where l.u = c.u) as n_links, component_id, c.u = component_id as kept from c
"""
