"""MinHash near-dedup with tensored banding, confirmed on full shingle sets.

Two collections of TABLES half keys each are drawn from a document's shingles; a half key is ROWS minhashes. Every
pair of one half key from each collection is a table key, so TABLES**2 tables cost only 2 * TABLES * ROWS
minhashes. At a similarity of s one collection matches with 1 - (1 - s**ROWS)**TABLES, a pair of documents meets in
some table with the square of that: 0.997 at 0.8, 0.9999 at 0.85.

Documents with equal sets are one class from the start (by a 128-bit digest), and only classes enter the tables.
Within a table's group no pairs are listed: each class is compared with one of the group, drawn by a hash. Before full sets
are fetched, a pair must pass on its sizes and parity maps: a map holds, in each of PARITY bits, whether the set has an odd number of
shingles there, so two maps differ in no more bits than the sets differ in shingles, and a link's sets differ in few. For sets
up to some thousand shingles this loses no link; for longer ones the bound is that of six standard deviations. What was confirmed is joined to components; of
each group that then still lies in several components, the classes outside its largest one are compared with those in other
components by the same two steps, a large group in blocks of BLOCK by BLOCK classes. So no likely pair that met in a table and lies in two components stays unseen.

Defined cases: null and empty texts, and those without words, have an empty set and link with nothing; a text of
fewer words than a shingle is one shingle; long texts are read whole; rows that repeat a doc_id are linked, as they share the id; if
their texts differ, each row counts its own set, and each of the sets is compared with those of other documents; rows with a null doc_id take part in nothing, are their own document with a null component,
and are kept; an empty table gives no rows. Columns of any names may stand beside doc_id and text; the stage returns them as they are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import cut, give_back, packed, small_side
from threadloom.llm.graph import components

SHINGLE, PERCENT = 2, 80
TABLES, ROWS, SEED = 9, 3, 1234
PARITY = 1024
BLOCK = 1024
LONGS = PARITY // 64

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S33)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. Words are lower-cased in A-Z only, as bytes.lower() does."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, len(words) if len(words) < width else 0, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    if len(words) < SHINGLE:
        out = _mix(out + np.uint64(len(words)))
    return np.unique(out)


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(SEED * 2 + 1))


SKETCH = "n_shingles bigint, set_hi bigint, set_lo bigint, a array<bigint>, b array<bigint>, sk array<bigint>"


def sketched(text: Column, width: int = SHINGLE, tables: int = TABLES, rows: int = ROWS) -> Column:
    """A struct (SKETCH): the size of a text's set, its digest, and the half keys of both collections, and the parity map of its set."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seeds = _seeds(2 * tables * rows)
        for part in arrays:
            n, hi, lo, keys, low = [], [], [], [], []
            for t in part:
                s = shingles(t.as_py(), width)
                n.append(len(s))
                digest = _digest(s)
                hi.append(digest[0]), lo.append(digest[1])
                least = np.zeros(len(seeds), np.uint64)
                if len(s):
                    least = np.full(len(seeds), ~np.uint64(0))
                    for at in range(0, len(s), 4096):
                        x = s[None, at : at + 4096] ^ seeds[:, None]
                        x *= _M1
                        x ^= x >> _S33
                        x *= _M2
                        np.minimum(least, x.min(1), out=least)
                odd = np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
                low.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                half = least.reshape(2 * tables, rows)
                key = np.zeros(2 * tables, np.uint64)
                for r in range(rows):
                    key = _mix(key + half[:, r])
                keys.append(key.view(np.int64))
            k = np.array(keys, np.int64).reshape(-1, 2, tables)
            offsets = pa.array(np.arange(0, len(k) * tables + 1, tables), pa.int32())
            sides = [pa.ListArray.from_arrays(offsets, pa.array(k[:, i].ravel())) for i in (0, 1)]
            sides.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(k) * LONGS + 1, LONGS), pa.int32()), pa.array(np.array(low, np.int64).ravel())))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), *sides], ["n_shingles", "set_hi", "set_lo", "a", "b", "sk"])
        give_back()

    return F.arrow_udf(run, SKETCH)(text)


SET = "s array<bigint>, set_hi bigint, set_lo bigint"


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed longs."""
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def shingle_set(text: Column, width: int = SHINGLE) -> Column:
    """A struct (SET): the sorted set, and its digest."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in arrays:
            sets = [shingles(t.as_py(), width).view(np.int64) for t in part]
            hi, lo = zip(*map(_digest, sets)) if sets else ((), ())
            held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            del sets
            yield pa.StructArray.from_arrays([held, pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["s", "set_hi", "set_lo"])
            del held
        give_back()

    return F.arrow_udf(run, SET)(text)


def _nodes(again: bool) -> Column:
    """A class's name: the doc_id of one of its rows, together with the set's digest where doc_ids stand on several rows."""
    return F.struct("doc_id", "set_hi", "set_lo") if again else F.col("doc_id")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, again: bool) -> DataFrame:
    """pairs (u, v) with ``both`` and ``either``: the sizes of intersection and union of their full sets. docs: (doc_id, text)."""
    wanted = cut(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    ids = cut(wanted.select(F.col("node.doc_id").alias("doc_id")).distinct()) if again else wanted.withColumnRenamed("node", "doc_id")
    sets = docs.join(small_side(ids), "doc_id", "left_semi").select("doc_id", shingle_set(F.col("text"), width).alias("r")).select("doc_id", "r.*").select(_nodes(again).alias("node"), "s")
    if again:
        sets = sets.join(small_side(wanted), "node", "left_semi").dropDuplicates(["node"])
    sets = cut(sets)
    got = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    both = F.size(F.array_intersect("su", "sv"))
    return got.select("u", "v", both.alias("both"), (F.size("su") + F.size("sv") - both).alias("either"))


def _likely(percent: int) -> Column:
    """Whether sizes (na, nb) and parity maps (s0a and on, s0b and on) allow a link.

    Linked sets differ in ``apart`` shingles at most, and their maps in no more bits. Where that is beyond what a map can
    show, six standard deviations above what so many shingles change.
    """
    differ = F.lit(0)
    for i in range(LONGS):
        differ = differ + F.bit_count(F.col(f"s{i}a").bitwiseXOR(F.col(f"s{i}b")))
    apart = (F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent)
    seen = PARITY / 2 * (1 - F.exp(-2 * apart / PARITY)) + 3 * PARITY**0.5
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (differ <= F.least(apart, seen) + 1e-6)


def _about(side: str) -> list[Column]:
    """A node's size and parity map as plain columns, which a join's condition reads fastest."""
    return [F.col("n").alias(f"n{side}"), *(F.get("sk", i).alias(f"s{i}{side}") for i in range(LONGS))]


def linked(docs: DataFrame, members: DataFrame, info: DataFrame, width: int, percent: int, again: bool) -> DataFrame:
    """Confirmed links (u, v) that join all nodes of a component.

    members: (key, i, node), the classes in each table's groups, i being the half key of the first collection; info: (node, n, sk), sizes and parity maps.
    """
    # An order for each half key of the first collection: a cluster's groups compare it with some of its members, not with
    # another one in each of its TABLES**2 tables.
    groups = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "i").alias("h"), "node")).alias("r"), F.count("*").alias("n")).where("n > 1").select("key", F.col("r.node").alias("rep"))
    held = cut(members.select("key", "node").join(groups.select("key", "rep"), "key").where("node <> rep"))
    about = lambda c, x: info.select(F.col("node").alias(c), *_about(x))

    def confirm(pairs: DataFrame) -> DataFrame:
        got = confirmed(cut(pairs), docs, width, again)
        return cut(got.where(F.col("both") * 100 >= F.col("either") * percent).select("u", "v"))

    stars = held.select(F.least("rep", "node").alias("u"), F.greatest("rep", "node").alias("v")).distinct()
    links = confirm(stars.join(about("u", "a"), "u").join(about("v", "b"), "v").where(_likely(percent)).select("u", "v"))
    comp = cut(components(links))
    # What is left: pairs of one group in two components, of which one isn't the group's largest.
    of = cut(held.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")))
    largest = of.groupBy("key", "c").count().groupBy("key").agg(F.max(F.struct("count", "c")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    of = of.join(largest.select("key", F.col("most.c").alias("big")), "key")
    of = cut(of.join(info, "node"))
    # Blocks of a group: each of one side's parts meets each of the other's, so that no task takes a large group alone.
    parts = of.groupBy("key").agg(F.ceil(F.count_if(F.col("c") != F.col("big")) / BLOCK).cast("int").alias("pa"), F.ceil(F.count("*") / BLOCK).cast("int").alias("pb"))
    of = of.join(parts, "key").withColumn("x", F.pmod(F.xxhash64("node"), F.col("pa")).cast("int")).withColumn("y", F.pmod(F.xxhash64("node"), F.col("pb")).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = of.where("c <> big").select("key", "x", upto("pb").alias("y"), F.col("node").alias("u"), F.col("c").alias("cu"), *_about("a"))
    b = of.select("key", upto("pa").alias("x"), "y", F.col("node").alias("v"), F.col("c").alias("cv"), (F.col("c") == F.col("big")).alias("in_big"), *_about("b"))
    once = F.col("in_big") | (F.col("u") < F.col("v"))  # pairs outside the largest component come both ways
    rest = a.join(b, (a["key"] == b["key"]) & (a["x"] == b["x"]) & (a["y"] == b["y"]) & (F.col("cu") != F.col("cv")) & once & _likely(percent))
    return links.union(confirm(rest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()))


def repeats(rows: DataFrame) -> bool:
    """Whether a doc_id stands on several rows."""
    return rows.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def clusters(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    rows = cut(docs.select("doc_id", sketched(F.col("text"), width).alias("k")).select("doc_id", "k.*"))
    full = rows.where("n_shingles > 0 and doc_id is not null")
    again = repeats(full)
    classes = full.groupBy("set_hi", "set_lo").agg(F.min(F.struct("doc_id", "a", "b", "sk", "n_shingles")).alias("r")).select("set_hi", "set_lo", "r.*")
    classes = cut(classes.select("set_hi", "set_lo", _nodes(again).alias("node"), "a", "b", "sk", F.col("n_shingles").alias("n")))
    keyed = classes.select("node", F.posexplode("a").alias("i", "x"), "b").select("node", "i", "x", F.posexplode("b").alias("j", "y"))
    members = keyed.select(F.xxhash64("i", "x", "j", "y").alias("key"), "i", "node")
    links = linked(docs.where("doc_id is not null"), members, classes.select("node", "n", "sk"), width, percent, again)
    names = classes.select("set_hi", "set_lo", "node")
    if again:
        # The classes of one doc_id are linked.
        held = cut(full.select("doc_id", "set_hi", "set_lo").distinct().join(names, ["set_hi", "set_lo"]).select("doc_id", "node"))
        first = held.groupBy("doc_id").agg(F.min("node").alias("first"))
        links = links.union(held.join(first, "doc_id").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct())
    comp = components(links)
    of_class = names.join(comp, "node", "left").select("set_hi", "set_lo", F.coalesce("component", "node").alias("component"))
    of_class = of_class.select("set_hi", "set_lo", (F.col("component.doc_id") if again else F.col("component")).alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_hi", "set_lo").join(cut(of_class), ["set_hi", "set_lo"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least doc_id. Of rows that repeat a doc_id one stays: of the text with the least hash."""
    gone = cut(clusters(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct())
    left = docs.join(small_side(gone), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
    real = left.where("doc_id is not null")
    if not repeats(docs.where("doc_id is not null").select("doc_id")):
        return left
    hashed = real.select("doc_id", F.xxhash64("text").alias("h"), packed(real))
    least = hashed.groupBy("doc_id").agg(F.min("h").alias("h"))
    one = hashed.join(least, ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("row.*")
    return one.unionByName(left.where("doc_id is null"))


OP7_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from w),
g as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (select a.doc_id as u, b.doc_id as v, count(*) as k, any_value(a.n) as n, any_value(b.n) as m from g a join g b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
links as (select u, v from p where 100 * k >= 80 * (n + m - k)),
reach(u, v) as (select doc_id, doc_id from documents union select r.u, l.v from reach r join links l on r.v = l.u),
c as (select u, min(v) as component_id from reach group by u)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept from s join c on s.doc_id = c.u
"""
