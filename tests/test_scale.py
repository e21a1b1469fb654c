"""Tables of many files, and steps whose cost must grow no faster than the input."""

import pytest
from pyspark.sql import functions as F

from threadloom import storage
from threadloom.operators import index
from threadloom.plans import catalog

ROWS = [(i, t) for i, t in enumerate(["red fox in the forest", "red foxes run", "blue fox; blue sea", "", None, "the the the", "a sea of red sea", "license version 2"])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables whose documents are a folder of several files."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_streamed_postings_of_a_table_of_many_files(spark, folder):
    want = catalog.postings(spark, folder).select("term", "cid", "tf")
    got = rows(catalog.streamed_postings(spark, folder))
    assert got == rows(want) and len(got) == 14


def test_an_error_query_builds_nothing(spark, folder, monkeypatch):
    monkeypatch.setattr(catalog, "_saved", lambda *a: pytest.fail("a part of the index was saved"))
    assert catalog.QUERIES["query_error"](spark, folder).collect() == []


def test_queries_save_only_what_they_look_up(spark, folder, monkeypatch):
    saved, save = [], catalog.Index.save
    monkeypatch.setattr(catalog.Index, "save", lambda self, path, targets=index.TARGETS: (saved.extend(targets), save(self, path, targets)))
    at = f"{folder}/."  # another path, for which nothing is saved
    assert rows(catalog._engine(spark, at, "'red fox'").search("'red fox'")) == [(0,)] and saved == ["postings"]
    assert [r["cid"] for r in catalog._engine(spark, at, "license").search("license").collect()] == [7] and saved == ["postings", "terms"]


def test_saving_keeps_nothing_beside_the_index(spark, tmp_path, monkeypatch):
    """Texts were analysed into a checkpoint of all columns, several times the size of the index, which was dealt out and sorted."""
    monkeypatch.setattr(index, "TASK_ROWS", 3)
    monkeypatch.setattr(index, "LAYOUT_SHARE", 1.0)
    docs = spark.createDataFrame(ROWS, "cid long, text string")
    built = index.build(docs)
    monkeypatch.setattr(type(docs), "checkpoint", lambda *a, **k: pytest.fail("rows were kept beside the index"))
    built.save(str(tmp_path))
    got = index.Index.load(spark, str(tmp_path))
    assert rows(got.postings) == rows(built.postings) and rows(got.terms) == rows(built.terms)
    key = lambda x: str(x)
    assert sorted(map(tuple, got.docs.collect()), key=key) == sorted(map(tuple, built.docs.select(got.docs.columns).collect()), key=key)
    files = got.postings.groupBy(F.input_file_name().alias("file")).agg(F.min(F.struct("term", "cid")).alias("low"), F.max(F.struct("term", "cid")).alias("high"), F.count("*").alias("n")).orderBy("low").collect()
    assert len(files) > 2 and all(a["high"] < b["low"] for a, b in zip(files, files[1:]))


def test_ranges_split_a_common_term(spark):
    bounds = [("a", 3), ("b", 1), ("b", 5), ("b", 9), ("c", 0)]
    places = [("a", 0), ("a", 3), ("aa", 0), ("b", 0), ("b", 1), ("b", 4), ("b", 5), ("b", 10), ("bz", 0), ("c", 0), ("z", 7)]
    got = spark.createDataFrame(places, "term string, cid long").select("term", "cid", index._place(bounds, 0, len(bounds)).alias("at")).collect()
    assert [r["at"] for r in got] == [sum(b <= p for b in bounds) for p in places]


def test_clustered(spark, tmp_path):
    """Partitions that hold ranges of the key already aren't dealt out again; others are."""
    cores = spark.sparkContext.defaultParallelism
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    apart, mixed = spark.range(0, 100, 1, cores), spark.range(0, 100, 1, 3)
    assert "Exchange" not in plan(storage.clustered(apart, "id")) and "rangepartitioning" in plan(storage.clustered(mixed, "id"))
    assert rows(storage.clustered(mixed, "id")) == rows(mixed)


def test_packing_deals_postings_out_once(spark):
    """Posting lists were joined with the ends of their blocks, and packed by each task of the scan before they were dealt out."""
    p = spark.createDataFrame([("a", c, 0.0, [0]) for c in (5, 1, 9, index.GAP_BLOCK * 2 + 3)] + [("b", 7, 0.0, [0])], "term string, cid long, tf double, positions array<int>")
    got = index.from_gap_blocks(index.gap_blocks(p, 3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(term" in plan and "Join" not in plan and plan.index("Exchange") > plan.index("collect_list")
    assert rows(got) == rows(p.select("term", "cid"))


def test_gaps_deal_postings_out_once(spark):
    """Each posting was joined with the end of the block before its own."""
    b = index.GAP_BLOCK
    lists = {"a": [5, 1, 9, b - 1, b, b * 2 + 3, b * 7, b * 7], "b": [b * 3]}
    p = spark.createDataFrame([(t, c, 0.0, [0]) for t, cs in lists.items() for c in cs], "term string, cid long, tf double, positions array<int>")
    got = index.gaps(p, 3)
    want = [(t, c, c - last) for t, cs in lists.items() for last, c in zip([0, *sorted(cs)], sorted(cs))]
    assert rows(got) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()  # as it was executed
    assert "Join" not in plan and "ReusedExchange" in plan
