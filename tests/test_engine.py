import pytest
from pyspark.sql import functions as F

from threadloom.functions.porter import stem
from threadloom.functions.text import html_strip, treebank_tokens, url_basename
from threadloom.operators import etl
from threadloom.operators.index import TREEBANK, Index, build
from threadloom.operators.search import SearchEngine, combine
from threadloom.plans.query import QueryError, parse, reply_target

TEXTS = [(1, "christmas market in berlin"), (2, "christmas is near"), (3, "the market fell"), (4, "christmas market christmas tree"), (5, "war and peace")]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    build(spark.createDataFrame(TEXTS, "cid long, text string"), TREEBANK).save(path)
    return SearchEngine(Index.load(spark, path, TREEBANK))


def ids(df):
    return [r["cid"] for r in df.collect()]


def test_keyword_ranking(engine):
    got = engine.search("christmas market").collect()
    assert [r["cid"] for r in got] == [1, 4, 2, 3]
    assert [round(r["score"], 6) for r in got] == [1.0, 0.948683, 0.707107, 0.707107]
    assert ids(engine.search("market", top_k=2)) == [1, 3]
    assert sorted(ids(engine.search("market", top_k=None))) == [1, 3, 4]
    assert ids(engine.search("the")) == []
    with pytest.raises(QueryError):
        engine.search("market", top_k=-1)


def test_prefix_is_matched_against_stems(engine):
    assert ids(engine.search("christmas*")) == []
    assert sorted(ids(engine.search("christ*"))) == [1, 2, 4]


def test_phrase(engine):
    assert sorted(ids(engine.search("'christmas market'"))) == [1, 4]
    assert ids(engine.search("'war and peace'")) == []


def test_boolean(engine):
    assert sorted(ids(engine.search("christmas AND market"))) == [1, 4]
    assert ids(engine.search("christmas AND the")) == []
    assert sorted(ids(engine.search("christmas AND zzz"))) == [1, 2, 4]
    assert ids(SearchEngine(engine.index, strict_sets=True).search("christmas AND zzz")) == []
    assert {r["text"] for r in engine.search("war", ids_only=False).collect()} == {"war and peace"}


def test_combine(spark):
    # Sets and what must come out of them.
    a, b, c, z = (spark.createDataFrame([(x,) for x in s], "cid long") for s in ([1, 2, 5, 7, 9], [2, 5, 11, 13, 17], [2, 7, 20, 13], []))
    assert sorted(ids(combine("AND", [a, b, c]))) == [2]
    assert sorted(ids(combine("OR", [a, b, c]))) == [1, 2, 5, 7, 9, 11, 13, 17, 20]
    assert sorted(ids(combine("NOT", [a, b, c]))) == [1, 9]
    assert sorted(ids(combine("NOT", [z, a]))) == [1, 2, 5, 7, 9]
    assert ids(combine("AND", [z, z])) == []


@pytest.mark.parametrize("q, kind", [("harvest", "keyword"), ("12 eggs", "keyword"), ("hous*", "prefix"), ("'Green valley'", "phrase"), ("ReplyTo:2", "reply"), ("apple NOT pear", "boolean"), ("sea OR 'blue ocean'", "boolean"), ("a1 AND b2 AND c3 AND d4", "boolean"), ("FORD", "boolean"), ("SANDY", "boolean"), ("a AND b AND c", "error"), ("a AND 'x y' AND c", "error"), ("'old to'*", "error"), ("NOT rain", "error"), ("x1 AND y2 NOT z3", "error")])
def test_kinds(q, kind):
    assert parse(q).kind == kind


def test_reply_target():
    assert reply_target("ReplyTo:2") == 2 and reply_target("ReplyTo:2:3") is None
    with pytest.raises(QueryError):
        reply_target("ReplyTo:x")


def test_replies(spark):
    # Fixed values: (child, parent), and children by parent.
    rows = [(1, 1), (2, 1), (3, 2), (4, 1), (5, 4), (6, 4), (7, 6), (8, 2), (9, 1), (10, 4), (11, 2), (12, 1), (13, 6), (14, 5)]
    i = build(spark.createDataFrame([(c, "", p) for c, p in rows], "cid long, text string, parent_cid long"))
    assert {r["parent_cid"]: r["count"] for r in i.replies.groupBy("parent_cid").count().collect()} == {1: 4, 2: 3, 4: 3, 5: 1, 6: 2}


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("christmas", "christma"), ("peace", "peac")])
def test_porter(word, want):
    assert stem(word) == want


def test_text_functions(spark):
    one = spark.createDataFrame([("<p>a</p><script>x</script>b<!-- c -->\nd&nbsp;e", "https://x.org/a/b.html?q=1", "I can't go. It's \"fine\", really...")], "h string, u string, t string")
    r = one.select(html_strip(F.col("h")).alias("h"), url_basename(F.col("u")).alias("u"), treebank_tokens(F.col("t")).alias("t")).first()
    assert r["h"] == " a bd e" and r["u"] == "b.html"
    assert r["t"] == ["i", "ca", "not", "go", "it", "s", "``", "fine", "", "really", "..."]


def test_surrogate_ids(spark):
    e = spark.createDataFrame([(i, a) for i, a in enumerate(["abc", "abc", "bcd", "cde", "abc"])], "seq int, a string")
    assert [r["run"] for r in etl.run_ids(e, "a", ["seq"], F.floor(F.col("seq") / 2), "run").orderBy("seq").collect()] == [0, 0, 1, 2, 3]
    n = spark.createDataFrame([(0, "Nora"), (1, "Piet"), (2, "Zoe"), (3, "Piet"), (4, ""), (5, None)], "seq int, name string")
    assert {r["name"]: r["id"] for r in etl.appearance_ids(n, "name", ["seq"], "id").collect()} == {"Nora": 0, "Piet": 1, "Zoe": 2}


def test_parents_cascade(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(0, 0, "a", None), (0, 1, "b", "a"), (0, 2, "c", "x"), (0, 3, "d", "c"), (0, 4, "e", "b"), (0, 5, "f", "g"), (0, 6, "g", None)]
    c = spark.createDataFrame(rows, "run int, seq int, orig_id string, orig_parent string")
    assert sorted(r["orig_id"] for r in etl.resolved_parents(c).collect()) == ["a", "b", "e", "g"]


def test_csv_round_trip(spark, tmp_path):
    from threadloom.sources.files import read_comments, write_comments

    rows = [("0", "0", "7", 'a "q", b\nc', "t", "", "3", "1"), ("x", "0", "7", "bad", "t", "", "0", "0")]
    write_comments(spark.createDataFrame(rows, "cid string, article_id string, author_id string, text string, time string, parent string, upvotes string, downvotes string"), str(tmp_path / "c"))
    got = read_comments(spark, str(tmp_path / "c")).collect()
    assert [(r["commentId"], r["comment_text"], r["parent_comment_id"], r["upvotes"]) for r in got] == [(0, 'a "q", b\nc', None, 0)]


def test_stream(spark, tmp_path):
    from threadloom.streaming.incremental import grow, grown

    spark.createDataFrame(TEXTS, "cid long, text string").write.parquet(str(tmp_path / "in"))
    q = grow(spark.readStream.schema("cid long, text string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = grown(spark, str(tmp_path / "out"))
    assert {r["term"]: r["idf"] for r in got.terms.collect()}["market"] == pytest.approx(5 / 3)
