"""Engine: readers, batches, phrases, stems, lemmas, numbering, packed lists, the crawl, comment files, streams, the command line."""

import json
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from threadloom import cli, storage
from threadloom.functions import porter, porter2
from threadloom.functions.text import contains_sequence, escape_newlines, html_strip, row_json, sorted_json, unescape_newlines
from threadloom.operators import etl, index
from threadloom.operators.index import SIMPLE, TREEBANK, Analyzer, Index, build, lemmatizer
from threadloom.operators.search import SearchEngine
from threadloom.plans.query import parse, split_operators
from threadloom.sources import api, files
from threadloom.streaming import incremental

TEXTS = [(1, "red fox in the forest"), (2, "red foxes run"), (3, "blue fox; blue sea"), (4, ""), (5, None), (6, "// note of the red fox"), (7, "the the the")]


@pytest.fixture(scope="module")
def simple(spark):
    return build(spark.createDataFrame(TEXTS, "cid long, text string"))


def ids(df):
    return sorted(r["cid"] for r in df.collect())


def brute_postings(rows, stop):
    out = {}
    for cid, text in rows:
        toks = [(w, i) for i, w in enumerate(re.findall(r"[^\W]+", (text or "").lower())) if w not in stop]
        for w, i in toks:
            out.setdefault((w, cid), ([], len(toks)))[0].append(i)
    return {k: (p, len(p) / n) for k, (p, n) in out.items()}


def test_postings_equal_brute_force(spark, simple):
    from threadloom.functions.text import STOPWORDS

    got = {(r["term"], r["cid"]): (r["positions"], r["tf"]) for r in simple.postings.collect()}
    assert got == brute_postings(TEXTS, set(STOPWORDS))
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("cid"), "text")
    got = {(r["term"], r["cid"]): (r["positions"], r["tf"]) for r in index.postings_of(rows).collect()}
    assert got == brute_postings([tuple(r) for r in rows.collect()], set(STOPWORDS))


def test_postings_are_built_without_a_shuffle(simple):
    plan = simple.postings._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("Generate ") == 1


def test_readers(simple, tmp_path):
    i = simple
    assert i.idf("fox") == 7 / 3 and i.idf("nothing") == 0.0 and i.tf("fox", 1) == 1 / 3 and i.tf("fox", 4) == 0.0
    assert i.tf_idf("nothing", 1) == (0.0, 0.0) and i.tf_idf("fox", 4) == (0.0, 7 / 3)
    assert {r["cid"]: r["idf"] for r in i.retrieve("blue").collect()} == {3: 7.0} and i.retrieve("nothing").count() == 0
    assert i.posting_list("blue").first()["positions"] == [0, 2] and i.n_terms() == i.term_list().count() == 8
    assert ids(i.cids()) == [1, 2, 3, 4, 5, 6, 7] and {r["text"] for r in i.documents([2, 99]).collect()} == {"red foxes run"}
    i.save(str(tmp_path / "some"), ["terms", "replies"])
    assert sorted(p.name for p in (tmp_path / "some").iterdir()) == ["replies", "terms"]
    with pytest.raises(ValueError):
        i.save(str(tmp_path / "some"), ["nothing"])


def test_saved_index_is_the_same_and_reads_by_term(spark, simple, tmp_path):
    at = str(tmp_path / "i")
    simple.save(at)
    with Index.load(spark, at) as i:
        key = lambda df: sorted(map(str, df.collect()))
        assert key(i.postings) == key(simple.postings) and key(i.terms) == key(simple.terms) and i.n_docs == 7
        assert "entries" not in i.docs.columns
        assert "PushedFilters: [IsNotNull(term), EqualTo(term,fox)]" in i.posting_list("fox")._jdf.queryExecution().executedPlan().toString()


def test_batches_equal_single_searches(spark, tmp_path):
    rows = [(1, "red fox in the forest", None), (2, "red foxes run", 1), (3, "blue fox; blue sea", 1), (4, "fox fox red", 2)]
    e = SearchEngine(build(spark.createDataFrame(rows, "cid long, text string, parent_cid long")))
    queries = ["red fox", "fox fox blue", "fo*", "the", "zzz", "'red fox'", "red NOT blue", "ReplyTo:1", "ReplyTo:1:2", "NOT x", "zz*"]
    for k in (2, None):
        got = {}
        for r in e.search_many(queries, top_k=k).collect():
            got.setdefault(r["query_id"], []).append(r["cid"])
        for i, q in enumerate(queries):
            assert sorted(got.get(i, [])) == ids(e.search(q, top_k=k)), (q, k)
    assert e.search_many([]).count() == 0


def test_ranked_documents_can_be_filtered(spark, simple):
    e = SearchEngine(simple)
    assert ids(e.search("red fox", keep=F.col("cid") > 1)) == [2, 3, 6] and ids(e.search("re*", keep=F.col("cid") == 1)) == [1]


def test_phrase_with_blanks_and_repeated_ids(spark):
    assert parse(" 'green valley' ").kind == "phrase" and parse("'a\rb'").kind == "keyword" and parse("a\rAND b").kind == "error"
    rows = [(1, "old red fox"), (1, "the red fox is a fox"), (2, "red and fox"), (3, "fox red")]
    e = SearchEngine(build(spark.createDataFrame(rows, "cid long, text string")))
    assert ids(e.search("'red fox'")) == ids(e.search("  'red fox' ")) == [1]


def test_operators_are_split_as_substrings():
    assert split_operators("FORD") == ["F", "OR", "D"] and split_operators("a NOT b AND c OR'x y'") == ["a", "NOT", "b", "AND", "c", "OR", "'x y'"]
    assert split_operators("SANDY") == ["S", "AND", "Y"] and split_operators("xNOTORANDy") == ["x", "NOT", "", "OR", "", "AND", "y"]


@pytest.mark.parametrize("word, want", [("consignment", "consign"), ("consistency", "consist"), ("conspicuous", "conspicu"), ("knightly", "knight"), ("knives", "knive"), ("kneaded", "knead"), ("knavish", "knavish"), ("generate", "generat"), ("skies", "sky"), ("dying", "die"), ("hoping", "hope"), ("hopping", "hop"), ("news", "news"), ("controlling", "control"), ("boyish", "boyish"), ("university", "univers"), ("cry", "cri"), ("say", "say"), ("gas", "gas"), ("ties", "tie"), ("communication", "communic"), ("electricity", "electr")])
def test_porter2(word, want):
    assert porter2.stem(word) == want


def test_stems_of_junk():
    assert porter.stem("y" * 3000 + "ing").endswith("i") and porter2.stem("y" * 3000 + "ing") and porter.stem("") == porter2.stem("") == ""


def test_analyzers(spark):
    terms = lambda a, t: a.terms_of(spark, t)
    assert terms(Analyzer(stemmer="porter2"), "happy generators") == ["happi", "generat"] and terms(TREEBANK, "I can't run") == ["ca", "run"]
    assert terms(Analyzer(stemmer=lemmatizer({"mice": "mouse"})), "Mice and men") == ["mouse", "men"]
    assert terms(Analyzer(stopwords=()).with_stopwords("fox"), "the fox ran") == ["the", "ran"] and terms(SIMPLE.with_stopwords("fox", append=True), "the fox ran") == ["ran"]
    # steps come after stems, the usual one first
    assert terms(Analyzer(tokens=lambda t: F.split(t, " "), stemmer=lambda w: "//" if w == "gone" else w[:3]).with_step(lambda p: F.filter(p, lambda x: x["term"] != "abc")), "gone abcd stays") == ["sta"]
    assert TREEBANK.terms_of(spark, "see //x here", plain=True) == ["see", "here"]


def test_html_strip_keeps_what_the_end_tag_misses(spark):
    one = spark.createDataFrame([(" <script a>x</script >y</SCRIPT>z<style>q</style>w\xa0",), (None,), ("",)], "h string")
    assert [r["t"] for r in one.select(html_strip(F.col("h")).alias("t")).collect()] == ["zw", None, ""]


def test_numbers_without_one_task(spark):
    d = spark.createDataFrame([(f"k{(i * 37) % 500:03d}", i % 7) for i in range(500)], "a string, b int")
    got = [(r["a"], r["n"]) for r in storage.numbered(d, ["a", "b"], "n").collect()]
    assert sorted(n for _, n in got) == list(range(500)) and sorted(got) == sorted(got, key=lambda x: x[1])
    assert storage.numbered(d.limit(0), ["a"], "n").count() == 0


def test_posting_lists_packed_and_as_lines(spark, monkeypatch):
    monkeypatch.setattr(index, "GAP_BLOCK", 4)
    rows = [("a", c, 0.5, [1, 2]) for c in (0, 3, 4, 5, 11, 12, 40)] + [("b", 7, 0.25, [9])]
    p = spark.createDataFrame(rows, "term string, cid long, tf double, positions array<int>")
    assert [r["gap"] for r in index.gaps(p).where("term = 'a'").orderBy("cid").collect()] == [0, 3, 1, 1, 6, 1, 28]
    packed = index.gap_blocks(p)
    assert packed.count() == 6 and sorted(map(tuple, index.from_gap_blocks(packed).collect())) == sorted((t, c) for t, c, _, _ in rows)
    lines = index.posting_lines(p, spark.createDataFrame([("a", 2.0), ("b", 4.0)], "term string, idf double"))
    assert lines.where("term = 'b'").first()["line"] == "4.0;7|0.25|9"
    assert sorted(tuple(r)[:4] for r in index.from_posting_lines(lines).collect()) == sorted(rows)


# Crawl


def node(i, *replies, likes=(), more=None):
    listing = {"nodes": list(replies), "hasNextPage": more is not None, "endCursor": more}
    out = {"id": i, "body": f"<p>text {i}</p>", "created_at": f"t{i}", "user": {"username": f"u{i[0]}"}, "action_summaries": [{"__typename": "LikeActionSummary", "count": n} for n in likes] + [{"__typename": "Other", "count": 9}]}
    return out | ({"replies": listing} if replies or more else {})


def fake_new(request):
    """Two pages of roots, replies five levels deep, and a reply list of two pages."""
    deep = node("a5")
    for i in ("a4", "a3", "a2"):
        deep = node(i, deep)
    if "url" in request:
        return {"data": {"asset": {"id": "asset1", "comments": {"nodes": [node("a1", deep, likes=(3, 4)), node("b1", node("b2"), more="more-b")], "hasNextPage": True, "endCursor": "page2"}}}}
    if request["cursor"] == "page2":
        return {"data": {"comments": {"nodes": [node("c1"), node("a1")], "hasNextPage": False, "endCursor": None}}}
    assert request["parent_id"] == "b1"
    return {"data": {"comments": {"nodes": [node("b3", node("b4"))], "hasNextPage": False, "endCursor": None}}}


def fake_old(request):
    entry = lambda i, parent, replies=None: {"object": {"id": f"http://x/c/{i}?q", "content": f"old {i}", "published": "t", "accumulators": {"repliesCount": replies} if replies else {}}, "actor": {"title": "u1"}, "targets": [{}, {"conversationID": f"http://x/c/{parent}"}], "pageAfter": f"after {i}"}
    if request["childrenof"] == "http://x/c/o1?q":
        return {"entries": [entry("o3", "o1")], "hasMoreChildren": "false"}
    if "pageAfter" in request:
        return {"entries": [entry("o2", "o2")], "hasMoreChildren": "false"}
    return {"entries": [entry("o1", "o1", replies=1)], "hasMoreChildren": "true", "nextPageAfter": "p2"}


def stored(pages, path):
    with open(path, "w", encoding="utf-8") as f:
        for url, page, parent, body in pages:
            f.write(json.dumps({"url": url, "page": page, "parent": parent, "body": body}) + "\n")


def test_records_of_the_newer_api(spark, tmp_path):
    pages = list(api.graphql_pages(fake_new, "http://a/1"))
    assert [p[2] for p in pages] == [None, "b1", None] or sorted(map(str, (p[2] for p in pages))) == ["None", "None", "b1"]
    stored(pages, tmp_path / "new.json")
    rows = api.new_records(api.read_pages(spark, str(tmp_path / "new.json"))).orderBy("path").collect()
    parents = {r["comment_id"]: r["parent_comment_id"] for r in rows}
    assert parents == {"a1": None, "a2": "a1", "a3": "a2", "a4": "a3", "a5": "a4", "b1": None, "b2": "b1", "b3": "b1", "b4": "b3", "c1": None}
    assert [r["comment_id"] for r in rows][:5] == ["a1", "a2", "a3", "a4", "a5"] and {r["article_id"] for r in rows} == {"asset1"}
    assert rows[0]["upvotes"] == 4 and rows[1]["upvotes"] == 0 and rows[0]["article_url"] == "http://a/1"
    roots = spark.createDataFrame([("x", json.dumps(node("a", node("b", node("c"))))), ("x", json.dumps(node("d"))), ("y", json.dumps(node("e")))], "article string, node string").withColumn("path", F.array(F.lit(0).cast("bigint"))).withColumn("parent", F.lit(None).cast("string"))
    assert {r["article"]: r["comments"] for r in etl.count_threads(roots, ["article"]).collect()} == {"x": 4, "y": 1}


def test_crawl_to_comment_files(spark, tmp_path):
    stored(api.graphql_pages(fake_new, "http://a/1"), tmp_path / "new.json")
    stored(api.rest_pages(fake_old, "http://b/2"), tmp_path / "old.json")
    cli.main(["crawl", "--new", str(tmp_path / "new.json"), "--old", str(tmp_path / "old.json"), "--out", str(tmp_path / "data")])
    at = str(tmp_path / "data")
    got = {r["comment_text"]: r for r in files.read_comments(spark, f"{at}/comments", f"{at}/articles", f"{at}/authors").collect()}
    assert len(got) == 13 and " text a1 " in got and got["old o3"]["article_url"] == "http://b/2"
    by_id = {r["commentId"]: t for t, r in got.items()}
    assert by_id[got["old o3"]["parent_comment_id"]] == "old o1" and by_id[got[" text a5 "]["parent_comment_id"]] == " text a4 " and got["old o2"]["parent_comment_id"] is None
    assert sorted(by_id) == list(range(13)) and got["old o1"]["comment_author"] == "u1" and got[" text b3 "]["comment_author"] == "ub"


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset>\n<url><loc>\nhttp://a/?x=1&amp;y=2 </loc></url><url><loc>http://b</loc></url><url><loc>http://b</loc></url></urlset>")
    assert sorted(r["url"] for r in api.read_sitemap(spark, str(tmp_path)).collect()) == ["http://a/?x=1&y=2", "http://b"]


def test_comment_api_as_a_data_source(spark, tmp_path, monkeypatch):
    (tmp_path / "fetchers_for_test.py").write_text('def one(request):\n    return {"entries": [], "hasMoreChildren": "false", "asked": request}\n')
    spark.sparkContext.addPyFile(str(tmp_path / "fetchers_for_test.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    rows = api.fetch_pages(spark, "old", ["http://a", "http://b"], "fetchers_for_test:one").collect()
    assert sorted((r["url"], r["page"], json.loads(r["body"])["asked"]["childrenof"]) for r in rows) == [("http://a", 0, "http://a"), ("http://b", 0, "http://b")]


def test_comment_tables_golden(spark):
    """Four articles of four comments; comments 3 and 4 answer comment 2. Beside them: an orphan, what hangs on it, and empty ids."""
    rows, seq = [], 0
    for i in range(4):
        for k, author in ((1, "ann"), (2, "bob"), (3, "ann"), (4, f"guest{i}")):
            rows.append((seq, f"art{i}", f"http://a/{i}", f"c{k}-{i}", author, "words", "noon", None if k < 3 else f"c2-{i}", 5, 3))
            seq += 1
    extra = [(16, "art3", "http://a/3", "x1", "eve", "orphan", "d", "unknown", 0, 0), (17, "art3", "http://a/3", "x2", "eve", "child", "d", "x1", 0, 0), (18, "art0", "http://a/0", "c1-0", "bob", "again", "d", None, 0, 0), (19, "art0", "http://a/0", "", "bob", "no id", "d", None, 0, 0)]
    t = etl.comment_tables(spark.createDataFrame(rows + extra, "seq long, article_id string, article_url string, comment_id string, comment_author string, comment_text string, timestamp string, parent_comment_id string, upvotes long, downvotes long"))
    comments = sorted(t["comments"].collect(), key=lambda r: r["seq"])
    assert [r["cid"] for r in comments] == [*range(16), 16, None] and [r["article_id"] for r in comments] == [k // 4 for k in range(16)] + [4, 4]
    assert [r["parent"] for r in comments][:8] == [None, None, 1, 1, None, None, 5, 5]
    assert {r["author"]: r["author_id"] for r in t["authors"].collect()} == {"ann": 0, "bob": 1, "guest0": 2, "guest1": 3, "guest2": 4, "guest3": 5, "eve": 6}
    assert {r["article_id"]: r["article_url"] for r in t["articles"].collect()} == {0: "http://a/0", 1: "http://a/1", 2: "http://a/2", 3: "http://a/3", 4: "http://a/0"}
    assert sorted(r["cid"] for r in t["comment_ids"].collect()) == list(range(17))


def test_deep_threads_have_no_cap(spark):
    n = 20
    c = spark.createDataFrame([(0, i, f"c{i}", f"c{i - 1}" if i else None) for i in range(n)], "run int, seq int, orig_id string, orig_parent string")
    assert etl.resolved_parents(c).agg(F.max("depth")).first()[0] == n - 1


# Files


def test_older_files(spark, tmp_path):
    v2, v3 = tmp_path / "raw2", tmp_path / "v3"
    v2.mkdir(), v3.mkdir()
    (v2 / "a.csv").write_text("cid,article_url,author,text,time,parent,votes,article_id\n1,u,x,<b>hi</b>\\nyou,t,,4,9\n")
    (v2 / "b.csv").write_text("cid,article_url,author,text,time,parent,votes,article_id\n2,u,x,bad\x00line,t,,4,9\n")
    (v3 / "c.csv").write_text("cid,article_url,author,text,time,parent,upvotes,downvotes,article_id\n3,u,x,t,t,1,4,2,9\n")
    rows = files.read_raw_folder(spark, str(v2)).collect()
    assert [(r["cid"], r["text"], r["upvotes"], r["downvotes"], r["file"]) for r in rows] == [("1", " hi \nyou", 4, 0, "a.csv")]
    assert [(r["cid"], r["upvotes"], r["downvotes"]) for r in files.read_legacy(spark, str(v3), 3).collect()] == [("3", 4, 2)]
    with pytest.raises(ValueError):
        files.read_legacy(spark, str(v3), 1)
    assert files.without_nul_lines(spark, str(v2), str(tmp_path / "clean")) == 1
    files.migrate(spark, str(v3), 3, str(tmp_path / "moved"))
    assert spark.read.option("header", True).csv(str(tmp_path / "moved")).first()["downvotes"] == "2"


def test_merged_and_packed_files(spark, tmp_path):
    row = "cid string, article_id string, author_id string, text string, time string, parent string, upvotes string, downvotes string"
    for k in (0, 1):
        files.write_comments(spark.createDataFrame([(str(k), "0", "7", f"t{k}\n", "t", "", "3", "1")], row), str(tmp_path / f"f{k}"))
    files.merge_files(spark, [str(tmp_path / "f0"), str(tmp_path / "f1")], str(tmp_path / "all"))
    assert sorted((r["commentId"], r["comment_text"]) for r in files.read_comments(spark, str(tmp_path / "all")).collect()) == [(0, "t0\n"), (1, "t1\n")]
    for kind in ("parquet", "json"):
        files.write_packed(spark.range(3), str(tmp_path / kind), kind)
        assert files.read_packed(spark, str(tmp_path / kind), "id long", kind).count() == 3
    with pytest.raises(ValueError):
        files.write_packed(spark.range(1), "x", "pickle")


def test_small_functions(spark):
    assert sorted_json({"b": "ü", "a": [1]}) == '{"a": [1], "b": "ü"}'
    one = spark.createDataFrame([("x\ny", None)], "b string, a string")
    r = one.select(row_json(["b", "a"]).alias("j"), escape_newlines(F.col("b")).alias("e"), unescape_newlines(escape_newlines(F.col("b"))).alias("u")).first()
    assert r["j"] == '{"a":null,"b":"x\\ny"}' and r["e"] == "x\\ny" and r["u"] == "x\ny"
    assert spark.createDataFrame([(["a", "b"],)], "t array<string>").select(contains_sequence(F.col("t"), F.array().cast("array<string>")), contains_sequence(F.col("t"), F.array(F.lit("b"), F.lit("a")))).first()[:] == (True, False)
    d = spark.createDataFrame([("a\x00",), ("b",)], "t string")
    assert [r["t"] for r in etl.without_nul(d, "t").collect()] == ["b"]


# Streams


def test_growing_index_with_replies_and_search(spark, tmp_path):
    schema = "cid long, text string, parent_cid long"
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in ([(1, "red fox", None), (2, "blue sea", 1)], [(2, "red sea", 1), (3, "green fox", 2)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        incremental.grow(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination()
    i = incremental.grown(spark, out)
    e = SearchEngine(i)
    assert i.n_docs == 3 and i.idf("red") == 1.5 and i.idf("blue") == 0.0
    assert ids(e.search("red")) == [1, 2] and ids(e.search("'red sea'")) == [2] and ids(e.search("ReplyTo:1")) == [2]


def test_handlers(spark, tmp_path):
    d = spark.createDataFrame([(1, "<b>x</b>"), (1, "y"), (2, None)], "id long, t string")
    seen = Observation("seen")
    got = incremental.chain(d, incremental.quarantined(F.col("t").isNotNull(), str(tmp_path / "bad")), incremental.unique("id"), incremental.stripped("t"), incremental.counted(seen), incremental.shown())
    assert got.count() == 1 and seen.get["rows"] == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    assert {r["id"]: r["n"] for r in incremental.counts("id")(d).collect()} == {1: 2, 2: 1}
    incremental.swallowed(d)


def test_listeners_and_streamed_duplicates(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, t string").write.parquet(src)
    heard = []
    stream = spark.readStream.schema("id long, t string").parquet(src)
    incremental.listened(incremental.unique("id")(stream), str(tmp_path / "cp"), lambda rows, n: heard.append((n, rows.count())), lambda rows, n: heard.append(("second", rows.count()))).awaitTermination()
    assert heard == [(0, 2), ("second", 2)]


def test_command_line(spark, tmp_path):
    row = "cid string, article_id string, author_id string, text string, time string, parent string, upvotes string, downvotes string"
    files.write_comments(spark.createDataFrame([("1", "0", "7", "Foxes are running", "t", "", "0", "0"), ("2", "0", "7", "A fox\nran", "t", "1", "0", "0")], row), str(tmp_path / "c"))
    q = tmp_path / "queries.txt"
    q.write_text(f"Index:{tmp_path / 'c'}\nfox\nReplyTo:1\n\n'a fox'\n")
    out = cli.main([str(q), "--index", str(tmp_path / "i"), "--out", str(tmp_path / "o"), "--topN", "5"])
    read = lambda p: sorted(open(p, encoding="utf-8").read().splitlines())
    assert [p.rpartition("/")[2] for p in out] == ["query0.txt", "query1.txt", "query2.txt"]
    assert read(out[0]) == ["1, Foxes are running", "2, A fox\\nran"] and read(out[1]) == read(out[2]) == ["2, A fox\\nran"]
    assert cli.main([f"Index:{tmp_path / 'c'}", "--index", str(tmp_path / "i2")]) == [] and (tmp_path / "i2" / "postings").exists()
    again = cli.main([str(tmp_path / "q2.txt"), "--index", str(tmp_path / "i"), "--out", str(tmp_path / "o2"), "--printIdsOnly"]) if (tmp_path / "q2.txt").write_text("running\n") else []
    assert read(again[0]) == ["1"]
