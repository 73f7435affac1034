import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.predicates import Field
from lodestone.functions.schema import MetadataField, MetadataSchema
from lodestone.operators import catalog, chat, citations, evaluation, models, search, summarize
from lodestone.operators.chunking import chunk, chunk_sql, spans, token_length, units
from lodestone.sources import files

from .conftest import same_rows


def test_search_many_agrees_with_one(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id in (5, 6)").selectExpr("vec_id as query_id", "embedding as query")
    for metric in search.METRICS:
        many = {(r["query_id"], r["rank"]): r["vec_id"] for r in search.search_many(rows, asked, 7, metric).collect()}
        q = rows.where("vec_id = 5").first()["embedding"]
        one = search.search_one(rows, q, 7, metric, F.col("vec_id") != 5).collect()
        assert [many[5, r["rank"]] for r in one] == [r["vec_id"] for r in one]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [inf, 1.0]), (9, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids = lambda out: [r["vec_id"] for r in out.orderBy("rank").collect()]
    assert ids(search.search_one(df, [1.0, 0.1], 9)) == [1, 4, 2, 9] and ids(search.search_one(df, [1.0, 0.1], 9, "cosine")) == [1, 9, 2]
    for bad, metric in (([nan, 1.0], "l2"), ([0.0, 0.0], "cosine"), ([None, 1.0], "l2")):
        with pytest.raises(ValueError):
            search.search_one(df, bad, 3, metric)
    asked = df.selectExpr("vec_id as query_id", "embedding as query")
    for metric, n in (("l2", 4), ("cosine", 3)):
        out = search.search_many(df, asked, 9, metric).groupBy("query_id").count().collect()
        assert len(out) == n and all(r["count"] == n - 1 for r in out)
    assert search.search_many(df, asked.where("query is null"), 3).count() == 0


def test_questions_without_terms(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert search.bm25(docs, []).count() == search.bm25(docs, [""]).count() == search.bm25(docs.where("false"), ["a"]).count() == 0
    assert search.bm25(docs, []).dtypes == search.bm25(docs, ["a"]).dtypes
    assert docs.select(search.lexical_score([], F.col("text"))).first()[0] == -5.0
    r = spark.createDataFrame([("a b", "B x"), ("", "a"), ("a", None)], "q string, t string").select(models.shared_words(F.col("q"), F.col("t")))
    assert [x[0] for x in r.collect()] == [0.0, -5.0, -5.0]


def test_first_sentences_stop_at_the_one_that_does_not_fit(spark):
    r = spark.range(1).select(models.first_sentences(F.lit("One two. This sentence is far too long to fit. Six."), 20), models.first_sentences(F.lit("This one is too long by itself. B."), 5), models.first_sentences(F.lit(""), 5)).first()
    assert tuple(r) == ("One two.", "This one is too long by itself.", "")


def test_rerank_and_boosts(spark):
    asked = spark.createDataFrame([(1, "red fish"), (2, "blue")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 10, "a red fish"), (1, 11, "a fish"), (1, 12, "none"), (2, 10, "a red fish"), (2, 13, "blue"), (3, 13, "blue")], "query_id long, pk long, text string")
    got = [(r["query_id"], r["pk"], r["rank"]) for r in search.rerank(asked, hits, models.shared_words, 2, 0.4).orderBy("query_id", "rank").collect()]
    assert got == [(1, 10, 1), (1, 11, 2), (2, 13, 1)]
    a = spark.createDataFrame([(1, 9.0), (2, 5.0)], "pk long, score double")
    b = spark.createDataFrame([(2, 4.0), (3, 2.0)], "pk long, score double")
    assert {r["pk"]: r["score"] for r in search.boosted_sum(a, b, 1.0, 0.5).collect()} == {1: 9.0, 2: 7.0, 3: 1.0}


def test_fan_out(spark):
    schema = MetadataSchema((MetadataField("n", "integer"),))
    rows = spark.createDataFrame([(i, "abc"[i % 3], i, float(i)) for i in range(30)], "pk long, collection_name string, n long, distance double")
    out = search.fan_out(rows, {"c": Field(schema, "n").compare(">", 10), "a": Field(schema, "n").compare("<", 5)}, lambda x: x, 2).orderBy("place", "rank").collect()
    assert [(r["place"], r["collection_name"], r["pk"]) for r in out] == [(0, "c", 11), (0, "c", 14), (1, "a", 0), (1, "a", 3)]
    for n in (0, 6):
        with pytest.raises(ValueError):
            search.fan_out(rows, {str(i): Field(schema, "n").compare(">", 1) for i in range(n)}, lambda x: x, 2)


def test_top_k_grows_by_rows(spark):
    rows = spark.range(100).select(F.col("id").alias("pk"), (F.col("id") % 7).alias("s"), (F.col("id") % 3).alias("g"))
    five = {r["pk"] for r in search.top_k(rows, "s", 5, ["g"]).collect()}
    six = {r["pk"] for r in search.top_k(rows, "s", 6, ["g"]).collect()}
    assert five < six and len(six) == 18
    assert search.top_k(rows, "s", 3).count() == 3


def test_fusion_and_scores(spark):
    a = spark.createDataFrame([(1, 9.0, 1), (2, 5.0, 2)], "pk long, score double, rank long")
    b = spark.createDataFrame([(2, 4.0, 1), (3, 2.0, 2)], "pk long, score double, rank long")
    rrf = {r["pk"]: r["score"] for r in search.reciprocal_rank_fusion([a, b]).collect()}
    assert rrf[2] == pytest.approx(1 / 62 + 1 / 61) and rrf[1] == pytest.approx(1 / 61)
    w = {r["pk"]: r["score"] for r in search.weighted_fusion(a, b, 0.7, 0.3).collect()}
    assert w == {1: 0.7, 2: 0.3, 3: 0.0}
    s = spark.createDataFrame([(1, "0.5"), (2, "x"), (3, None), (4, "0.2")], "pk long, relevance_score string")
    assert {r["pk"] for r in search.confident(s, 0.3).collect()} == {1}
    assert search.confident(s, 0.0).count() == 4
    with pytest.raises(ValueError):
        search.confident(s, 1.5)
    for bad in ((5, 6), (0, 1), (True, 1), (5, 1.0)):
        with pytest.raises(ValueError):
            search.check_limits(*bad)


def test_merge_keeps_first(spark):
    a = spark.createDataFrame([(2, "x"), (1, "x"), (3, None)], "pk long, content string")
    b = spark.createDataFrame([(0, "x"), (9, "y")], "pk long, content string")
    assert {(r["list_no"], r["pk"]) for r in search.merge_contexts([a, b]).collect()} == {(0, 1), (0, 3), (1, 9)}
    assert search.merge_contexts([a.union(a), b]).count() == 3


def test_recall(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "a", 3)], "query_id string, item string, rank int")
    relevant = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "c"), ("p", "z")], "query_id string, item string")
    got = {r["k"]: r["recall"] for r in evaluation.recall_at(hits, relevant, (1, 3)).collect()}
    assert got == {1: pytest.approx(1 / 6), 3: pytest.approx(1 / 6)}


def test_catalog(spark):
    chunks = spark.createDataFrame([(3, "c", "a.pdf", "late"), (1, "c", "a.pdf", "early"), (2, "c", "b.pdf", "x"), (4, "meta", "m", "y")], "pk long, collection_name string, document_name string, v string")
    assert {(r["document_name"], r["v"]) for r in catalog.documents_of(chunks).collect()} == {("a.pdf", "early"), ("b.pdf", "x"), ("m", "y")}
    none = spark.createDataFrame([], "collection_name string, x string")
    assert [r["num_entities"] for r in catalog.list_collections(chunks, none, none.withColumnRenamed("x", "y")).collect()] == [3]
    names = spark.createDataFrame([("a.pdf",), ("zz",)], "document_name string")
    stay, status = catalog.delete_documents(chunks, names)
    assert stay.count() == 2 and {tuple(r) for r in status.collect()} == {("a.pdf", "deleted"), ("zz", "not_found")}
    assert catalog.delete_documents(stay, names)[0].count() == 2
    info = spark.createDataFrame([("c", 10, True, "old", 1), ("c", 5, None, "new", 2), ("d", None, None, None, 1)], "k string, n long, has_x boolean, note string, seq int")
    got = {r["k"]: tuple(r) for r in catalog.merge_info(info, ["k"], ["n"], ["has_x"], ["note"], "seq").collect()}
    assert got == {"c": ("c", 15, True, "new"), "d": ("d", 0, False, None)}
    assert {tuple(r) for r in catalog.upsert(names.withColumn("v", F.lit(1)), spark.createDataFrame([("a.pdf", 2)], "document_name string, v int"), ["document_name"]).collect()} == {("a.pdf", 2), ("zz", 1)}


def test_page_filter(spark):
    pages = spark.createDataFrame([("a", i) for i in range(1, 6)] + [("b", 1)], "f string, page_number int")
    got = lambda w: sorted((r["f"], r["page_number"]) for r in catalog.page_filter(pages, w, ["f"]).collect())
    assert got("even") == [("a", 2), ("a", 4)] and len(got("ODD")) == 4
    assert got([[-2, -1]]) == [("a", 4), ("a", 5), ("b", 1)]
    assert got([[7, 9]]) == [("a", 5), ("b", 1)]
    for bad in ("all", [[0, 1]], [[-1, 2]], [[3, 2]]):
        with pytest.raises(ValueError):
            catalog.page_filter(pages, bad, ["f"])


def test_chunks_cover_every_token(spark):
    rng = np.random.default_rng(11)
    pieces = ["word", " ", "  ", "\n", "\n\n", ". ", "!", "? ", "é", "日本", "😀", "x1", "\t", " \n \n", "_a", "-"]
    texts = ["", "  ", "one", "One two three. Four five six! Seven eight nine? Ten eleven twelve.\n\nThirteen " * 4]
    texts += ["".join(rng.choice(pieces, rng.integers(1, 400))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((20, 5), (7, 0), (3, 1), (1, 0), (10, 9), (500, 20)):
        got = {}
        for r in docs.select("doc_id", units(F.col("text")).alias("u")).where("size(u) > 0").collect():
            parts, at = r["u"], spans("".join(r["u"]), np.cumsum([len(u) for u in r["u"]]), size, min(overlap, size // 2))
            assert "".join(parts) == texts[r["doc_id"]]
            assert at[0][0] == 0 and at[-1][1] == len(parts)
            assert all(0 < y - x <= size for x, y in at)
            assert all(a0 < b0 <= a1 < b1 for (a0, a1), (b0, b1) in zip(at, at[1:])), (size, overlap, at)
            got[r["doc_id"]] = ["".join(parts[x:y]) for x, y in at]
        rows = {}
        for r in chunk(docs, size, overlap).orderBy("doc_id", "chunk_no").collect():
            rows.setdefault(r["doc_id"], []).append(r["chunk"])
        assert rows == {k: v for k, v in got.items() if texts[k].strip(" \n\t")}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert same_rows(chunk(docs, 20, 5), con, chunk_sql(20, 5)) > 100


def test_chunks_end_at_the_strongest_boundary(spark):
    text = "a b c d e. f g\n\nh i. j k l m n o p q r s t u v w x y z"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r["chunk"] for r in chunk(docs, 12, 2).orderBy("chunk_no").collect()]
    assert got[0] == "a b c d e. f g\n\nh i. " or got[0] == "a b c d e. f g\n\n"
    assert spark.range(1).select(token_length(F.lit("It's 12, ok"))).first()[0] == 6


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (4, " \n ")], "id long, text string")
    assert {r["id"] for r in chunk(docs, 3, 0).collect()} == {1}
    with pytest.raises(ValueError):
        chunk(docs, 0)


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "hi {x}"), (1, 2, "assistant", " "), (1, 3, "user", "bye {y}"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert chat.last_turns(rows, 1).count() == 3 and chat.last_turns(rows, 0).count() == 0
    got = {r["conv_id"]: r for r in chat.asked(rows).collect()}
    assert got[1]["query"] == "bye {{y}}" and got[1]["n_history"] == 2
    assert {r["query"] for r in chat.concatenated(rows).collect()} == {"hi {x}. bye {y}", ""}
    lines = spark.createDataFrame([(1, "1. first?\nnone\n 2.  second")], "k long, t string")
    assert [r["query"] for r in chat.sub_queries(lines, "k", "t").orderBy("ordinal").collect()] == ["first?", "second"]


def test_text_functions(spark):
    rows = spark.createDataFrame([("a/b/C.Tar.GZ", "<think>x</think>y", "score 1 or 2")], "p string, t string, s string")
    r = rows.select(T.basename(F.col("p")), T.strip_extension(T.basename(F.col("p"))), T.extension(F.col("p")), T.think_strip(F.col("t")), T.first_score(F.col("s")), T.html_text(F.lit("<p>a&amp;b<script>no</script> &lt;c&gt;</p>")), T.escape_braces(F.lit("{a}"))).first()
    assert tuple(r) == ("C.Tar.GZ", "C.Tar", "gz", "y", 2, "a&b <c>", "{{a}}")
    box = F.array(F.lit(0.12345), F.lit(1.0))
    assert rows.select(T.object_key(F.lit("c"), F.lit("f"), F.lit(3), box)).first()[0] == "c_::_f_::_3_0.1235_1.0000"
    none = F.lit(None).cast("array<double>")
    assert rows.select(T.location(none, box, none, F.array(F.lit(9.0)))).first()[0] == [0.12345, 1.0, 9.0]
    assert rows.select(T.extension(F.lit("noext"))).first()[0] == "unknown"


def test_citations(spark):
    hits = spark.createDataFrame([("1", "text", "t"), ("2", "image", "raw"), ("3", "chart", "raw"), ("4", "video", "v"), ("5", "text", "")], "key string, doc_type string, content string")
    payloads = spark.createDataFrame([("2", "payload")], "key string, content string")
    assert {(r["key"], r["content"]) for r in citations.citations(hits, payloads).collect()} == {("1", "t"), ("2", "payload")}


def test_batches_and_levels(spark):
    got = spark.range(1).select(summarize.batch_numbers(F.array(*(F.lit(x).cast("long") for x in (5, 5, 1, 20, 3))), 10)).first()[0]
    assert got == [0, 0, 1, 2, 3]
    chunks = spark.createDataFrame([(1, i, f"Sentence {i} is here. More of it.") for i in range(9)] + [(2, 0, "Only one.")], "doc long, chunk_no long, chunk string")
    rows = summarize.hierarchical(chunks, "doc", 60, max_chars=40).collect()
    last = {r["doc"]: r for r in rows if r["summary"] is not None}
    assert set(last) == {1, 2} and last[2]["level"] == 0 and last[1]["n_summaries"] == 1
    assert all(r["n_summaries"] > 1 or r["summary"] for r in rows)
    assert summarize.iterative(chunks, "doc").count() == 2
    v = spark.range(1).select(models.hashed_embedding(F.lit("a b a"), 8)).first()[0]
    assert sum(x * x for x in v) == pytest.approx(1)


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, content in (("a.txt", "hello"), ("sub/b.html", "<b>x</b> y"), ("c.rtf", "no")):
        (tmp_path / "in" / name).write_text(content)
    assert {r["document_name"] for r in files.discover(spark, str(tmp_path / "in")).collect()} == {"a.txt", "b.html"}
    assert {tuple(r) for r in files.read_texts(spark, str(tmp_path / "in")).collect()} == {("a.txt", "hello"), ("b.html", "x y")}
    rows = spark.createDataFrame([(1, "c"), (2, "d")], "pk long, collection_name string")
    files.write_collection(rows, str(tmp_path / "store"))
    back = files.read_collections(spark, str(tmp_path / "store"), ["d"])
    assert [r["pk"] for r in back.collect()] == [2]
    assert "PartitionFilters: [isnotnull(collection_name" in back._jdf.queryExecution().executedPlan().toString()


def test_stream_does_not_store_twice(spark, tmp_path):
    from lodestone.streaming import ingest

    schema = "collection_name string, document_name string, text string, ts timestamp"
    src = str(tmp_path / "src")
    rows = spark.createDataFrame([("c", "a", "x y", None), ("c", "a", "x y", None), ("c", "b", "z", None)], schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    rows.write.parquet(src)
    for _ in range(2):
        ingest.ingest(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"), 8, 0).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    rows.select("collection_name", F.lit("a").alias("document_name"), "text", "ts").limit(1).write.mode("append").parquet(src)
    ingest.ingest(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"), 8, 0).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_store(spark, tmp_path):
    from lodestone.sources.store import ParquetStore

    store = ParquetStore(spark, f"file://{tmp_path}/s", "pk long, document_name string, collection_name string")
    assert store.names() == [] and store.chunks().count() == 0
    assert store.create("a", MetadataSchema((MetadataField("title"),))) == "created" and store.create("a") == "exists"
    assert store.create_all(["b", "", "meta"])["b"] == "created" and store.names() == ["a", "b"]
    assert [f.name for f in store.schema("a").fields][:2] == ["title", "filename"]
    store.add(spark.createDataFrame([(1, "x", "a"), (2, "y", "a"), (3, "z", "b")], "pk long, document_name string, collection_name string"))
    store.put_info("document", spark.createDataFrame([("a", "x", 5), ("a", "y", 6)], "collection_name string, document_name string, n long"))
    store.put_info("document", spark.createDataFrame([("a", "x", 7)], "collection_name string, document_name string, n long"))
    assert {(r["document_name"], r["n"]) for r in store.info("document", "n long").collect()} == {("x", 7), ("y", 6)}
    store.replace_without("a", spark.createDataFrame([("x",), ("none",)], "document_name string"))
    assert [r["pk"] for r in store.chunks(["a"]).collect()] == [2]
    assert [r["document_name"] for r in store.info("document", "n long").collect()] == ["y"]
    store.add(spark.createDataFrame([(4, "w", "a")], "pk long, document_name string, collection_name string"))
    assert sorted(r["pk"] for r in store.chunks(["a"]).collect()) == [2, 4]
    keys = [("a_::_y_::_1", "p", "a"), ("a_::_w_::_1", "q", "a"), ("b_::_z_::_1", "r", "b")]
    store.add_payloads(spark.createDataFrame(keys, "key string, content string, collection_name string"))
    put, store._put = store._put, lambda rows: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):  # it breaks off before the switch: nothing has changed
        store.replace_without("a", spark.createDataFrame([("w",)], "document_name string"))
    store._put = put
    assert sorted(r["pk"] for r in store.chunks(["a"]).collect()) == [2, 4] and store.payloads(["a"]).count() == 2
    store.replace_without("a", spark.createDataFrame([("w",)], "document_name string"))
    assert [r["pk"] for r in store.chunks(["a"]).collect()] == [2] and [r["key"] for r in store.payloads(["a"]).collect()] == ["a_::_y_::_1"]
    store.put_schema("a", MetadataSchema((MetadataField("other"),)))
    assert store.schema("a").fields[0].name == "other"
    with pytest.raises(ValueError):
        store.put_schema("nowhere", MetadataSchema())
    assert store.drop(["a", "c"]) == {"a": "deleted", "c": "not_found"}
    assert store.names() == ["b"] and [r["pk"] for r in store.chunks().collect()] == [3] and store.info("document", "n long").count() == 0
    assert [r["key"] for r in store.payloads().collect()] == ["b_::_z_::_1"]
    assert store.create("a") == "created" and store.chunks(["a"]).count() == 0
    store.add(spark.createDataFrame([(9, "n", "a")], "pk long, document_name string, collection_name string"))
    assert sorted(r["pk"] for r in store.chunks().collect()) == [3, 9]


def test_loops(spark):
    from lodestone.operators import loops

    rows = spark.createDataFrame([("q", "bad"), ("q", "2 fine"), ("q", None)], "question string, answer string")
    score = lambda q, a: F.coalesce(T.first_score(a), F.lit(0))
    out = loops.reflect(rows, score, lambda q, a: F.lit("1"), threshold=2).collect()
    assert sorted((r["score"], r["tries"], r["grounded"]) for r in out) == [(1, 3, False), (1, 3, False), (2, 0, True)]
    lost = loops.reflect(rows, score, lambda q, a: F.lit(loops.OUT_OF_CONTEXT + " 2")).collect()
    assert sorted((r["answer"] or "", r["tries"]) for r in lost) == [("", 1), ("2 fine", 0), ("bad", 1)]
    asked = spark.createDataFrame([(1, "a b")], "question_id long, question string")
    found = loops.decompose(asked, lambda q: F.split(q, " "), lambda q: q.select("question_id", F.length("query").cast("long").alias("pk"), F.col("query").alias("content")), lambda q, c: F.when(c == "a", "more"), 3)
    assert {(r["depth"], r["content"]) for r in found.collect()} == {(0, "a"), (0, "b"), (1, "more")}
    r = spark.range(1).select(loops.similarity_ratio(F.lit("abcd"), F.lit("abxd")), loops.similarity_ratio(F.lit(""), F.lit(""))).first()
    assert tuple(r) == (0.75, 1.0)


def test_similarity_of_whole_texts(spark, tmp_path):
    from lodestone.jobs import catalogue

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(5)
    new = lambda n: "".join(rng.choice(list("abcé日 "), n))
    long = new(700)
    pairs = [("ab", "ab"), (long, long[:500] + new(150)), (new(199), new(201)), ("é" * 300, "ü" * 300), ("", ""), ("", None), (None, new(9)), (None, None), (new(400), "")]
    rows = [(i, turn, text) for i, (a, b) in enumerate(pairs) for turn, text in ((0, a), (1, "between"), (2, b))] + [(99, 0, "alone")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["ratio"] for r in catalogue.QUERIES["page_similarity_whole"](spark, f"file://{tmp_path}").collect()}
    want = {i: None if a is None or b is None else 1.0 if a == b else 1 - distance(a, b) / max(len(a), len(b)) for i, (a, b) in enumerate(pairs)}
    assert got == {i: None if x is None else pytest.approx(x, abs=1e-6) for i, x in want.items()}


def test_single_pass_cuts_only_what_is_too_long(spark):
    rows = spark.createDataFrame([(1, "word " * 10), (2, "extraordinarily " * 10), (3, "word " * 11), (4, ""), (5, None)], "doc int, text string")
    got = {r["doc"]: r["summary"] for r in summarize.single_pass(rows, 10, lambda p, n: p).collect()}
    assert got == {1: "word " * 10, 2: "extraordinarily " * 10, 3: ("word " * 11)[:40], 4: "", 5: None}


def test_progress_counts_each_task_by_itself(spark):
    rows = [("a", 1, "completed"), ("a", 1, "extracted"), ("a", 2, "completed"), ("a", 2, "failed"), ("b", 2, "completed")]
    got = catalog.progress(spark.createDataFrame(rows, "task_id string, batch_no int, status string")).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 1, 0, 2), ("a", 2, 2, 1, 3), ("b", 2, 1, 1, 1)]
