import math
import os

import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import bm25, changes, fusion, rerank, vector

CHUNKS = [
    ("a", "src/auth/login.py", "python", "def loginUser(name): check the password_hash of the user"),
    ("b", "src/auth/tokens.py", "python", "issue token for the user and refresh the token"),
    ("c", "src/db/connection.py", "python", "open a connection to the database pool"),
    ("d", "src/api/routes.js", "javascript", "route the user request"),
    ("e", "docs/auth-guide.md", "markdown", "Guide: how a user logs in"),
    ("f", "docs/empty.md", "markdown", "a . , ! x"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "id string, file_path string, language string, content string").cache()


@pytest.fixture(scope="module")
def index(chunks):
    toks = bm25.tokens(chunks)
    docs = bm25.doc_lengths(toks)
    return bm25.postings(toks).cache(), docs.cache(), bm25.corpus_stats(docs).cache()


@pytest.mark.parametrize("text,want", [("getUserName", ["get", "user", "name"]), ("snake_case_9x", ["snake", "case", "9x"]), ("The a x HTTPServer café", ["httpserver", "caf"]), ("", []), ("ab AB", ["ab", "ab"])])
def test_terms(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.terms(F.col("t"))).first()[0] == want == tx.terms_of(text)


def test_null_has_no_terms(spark):
    assert spark.createDataFrame([(None,)], "t string").select(tx.terms(F.col("t"))).first()[0] == []


@pytest.mark.parametrize("query", ["user token", "user user login", "database", "zzz", "the of", "password hash"])
def test_scores_follow_the_formula(chunks, index, query):
    want = {i: s for (i, *_), s in zip(CHUNKS, bm25.reference_score(query, [c[3] for c in CHUNKS])) if s}
    for got in (bm25.score(query, *index), bm25.scan_score(query, chunks)):
        got = {r["id"]: r["raw"] for r in got.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in want)


def test_filters_change_no_score(chunks, index):
    alone = {r["id"]: r["score"] for r in bm25.search("user", *index, 10).collect()}
    some = bm25.search("user", *index, 10, F.col("language") == "python", chunks).collect()
    assert {r["id"] for r in some} == {"a", "b"} and all(r["score"] == alone[r["id"]] for r in some)


def test_corpus_without_terms(spark):
    df = spark.createDataFrame([("x", "! ?")], "id string, content string")
    toks = bm25.tokens(df)
    docs = bm25.doc_lengths(toks)
    assert docs.collect()[0]["dl"] == 0
    assert bm25.score("user", bm25.postings(toks), docs, bm25.corpus_stats(docs)).count() == 0 == bm25.scan_score("user", df).count()


def test_updates_equal_a_rebuild(spark, chunks, index):
    post, docs, _ = index
    fresh = spark.createDataFrame([("b", "revoke key")], "id string, content string")
    got = bm25.add(bm25.delete_by_file(post, chunks, chunks.where("id = 'c'").select("file_path")), bm25.postings(bm25.tokens(fresh)))
    rest = chunks.where("id not in ('b', 'c')").select("id", "content").unionByName(fresh)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm25.postings(bm25.tokens(rest)).select(*got.columns).collect()))


@pytest.mark.parametrize(
    "glob,path,want",
    [("src/**", "src/a/b.py", True), ("src/*", "src/a/b.py", False), ("*.py", "a.py", True), ("*.py", "x/a.py", False), ("**/*.py", "a.py", True), ("src/**/x.py", "src/x.py", True), ("", "any", True), ("src\\*.py", "src/a.py", True), ("**/.hid/*", "a/.hid/b", True), ("a?c", "abc", True), ("a", "a\n", False)],
)
def test_globs(spark, glob, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(tx.matches_glob(F.col("p"), glob)).first()[0] is want


def test_cosine(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", [2.0, 2.0])], "id string, vector array<float>")
    got = [(r["id"], r["score"]) for r in vector.search(df, [1.0, 0.0], 5).collect()]
    assert got == [("a", 1.0), ("b", 0.7071), ("e", 0.7071)]
    assert [r["id"] for r in vector.search(df, [0.0, 1.0], 1, F.col("id") != "b").collect()] == ["e"]


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("a", "python", [1.0], "long")], "id string, language string, vector array<float>, content string")
    df.write.parquet(str(tmp_path / "t"))
    plan = vector.search(spark.read.parquet(str(tmp_path / "t")).select("id", "language", "vector"), [1.0], 3, F.col("language") == "python")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(language,python)" in plan and "content" not in plan.split("ReadSchema")[1] and "TakeOrderedAndProject" in plan


def test_fusion(spark):
    v = spark.createDataFrame([("1", "p", 0.95), ("2", "p", 0.8), ("3", "p", 0.7)], "id string, file_path string, score double")
    b = spark.createDataFrame([("2", "q", 8.5), ("1", "q", 6.2), ("4", "q", 4.0)], "id string, file_path string, score double")
    got = {r["id"]: r for r in fusion.fuse(v, b, 0.7).collect()}
    assert got["2"]["fused_score"] == round(0.7 / 62 + 0.3 / 61, 6) and got["4"]["fused_score"] == round(0.3 / 63, 6)
    assert got["1"]["file_path"] == "p" and got["4"]["file_path"] == "q" and got["3"]["bm25_score"] is None
    assert {r["id"]: r["fused_score"] for r in fusion.fuse(v, b, 1.0).collect()}["4"] == 0


def test_hits_without_id_go_by_place(spark):
    s = "id string, file_path string, start_line int, end_line int, chunk_type string, score double"
    v = spark.createDataFrame([(None, "p", 1, 5, "function", 0.9), (None, "p", 1, 9, "class", 0.8)], s)
    b = spark.createDataFrame([("", "p", 1, 5, "function", 3.0)], s)
    assert sorted((r["end_line"], r["bm25_score"]) for r in fusion.fuse(v, b, 0.5).collect()) == [(5, 3.0), (9, None)]


def test_rerank(spark):
    df = spark.createDataFrame([("a", "user token", 1.0), ("b", "user", 0.5), ("c", "  ", 0.4), ("d", "token", 0.3)], "id string, content string, score double")
    got = [(r["id"], r["rerank_score"]) for r in rerank.rerank(df, "user token", 3, order=F.desc("score")).collect()]
    assert got == [("a", 1.0), ("b", 0.5), ("d", 0.5)]
    rerank.register("length", lambda: lambda q, c: [float(len(x)) for x in c])
    assert rerank.rerank(df, "q", 1, "length").first()["id"] == "a"
    # A model that isn't there, or that fails, leaves the list in its order.
    kept = [r["id"] for r in df.orderBy(F.desc("score"), "id").limit(2).collect()]

    def broken(q, c):
        raise RuntimeError("no memory")

    rerank.register("broken", lambda: broken)
    for model in ("never/heard-of", "broken"):
        got = rerank.rerank(df, "q", 2, model, F.desc("score")).collect()
        assert [r["id"] for r in got] == kept and [r["rerank_score"] for r in got] == [None, None]


def test_a_scorer_is_made_once_in_a_worker(spark, tmp_path):
    def make():
        with open(tmp_path / "made", "a") as f:
            f.write(f"{os.getpid()} ")
        return lambda q, c: [1.0] * len(c)

    rerank.register("counted", make)
    df = spark.range(50).selectExpr("cast(id as string) as id", "'text' as content", "1.0 as score").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert rerank.rerank(df, "q", 50, "counted").count() == 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    workers = (tmp_path / "made").read_text().split()
    assert len(workers) == len(set(workers)) <= 4  # ten batches


def test_changes(spark):
    files = spark.createDataFrame([("same", "1"), ("new", "1"), ("edit", "2"), ("null", None)], "file_path string, hash string")
    was = spark.createDataFrame([("same", "1"), ("edit", "1"), ("gone", "1"), ("null", None)], "file_path string, hash string")
    got = dict(map(tuple, changes.changes(files, was).collect()))
    assert got == {"same": "unchanged", "new": "new", "edit": "changed", "gone": "deleted", "null": "changed"}
    assert dict(map(tuple, changes.changes(files, was, full=True).collect()))["same"] == "changed"


def test_paths(spark):
    rows = [("a/b.PY", "py", "python"), (".gitignore", "", None), ("x.tar.gz", "gz", None), ("d.v1/readme", "", None), ("y.h", "h", "c"), ("z.ditamap", "ditamap", "ditamap")]
    for p, ext, lang in rows:
        assert tuple(spark.createDataFrame([(p,)], "p string").select(tx.extension(F.col("p")), tx.language(F.col("p"))).first()) == (ext, lang)


def test_overlap_holds_every_vector(spark, tmp_path):
    import random

    from quern.plans.catalog import QUERIES

    r = random.Random(3)
    data = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(2500)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {x.id: x for x in QUERIES["rrf_overlap"](spark, str(tmp_path)).collect()}
    assert len(out) == 2500
    first = {i: n for n, i in enumerate(sorted(out, key=lambda i: (-out[i].vector_score, i)), 1)}
    second = {i: n for n, i in enumerate(sorted(out, key=lambda i: (-out[i].bm25_score, i)), 1)}
    assert all(abs(x.fused_score - 0.7 / (60 + first[i]) - 0.3 / (60 + second[i])) < 1e-6 for i, x in out.items())


def test_a_document_that_comes_again_without_terms(spark, tmp_path):
    """Its older terms go: 'of' backwards is a term, forwards it is none."""
    from quern.plans.catalog import QUERIES

    rows = [(1, "of", "en", "src2"), (2, "user token user", "en", "src2"), (3, "kept words", "en", "src1"), (4, None, "en", "src9")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["incremental_equals_full"](spark, str(tmp_path)).collect()))
    assert got == [(2, "token", 1), (2, "user", 2), (3, "kept", 1), (3, "words", 1)]
    old, fresh = (spark.createDataFrame(x, "term string, id string, tf int") for x in ([("fo", "a", 1), ("new", "b", 1)], [("user", "c", 1)]))
    assert sorted(r.id for r in bm25.add(old, fresh, spark.createDataFrame([("a",), ("c",)], "id string")).collect()) == ["b", "c"]


TEXTS = ["getUserName aBcD ABc", "snake_case_9x user user", "The a x HTTPServer café straßeNameÜber Ab", "", None, "of the", "ab AB aB\n\nab\ttoken", "x" * 5000 + " y9 " * 700]


def test_texts_are_counted_where_they_lie(spark, monkeypatch):
    """As by exploded terms, whatever the slices; nothing is shuffled."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, content string").coalesce(1)
    want = sorted(map(tuple, bm25.postings(bm25.tokens(df)).select("term", "id", "tf").collect()))
    long = sorted(map(tuple, bm25.lengths(df).collect()))
    for most in (1, 40, bm25.SLICE):
        monkeypatch.setattr(bm25, "SLICE", most)
        docs = bm25.counted(df)
        assert sorted(map(tuple, bm25.unfold(docs).collect())) == want and sorted(map(tuple, docs.select("id", "dl").collect())) == long
    assert "Exchange" not in bm25.unfold(docs)._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_id_are_one_document(spark):
    df = spark.createDataFrame([("a", "user of"), ("a", "User token"), ("b", None), ("a", None), (None, "x1"), (None, "x1")], "id string, content string")
    want = sorted(map(str, bm25.postings(bm25.tokens(df)).select("term", "id", "tf").collect()))
    docs = bm25.counted(df)
    assert sorted(map(str, bm25.unfold(docs).collect())) == want and docs.count() == 3


def test_documents_are_deleted_before_their_terms_are_listed(spark, tmp_path):
    """What is joined is a row a document, not a row a posting."""
    from quern.plans.catalog import QUERIES

    rows = [(1, "user token user", "en", "src4"), (2, "user words", "en", "src1"), (3, "user", "en", "src4")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["delete_by_file"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("user", 1, 1), ("words", 1, 1)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftAnti")  # nearer the result
