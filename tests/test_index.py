import io
import json

import pytest
from pyspark.sql import functions as F

from quern import cli, service
from quern import config as cfg
from quern.errors import ConfigError, EmbeddingError, QuernError, TooLargeError
from quern.functions import embed
from quern.plans.index import build
from quern.plans.search import Query
from quern.service import IndexService
from quern.sources.ignore import Rules
from quern.sources.scan import list_files, listed
from quern.store import Store
from quern.streaming.ingest import index_stream, token_counts


@pytest.fixture
def project(tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put(".index/config.json", json.dumps({"embedding": {"dimensions": 32}, "chunking": {"min_tokens": 2}, "later": 1}))
    put("src/auth.py", "def login(user):\n    return check_password(user)\n")
    put("src/__init__.py", "VERSION = 'one two three'\n")
    put(".hidden/notes.md", "# Notes\n\nhidden words about tokens\n")
    put("docs/guide.md", "# Guide\n\nHow a user gives the password to log in\n")
    put("node_modules/x.js", "var a = 1;\n")
    put("big.txt", "x" * 600_000)
    put("skip.txt", "ignored words here")
    put(".gitignore", "skip.txt\n")
    return tmp_path, put


def test_scan(project):
    root, _ = project
    assert [p for p, _ in list_files(str(root), cfg.Indexing())] == [".hidden/notes.md", "docs/guide.md", "src/__init__.py", "src/auth.py"]
    assert "skip.txt" in [p for p, _ in list_files(str(root), cfg.Indexing(respect_gitignore=False))]


@pytest.mark.parametrize(
    "rules,path,want",
    [(["*.pyc"], "a/b.pyc", True), (["build/"], "build/x", True), (["build/"], "build", False), (["/top"], "a/top", False), (["a/*/c"], "a/b/c", True), (["a/**/c"], "a/c", True), (["*.log", "!keep.log"], "keep.log", False), (["# c", ""], "c", False), (["[ab].txt"], "b.txt", True), (["[!ab].txt"], "b.txt", False), (["doc/**"], "doc/x/y", True), (["**/tmp"], "a/tmp/f", True)],
)
def test_rules(rules, path, want):
    assert Rules(rules)(path) is want


def test_build_search_update(spark, project):
    root, put = project
    s = IndexService(spark, str(root))
    assert s.search("user", mode="keyword")["error_type"] == "QuernError"
    made = s.build()
    assert (made["status"], made["files_indexed"], made["files_failed"]) == ("success", 4, 0)
    assert s.build()["status"] == "up_to_date"
    hits = s.search("password user", mode="keyword", threshold=0.0)["results"]
    assert {h["file_path"] for h in hits} == {"src/auth.py", "docs/guide.md"} and [h["rank"] for h in hits] == [1, 2]
    assert [h["file_path"] for h in s.search("password user", mode="hybrid", path="docs/**")["results"]][0] == "docs/guide.md"
    assert s.search("user", mode="vector", language="python", threshold=-1.0)["results"][0]["language"] == "python"
    assert s.search("user", mode="keyword", threshold=99.0)["total_results"] == 0
    assert "rerank_score" in s.search("log in", mode="hybrid", rerank=True)["results"][0]

    put("src/auth.py", "def logout(session):\n    return close(session)\n")
    (root / "docs/guide.md").unlink()
    state = s.status()
    assert (state["stale_files"], state["deleted_files"], state["total_files"], state["languages"]) == (1, 1, 4, {"python": 2, "markdown": 2})
    s.build()
    assert s.search("password", mode="keyword", threshold=0.0)["total_results"] == 0
    part = {t: sorted(map(str, s.store.read(t).select(*c).collect())) for t, c in (("postings", ("term", "id", "tf")), ("docs", ("id", "dl")), ("stats", ("n_docs", "total_len")))}
    s.build(full=True)
    assert part == {t: sorted(map(str, s.store.read(t).select(*c).collect())) for t, c in (("postings", ("term", "id", "tf")), ("docs", ("id", "dl")), ("stats", ("n_docs", "total_len")))}
    assert s.store.vacuum() >= 2 and s.status()["stale_files"] == 0
    assert s.build(batch_size=0)["error_type"] == "ConfigError"


def test_pointer_that_cannot_be_read(spark, tmp_path):
    """The one before it counts, and no generation is written over."""
    st = Store(spark, f"file://{tmp_path}/t")
    assert not st.has("chunks") and st.read("chunks").count() == 0 and st.pointer()["generation"] == 0
    docs = lambda *ids: spark.createDataFrame([(x, 1) for x in ids], "id string, dl int")
    assert (st.write({"docs": docs("a")}), st.write({"docs": docs("a", "b")})) == (1, 2)
    (tmp_path / "t" / "pointer-000000000003.json").write_text("{broken")
    assert st.pointer()["generation"] == 2 and st.read("docs").count() == 2
    assert st.write({"docs": docs("c")}) == 4 and sorted(p.name for p in (tmp_path / "t").glob("gen-*")) == ["gen-1", "gen-2", "gen-4"]
    for p in (tmp_path / "t").glob("pointer-*"):
        p.write_text("[]")
    assert not st.known("docs") and st.write({"docs": docs("d")}) == 5 and (tmp_path / "t" / "gen-1" / "docs").exists()


def test_a_write_that_dies_leaves_the_old_index(spark, tmp_path, monkeypatch):
    st = Store(spark, f"file://{tmp_path}/t")
    docs = lambda *ids: spark.createDataFrame([(x, 1) for x in ids], "id string, dl int")
    st.write({"docs": docs("a", "b")})

    def die(*_):
        raise KeyboardInterrupt

    whole = Store._point
    monkeypatch.setattr(Store, "_point", die)  # between the tables and the pointer
    with pytest.raises(KeyboardInterrupt):
        st.write({}, {"docs": docs("c")}, {"id": docs("a").selectExpr("id as key")})
    assert sorted(r.id for r in st.read("docs").collect()) == ["a", "b"]
    monkeypatch.setattr(Store, "_point", whole)
    st.write({}, {"docs": docs("c")}, {"id": docs("a").selectExpr("id as key")})
    assert sorted(r.id for r in st.read("docs").collect()) == ["b", "c"] and st.pointer()["generation"] == 3
    st.write({}, {"docs": docs("a", "b")}, {"id": docs("b", "c").selectExpr("id as key")})
    assert sorted(r.id for r in st.read("docs").collect()) == ["a", "b"]
    assert st.compact(2) and sorted(r.id for r in st.read("docs").collect()) == ["a", "b"]
    now = st.pointer()
    assert len(now["tables"]["docs"]) == 1 and now["gone"] == {} and st.vacuum() == 4 and st.read("docs").count() == 2


def test_an_update_writes_what_is_new(spark, tmp_path):
    """One file of very many: less than a fiftieth of the index."""
    config = cfg.Config(embedding=cfg.Embedding(dimensions=8), chunking=cfg.Chunking(min_tokens=1))
    st = Store(spark, f"file://{tmp_path}/t")
    text = "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', hex(xxhash64(id, x, {0})))))"
    files = lambda n, salt: spark.range(n).selectExpr("concat('f', id, '.txt') as file_path", f"cast({text.format(salt)} as binary) as content").selectExpr("file_path", "content", "concat('sha256:', sha2(content, 256)) as hash", "cast(length(content) as long) as file_size_bytes")
    assert build(spark, st, files(1500, 0), config)["files_indexed"] == 1500
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "t").rglob("*.parquet"))
    before = size()
    changed = files(1500, 0).where("file_path != 'f7.txt'").unionByName(files(8, 1).where("file_path = 'f7.txt'"))
    assert build(spark, st, changed, config)["files_indexed"] == 1
    assert size() - before < 0.02 * before and st.read("docs").count() == 1500
    assert build(spark, st, files(2, 2), config, partial=True)["files_deleted"] == 0 and st.read("docs").count() == 1500
    assert len(st.pointer()["tables"]["postings"]) == 3 and st.compact(2)
    assert max(len(x) for x in st.pointer()["tables"].values()) == 1 and st.read("docs").count() == 1500
    one = {t: sorted(map(str, st.read(t).select(*c).collect())) for t, c in (("postings", ("term", "id", "tf")), ("docs", ("id", "dl")), ("stats", ("n_docs", "total_len")))}
    assert one == {t: sorted(map(str, df.select(*c).collect())) for (t, df), c in zip(st.keyword_tables(st.read("chunks").select("id", "content")).items(), (("term", "id", "tf"), ("id", "dl"), ("n_docs", "total_len")))}


def test_folders_left_to_the_executors(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"d{i}" / "deep").mkdir(parents=True)
        (tmp_path / f"d{i}" / "deep" / "a.py").write_text("x = 1\n" * i)
        (tmp_path / f"d{i}" / "b.md").write_text("# b")
    (tmp_path / ".indexignore").write_text("d3/\nd4/deep/\n")
    want = list_files(str(tmp_path), cfg.Indexing())
    assert len(want) == 21 and [tuple(r) for r in listed(spark, str(tmp_path), cfg.Indexing(), frontier=2).orderBy("file_path").collect()] == want


def test_every_failure_of_the_service_is_a_dict(spark, project, monkeypatch):
    s = IndexService(spark, str(project[0]))
    assert s.search("q", top_k=0)["error_type"] == s.search("q", top_k=101)["error_type"] == "ConfigError"
    assert s.search("q", nonsense=1)["error_type"] == "TypeError"

    def broken(*_, **__):
        raise RuntimeError("an executor is gone")

    for name in ("build_project", "status", "search"):
        monkeypatch.setattr(service, name, broken)
    assert [x["error"] for x in (s.build(), s.status(), s.search("q"))] == ["an executor is gone"] * 3


def test_files_that_fail_are_tried_again(spark, tmp_path):
    """A PDF without its package is an error, not a file without chunks; a file that is indexed then isn't read again."""
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.txt").write_text("some words of text")
    s = IndexService(spark, str(tmp_path))
    first, second = s.build(), s.build()
    assert (first["files_failed"], second["files_failed"], second["files_indexed"]) == (1, 1, 1)
    assert [r["file_path"] for r in s.store.read("manifest").collect()] == ["b.txt"]


def test_migration_asks(tmp_path, monkeypatch, capsys):
    (tmp_path / ".index").mkdir()
    at = tmp_path / ".index/config.json"
    at.write_text('{"search": {"mode": "vector"}}')
    old = at.read_text()
    for typed, flags, status in (("n\n", [], "cancelled"), ("", ["--dry-run"], "dry_run"), ("yes\n", [], "success"), ("", ["--force"], "up_to_date")):
        monkeypatch.setattr("sys.stdin", io.StringIO(typed))
        assert cli.main(["migrate", str(tmp_path), *flags]) == 0 and json.loads(capsys.readouterr().out)["status"] == status
        assert (at.read_text() == old) == (status in ("cancelled", "dry_run"))
    at.write_text(old)
    assert cli.main(["migrate", str(tmp_path), "--force"]) == 0 and at.read_text() != old


def test_stream(spark, tmp_path):
    rows = [("a.txt", "first words of a"), ("b.txt", "second words of b")]
    spark.createDataFrame(rows, "file_path string, content string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("file_path string, content string").parquet(f"{tmp_path}/in")
    store, config = Store(spark, f"file://{tmp_path}/index"), cfg.Config(embedding=cfg.Embedding(dimensions=8), chunking=cfg.Chunking(min_tokens=1))
    q = index_stream(spark, source, store, config, f"{tmp_path}/cp")
    q.awaitTermination()
    assert store.read("chunks").count() == 2
    spark.createDataFrame([("a.txt", "other text now")], "file_path string, content string").write.mode("append").parquet(f"{tmp_path}/in")
    index_stream(spark, source, store, config, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["content"] for r in store.read("chunks").collect()) == ["other text now", "second words of b"]
    q = token_counts(source, "file_path", "content").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.awaitTermination()
    assert spark.table("counts").where("term = 'words'").first()["n"] == 2


class Fussy(embed.Provider):
    def embed(self, texts):
        self.calls = getattr(self, "calls", [])
        self.calls.append(len(texts))
        if len(texts) > 1 and sum(map(len, texts)) > 12 or max(map(len, texts)) > 200:
            raise TooLargeError("out of memory")
        return [[float(len(t)), 0.0] for t in texts]


def test_batches_are_halved():
    p = Fussy(cfg.Embedding(dimensions=2, batch_size=4))
    vectors, calls = embed.embed_batch(p, ["a" * n for n in (3, 4, 5, 6, 7)])
    assert [v[0] for v in vectors] == [3, 4, 5, 6, 7] and calls == 3 and p.calls == [4, 2, 2, 1]
    assert embed.embed_batch(p, ["b" * 300])[0][0][0] <= 200
    with pytest.raises(EmbeddingError):
        embed.embed_batch(Fussy(cfg.Embedding(dimensions=3)), ["a"])


def remote(answers, **k):
    waits, it = [], iter(answers)
    p = embed.RemoteProvider(cfg.Embedding(dimensions=1, provider="remote", endpoint="http://x", api_key="k", **k), lambda *a: next(it), waits.append)
    return p, waits


def test_remote():
    ok = json.dumps({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    p, waits = remote([(500, "", {}), (429, "", {"Retry-After": "7"}), (200, ok, {})])
    assert p.embed(["a", "b"]) == [[1.0], [2.0]] and waits == [1.0, 7.0]
    for bad in ((413, "", {}), (400, "context length exceeded", {}), (200, '{"error": {"message": "input too long"}}', {})):
        with pytest.raises(TooLargeError):
            remote([bad])[0].embed(["a"])
    for bad in ("[]x", '{"data": []}', '{"data": [{"index": 5, "embedding": [1]}]}', '{"error": "no"}'):
        with pytest.raises(EmbeddingError):
            remote([(200, bad, {})])[0].embed(["a"])
    with pytest.raises(EmbeddingError):
        remote([(500, "", {})] * 3)[0].embed(["a"])
    assert embed.retry_after("inf") is None and embed.retry_after("-1") is None and embed.retry_after("2") == 2


def test_settings(tmp_path):
    c = cfg.load(str(tmp_path), env={"QUERN_DIMENSIONS": "7", "QUERN_MODEL": "m"})
    assert (c.embedding.dimensions, c.embedding.model) == (7, "m")
    for change in ({"embedding": {"batch_size": 0}}, {"search": {"mode": "x"}}, {"search": {"hybrid_alpha": 2}}, {"embedding": {"provider": "x"}}, {"embedding": {"device": "tpu"}}, {"search": {"rerank_top_n": 0}}):
        with pytest.raises(ConfigError):
            cfg.validate(cfg.Config.from_dict(change))
    assert cfg.Config.from_dict({"own": 1, "search": {"odd": 2}}).to_dict()["own"] == 1
    (tmp_path / ".index").mkdir()
    (tmp_path / ".index/config.json").write_text("{")
    with pytest.raises(ConfigError):
        cfg.load(str(tmp_path))


def test_migration(tmp_path):
    old = {"search": {"mode": "vector"}, "indexing": {"file_extensions": [".py"]}}
    steps = cfg.analyse(old)
    new = cfg.migrate(old, steps)
    assert new["search"]["mode"] == "vector" and new["search"]["rerank_top_n"] == 10 and new["schema_version"] == "1.0"
    assert new["indexing"]["file_extensions"] == [".py", ".dita", ".ditamap", ".docx", ".pdf", ".pptx"] and old["indexing"]["file_extensions"] == [".py"]
    assert cfg.analyse(new) == []


@pytest.mark.parametrize("bad", [{"text": ""}, {"text": "x" * 2001}, {"text": "q", "top_k": 101}, {"text": "q", "alpha": 1.5}, {"text": "q", "mode": "x"}])
def test_query_bounds(bad):
    with pytest.raises(ConfigError):
        Query(**bad)
    assert issubclass(ConfigError, QuernError)


def test_cache_spares_calls(spark):
    s = cfg.Embedding(dimensions=4)
    chunks = spark.createDataFrame([("1", "same text"), ("2", "same text"), ("3", "other text")], "id string, content string")
    empty = spark.createDataFrame([], "content_hash string, model string, dimensions int, vector array<float>")
    _, new = embed.embed_chunks(chunks, empty, s)
    assert new.count() == 2
    assert embed.embed_chunks(chunks, new, s)[1].count() == 0
    assert embed.embed_chunks(chunks, new, cfg.Embedding(dimensions=4, document_prefix="d: "))[1].count() == 2
    assert new.where(F.size("vector") != 4).count() == 0


def test_postings_hold_a_number_for_an_id(spark, tmp_path, monkeypatch):
    """Ids that share one keep themselves; a segment's numbers are its own, and ids that are gone and come again aren't met twice."""
    from quern import store as st_

    monkeypatch.setattr(st_, "number", lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    monkeypatch.setattr(st_, "FEW", 2)
    st = Store(spark, f"file://{tmp_path}/t")
    text = lambda *ids: spark.createDataFrame([(x, f"user {x}{x} user") for x in ids], "id string, content string")
    rows = lambda: sorted((r.term, r.id, r.tf, r.dl) for r in st.read("postings").collect())
    want = lambda *ids: sorted(x for i in ids for x in (("user", i, 2, 3), (f"{i}{i}", i, 1, 3)))
    new = lambda *ids: {n: df for n, df in st.keyword_tables(text(*ids)).items() if n != "stats"}
    st.write(new("a", "b", "c", "d", "e"))
    assert rows() == want(*"abcde")
    st.write({}, new("b", "f", "g", "h"), {"id": spark.createDataFrame([("b",), ("c",)], "key string")})
    st.write({}, new("c"), {"id": spark.createDataFrame([("h",)], "key string")})
    assert rows() == want(*"abcdefg") and {r.id for r in st.query_postings(["user"]).collect()} == set("abcdefg")
    assert st.compact(2) and rows() == want(*"abcdefg") and len(st.pointer()["tables"]["names"]) == 1
    st.write({"postings": st.read("postings")})  # without documents: ids as they are
    assert rows() == want(*"abcdefg") and st.pointer()["tables"]["names"] == []


def test_an_index_is_smaller_than_its_ids_would_be(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/t")
    text = spark.range(300).selectExpr("concat('sha256:', sha2(cast(id as string), 256)) as id", "concat_ws(' ', transform(sequence(1, 100), x -> concat('w', x))) as content")
    st.write(st.keyword_tables(text))
    assert st.read("postings").count() == 30000 and sum(p.stat().st_size for p in (tmp_path / "t").rglob("postings/**/*.parquet")) < 20 * 30000
