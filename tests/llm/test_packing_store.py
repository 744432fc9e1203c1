import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.op02_packing import best_two_fit, pack_documents, place
from quern.llm.op04_store import chunks_of, cuts, merkle_root, read_checksums, read_store, unpack_ids, verify, write_store
from quern.llm.pieces import PieceEncoder
from quern.session import new_path, remove

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
ODD = ["", " ", "a  b", "a\n b", " lead", "trail ", "x\ty z", "don't 've it’s  ok", "Ünḯ café ́x", "日本 語 <|endoftext|> <|x", "ﬁ № İI ǅ", "12 3'4 's's", "x ‍ y", "word, word. word; word: WORD! word? " * 50, "y" * 5000]


NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
CAPITALS = [
    "He said \u201cHello World\u201d \u2014 The End of It",
    "The price is \u20ac5 in New York City",
    "don\u2019t Stop The Music now, STOP! \u03a3\u0391\u03a3 \u0130stanbul",
    "<|endoftext|>",
    "a <|endoftext|> b",
    "A <|ENDOFTEXT|> <|StartOfText|>x",
    "x<|startoftext|>\n<|endoftext|>y \u2026",
]
WORDS = ["The", "the", "THE", "Stra\u00dfe", "\u00c9t\u00e9", "\u00e9t\u00e9", "\u201cNew", "York\u201d", "\u20ac5", "don't", "Don\u2019t", "I'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "a<|endoftext|>b", "\u03a3\u03a3", "\u0130I", "e\u0301", "\u0301x", "12", "Word,", "word...", "WORD!?", "\ufb01", "\U0001f600", "\u65e5\u672c", "\u00aa", "\u00b5M", "\u01c5", "'s", "'S", "\u00a0", "\x1c", "\u2028", "\ufeff", "<|", "|>"]


@pytest.fixture(scope="module", params=NAMES)
def fresh(request):
    """A tokenizer as the library reads it, with nothing set."""
    return request.param, Tokenizer.from_file(P.path(request.param))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_librarys_ids(fresh):
    name, tokenizer = fresh
    e = PieceEncoder(P.path(name), cache_pieces=10)
    texts = ODD + CAPITALS
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [ids_of(tokenizer, t) for t in texts]
    assert e.encode([None])[0].tolist() == []


WARM: dict = {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join), st.lists(st.one_of(st.sampled_from(WORDS), st.sampled_from([" ", "\n", "  ", "\t", " \n", ". "]), st.text(max_size=6)), max_size=10).map("".join), st.none()), max_size=6))
def test_any_text_gives_the_librarys_ids(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    for name in NAMES:
        if name not in WARM:
            WARM[name] = Tokenizer.from_file(P.path(name)), PieceEncoder(P.path(name), cache_pieces=300)
        tokenizer, warm = WARM[name]
        want = [ids_of(tokenizer, t) for t in texts]
        assert [x.tolist() for x in warm.encode(texts)] == want  # what other texts left behind doesn't count
        warm._reset()
        assert [x.tolist() for x in warm.encode(texts)] == want


class Counted:
    """A tokenizer that counts the texts it is given to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.met = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode(self, text, **more):
        self.met += 1 if isinstance(text, str) else len(text)
        return self.tokenizer.encode(text, **more)

    def encode_batch_fast(self, texts, **more):
        self.met += sum(t.count("\n") + 1 for t in texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_ordinary_words_are_merged_without_the_library():
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    e = PieceEncoder(P.path("word_bpe_49k.json"))
    e.tokenizer, e.merges = Counted(e.tokenizer), Counted(e.merges)
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu\u00e9\u00df"), rng.integers(1, 13)))
    texts = ["\n".join(", ".join(" ".join(word() for _ in range(6)) for _ in range(3)) for _ in range(20)) for _ in range(10)]
    assert [x.tolist() for x in e.encode(texts)] == [ids_of(tokenizer, t) for t in texts]
    assert e.tokenizer.met + e.merges.met <= 2  # the mark, and not one of some 3,600 words and 200 line breaks


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("abehinost"), min_size=1, max_size=40), st.text(st.sampled_from("aAzZ\u00aa\u00c3\u00df\u00e9\u0101\u012f"), min_size=1, max_size=40)), min_size=1, max_size=30, unique=True))
def test_merges_of_short_words(words):
    from quern.llm.pieces import BYTE_CHARS

    for name in NAMES:
        if name not in WARM:
            WARM[name] = Tokenizer.from_file(P.path(name)), PieceEncoder(P.path(name), cache_pieces=300)
        e, left = WARM[name][1], set(range(len(words)))
        for some, ids, n in e.short(words):
            at = 0
            for i, k in zip(some.tolist(), [None] * len(some) if n is None else n.tolist()):
                left.remove(i)
                if k is None:
                    assert len(words[i].encode()) + len(e.lead) > e.short.LIMIT
                    continue
                byte_chars = e.lead + "".join(BYTE_CHARS[b] for b in words[i].encode())
                assert ids[at : at + k].tolist() == [t.id for t in e.merges.model.tokenize(byte_chars)]
                at += k
        assert not left


def test_other_tokenizers_take_whole_texts(tmp_path):
    from tokenizers import models

    t = Tokenizer(models.BPE({"a": 0, "b": 1, " ": 2, "a ": 3}, [("a", " ")]))
    t.save(str(tmp_path / "t.json"))
    assert [x.tolist() for x in PieceEncoder(str(tmp_path / "t.json")).encode(["a b", None])] == [ids_of(t, "a b"), []]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_bins_hold_every_item_once(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offset = place(lengths, 30)
    at = {}
    for b, o, n in sorted(zip(bins.tolist(), offset.tolist(), lengths.tolist())):
        assert at.get(b, 0) == o
        at[b] = o + n
    assert all(v <= 30 for v in at.values())
    made = sorted(n for times, held in best_two_fit(np.bincount(lengths, minlength=31), 30) for n in held * times)
    assert made == sorted(lengths.tolist())


def test_two_replace_one():
    counts = np.zeros(11, np.int64)
    for n in (6, 3, 2, 2):
        counts[n] += 1
    # 6 and 3 leave a gap of 1; 2 and 2 in place of 3 fill it.
    assert best_two_fit(counts, 10)[0] == (1, [6, 2, 2])


def docs_of(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD + CAPITALS)] + [(50, None, "x", 2), (50, "same", "x", 3), (50, "same", "x", 3), (None, "no id", "x", 4), (7000, "long text, " * 3000, "x", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, sequence_id int"), rows


def test_packed_documents(spark):
    df, rows = docs_of(spark)
    out = pack_documents(df, P.path("byte_bpe_50k.json"), 1024, 2).toPandas()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t, *_ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        k = -(-len(ids) // 1024)
        for p in range(k):
            a, b = max(0, len(ids) - (k - p) * 1024), len(ids) - (k - p - 1) * 1024
            want.append((d if d is not None else -1, p, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = sorted((int(r.doc_id) if r.doc_id == r.doc_id else -1, r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert got == sorted(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 1024 and (g.offset == g.length.cumsum() - g.length).all()


def test_store_round_trip(spark):
    df, rows = docs_of(spark)
    path = new_path(spark, "t")
    write_store(df, path, P.path("word_bpe_49k.json"), 1)
    out = [r.asDict() for r in read_store(spark, path).collect()]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, at = [], 0
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, len(ids), np.array(ids, "<u4").tobytes()))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted([(r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in out], key=key) == sorted(want, key=key)
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += r["n_tokens"]
    assert verify(spark, path)
    key2 = lambda r: (str(r[0]), *r[1:])
    assert sorted([tuple(r) for r in read_checksums(spark, path).collect()], key=key2) == sorted([(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out], key=key2)
    chunks = chunks_of(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_store_of_nothing_and_a_lost_chunk(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    path = new_path(spark, "t")
    write_store(empty, path, P.path("word_bpe_49k.json"), 1)
    assert read_store(spark, path).count() == 0 == read_checksums(spark, path).count() and verify(spark, path)
    df, _ = docs_of(spark)
    path, lost = new_path(spark, "t"), new_path(spark, "t")
    write_store(df, path, P.path("word_bpe_49k.json"), 1)
    spark.read.parquet(f"{path}/chunks").where("kind = 0 or bucket % 2 = 0").write.partitionBy("kind").parquet(f"{lost}/chunks")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{lost}/{name}")
    for read in (read_store, read_checksums):
        with pytest.raises(Exception, match="missing"):
            read(spark, lost).collect()
    assert pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 50000, 3000).astype(np.uint32)
    a, b = np.concatenate([rng.integers(0, 50000, 777).astype(np.uint32), shared]), shared
    ends = cuts(np.concatenate([a, b]), [0, len(a), len(a) + len(b)])
    chunk = lambda x, e: {x[i:j].tobytes() for i, j in zip([0, *e], e)}
    assert len(chunk(a, ends[0]) & chunk(b, ends[1])) >= len(ends[1]) // 2
    assert ends[0][-1] == len(a) and ends[1][-1] == len(b)
    assert all((unpack_ids(shared.astype(f"<u{w}").tobytes(), len(shared)) == shared).all() for w in (2, 4))
    assert merkle_root([b"a", b"b", b"c"]) != merkle_root([b"a", b"c", b"b"])


def test_cuts_are_where_a_windows_sum_meets_the_mask():
    from quern.llm.op04_store import AVG_IDS, MAX_IDS, MIN_IDS, WINDOW

    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 7, 8, 9, 5000):
        ids, wrap = rng.integers(0, 300, n).astype(np.uint32), 2**64 - 1
        mixed = [(x + 1) * 0x9E3779B97F4A7C15 & wrap for x in ids.tolist()]
        mixed = [x ^ x >> 29 for x in mixed]
        want, last = [], 0
        for i in range(n):
            h = sum(mixed[i - j] * 0xD1342543DE82EF95**j for j in range(min(WINDOW, i + 1))) * 0xFF51AFD7ED558CCD & wrap
            if i + 1 - last == MAX_IDS or (i + 1 - last >= MIN_IDS and h < 2**64 // AVG_IDS) or i + 1 == n:
                last = i + 1
                want.append(last)
        assert cuts(ids, [0, n]) == [want]


def test_shared_passages_hold_whole_chunks():
    rng = np.random.default_rng(4)
    some = lambda n: rng.integers(0, 50000, n).astype(np.uint32)
    met = 0
    for _ in range(50):
        passage = some(300)  # about 130 words
        a, b = np.concatenate([some(250), passage, some(250)]), np.concatenate([some(400), passage, some(100)])
        ends = cuts(np.concatenate([a, b]), [0, len(a), len(a) + len(b)])
        met += bool({a[i:j].tobytes() for i, j in zip([0, *ends[0]], ends[0])} & {b[i:j].tobytes() for i, j in zip([0, *ends[1]], ends[1])})
    assert met >= 40


def test_changed_recipes_are_errors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, " ".join(f"w{i}{j}" for j in range(400))) for i in range(6)], "doc_id long, text string")
    path = new_path(spark, "t")
    write_store(df, path, P.path("word_bpe_49k.json"), 1)
    recipes = spark.read.parquet(f"{path}/recipes")
    schema, rows = recipes.schema, recipes.collect()
    assert read_checksums(spark, path).count() == 6
    swapped = F.concat(F.col("digests").substr(F.lit(17), F.length("digests") - 16), F.col("digests").substr(1, 16))
    for change in (lambda r: r.where("doc_id != 3"), lambda r: r.withColumn("digests", F.when(F.col("doc_id") == 3, swapped).otherwise(F.col("digests"))), lambda r: r.withColumn("leaf", F.unhex(F.sha2("leaf", 256)))):
        remove(spark, f"{path}/recipes")
        change(spark.createDataFrame(rows, schema)).write.parquet(f"{path}/recipes")
        with pytest.raises(Exception, match="don't give|doesn't give"):
            read_checksums(spark, path).collect()
