"""Brute-force versions of columns that other tests leave, and the cases that once went wrong."""

import random
import re
import zlib

import numpy as np
import pytest

from quern.llm import op01_mixing as mixing
from quern.llm import op03_quality_rules as rules
from quern.llm import op05_quality_classifier as quality
from quern.llm import op07_multiset_hash as multiset
from quern.llm import op08_simhash as sim
from quern.session import unused

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", ",", "."]) for _ in range(n))


# Clashing names


NAMES = [f"_quern{i}" for i in range(5)] + ["_key", "_copy", "_copies", "_taken", "_th", "_ki", "_kt", "_id", "fp", "label", "size", "sources", "picks", "copies"]


def clashing(spark):
    rows = [(i, prose(random.Random(i // 2), 40), f"s{i % 3}", *NAMES) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{x}` string" for x in NAMES))


@pytest.mark.parametrize("stage", [mixing.take_copies, sim.keep_one])
def test_columns_of_any_name_come_through(spark, stage):
    df = clashing(spark)
    out = stage(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and all([r[x] for x in NAMES] == NAMES for r in got)


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "_QUERN0 int, _quern2 int")
    assert unused(df, 3) == ["_quern1", "_quern3", "_quern4"]


# 1


def test_null_and_empty_sources_differ(spark):
    # The same ids and texts in a null and in an empty source, whose weights differ.
    rows = [(i, "word " * (5 + i % 3), x) for i in range(40) for x in (None, "", "a")] + [(None, "no id here", "a"), (100, None, "a"), (100, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {r.source_name: r.target for r in mixing.mix_by_rank(df).select("source_name", "target").distinct().collect()}
    assert len(targets) == 3 and targets[""] > 2 * targets["a"] > 3 * targets[None]
    got = dict.fromkeys(targets, 0)
    for r in mixing.take_copies(df).collect():
        got[r.source] += len(r.text.split())
    assert all(abs(got[x] - targets[x]) <= 7 for x in targets)


# 3


def brute_kept(text):
    import zstandard

    raw = (text or "").encode()
    words = raw.split()
    covered = set()
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            for i in at:
                covered.update(range(i, i + 8))
    if len(words) < 20 or 100 * len(covered) > 30 * len(words):
        return False
    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=rules.LEVEL).compress(x))
    low, high = [(lo, hi) for below, lo, hi in rules.BANDS if len(raw) < below][0]
    if not low <= ratio(raw) <= high:
        return False
    cuts, at = [], 0
    while len(raw) - at >= 4096:
        cuts.append(raw[at : at + 4096])
        at += 4096
    if cuts and len(raw) - at < 2048:
        cuts[-1] += raw[at:]
    elif at < len(raw):
        cuts.append(raw[at:])
    bad = sum(len(x) for x in cuts if len(cuts) > 1 and not rules.CHUNK_BAND[0] <= ratio(x) <= rules.CHUNK_BAND[1])
    return bad <= 0.2 * len(raw)


def test_kept_by_brute_force(spark):
    r = random.Random(5)
    invented = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(n))
    mixed = lambda n: " ".join(invented(3) if r.random() < 0.5 else prose(r, 4) for _ in range(n))
    noise = lambda n: " ".join("".join(chr(r.randint(33, 126)) for _ in range(8)) for _ in range(n))
    texts = [None, "", " \n", "one two"] + [f(n) for f in (invented, mixed, noise, lambda n: prose(r, n)) for n in (15, 25, 60, 150, 400, 900, 2500)]
    texts += [mixed(800) + " " + noise(300), mixed(800) + "\n" + "same words again and again \n" * 200, mixed(300) * 2]
    out = rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.kept for x in out} == {i: brute_kept(t) for i, t in enumerate(texts)}
    assert len({x.kept for x in out}) == 2


# 5


def brute_score(text, weights):
    """The dot product, feature by feature."""
    import xxhash

    mask, buckets = (1 << 64) - 1, quality.BUCKETS
    words = (text or "").encode().split()
    s = float(weights[-1])
    if words:
        def shape(w):
            runs = [m.group() for m in re.finditer(rb"[A-Z]+|[a-z]+|[0-9]+|[\x80-\xff]+|[^A-Za-z0-9\x80-\xff]", w)]
            kinds = [b"A" if x[:1].isupper() else b"a" if x[:1].islower() or x[0] >= 128 else b"0" if x[:1].isdigit() else x for x in runs]
            return b"".join(k for i, k in enumerate(kinds) if not (i and k == kinds[i - 1] and k in (b"A", b"a", b"0")))

        whole = [xxhash.xxh64_intdigest(w, 1) for w in words]
        shapes = [xxhash.xxh64_intdigest(shape(w), 2) ^ (0x5BD1E995 if i and whole[i] == whole[i - 1] else 0) for i, w in enumerate(words)]
        for group in (whole, shapes):
            pairs = [(((x * 31 + y) & mask) * 0x9E3779B97F4A7C15 & mask) ^ (y >> 17) for x, y in zip(group, group[1:])]
            at = [(x ^ (x >> 32)) % buckets for x in group + pairs]
            s += sum(float(weights[i]) for i in at) / len(at)
    return 1 / (1 + np.exp(-s))


def test_scores_are_dot_products(spark):
    r = random.Random(2)
    weights = np.random.default_rng(0).normal(size=quality.BUCKETS + 1).astype(np.float32)
    texts = [None, "", " \t", "one", "Two WORDS!! two two", "http://a.b/c?d=12&e=" + "x1" * 40, "ünï ÜNÏ 12a"] + [prose(r, n) for n in (3, 50, 700)]
    out = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).collect()
    assert all(x.score == pytest.approx(brute_score(texts[x.doc_id], weights), abs=1e-6) and x.predicted == (x.score >= 0.3) for x in out)


def test_shape_of_long_words():
    assert quality.shape(b"aB" * 30 + b"!?") == b"aA" * 30 + b"!?" and quality.shape(b"x1" * 20) != quality.shape(b"x1" * 20 + b"#")


def test_training_is_bounded_by_rows(spark):
    """An id that stands in very many rows brings no more rows than the bound; equal rows count once."""
    r = random.Random(4)
    good, bad = (lambda: prose(r, 20)), (lambda: prose(r, 20).upper() + "!!")
    base = [(i, good() if i % 2 else bad()) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.createDataFrame(base, "doc_id long, text string")
    w = quality.train(docs, labels, sample=40)
    hot = docs.unionByName(spark.createDataFrame([base[1]] * 3000, "doc_id long, text string"))
    assert (quality.train(hot.repartition(4), labels, sample=40) == w).all()
    many = docs.unionByName(spark.createDataFrame([(1, f"{good()} {k}") for k in range(500)], "doc_id long, text string"))
    assert np.isfinite(quality.train(many, labels, sample=40)).all()


# 7


@pytest.mark.parametrize("kind", ["string", "binary", "date", "decimal(20,3)", "timestamp", "double", "boolean"])
def test_ids_of_any_type(spark, kind):
    made = {"string": "concat('doc', lpad(id, 7, '0'))", "binary": "cast(concat('doc', lpad(id, 7, '0')) as binary)", "date": "date_add(date'2020-01-01', int(id))", "decimal(20,3)": "cast(id as decimal(20,3))", "timestamp": "timestamp_seconds(id * 1000)", "double": "id / 7", "boolean": "id % 2 = 0"}[kind]
    df = spark.range(60).selectExpr(f"nullif({made}, null) as doc_id", "concat('text number ', id, ' ', repeat('w ', int(id % 5)))  as text")
    df = df.unionByName(spark.sql(f"select cast(null as {kind}) as doc_id, 'no id' as text"))
    rows = sorted(df.collect(), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1])) if kind != "binary" else sorted(df.collect(), key=lambda x: (x[0] is None, bytes(x[0] or b""), x[1]))
    import hashlib

    want = []
    for i, (d, t) in enumerate(rows):
        following, k = rows[(i + 1) % len(rows)][1], len(t) // 2
        want.append((str(d), hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()))
    assert sorted((str(x.doc_id), x.edited_sha256) for x in multiset.with_neighbours(df).collect()) == sorted(want)


def true_likeness(a, b):
    """The shared sentences over all sentences of both, as multisets of what the vectors are made of."""
    from collections import Counter

    def parts(t):
        out = Counter()
        for line in (t or "").encode().split(b"\n"):
            for y in line.split(b". ") if line else []:
                out.update(multiset.runs(y) if len(y) > multiset.LONG else [y])
        return out

    x, y = parts(a), parts(b)
    dot, norm = sum(n * y[k] for k, n in x.items()), sum(n * n for n in x.values()) + sum(n * n for n in y.values())
    return dot / (norm - dot) if norm - dot else 1.0


def test_near_is_close_to_the_true_share(spark):
    """With 128 signs the estimate's error is about 1/sqrt(128) of the texts' size: five times that is never met."""
    r = random.Random(9)
    shared = [prose(r, 9) for _ in range(30)]
    texts = ["\n".join(r.sample(shared, k) + [prose(r, 9) for _ in range(r.randint(0, 30))]) for k in (0, 5, 10, 20, 30, 30, 15, 25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    worst = 0
    for x in multiset.with_neighbours(df).collect():
        t, following = texts[x.doc_id], texts[(x.doc_id + 1) % len(texts)]
        edited = multiset.edit(t, following)
        worst = max(worst, abs(x.near_next - true_likeness(t, following)), abs(x.near_edited - true_likeness(t, edited)))
    assert worst < 0.35


def test_very_many_sentences_do_not_wrap():
    near = lambda s, t: float(multiset.likeness(*(tuple(x[i : i + 1] for x in multiset.vectors([s, t])) for i in (0, 1)))[0])
    assert near("x\n" * 40_000, "x\n" * 20_000) == pytest.approx(near("x\n" * 40, "x\n" * 20)) == pytest.approx(2 / 3)
    assert near("x\n" * 70_000, "x\n" * 70_001) == pytest.approx(1, abs=1e-4)


# 8


def test_a_hot_fingerprint(spark):
    """A third of all rows without words, joined to their group by a broadcast."""
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, '', concat_ws(' ', transform(sequence(1, 12), x -> hex(xxhash64(id, x))))) as text")
    out = sim.groups(df).collect()
    assert len(out) == 3000 and {(x.component_id, x.n_near, x.fingerprint) for x in out if x.doc_id % 3 == 0} == {(0, 999, "0" * 16)}
    assert all(x.component_id == x.doc_id for x in out if x.doc_id % 3) and zlib
