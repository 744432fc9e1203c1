"""Each operator against brute force, with nulls, empty and very long texts, ties, repeated rows,
empty tables and columns whose names clash."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import op01_mixing as mixing
from quern.llm import op03_quality_rules as rules
from quern.llm import op05_quality_classifier as quality
from quern.llm import op06_token_counts as counts
from quern.llm import op07_multiset_hash as multiset
from quern.llm import op08_simhash as sim
from quern.llm import op09_hmm as hmm
from quern.llm import op10_line_dedup as dedup
from quern.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, score string, fp string, label string, k string, word string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus(seed=0, n=60):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed"]) for _ in range(r.randint(5, 25))) + "."
    shared = [line() for _ in range(6)]
    texts = ["\n".join(r.choice(shared) if r.random() < 0.3 else line() for _ in range(r.randint(1, 6))) for _ in range(n)]
    texts += texts[:8] + [t.replace("alpha", "omega") for t in texts[8:20]] + [t.upper() for t in texts[20:24]]
    texts += ["", " \n\t ", None, "one", "two words", "long line " * 5000, "x" * 20000, "ünï cödé x\x1cy", "\n\n", "a\nb\na\nb"]
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, i, "s", "t", "c", "f", "l", "k", "w") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id here at all", None, None, None, *[None] * 7), (None, None, None, "src1", 1, *[None] * 7), (5, "same id other text", "en", "src1", 1, *[None] * 7)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def b(text):
    return (text or "").encode()


# 1


def brute_flow(patterns, quotas, costs):
    """The least cost of the largest flow, by trying every whole split; tiny cases."""
    best = None
    options = []
    for held, tokens in patterns:
        top = tokens * len(costs)
        options.append([dict(zip(held, c)) for c in itertools.product(range(top + 1), repeat=len(held)) if sum(c) <= top])
    for pick in itertools.product(*options):
        got = Counter()
        for p in pick:
            got.update(p)
        if any(got[x] > quotas[x] for x in quotas):
            continue
        cost = sum(sum(min(max(sum(p.values()) - i * t, 0), t) * c for i, c in enumerate(costs)) for p, (_, t) in zip(pick, patterns))
        key = (-sum(got.values()), cost)
        best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_cheapest(seed):
    r = random.Random(seed)
    patterns = [(("a",), r.randint(1, 2)), (("a", "b"), r.randint(1, 2)), (("b",), r.randint(1, 2))]
    quotas, costs = {"a": r.randint(0, 6), "b": r.randint(0, 6)}, (0, 1, 3)
    flow = mixing.route(patterns, quotas, costs)
    got = Counter()
    for f in flow:
        got.update(f)
    cost = sum(sum(min(max(sum(f.values()) - i * t, 0), t) * c for i, c in enumerate(costs)) for f, (_, t) in zip(flow, patterns))
    assert all(got[x] <= quotas[x] for x in quotas) and (-sum(got.values()), cost) == brute_flow(patterns, quotas, costs)


def test_shares():
    assert mixing.capped_shares([10, 10, 10], [5, 2, 1], 3) == [18.75, 7.5, 3.75]
    assert mixing.capped_shares([1, 100, 100], [5, 2, 1], 3) == [3, 132, 66]
    assert mixing.capped_shares([0, 0], [5, 2], 3) == [0, 0]


def test_mix(docs, rows, nothing):
    out = mixing.mix_by_rank(docs).toPandas()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(b(r[1]).split())
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    want = dict(zip(order, mixing.capped_shares([sizes[x] for x in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)))
    for name, g in out.groupby(out["source_name"].fillna("-")):
        key = None if name == "-" else name
        assert g["size"].sum() == sizes[key] == g["source_size"].iloc[0] and g["target"].iloc[0] == pytest.approx(want[key])
        assert abs(g["taken"].sum() - want[key]) <= max(30, g["size"].max() / 2)
        assert (g["taken"] <= 3 * g["size"]).all()
    again = mixing.mix_by_rank(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.mix_by_rank(nothing).count() == 0
    copies = mixing.take_copies(docs)
    assert copies.columns == docs.columns and mixing.take_copies(nothing).count() == 0
    got = Counter()
    for r in copies.collect():
        got[r.source] += len(b(r.text).split())
    assert all(abs(got[x] - want[x]) <= 30 for x in want if x != "src1")  # its long text takes or leaves 10000 words at once


def test_overlapping_sources(spark):
    r = random.Random(2)
    data = [(i, r.randint(1, 30), r.choice([["a"], ["a", "b"], ["b"], ["b", "c"], [None], []])) for i in range(5000)]
    df = spark.createDataFrame(data, "doc_id int, size long, sources array<string>")
    quotas = {"a": 20000, "b": 30000, "c": 9000, None: 4000}
    out, _ = mixing.mix(df, quotas)
    got = Counter()
    for row in out.collect():
        assert row.copies == len(row.picks) <= 3 and set(row.picks) <= set(row.sources)
        for x in row.picks:
            got[x] += row.size
    assert all(abs(got[x] - q) <= 30 for x, q in quotas.items())


def test_patterns_beyond_two_thousand_keep_their_sources(spark):
    names = [f"s{i:02}" for i in range(12)]
    held = [[x for i, x in enumerate(names) if k >> i & 1] for k in range(1, 4096)]
    df = spark.createDataFrame([(k, 10, h) for k, h in enumerate(held)], "doc_id int, size long, sources array<string>")
    quotas = dict.fromkeys(names, 3000)  # the last source alone is first of one document
    out, _ = mixing.mix(df, quotas)
    got = Counter()
    for row in out.collect():
        assert set(row.picks) <= set(row.sources) and len(row.sources) == bin(row.doc_id + 1).count("1")
        for x in row.picks:
            got[x] += row.size
    assert all(abs(got[x] - 3000) <= 30 for x in names)


def test_single_sources_without_limit(spark):
    df = spark.range(2500).selectExpr("cast(id as int) doc_id", "10L size", "array(concat('s', id)) sources")
    out, _ = mixing.mix(df, lambda sizes: dict.fromkeys(sizes, 20))
    assert [r.copies for r in out.collect()] == [2] * 2500


# 3


def test_rules(docs, rows, nothing):
    out = [r.asDict() for r in rules.judge(docs).collect()]
    want = []
    for r in rows:
        t = r[1] or ""
        w = t.encode().split()
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = t.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if x.encode().strip() and x in lines[:i])
        want.append((r[0], len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = [(o["doc_id"], o["n_words"], o["word_chars"], o["n_symbols"], o["n_dup_lines"], o["n_repeat_words"], o["base_failed"]) for o in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(not o["kept"] for o in out if o["base_failed"]) and rules.judge(nothing).count() == 0


def test_bands(spark):
    r = random.Random(1)
    prose = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(900))
    noise = "".join(map(chr, (r.randint(0x4E00, 0x9FFF) for _ in range(4000))))
    noise = " ".join(noise[i : i + 5] for i in range(0, 4000, 5))
    table = "\n".join(f"row {i} of the very same long table that goes on" for i in range(300))
    df = spark.createDataFrame([(1, prose), (2, noise), (3, table), (4, prose + " " + " ".join(f"cell{i % 3} {i}" for i in range(3000)))], "doc_id long, text string")
    got = {x.doc_id: x for x in rules.judge(df).collect()}
    assert got[1].kept and not got[3].kept and got[3].ratio > 4 and not got[4].kept and got[4].chunk_outside > 0.2
    assert rules.chunks_of(10000) == [(0, 4096), (4096, 10000)] and rules.chunks_of(10300) == [(0, 4096), (4096, 8192), (8192, 10300)] and rules.chunks_of(5) == [(0, 5)]


def test_noise_fails_and_prose_stays(spark):
    r = random.Random(7)
    letters, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    more = letters + letters.upper() + "0123456789"
    lengths = (200, 400, 700, 1000, 1500, 2100, 3000, 4096, 6000, 8192, 12000, 16384, 30000)

    def noise(alphabet, n):
        text = ""
        while len(text) < n:
            text += "".join(r.choice(alphabet) for _ in range(r.randint(2, 9))) + " "
        return text[:n]

    # From which length on each kind is told from prose.
    kinds = {"base64": (more + "+/", 700), "alphanumeric": (more, 700), "letters": (letters, 2100), "hex": (hexes, 8192)}
    bad = [(f"{k} {n}", noise(alphabet, n)) for k, (alphabet, least) in kinds.items() for n in lengths if n >= least]
    # The prose of Python's own documentation strings, cut to each length.
    import argparse, datetime, decimal, doctest, logging, pickle, statistics, typing  # noqa: E401

    real = ["\n".join(x for m in (argparse, decimal, doctest, logging, pickle, statistics, datetime, typing) for o in [m, *vars(m).values()] if isinstance(x := getattr(o, "__doc__", None), str) and len(x) > 200)]
    good = [(f"prose {n} {a}", t[a : a + n]) for t in real for n in lengths for a in (0, 9000) if len(t) >= a + n]
    kept = {x.doc_id: (x.kept, x.ratio) for x in rules.judge(spark.createDataFrame(bad + good, "doc_id string, text string")).where("not base_failed").collect()}
    assert len(good) > 15 and [k for k, _ in bad if k in kept and kept[k][0]] == []
    low = [(k, kept[k]) for k, t in good if k in kept and kept[k][1] < rules.band_of(len(t.encode()))[0]]
    assert low == []


# 5


def test_classifier(spark, nothing):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(40))
    data = [(i, good() if i % 5 else " ".join(w.upper() + "!!" for w in good().split()), 1 if i % 5 else 0) for i in range(800)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in data] + [(5, None), (None, 1)], "doc_id long, quality int")
    w = quality.train(docs, labels)
    assert (w == quality.train(docs.repartition(7), labels)).all()
    out = {x.doc_id: x for x in quality.score(docs, w).collect()}
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, *_ in data)
    assert np.mean([out[d].predicted == y for d, _, y in data if out[d].held_out]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x " * 50000)], "doc_id long, text string")
    assert all(0 <= x.score <= 1 for x in quality.score(odd, w).collect()) and quality.score(nothing, w).count() == 0
    kept = quality.score(docs, w, keep=True)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted for x in out.values())
    assert (quality.train(docs, labels.where("quality = 1")) == 0).all() and (quality.train(nothing, labels) == 0).all()


def test_ftrl_follows_the_formula():
    rows = [(1, np.array([0, 2]), np.array([0.5, 1.0])), (0, np.array([1, 2]), np.array([1.0, 1.0]))]
    w = quality.ftrl(rows, buckets=2, epochs=2)
    z, n = np.zeros(3), np.zeros(3)
    at = lambda i: 0 if abs(z[i]) <= quality.L1 else -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + np.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for _ in range(2):
        for y, idx, x in rows:
            wi = [at(i) for i in idx]
            p = 1 / (1 + np.exp(-np.dot(wi, x)))
            for i, v, old in zip(idx, x, wi):
                g = (p - y) * v
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / quality.ALPHA * old
                n[i] += g * g
    assert np.allclose(w, [at(i) for i in range(3)], atol=1e-6)


# 6


def test_counts_equal_the_library(docs, rows, nothing):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = P.path("piece_bpe_32k.model")
    vocab, unk = counts.vocabulary(path)
    t = Tokenizer(models.Unigram(vocab, unk, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    out = counts.token_counts(docs, path).collect()
    assert sorted(((r.doc_id, r.n_chars, r.n_tokens) for r in out), key=str) == sorted(((r[0], len(r[1] or ""), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=str)
    assert counts.token_counts(nothing, path).count() == 0


@pytest.mark.parametrize("seed", range(25))
def test_ties_go_as_in_the_library(seed):
    from tokenizers import Tokenizer, models, pre_tokenizers

    r = random.Random(seed)
    vocab = {"<unk>": 0.0}
    for _ in range(12):
        vocab["".join(r.choice("ab▁c") for _ in range(r.randint(1, 3)))] = r.choice([-1.0, -2.0, -0.1, -0.3, -0.7])
    vocab = list(vocab.items())
    t = Tokenizer(models.Unigram(vocab, 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    c = counts.Counter(vocab, 0, False)
    for _ in range(60):
        s = "".join(r.choice("abcd \n▁") for _ in range(r.randint(0, 25)))
        assert c.count(s) == len(t.encode(s, add_special_tokens=False).ids), s


# 7


def test_multiset_hash(docs, rows, nothing):
    out = [r.asDict() for r in multiset.with_neighbours(docs).collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, b(r[1])))
    want = []
    for i, r in enumerate(order):
        t, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 2
        want.append((r[0], len(t), hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()))
    assert sorted(((o["doc_id"], o["n_chars"], o["edited_sha256"]) for o in out), key=str) == sorted(want, key=str)
    of = {r.doc_id: r.fingerprint for r in multiset.fingerprint(docs.where("doc_id is not null and doc_id != 5")).collect()}
    assert all(of[o["doc_id"]] == o["fingerprint"] for o in out if o["doc_id"] in of) and all(0 <= o["near_edited"] <= 1 and 0 <= o["near_next"] <= 1 for o in out)
    assert multiset.with_neighbours(nothing).count() == 0 == multiset.fingerprint(nothing).count()
    one = multiset.with_neighbours(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_homomorphism():
    f = lambda t: multiset.to_string(*(x[0] for x in multiset.vectors([t])))
    assert f("a b\nc d\ne") == f("e\na b\nc d") != f("a b\nc d")
    assert multiset.combine(f("a b\nc d"), f("e")) == f("a b\nc d\ne") and multiset.combine(f("a b\nc d\ne"), f("c d"), -1) == f("e\na b")
    assert f("x\nx") != f("x") and f("") == f(None) == f("\n\n")
    near = lambda s, t: float(multiset.likeness(*(tuple(x[i : i + 1] for x in multiset.vectors([s, t])) for i in (0, 1)))[0])
    text = "\n".join(f"sentence number {i} of this text" for i in range(60))
    other = "\n".join(f"quite another one {i} in here" for i in range(60))
    assert near(text, text) == 1 and near("", "") == 1 and near("", text) == 0 and near(text, other) < 0.2
    assert 0.7 < near(text, text.replace("number 3 ", "number x ")) < 1


# 8


def brute_simhash(text):
    w = b(text).lower().split()
    from xxhash import xxh64_intdigest

    if not w:
        return 0
    made = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in made) > len(made))


def brute_groups(pairs, nodes):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_simhash(docs, rows, nothing):
    out = sim.groups(docs).collect()
    prints = [brute_simhash(r[1]) for r in rows]
    linked = [[j for j, q in enumerate(prints) if bin(p ^ q).count("1") <= 3] for p in prints]
    comp = brute_groups([(i, j) for i, l in enumerate(linked) for j in l], range(len(rows)))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[comp[i]].append(r[0])
    want = [(r[0], f"{prints[i]:016x}", len(linked[i]) - 1, min(least[comp[i]], default=None)) for i, r in enumerate(rows)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert sim.groups(nothing).count() == 0
    kept = sim.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp.values())) and sim.keep_one(nothing).count() == 0
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(min(x) for x in least.values() if x)


def test_golay_keys_meet():
    r = np.random.default_rng(0)
    v = r.integers(0, 1 << 23, 400).astype(np.uint32)
    keys = sim.golay_keys(v)
    assert {len(set(k)) for k in keys.tolist()} <= {1, 6}
    for bit in range(23):
        assert all(x in set(k) for x, k in zip(sim.golay_index(v ^ np.uint32(1 << bit)).tolist(), keys.tolist()))


@pytest.mark.parametrize("hot", [0, 3, sim.HOT])
def test_no_link_is_lost(spark, hot):
    r = random.Random(hot)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for x in base:
        for _ in range(12):
            y = x
            for bit in r.sample(range(64), r.randint(1, 5)):
                y ^= 1 << bit
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(p.u, p.v) for p in sim.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), hot).collect()}
    mask = (1 << 64) - 1
    assert got == {(min(x, y), max(x, y)) for x, y in itertools.combinations(signed, 2) if bin((x ^ y) & mask).count("1") <= 3}


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, r.randint(201, 260)) for _ in range(60)] + [(r.randint(300, 340), r.randint(300, 340)) for _ in range(30)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == brute_groups(edges, nodes | {x for e in edges for x in e}) or got == {k: v for k, v in brute_groups(edges, nodes).items()}


# 9


def test_hmm_counts_and_base(docs, rows, nothing):
    out = [r.asDict() for r in hmm.score(docs, explicit=8, known=12, states=3, rounds=2).collect()]
    train, toks = Counter(), []
    for r in rows:
        t = [*b(r[1]).lower().split(), None]
        held = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2
        toks.append((r[0], held, t))
        if not held:
            train.update(t)
    N, V = sum(train.values()), len(train)
    want = [(d, h, len(t), sum(train[w] > 0 for w in t), N, round(sum(np.log10((train[w] + 1) / (N + V + 1)) for w in t), 5)) for d, h, t in toks]
    got = [(o["doc_id"], o["held_out"], o["n_tokens"], o["n_known"], o["train_tokens"], round(o["base_score"], 5)) for o in out]
    assert sorted(got, key=str) == sorted(want, key=str) and all(np.isfinite(o["score"]) and o["score"] < 0 for o in out)
    assert hmm.score(nothing).count() == 0
    one = hmm.score(docs, explicit=8, known=12, states=1, rounds=1).collect()
    assert len(one) == len(rows)


def test_hmm_is_exact():
    r = np.random.default_rng(0)
    m = hmm.Model(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(5), 3).T)
    seqs = [r.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 3, 4, 4, 5)]
    path = lambda d, z: m.start[z[0]] * m.emit[d[0], z[0]] * np.prod([m.move[z[i - 1], z[i]] * m.emit[d[i], z[i]] for i in range(1, len(d))])
    total = [sum(path(d, z) for z in itertools.product(range(3), repeat=len(d))) for d in seqs]
    assert np.allclose(hmm.log10_likelihood(m, seqs), np.log10(total))
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    assert np.isclose(hmm.expected(m, seqs, start, move, emit), np.log(total).sum())
    s, v, e = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for d, p in zip(seqs, total):
        for z in itertools.product(range(3), repeat=len(d)):
            w = path(d, z) / p
            s[z[0]] += w
            for i in range(len(d)):
                e[z[i], d[i]] += w
                if i:
                    v[z[i - 1], z[i]] += w
    assert np.allclose(start, s, atol=1e-5) and np.allclose(move, v, atol=1e-5) and np.allclose(emit, e, atol=1e-5)


# 10


def brute_lines(rows, least=0.8):
    docs = sorted({(r[0] is None, r[0] or 0, i) for i, r in enumerate(rows)})
    del docs
    occ = []
    for i, r in enumerate(rows):
        for j, x in enumerate(b(r[1]).lower().split(b"\n") if r[1] is not None else []):
            if x.split():
                occ.append((i, j, x))
    return occ


def family(seed):
    """Rows with many near copies of a few passages, so that pairs meet at several words and in several places."""
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(150)]
    base = [r.sample(vocab, r.choice([3, 6, 12, 30, 60])) for _ in range(8)]
    out = []
    for _ in range(60):
        lines = []
        for _ in range(r.randint(1, 5)):
            x = list(r.choice(base))
            for _ in range(r.randint(0, max(1, len(x) // 6))):
                x[r.randrange(len(x))] = r.choice(vocab)
            lines.append(" ".join(x[r.randint(0, 1) :]))
        out.append((0, "\n".join(lines), "en", "s", 0, *"abcdefg"))
    return out


@pytest.mark.parametrize("meet,made", [(dedup.MEET, corpus), (3, corpus), (dedup.MEET, family), (2, family), (9, family)])
def test_line_dedup(spark, nothing, meet, made):
    # Ids that differ, so that the order of lines is theirs.
    rows = [(i, *r[1:]) for i, r in enumerate(made(4))]
    out = {r.doc_id: r for r in dedup.report(spark.createDataFrame(rows, SCHEMA).repartition(3), meet=meet).collect()}
    occ = brute_lines(rows)
    n, first = Counter(x for *_, x in occ), {}
    for i, j, x in occ:
        first.setdefault(x, (i, j))
    sets = {x: frozenset(x.split()) for x in n}
    near = {x: [y for y in n if y != x and 9 * len(sets[x] & sets[y]) >= 4 * (len(sets[x]) + len(sets[y]))] for x in n}
    want = defaultdict(lambda: [[], 0, 0, 0, []])
    for i, j, x in occ:
        w = want[i]
        if min([first[x], *(first[y] for y in near[x])]) != (i, j):
            w[4].append("%d:%d" % min([first[x], *(first[y] for y in near[x])]))
        w[3] += n[x] - 1 + sum(n[y] for y in near[x])
        if first[x] != (i, j):
            w[0].append(j)
            w[1] += 1
        elif any(first[y] < first[x] for y in near[x]):
            w[0].append(j)
            w[2] += 1
    for r in rows:
        w, lines = want[r[0]], 0 if r[1] is None else len(r[1].split("\n"))
        o = out[r[0]]
        assert (o.n_lines, o.n_kept, o.n_same, o.n_near, o.n_links, o.removed, o.matched) == (lines, lines - w[1] - w[2], w[1], w[2], w[3], ",".join(map(str, w[0])), ",".join(w[4]))
    assert any(o.n_near for o in out.values()) and dedup.report(nothing).count() == 0


def entries_of(texts, bits):
    import pyarrow as pa

    _, lines = dedup._split(pa.array(texts))
    raw = lines.cast(pa.large_binary()).to_pylist()
    fresh, keys = dedup._fresh(raw, set())
    ordered, n = dedup._ordered(*dedup._words(lines.take(pa.array(fresh))), len(fresh), np.full(dedup.BUCKETS, 10, np.uint32))
    sets = {int.from_bytes(k[:8], "little", signed=True): frozenset(raw[i].split()) for i, k in zip(fresh, keys)}
    return *dedup._entries(ordered, n, keys, 4, 5, bits), sets


@pytest.mark.parametrize("meet,most", [(10_000, 10_000), (5, 10_000), (5, 40)])
def test_lines_that_match_meet(meet, most):
    """Of two matching lines both leave a meeting, in one piece or set aside and met in blocks, whether or not a task holds all of a bucket."""
    import pyarrow as pa

    e, bucket, sets = entries_of([r[1] for r in family(1)], 3)
    at = [(x, e[i : min(i + 7, hi)].tobytes()) for x in np.unique(bucket) for lo, hi in [np.searchsorted(bucket, [x, x + 1])] for i in range(lo, hi, 7)]
    at += at[:: 5]  # met by two tasks
    at.sort(key=lambda r: r[0])
    batches = [pa.RecordBatch.from_arrays([pa.array([int(x) for x, _ in at[i : i + 4]]), pa.array([d for _, d in at[i : i + 4]], pa.binary())], names=["bucket", "data"]) for i in range(0, len(at), 4)]
    met, aside = defaultdict(set), []
    for out in dedup._meet(4, 5, 3, meet, most)(iter(batches)):
        for r in out.to_pylist():
            if r["kind"]:
                aside.append((r["g"], r["data"], r["n"]))
            else:
                met[r["g"]].add(r["k"])
    assert bool(aside) == (meet == 5)
    if aside:
        lines = Counter()
        for g, _, n in aside:
            lines[g] += n
        blocks = pa.RecordBatch.from_arrays([pa.array([g for g, *_ in aside]), pa.array([d for _, d, _ in aside], pa.binary()), pa.array([1 + lines[g] // meet for g, *_ in aside])], names=["g", "data", "blocks"])
        rows = sorted((r for out in dedup._in_blocks([blocks]) for r in out.to_pylist()), key=lambda r: r["place"])
        laid = pa.RecordBatch.from_pylist(rows, pa.schema([("place", pa.int64()), ("side", pa.int32()), ("data", pa.binary())]))
        for out in dedup._meet_again(4, 5)(laid.slice(i, 9) for i in range(0, laid.num_rows, 9)):
            for r in out.to_pylist():
                met[r["g"]].add(r["k"])
    pairs = {p for ks in met.values() for p in itertools.combinations(sorted(ks), 2)}
    want = {tuple(sorted((x, y))) for x, y in itertools.combinations(sets, 2) if 9 * len(sets[x] & sets[y]) >= 4 * (len(sets[x]) + len(sets[y]))}
    assert want and want <= pairs


@pytest.mark.parametrize("matrix", [dedup.MATRIX, 0])
def test_overlaps(monkeypatch, matrix):
    monkeypatch.setattr(dedup, "MATRIX", matrix)
    r = random.Random(3)
    sets = [r.sample(range(300), r.randint(1, 80)) for _ in range(40)]
    count = dedup._overlaps(np.concatenate(sets), np.array([len(x) for x in sets]), 300)
    i, j = np.array(list(itertools.combinations(range(40), 2))).T
    assert count(i, j).tolist() == [len(set(sets[x]) & set(sets[y])) for x, y in zip(i, j)]


def test_tables_of_many_tasks(spark):
    """Tasks' tables are summed in a tree, up to the largest number that fits."""
    import pyarrow as pa

    def run(batches):
        for _ in batches:
            pass
        yield dedup._blocks(np.full(4096, 1 << 30, np.uint32), 4096)

    def sums(x, y):
        return np.minimum(x.view(np.uint32).astype(np.uint64) + y.view(np.uint32), (1 << 32) - 1).astype(np.uint32).view(np.uint8)

    rows = lambda n: spark.range(n).repartition(n).mapInArrow(run, dedup._ROWS)
    assert set(dedup._merge(rows(3), 4096 * 4, 4096, sums, fan=2).view(np.uint32).tolist()) == {3 << 30}
    assert set(dedup._merge(rows(9), 4096 * 4, 4096, sums, fan=2).view(np.uint32).tolist()) == {(1 << 32) - 1}


def test_removed_lines_in_clashing_columns(spark):
    text = "\n".join(f"line {i} of some words" for i in range(50))
    names = [f"_quern{i}" for i in range(4)] + ["_id", "_th", "_rid", "_rth", "_removed", "_text", "number", "k", "kk", "kind"]
    df = spark.createDataFrame([(1, text, *names), (2, text + "\nlast one here", *names), (2, text + "\nlast one here", *names)], "doc_id long, text string, " + ", ".join(f"`{x}` string" for x in names))
    out = dedup.remove_lines(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, text), (2, "last one here"), (2, "last one here")]
    assert all([r[x] for x in names] == names for r in out.collect())


def test_removed_lines_leave_the_text(docs, rows, nothing):
    out = dedup.remove_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and dedup.remove_lines(nothing).count() == 0
    got = {(r.doc_id, r.n_chars): r.text for r in out.collect()}
    assert got[(0, 0)] is not None and [r.text for r in out.collect() if r.text is None] == [r[1] for r in rows if r[1] is None]
    by_id = {r.doc_id: r for r in dedup.report(docs.where("doc_id is not null and doc_id != 5")).collect()}
    assert len(by_id) == len({r[0] for r in rows if r[0] not in (None, 5)})
