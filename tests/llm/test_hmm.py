"""The hidden Markov model's scores from end to end, against a plain version: one document and one step at a time."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import op09_hmm as hmm


def forward_backward(model, seq, inner):
    """(log likelihood, state shares at each place, expected moves); ``inner``: a factor for each place and state."""
    b = model.emit[seq] * inner
    k, n = len(model.start), len(seq)
    alpha, beta, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        a = (model.start if t == 0 else alpha[t - 1] @ model.move) * b[t]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = model.move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    moves = sum((np.outer(alpha[t], b[t + 1] * beta[t + 1]) * model.move / scale[t + 1] for t in range(n - 1)), np.zeros((k, k)))
    return np.log(scale).sum(), alpha * beta, moves


def brute(rows, states, rounds, explicit):
    train, docs = Counter(), []
    for d, text in rows:
        words = (text or "").encode().lower().split()
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        docs.append((words, held))
        if not held:
            train.update(words)
    n_docs = sum(not h for _, h in docs)
    by_n = Counter(train.values())
    held, least = 0, 1 << 62
    for n in sorted(by_n, reverse=True):
        held += by_n[n]
        if held <= explicit:
            least = n
    top = sorted(w for w, n in train.items() if n >= least)
    # Symbols are told apart as the engine numbers them: the first model's noise goes by number.
    top = [top[i] for i in np.lexsort((hmm._named(top)["b"], hmm._named(top)["a"]))] if top else []
    number = {w: i + 1 for i, w in enumerate(top)}
    m = len(top)
    rare = {w: n for w, n in train.items() if w not in number}
    in_class, of_class = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, n in rare.items():
        in_class[hmm.word_class(w)] += n
        of_class[hmm.word_class(w)] += 1
    unigram = np.concatenate([[n_docs], [train[w] for w in top], in_class]) + 1
    unigram /= unigram.sum()
    model = hmm.Model.first(unigram, states)
    seqs = [np.array([number.get(w, 1 + m + hmm.word_class(w)) for w in words] + [0]) for words, _ in docs]
    c = {w: np.zeros(states) for w in rare}
    inner = np.zeros((hmm.CLASSES, states))
    for r in range(rounds):
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((len(unigram), states))
        for (words, held), seq in zip(docs, seqs):
            if held:
                continue
            _, share, moves = forward_backward(model, seq, np.ones((len(seq), states)))
            start += share[0]
            move += moves
            np.add.at(emit, seq, share)
            if r == rounds - 1:
                for w, s in zip(words, share):
                    if w in c:
                        c[w] += s
        inner = emit[1 + m :]
        model = hmm.Model.from_counts(start, move, emit, unigram)
    out = []
    for (words, _), seq in zip(docs, seqs):
        factor = np.ones((len(seq), states))
        for t, w in enumerate(words):
            if w not in number:
                k = hmm.word_class(w)
                total = inner[k].sum()
                if total > 0:
                    rho = inner[k] / total
                    own = (c.get(w, np.zeros(states)) + rho) / np.where(rho > 0, inner[k] + rho * (of_class[k] + 1), 1)
                    factor[t] = np.where(rho > 1e-12, own, 1 / (total + of_class[k] + 1))
                else:
                    factor[t] = 1 / (total + of_class[k] + 1)
        out.append(forward_backward(model, seq, factor)[0] / np.log(10))
    return out


def texts(seed, n=70):
    """Two kinds of documents, each with its own frequent and rare words."""
    r = random.Random(seed)
    kinds = [[f"a{i}x" for i in range(40)], [f"b{i}x" for i in range(40)]]
    out = []
    for i in range(n):
        own = kinds[i % 2]
        out.append(" ".join(r.choice(own) if r.random() < 0.7 else r.choice(["the", "of", "and", f"n{r.randint(0, 400)}"]) for _ in range(r.randint(0, 40))))
    return [*enumerate(out), (None, None), (500, ""), (501, " \n"), (502, "THE Of never met before"), (3, out[3]), (3, out[3])]


@pytest.mark.parametrize("explicit,known,states,rounds", [(6, 30, 3, 3), (6, 6, 2, 2), (0, 0, 2, 2), (1000, 2000, 3, 2), (20, 100, 1, 1)])
def test_scores_equal_a_plain_version(spark, explicit, known, states, rounds):
    rows = texts(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in hmm.score(df, explicit=explicit, known=known, states=states, rounds=rounds).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    want = {}
    for (d, _), x in zip(rows, brute(rows, states, rounds, explicit)):
        want.setdefault(d, []).append(x)
    assert got.keys() == want.keys() and all(sorted(got[d]) == pytest.approx(sorted(want[d]), rel=2e-4, abs=1e-4) for d in want)


def test_words_within_a_class_are_a_distribution():
    r = np.random.default_rng(0)
    states, words = 3, 9
    cls = np.array([0, 0, 0, 0, 1, 1, 1, 2, 2])
    c = r.gamma(1, size=(words, states))
    of_class, in_class = np.bincount(cls, minlength=4).astype(float), np.zeros((4, states))
    np.add.at(in_class, cls, c)
    own = hmm.within(c, cls, in_class, of_class)
    unseen = hmm.within(np.zeros((4, states)), np.arange(4), in_class, of_class)
    for k in range(4):
        assert np.allclose(own[cls == k].sum(0) + unseen[k], 1)
    # Over the states it is the add-one frequency.
    share = in_class[cls] / in_class[cls].sum(1, keepdims=True)
    assert np.allclose((own * share).sum(1), (c.sum(1) + 1) / (in_class[cls].sum(1) + of_class[cls] + 1))


def test_states_matter_to_rare_words(spark):
    """Held-out text of one kind is likelier where rare words are learnt by state than where they are only counted."""
    df = spark.createDataFrame(texts(2, 400), "doc_id long, text string")
    by_state = hmm.score(df, explicit=4, states=2, rounds=8).where("held_out").agg({"score": "sum"}).first()[0]
    alike = hmm.score(df, explicit=4, states=1, rounds=1).where("held_out").agg({"score": "sum"}).first()[0]
    assert by_state > alike


def test_other_columns_and_an_empty_table(spark):
    names = ["block", "ids", "held", "ends", "symbols", "outer", "names", "bucket", "data", "kind", "score"]
    df = spark.createDataFrame([(i, f"some words {i}", *names) for i in range(9)], "doc_id long, text string, " + ", ".join(f"{x} string" for x in names))
    assert hmm.score(df, states=2, rounds=1).count() == 9
    assert hmm.score(df.where("false"), states=2, rounds=1).count() == 0
    ids = df.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert sorted(r.doc_id for r in hmm.score(ids, states=2, rounds=1).collect()) == [f"d{i}" for i in range(9)]
