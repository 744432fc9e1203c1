"""A quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader updates and scored as sparse dot products.

Features are the words of a text and their pairs, and the same of the words' shapes (runs of
capitals, small letters, digits and other characters, and a mark for a word that repeats the one
before), hashed into ``BUCKETS``. Each group's features count by their share of the group, so a
text's score doesn't depend on its length. Only the text is read.

Training takes at most ``SAMPLE`` labelled rows, those with the smallest seeded hash of their id (of
one id's those with the smallest hash of the text; equal rows once):
a documented bound, the same at every size. Their features are hashed where the texts lie; one
task then runs the updates, whose cost is bounded as the sample is.

A null or empty text, or one without words, has no features, and its score is the bias alone. A
label that is null is no label; of several labels of an id the smallest counts. With no labels,
or none of a kind, the score is 0.5. A very long text counts whole, its features by their shares. An empty table gives an
empty result. Other columns, whatever their names, are ignored (``keep`` returns them as they were); repeated rows get repeated scores.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.pieces import parts
from quern.llm.workers import lean, values
from quern.session import materialise, spread

BUCKETS = 1 << 20
SAMPLE, EPOCHS = 10_000, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-4
#: Words whose hashes a task remembers.
KEEP = 200_000
_RUNS = re.compile(rb"[A-Z]+|[a-z]+|[0-9]+|[\x80-\xff]+|[^A-Za-z0-9\x80-\xff]")
_M = np.uint64(0x9E3779B97F4A7C15)


def shape(word: bytes) -> bytes:
    """``Word!!`` becomes ``Aa!!``: runs of letters or digits shrink to one sign, marks stay."""
    out = []
    for run in _RUNS.findall(word):
        c = run[:1]
        out.append(b"A" if c.isupper() else b"a" if c.islower() or c >= b"\x80" else b"0" if c.isdigit() else run)
    return b"".join(x for i, x in enumerate(out) if i == 0 or x != out[i - 1] or x not in (b"A", b"a", b"0"))


class Hasher:
    """Bucket numbers of texts' features. Different words are hashed once for a batch, and those met before not again."""

    def __init__(self, buckets: int = BUCKETS):
        import xxhash

        self.hash, self.buckets = xxhash.xxh64_intdigest, np.uint64(buckets)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table, self.n = np.zeros((1 << 12, 2), np.uint64), 0

    def _look(self, words: list[bytes]) -> np.ndarray:
        """(words, 2): the hashes of different words and of their shapes."""
        if len(self.known) > KEEP:
            self._reset()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        fresh = [words[i] for i in new.tolist()]
        while self.n + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        at[new] = self.n + np.arange(len(new))
        self.table[at[new], 0] = np.fromiter((self.hash(w, 1) for w in fresh), np.uint64, len(fresh))
        self.table[at[new], 1] = np.fromiter((self.hash(shape(w), 2) for w in fresh), np.uint64, len(fresh))
        self.known.update(zip(fresh, at[new].tolist()))
        self.n += len(fresh)
        return self.table[at]

    def features(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Each text's number of words; for words and for shapes the buckets of each and of its pair with the next; and where the next is of the same text."""
        plain = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(plain)
        coded = lists.flatten().dictionary_encode()
        words, code = values(coded.dictionary.cast(pa.large_binary())), coded.indices.to_numpy()
        n = pc.list_value_length(lists).to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        if b"" in words:  # white space at an end leaves an empty word
            full = code != words.index(b"")
            code, doc = code[full], doc[full]
            n = np.bincount(doc, minlength=len(n))
        h = self._look(words)[code] if len(code) else np.zeros((0, 2), np.uint64)
        w, s = h[:, 0], h[:, 1].copy()
        pairs = doc[1:] == doc[:-1]
        s[1:][pairs & (w[1:] == w[:-1])] ^= np.uint64(0x5BD1E995)
        pair = lambda x: ((x[:-1] * np.uint64(31) + x[1:]) * _M) ^ (x[1:] >> np.uint64(17))
        cut = lambda x: ((x ^ (x >> np.uint64(32))) % self.buckets).astype(np.uint32)
        return n, [(cut(w), cut(pair(w))), (cut(s), cut(pair(s)))], pairs

    def groups(self, texts: pa.Array):
        """For each text the buckets of its words and pairs, and of its shapes and theirs."""
        n, made, _ = self.features(texts)
        ends = np.cumsum(n)
        for start, stop in zip((ends - n).tolist(), ends.tolist()):
            yield tuple(np.concatenate([one[start:stop], two[start : max(start, stop - 1)]]) for one, two in made)

    def sums(self, texts: pa.Array, weights: np.ndarray) -> np.ndarray:
        """The dot product of each text's features, by their shares, and ``weights``."""
        n, made, pairs = self.features(texts)
        doc = np.repeat(np.arange(len(n)), n)
        out = np.full(len(n), float(weights[-1]))
        for one, two in made:
            total = np.bincount(doc, weights=weights[one], minlength=len(n)) + np.bincount(doc[:-1][pairs], weights=weights[two[pairs]], minlength=len(n))
            out += total / np.maximum(1, 2 * n - 1)
        return out


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) from rows of label, feature numbers (distinct) and values, in the order given."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for _ in range(epochs):
        for y, idx, x in rows:
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            g2 = g * g
            z[idx] = zi + g - (np.sqrt(ni + g2) - root) / ALPHA * w
            n[idx] = ni + g2
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32)


def sparse(groups: tuple[np.ndarray, np.ndarray], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and values: each group's shares, and the bias."""
    parts = [(g, np.full(len(g), 1 / len(g))) for g in groups if len(g)]
    idx = np.concatenate([g for g, _ in parts] + [np.array([buckets], np.uint32)])
    val = np.concatenate([v for _, v in parts] + [np.ones(1)])
    u, inverse = np.unique(idx, return_inverse=True)
    return u, np.bincount(inverse, weights=val)


def held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    """Whether CRC-32 of the id's text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from the labelled documents whose id isn't held out."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_y"))
    chosen = usable.withColumn("_order", F.xxhash64(F.lit(5), "_id")).orderBy("_order", "_id").limit(sample)
    # At most ``sample`` ids of a few bytes each.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").withColumn("_th", F.xxhash64("_text"))

    def hash_rows(batches):
        h, seen = Hasher(), set()
        for batch in batches:
            # Equal rows of a task are hashed once; the others of an id stay few, as the sample does.
            fresh = [i for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 4)))) if not (k in seen or seen.add(k))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            if len(seen) > KEEP:
                seen.clear()
            idx, val = [], []
            for made in h.groups(batch.column(1)):
                i, v = sparse(made)
                idx.append(i.astype("<u4").tobytes())
                val.append(v.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(0), batch.column(4), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["_y", "_order", "_id", "_th", "idx", "val"])

    def fit(batches):
        rows = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns))
        rows.sort(key=lambda r: (r[1], r[2], r[3]))
        made = [(y, np.frombuffer(i, "<u4"), np.frombuffer(v, "<f4").astype(np.float64)) for y, _, _, i, v in rows]
        w = ftrl(made, epochs=epochs) if len({r[0] for r in made}) > 1 else np.zeros(BUCKETS + 1, np.float32)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary())], names=["at", "w"])

    id_type = docs.schema[id_col].dataType.simpleString()
    hashed = materialise(rows.select("_id", "_text", "_y", "_order", "_th").mapInArrow(lean(hash_rows), f"_y int, _order long, _id {id_type}, _th long, idx binary, val binary"), "features")
    # An id may stand in many rows: the bound is on rows, chosen by their keys alone.
    keys = hashed.select("_order", "_id", "_th").distinct().orderBy("_order", "_id", "_th").limit(sample)
    used = hashed.join(F.broadcast(keys), ["_order", "_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"])
    got = used.select("_y", "_order", "_th", "idx", "val").repartition(1).mapInArrow(fit, "at binary, w binary").collect()
    w = np.zeros(BUCKETS + 1, np.float32)
    for r in got:
        w[np.frombuffer(r.at, "<u4")] = np.frombuffer(r.w, np.float32)
    return w


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """The id, held_out, score and predicted. With ``keep``: the columns of ``docs``, of the rows predicted 1."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS + 1 floats

    def probabilities(batch: pa.RecordBatch, column: int, h: Hasher, w: np.ndarray) -> np.ndarray:
        sums = [h.sums(part.column(column), w) for part in parts(batch, column)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *sums]), -35, 35)))

    if keep:
        at = docs.columns.index(text_col)

        def choose(batches):
            h, w = Hasher(), sent.value
            for batch in batches:
                p = probabilities(batch, at, h, w)
                yield batch.filter(pa.array(p >= threshold))

        return spread(docs).mapInArrow(lean(choose), docs.schema)

    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        h, w = Hasher(), sent.value
        for batch in batches:
            p = probabilities(batch, 1, h, w)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return spread(docs.select(F.col(id_col), F.col(text_col), held_out(id_col).alias("_held"))).mapInArrow(lean(run), f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")
