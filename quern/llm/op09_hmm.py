"""A hidden Markov language model.

Words are counted over every training document. The ``EXPLICIT`` most frequent words and the end
mark are symbols of their own; any other word is emitted in two steps, its class (by its last
letters, so that unseen words have one too) by the state, and the word within the class by the
state as well. Symbols' emissions are a table of fixed size. Those of words within classes are a
table of all words, spread over the cluster, which grows with the corpus as the word counts do: no word's
share depends on how many others there are.

Baum-Welch: each task runs the scaled forward and backward recursions over its documents, many
side by side, and returns expected counts; these are summed by blocks of symbols on the
executors, in a tree, and the driver receives one table (states x symbols). The last round also gives the expected
counts of every word and state, summed by word where the word counts lie. Within a class a word
has, in a state, its expected count and its share of one pseudo-count, so that over all states that is
the add-one frequency. A text's probability is that of its whole sequence under the scaled forward recursion.

Words are known by 96 bits of their hash. A word's expected counts are kept as its count and 16 bits of each
state's share. The emissions of the ``KNOWN`` most frequent are
broadcast; others' meet the blocks of documents that ask for them.

A null or empty text is the end mark alone. Without training text each word has the base's
1/(N+V+1). Of words equally frequent, those of one count are symbols together or not at all. A very long text is one sequence,
in a block of its own. Repeated rows are scored each; an empty table gives an empty result. Only the id and text are read, so that other columns may
have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.pieces import parts
from quern.llm.workers import bucket_count, lean, packed, values
from quern.session import Scratch, materialise, release, spread

STATES, ROUNDS = 8, 6
#: Words that are symbols, classes of the others, and words whose emissions are broadcast.
EXPLICIT, CLASSES, KNOWN = 16_000, 1024, 200_000
#: Pseudo-counts of the unigram in each state's emissions, and of each transition.
PRIOR, MOVES = 50.0, 1.0
#: Symbols of a block when counts are summed, and tasks' rows summed in one place; ids of one recursion; bytes of text in a block of documents.
BLOCK, FAN, TOKENS, TEXT = 2048, 256, 200_000, 8 << 20
#: A word, its count and class; what a block expects of it in each state is added behind.
WORD = [("a", "<u8"), ("b", "<u4")]
COUNT = np.dtype([*WORD, ("n", "<u8"), ("cls", "<u2")])


def word_class(word: bytes) -> int:
    from zlib import crc32

    return crc32(word[-4:]) % CLASSES


def _named(words: list[bytes], n: np.ndarray | None = None, kind: np.dtype = COUNT) -> np.ndarray:
    """Records of different words: their 96 bits, and counts and classes if ``kind`` has them."""
    from xxhash import xxh3_128_digest

    out = np.zeros(len(words), kind)
    raw = np.frombuffer(b"".join([xxh3_128_digest(w)[:12] for w in words]), np.dtype(WORD))
    out["a"], out["b"] = raw["a"], raw["b"]
    if n is not None:
        out["n"], out["cls"] = n, [word_class(w) for w in words]
    return out


def _sorted(x: np.ndarray) -> np.ndarray:
    return x[np.lexsort((x["b"], x["a"]))]


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each of ``x``'s words in a sorted table of different words; -1 if it isn't there."""
    at = np.searchsorted(table["a"], x["a"])
    out, todo = np.full(len(x), -1), np.arange(len(x))
    while len(todo):
        todo = todo[at[todo] < len(table)]
        todo = todo[table["a"][at[todo]] == x["a"][todo]]
        same = table["b"][at[todo]] == x["b"][todo]
        out[todo[same]] = at[todo[same]]
        todo = todo[~same]
        at[todo] += 1
    return out


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x["a"] >> np.uint64(20)).astype(np.int64) & (buckets - 1)


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each text's number of words, the words' numbers, and the different words; A-Z lower-cased."""
    plain = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    coded = lists.flatten().dictionary_encode()
    words, code = values(coded.dictionary.cast(pa.large_binary())), coded.indices.to_numpy().astype(np.int64)
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    if b"" in words:  # white space at an end leaves an empty word
        hole = code == words.index(b"")
        n -= np.bincount(np.repeat(np.arange(len(n)), n)[hole], minlength=len(n))
        code = code[~hole]
    return n, code, words


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    """Whether CRC-32 of the id's text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


class Model:
    """start (K), move (K, K), emit (symbols, K): float64, each row of start and move and each column of emit sums to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(unigram: np.ndarray, states: int, seed: int = 3) -> Model:
        """States that last, each with the unigram under its own fixed noise."""
        emit = unigram[:, None] * np.random.default_rng(seed).uniform(0.5, 1.5, (len(unigram), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(0))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        move, emit, start = move + MOVES, emit + PRIOR * unigram[:, None], start + 1
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def side_by_side(docs: list[np.ndarray], tokens: int = TOKENS):
    """Documents by falling length in groups of about ``tokens`` symbols: (their numbers, lengths)."""
    n = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-n, kind="stable")
    at = 0
    while at < len(order):
        stop, held = at, 0
        while stop < len(order) and (held == 0 or held + n[order[stop]] <= tokens):
            held += n[order[stop]]
            stop += 1
        yield order[at:stop], n[order[at:stop]]
        at = stop


def columns(docs: list[np.ndarray], who: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols ordered by position, then document; and where each position begins. Lengths fall, so that position t holds the first documents."""
    flat = np.concatenate([docs[i] for i in who])
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    live = np.bincount(pos)
    begin = np.concatenate([[0], np.cumsum(live)])
    out = np.empty(len(flat), flat.dtype)
    out[begin[pos] + np.repeat(np.arange(len(n)), n)] = flat
    return out, begin


def forward(model: Model, seen: np.ndarray, begin: np.ndarray, keep: bool, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The scales (probability of each symbol given those before), and on demand the scaled forward table. In the model's own precision. ``inner``: a factor for each symbol and state."""
    move, lit = model.move, model.emit[seen]
    if inner is not None:
        lit *= inner
    scale = np.empty(len(seen), lit.dtype)
    a = None
    edges = begin.tolist()
    for lo, hi in zip(edges, edges[1:]):
        e = lit[lo:hi]
        e *= model.start if a is None else a[: hi - lo] @ move
        c = e.sum(1)
        e /= c[:, None]
        scale[lo:hi] = c
        a = e  # the table is filled in place
    return scale, lit if keep else None


def log10_likelihood(model: Model, docs: list[np.ndarray], inner: np.ndarray | None = None, which: list[np.ndarray] | None = None) -> np.ndarray:
    """``which`` numbers, for each symbol, the row of ``inner`` that its emissions are multiplied by."""
    out = np.zeros(len(docs))
    for who, n in side_by_side(docs):
        seen, begin = columns(docs, who, n)
        scale, _ = forward(model, seen, begin, False, None if inner is None else inner[columns(which, who, n)[0]])
        doc = np.arange(len(seen)) - np.repeat(begin[:-1], np.diff(begin))
        out[who] = np.bincount(doc, weights=np.log10(scale), minlength=len(who))
    return out


def expected(model: Model, docs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, which: list[np.ndarray] | None = None, inside: np.ndarray | None = None) -> float:
    """Add the documents' expected counts to ``start``, ``move`` and ``emit`` (states, symbols); returns their natural log likelihood.

    ``inside`` (states, rows) gets those of the rows that ``which`` names for each symbol.
    The recursions run in single precision, as they are scaled at each step; sums are double.
    """
    total, k = 0.0, len(model.start)
    m = Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))
    back = np.ascontiguousarray(m.move.T)
    for who, n in side_by_side(docs):
        seen, begin = columns(docs, who, n)
        scale, alpha = forward(m, seen, begin, True)
        total += np.log(scale, dtype=np.float64).sum()
        # What follows each symbol, and that times the symbol's emission over its scale.
        beta = np.ones_like(alpha)
        weight = m.emit[seen]
        weight /= scale[:, None]
        edges = begin.tolist()
        after = None
        for lo, hi in zip(edges[-2::-1], edges[:0:-1]):
            if after is not None:
                np.matmul(after, back, out=beta[lo : lo + len(after)])
            after = weight[lo:hi]
            after *= beta[lo:hi]
        if len(begin) > 2:
            # Each symbol but the first follows the one a position before, of the same document.
            live = np.diff(begin)
            before = np.arange(begin[1], len(seen)) - np.repeat(live[:-1], live[1:])
            move += (alpha[before].T @ weight[begin[1] :]).astype(np.float64) * model.move
        alpha *= beta
        start += alpha[: begin[1]].sum(0, dtype=np.float64)
        by_state = np.ascontiguousarray(alpha.T)
        rows = None if which is None else columns(which, who, n)[0]
        for s in range(k):
            emit[s] += np.bincount(seen, weights=by_state[s], minlength=emit.shape[1])
            if rows is not None:
                inside[s] += np.bincount(rows, weights=by_state[s], minlength=inside.shape[1])
    return total


def within(word: np.ndarray, cls: np.ndarray, in_class: np.ndarray, of_class: np.ndarray) -> np.ndarray:
    """(words, states): the probability of each word within its class in each state, from its expected
    counts and its class's (classes, states) and the class's words. Over the states, weighted as the class's counts are, that is
    the add-one frequency; a word without counts has one share of what is left for the unseen."""
    total = in_class.sum(1, keepdims=True)
    share = np.divide(in_class, total, out=np.zeros_like(in_class), where=total > 0)
    left = in_class + share * (of_class[:, None] + 1)
    plain = 1 / (total + of_class[:, None] + 1)
    made = np.divide(word + share[cls], left[cls], out=np.zeros((len(cls), in_class.shape[1])), where=left[cls] > 0)
    return np.where(left[cls] > 1e-9, made, plain[cls])


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pages of different words' records (bucket long, data binary) over every training text; the end mark isn't among them."""
    spark = docs.sparkSession
    buckets, partitions = bucket_count(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, 0, TEXT)):
            _, code, words = _split(batch.column(0))
            n = np.bincount(code, minlength=len(words))
            use = np.flatnonzero(n).tolist()
            found = _named([words[i] for i in use], n[use])
            keys, data = packed(found, _bucket(found, buckets))
            yield pa.RecordBatch.from_arrays([pa.array(keys), data], names=["bucket", "data"])

    texts = spread(docs.where(~held_out(id_col)).select(text_col))
    sent = texts.mapInArrow(lean(run), "bucket long, data binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(lean(_by_bucket(_summed)), "bucket long, data binary")


def _summed(bucket: int, data: list[bytes]) -> np.ndarray:
    x = _sorted(np.concatenate([np.frombuffer(d, COUNT) for d in data]))
    new = np.ones(len(x), bool)
    new[1:] = (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])
    first = np.flatnonzero(new)
    out = x[first]
    out["n"] = np.add.reduceat(x["n"], first)
    return out


def _by_bucket(f):
    """For rows (bucket, data) in order of bucket: one row a bucket, of ``f``'s records."""

    def run(batches):
        now, held = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([f(now, held).tobytes()], pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for bucket, data in zip(values(batch.column(0)), values(batch.column(1))):
                if bucket != now:
                    if held:
                        yield row()
                    now, held = bucket, []
                held.append(data)
        if held:
            yield row()

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, explicit: int = EXPLICIT, known: int = KNOWN) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, after learning from those not held out."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    buckets, partitions = bucket_count(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark)
    counts = scratch.table(count_words(docs, id_col, text_col), "words")
    release(spark)
    n_docs = docs.where(~held_out(id_col)).count()
    EXPECT = np.dtype([*WORD, ("c", "<f4", (states,))])
    EMIT = np.dtype([*COUNT.descr, ("c", "<u2", (states,))])

    def tally(batches):
        """How many words have each count, and the tokens and words of each class."""
        of_n: dict[int, int] = {}
        in_class, of_class = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for data in values(batch.column(1)):
                x = np.frombuffer(data, COUNT)
                n, v = np.unique(x["n"], return_counts=True)
                for i, j in zip(n.tolist(), v.tolist()):
                    of_n[i] = of_n.get(i, 0) + j
                np.add.at(in_class, x["cls"], x["n"].astype(np.int64))
                of_class += np.bincount(x["cls"], minlength=CLASSES)
        n, v = np.array(list(of_n), np.int64), np.array(list(of_n.values()), np.int64)
        cls = np.arange(CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(n), CLASSES]).astype(np.int32)), pa.array(np.concatenate([n, cls])), pa.array(np.concatenate([v, of_class])), pa.array(np.concatenate([n * v, in_class]))], names=["kind", "key", "v", "n"])

    sums = counts.mapInArrow(tally, "kind int, key long, v long, n long").groupBy("kind", "key").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    in_class, of_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums.where("kind = 1").collect():
        in_class[r.key], of_class[r.key] = r.n, r.v
    N, V = int(in_class.sum()) + n_docs, int(of_class.sum()) + (n_docs > 0)
    # The most frequent, as far as all words of a count still fit.
    least, held = {explicit: 1 << 62, known: 1 << 62}, 0
    for r in sums.where("kind = 0").orderBy(F.desc("key")).toLocalIterator():
        held += r.v
        for most in least:
            if held <= most:
                least[most] = r.key
        if held > max(least):
            break

    def frequent(batches, least=min(least.values())):
        for batch in batches:
            for data in values(batch.column(1)):
                x = np.frombuffer(data, COUNT)
                yield pa.RecordBatch.from_arrays([pa.array([x[x["n"] >= least].tobytes()], pa.binary())], names=["data"])

    often = np.concatenate([np.zeros(0, COUNT), *(np.frombuffer(r.data, COUNT) for r in counts.mapInArrow(frequent, "data binary").collect())])  # the greater of ``explicit`` and ``known`` at most
    often = _sorted(often)
    top, often = often[often["n"] >= least[explicit]], often[often["n"] < least[explicit]]
    m = len(top)
    np.subtract.at(in_class, top["cls"], top["n"].astype(np.float64))
    np.subtract.at(of_class, top["cls"], 1)
    size = 1 + m + CLASSES
    unigram = np.concatenate([[n_docs], top["n"].astype(np.float64), in_class]) + 1
    unigram /= unigram.sum()
    base_log = np.log10((np.concatenate([[n_docs], top["n"].astype(np.float64)]) + 1) / (N + V + 1))
    symbol_type = "<u2" if size <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast((top, often))

    def to_symbols(batches):
        """A row for each block of documents: ends of their symbols, the symbols (0 ends a text), and for each that is a class the number of its word: in the table of frequent ones, or behind these among the block's own."""
        top, often = shared.value
        block = TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in parts(whole, 1, TEXT)):
            n, code, words = _split(batch.column(1))
            found = _named(words)
            at = _find(top, found)
            rare = np.flatnonzero(at < 0)
            symbol = at + 1
            symbol[rare] = 1 + m + np.array([word_class(words[i]) for i in rare.tolist()], np.int64)
            own = np.full(len(words), -1)
            own[rare] = _find(often, found[rare])
            rare = np.flatnonzero((at < 0) & (own < 0))
            own[rare] = len(often) + np.arange(len(rare))
            ends = np.cumsum(n + 1)
            flat = np.zeros(int(ends[-1]) if len(ends) else 0, symbol_type)
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            flat[inside] = symbol[code]
            outer = own[code]
            names = np.zeros(len(rare), np.dtype(WORD))
            names["a"], names["b"] = found["a"][rare], found["b"][rare]
            del found
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0).take(pa.array(np.arange(batch.num_rows))))
            yield pa.RecordBatch.from_arrays([pa.array([block]), ids, one(held), one(ends.astype("<i8")), one(flat), one(outer[outer >= 0].astype("<u4")), one(names), pa.array([len(names)])], names=["block", "ids", "held", "ends", "symbols", "outer", "names", "n"])
            block += 1

    schema = f"block long, ids array<{id_type}>, held binary, ends binary, symbols binary, outer binary, names binary, n long"
    laid = materialise(spread(docs.select(F.col(id_col), F.col(text_col), held_out(id_col))).mapInArrow(lean(to_symbols), schema), "symbols")
    train = laid.select("held", "ends", "symbols", "outer", "names")

    def unpack(held, ends, symbols, outer, rows):
        """A block's documents: whether they are held out, their symbols, and (unless ``rows`` is None) for each symbol its word's number, or ``rows``."""
        ends, flat = np.frombuffer(ends, "<i8"), np.frombuffer(symbols, symbol_type)
        cut = lambda x: np.split(x, ends[:-1])
        if rows is None:
            return np.frombuffer(held, np.uint8).astype(bool), cut(flat), None
        which = np.full(len(flat), rows)
        which[flat > m] = np.frombuffer(outer, "<u4")
        return np.frombuffer(held, np.uint8).astype(bool), cut(flat), cut(which)

    def sums_of(batches, sent, last):
        start, move, emit, ll = np.zeros(states), np.zeros((states, states)), np.zeros((states, size)), 0.0
        often = shared.value[1]
        total = np.zeros((len(often), states), np.float32) if last else None

        def expects(name, c):
            x = np.zeros(len(name), EXPECT)
            x["a"], x["b"], x["c"] = name["a"], name["b"], c
            x = x[x["c"].any(1)]
            keys, data = packed(x, _bucket(x, buckets))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), 1, np.int32)), data], names=["bucket", "kind", "data"])

        for batch in batches:
            for held, ends, symbols, outer, names in zip(*(values(c) for c in batch.columns)):
                rows = len(often) + len(names) // 12
                out, flat, which = unpack(held, ends, symbols, outer, rows if last else None)
                use = np.flatnonzero(~out).tolist()
                inside = np.zeros((states, rows + 1)) if last else None
                ll += expected(sent.value, [flat[i] for i in use], start, move, emit, [which[i] for i in use] if last else None, inside)
                if last:
                    total += inside[:, : len(often)].T
                    yield expects(np.frombuffer(names, np.dtype(WORD)), inside[:, len(often) : rows].T)
        if last:
            yield expects(often, total)
        task = TaskContext.get().partitionId()
        cuts = range(0, size, BLOCK)
        data = [np.concatenate([[ll], start, move.ravel()]).tobytes()] + [np.ascontiguousarray(emit[:, b : b + BLOCK]).tobytes() for b in cuts]
        # Below zero: no bucket of words.
        yield pa.RecordBatch.from_arrays([pa.array([-1 - i for i in range(len(data))], pa.int64()), pa.array(np.full(len(data), task, np.int32)), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])

    def added(rows: DataFrame, tasks: int) -> dict[int, np.ndarray]:
        """Tables summed on the executors, at most ``FAN`` in one place, and one of each block collected."""

        def add(table: pa.Table) -> pa.Table:
            s = sum(np.frombuffer(b, np.float64) for b in table.column("data").to_pylist())
            return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int64()), "kind": pa.array([table.column("kind")[0].as_py() // FAN], pa.int32()), "data": pa.array([s.tobytes()], pa.binary())})

        while tasks > FAN:
            rows = rows.groupBy("bucket", F.floor(F.col("kind") / FAN)).applyInArrow(lambda key, table: add(table), "bucket long, kind int, data binary")
            tasks = -(-tasks // FAN)
        return {-1 - r.bucket: np.frombuffer(r.data, np.float64) for r in rows.groupBy("bucket").applyInArrow(add, "bucket long, kind int, data binary").collect()}

    model, tasks, emissions = Model.first(unigram, states), train.rdd.getNumPartitions(), None
    packs = "bucket long, kind int, data binary"
    for k in range(rounds if n_docs else 0):
        sent, last = spark.sparkContext.broadcast(model), k == rounds - 1
        rows = train.mapInArrow(lean(lambda b, sent=sent, last=last: sums_of(b, sent, last)), packs)
        if last:
            # The words' expected counts go to the pages of their counts; the tables of symbols come along.
            pages = counts.select("bucket", F.lit(0).alias("kind"), "data")
            both = rows.unionByName(pages).repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind")
            done = materialise(both.mapInArrow(lean(_joined(EXPECT, EMIT)), packs), "emissions")
            rows, emissions = done.where("bucket < 0"), done.where("bucket >= 0")
        data = added(rows, tasks)
        emit = np.concatenate([data[b].reshape(states, -1) for b in range(1, len(data))], axis=1)
        head = data[0][1:]
        model = Model.from_counts(head[:states], head[states:].reshape(states, states), emit.T, unigram)
        sent.unpersist()
        release(spark)
    if emissions is None:  # no round: what is known of words are their counts
        emissions = materialise(counts.select("bucket", F.lit(0).alias("kind"), "data").mapInArrow(lean(_joined(EXPECT, EMIT)), packs), "emissions")
    scratch.close()  # nothing reads the counts any more

    def classes_of(batches):
        """The classes' expected counts as the kept shares give them, so that within a class and state all words' add up to one."""
        task, total = TaskContext.get().partitionId(), np.zeros((CLASSES, states))
        for batch in batches:
            for data in values(batch.column(2)):
                x = np.frombuffer(data, EMIT)
                x = x[x["n"] < least[explicit]]
                c = kept(x)
                for k in range(states):
                    total[:, k] += np.bincount(x["cls"], weights=c[:, k], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["bucket", "kind", "data"])

    def kept(x):
        """(words, states): expected counts, from counts and shares; without shares, the same in each state."""
        share = x["c"].astype(np.float64)
        return share / 65535 * x["n"].astype(np.float64)[:, None]

    inner = added(emissions.mapInArrow(lean(classes_of), packs), emissions.rdd.getNumPartitions()).get(0, np.zeros(CLASSES * states)).reshape(CLASSES, states)

    def most(batches, least=least[known], skip=least[explicit]):
        for batch in batches:
            for data in values(batch.column(2)):
                x = np.frombuffer(data, EMIT)
                yield pa.RecordBatch.from_arrays([pa.array([x[(x["n"] >= least) & (x["n"] < skip)].tobytes()], pa.binary())], names=["data"])

    frequents = _sorted(np.concatenate([np.zeros(0, EMIT), *(np.frombuffer(r.data, EMIT) for r in emissions.mapInArrow(most, "data binary").collect())]))  # ``known`` records at most
    final = spark.sparkContext.broadcast((model, inner, of_class, frequents, base_log))

    def asked(batches):
        """Each block's own words, by bucket: the word and its number in the block."""
        kind = np.dtype([*WORD, ("i", "<u4")])
        for batch in batches:
            for block, names in zip(values(batch.column(0)), values(batch.column(1))):
                x = np.frombuffer(names, np.dtype(WORD))
                out = np.zeros(len(x), kind)
                out["a"], out["b"], out["i"] = x["a"], x["b"], np.arange(len(x))
                keys, data = packed(out, _bucket(out, buckets))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), 1, np.int32)), pa.array(np.full(len(keys), block)), data], names=["bucket", "kind", "block", "data"])

    ANSWER = np.dtype([("i", "<u4"), ("n", "<u4"), ("c", "<u2", (states,))])

    def answered(batches):
        kind = np.dtype([*WORD, ("i", "<u4")])
        now, table = None, np.zeros(0, EMIT)
        for batch in batches:  # in order of bucket, then kind
            block, data, n = [], [], []
            for bucket, is_asked, who, d in zip(*(values(c) for c in batch.columns)):
                if bucket != now:
                    now, table = bucket, np.zeros(0, EMIT)
                if not is_asked:
                    table = np.frombuffer(d, EMIT)
                    continue
                x = np.frombuffer(d, kind)
                at = _find(table, x)
                x, at = x[at >= 0], at[at >= 0]
                out = np.zeros(len(x), ANSWER)
                out["i"], out["n"], out["c"] = x["i"], np.minimum(table["n"][at], (1 << 32) - 1), table["c"][at]
                block.append(who)
                data.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(data, pa.binary())], names=["block", "answer"])

    def scored(batches):
        model, in_class, of_class, often, base_log = final.value
        now, answers, first = None, [], len(often)
        # What the frequent words have in every block.
        count_often, factor_often = often["n"].astype(np.float64), within(kept(often), often["cls"].astype(np.int64), in_class, of_class)
        for batch in batches:  # in order of block, answers first
            for i, (block, answer) in enumerate(zip(values(batch.column(0)), values(batch.column(1)))):
                if block != now:
                    now, answers = block, []
                if answer is not None:
                    answers.append(np.frombuffer(answer, ANSWER))
                    continue
                ids, (held, ends, symbols, outer, own) = batch.column(2)[i].values, (batch.column(c)[i].as_py() for c in range(3, 8))
                out, flat, which = unpack(held, ends, symbols, outer, first + own)
                count, c, cls = np.zeros(own), np.zeros((own, states)), np.zeros(own, np.int64)
                for x in answers:
                    count[x["i"]], c[x["i"]] = x["n"], kept(x)
                whole, number = np.frombuffer(symbols, symbol_type), np.concatenate(which)
                is_rare = whole > m
                is_own = is_rare & (number >= first)
                cls[number[is_own] - first] = whole[is_own].astype(np.int64) - 1 - m
                count = np.concatenate([count_often, count])
                factor = np.concatenate([factor_often, within(c, cls, in_class, of_class), np.ones((1, states))])
                base = np.zeros(len(whole))
                base[~is_rare] = base_log[whole[~is_rare]]
                base[is_rare] = np.log10((count[number[is_rare]] + 1) / (N + V + 1))
                met = np.ones(len(whole))
                met[is_rare] = count[number[is_rare]] > 0
                met[whole == 0] = n_docs > 0
                n = np.array([len(x) for x in flat], np.int64)
                doc = np.repeat(np.arange(len(n)), n)
                add = lambda v: np.bincount(doc, weights=v, minlength=len(n))
                made = log10_likelihood(model, flat, factor, which)
                yield pa.RecordBatch.from_arrays([ids, pa.array(out), pa.array(n), pa.array(add(met).astype(np.int64)), pa.array(np.full(len(n), N)), pa.array(add(base)), pa.array(made)], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                answers = []

    requests = laid.select("block", "names").mapInArrow(lean(asked), "bucket long, kind int, block long, data binary")
    pages = emissions.select("bucket", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"), "data")
    found = requests.unionByName(pages).repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lean(answered), "block long, answer binary")
    met = found.unionByName(laid.drop("names"), allowMissingColumns=True).select("block", "answer", "ids", "held", "ends", "symbols", "outer", "n")
    met = met.repartition(partitions, "block").sortWithinPartitions("block", F.col("answer").isNull())
    return met.mapInArrow(lean(scored), f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _joined(expect: np.dtype, emit: np.dtype):
    """From rows (bucket, kind, data) in order: word counts (kind 0) with the states' shares of the expected counts of blocks (kind 1). Tables of symbols (bucket below 0) go through."""

    def run(batches):
        now, table, total = None, None, None

        def page():
            all_of = total.sum(1, keepdims=True)
            share = np.divide(total, all_of, out=np.full(total.shape, 1 / total.shape[1]), where=all_of > 0)
            table["c"] = np.rint(share * 65535)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([0], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["bucket", "kind", "data"])

        for batch in batches:
            through = batch.column(0).to_numpy() < 0
            if through.any():
                yield batch.filter(pa.array(through))
                batch = batch.filter(pa.array(~through))
            for bucket, kind, data in zip(*(values(c) for c in batch.columns)):
                if bucket != now:
                    if table is not None:
                        yield page()
                    now, table, total = bucket, np.zeros(0, emit), np.zeros((0, *emit["c"].shape))
                if kind == 0:
                    x = np.frombuffer(data, COUNT)
                    table, total = np.zeros(len(x), emit), np.zeros((len(x), *emit["c"].shape))
                    for f in ("a", "b", "n", "cls"):
                        table[f] = x[f]
                    continue
                x = np.frombuffer(data, expect)
                at = _find(table, x)
                total[at[at >= 0]] += x["c"][at >= 0]
        if table is not None:
            yield page()

    return run
