"""Line dedup by an exact set-similarity join.

A line is the set of its words (lower-cased A-Z). Two lines match when the Jaccard likeness of
their sets is at least ``threshold``, a fraction. Words are ordered from rare to frequent, so that
matching lines must share one of a few rare words at the front: the prefix filter makes the
candidates; positions, sizes and 96 parities of the sets discard most, and the rest are compared
whole.

* Rarity is read from a table of fixed size, in how many lines words of each hash bucket occur, counted
  over all lines (those that a task has met before count once). Words of a bucket are ordered by hash; any total order gives the same matches,
  and this one keeps frequent words out of the prefixes.
* Equal lines (but for case) are one class from the start: classes are joined, never copies.
* Lines that share a word at the front meet sorted by size, so that sizes that can't match are
  never paired. What leaves a meeting isn't pairs but the lines that may match one there. A
  meeting of too many lines is held again in blocks, each pair of blocks apart.
* Meetings that share lines are drawn together, up to as many lines as a meeting has, so that near copies of one passage come to one
  place; whole sets are sent there, of candidate lines alone, which a bit table of bounded size
  picks out when the texts are read again (a table that fills up only spares less). Pairs are compared, counted
  and dropped at the first place that both lines come to; no pair crosses the network.

A line is removed if an earlier line is of its class, or any earlier line matches it, whether or
not that one is removed. Earlier: by the id (null last), then the hash of the text, then the
line's place. Lines without words are kept and match nothing. Rows with equal id and text are one
document: all of them lose the same lines. A null text has no lines; an empty text has one,
without words. A very long text is read whole, and its lines are joined like any others; an empty table gives an empty
result. Other columns, whatever their names, are carried along by ``remove_lines`` and ignored elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import join_counted
from quern.llm.pieces import parts as slices
from quern.llm.workers import lean, rows_of, values
from quern.session import materialise, release, spread, unused

#: Matching likeness as a fraction.
THRESHOLD = (4, 5)
#: Buckets of the rarity table; bits of a table of lines for each of them, and the most it has (32 MB).
BUCKETS, BITS_EACH, MOST_BITS = 1 << 21, 16, 1 << 28
#: Lines of a word that meet in one block; entries of a bucket of words, about; pairs looked at together.
MEET, BUCKET_ROWS, PAIRS = 20_000, 1 << 14, 1 << 18
#: Entries of a bucket that a task holds before it puts crowded words aside.
HELD = 1_500_000
#: Classes a task remembers, and bytes of text taken at once.
SEEN, SLICE = 200_000, 6 << 20
#: Bytes of matrices of words and lines up to which sets are compared as bits.
MATRIX = 32 << 20
_BLOCK = 1 << 14
#: An entry: word, class (96 bits), 96 parities, size of the set and the word's place in it.
ENTRY = np.dtype([("w", "<u4"), ("k", "<u8"), ("kk", "<u4"), ("s", "<u8"), ("t", "<u4"), ("n", "<u4"), ("p", "<u4")])


def ceil_div(a, b):
    return -(-a // b)


def probe_prefix(n, a: int, b: int):
    """Of two matching sets each has one word among its first so many, of ``n``, that the other has among its own."""
    return n - ceil_div(a * n, b) + 1


def _key(line: bytes) -> bytes:
    """A line's class: 96 bits."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(line)[:12]


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first 64 and the last 32 bits."""
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 12)
    return np.ascontiguousarray(raw[:, :8]).view("<u8").ravel(), np.ascontiguousarray(raw[:, 8:]).view("<u4").ravel()


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_digest

    return np.frombuffer(b"".join(map(xxh3_64_digest, words)), ">u8").astype(np.uint64)


def _lower(texts: pa.Array) -> pa.Array:
    # Taken anew: ascii_lower misreads slices of an array.
    return pc.ascii_lower(pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), ""))


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lower-cased lines: how many each text has (null none), and all of them."""
    lists = pc.split_pattern(_lower(texts), "\n")
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    if not texts.null_count:
        return n, lists.flatten()
    there = pc.is_valid(texts)
    return n * there.to_numpy(zero_copy_only=False), lists.filter(there).flatten()


def _fresh(lines: list[bytes], seen: set) -> tuple[list[int], list[bytes]]:
    """The numbers and classes of the lines with words that this task meets for the first time."""
    fresh, keys = [], []
    for i, x in enumerate(lines):
        if x and not x.isspace() and (k := _key(x)) not in seen:
            seen.add(k)
            fresh.append(i)
            keys.append(k)
    if len(seen) > SEEN:
        seen.clear()
    return fresh, keys


def _words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each different word, and for each word in the lines (or texts) its line and which it is."""
    lists = pc.ascii_split_whitespace(lines)
    coded = lists.flatten().dictionary_encode()
    words = values(coded.dictionary.cast(pa.large_binary()))
    line, code = np.repeat(np.arange(len(lines)), pc.list_value_length(lists).to_numpy()), coded.indices.to_numpy()
    # White space at an end leaves an empty word.
    if b"" in words:
        keep = code != words.index(b"")
        line, code = line[keep], code[keep]
    return _hashes(words), line, code


def _blocks(total: np.ndarray, block: int):
    """Rows (block, data, task) of an array, without blocks of zeros."""
    parts = total.view(np.uint8).reshape(-1, block)
    at = np.flatnonzero(parts.any(1))
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in at.tolist()], pa.binary()), pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int32))], names=["block", "data", "task"])


_ROWS = "block int, data binary, task int"


def _merge(rows: DataFrame, size: int, block: int, combine: Callable, fan: int = 256) -> np.ndarray:
    """The whole array of ``size`` bytes: tasks' blocks are combined on the executors, at most ``fan`` in one place, and one of each reaches the driver."""

    def add(table: pa.Table) -> pa.Table:
        out = None
        for d in table.column("data").to_pylist():
            x = np.frombuffer(zlib.decompress(d), np.uint8)
            out = x.copy() if out is None else combine(out, x)
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "data": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary()), "task": pa.array([table.column("task")[0].as_py() // fan], pa.int32())})

    tasks = rows.rdd.getNumPartitions()
    while tasks > fan:
        rows = rows.groupBy("block", F.floor(F.col("task") / fan)).applyInArrow(lambda key, table: add(table), _ROWS)
        tasks = ceil_div(tasks, fan)
    total = np.zeros(size, np.uint8).reshape(-1, block)
    for r in rows.groupBy("block").applyInArrow(add, _ROWS).toLocalIterator():
        total[r.block] = np.frombuffer(zlib.decompress(r.data), np.uint8)
    return total.ravel()


def _rarity(texts: DataFrame) -> np.ndarray:
    """For each bucket in how many lines words of it occur, as far as 32 bits go."""

    def run(batches):
        rarity, seen = np.zeros(BUCKETS, np.uint32), set()
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE)):
            _, lines = _split(batch.column(0))
            fresh, _ = _fresh(values(lines.cast(pa.large_binary())), seen)
            hashes, _, code = _words(lines.take(pa.array(fresh, pa.int64())))
            np.add.at(rarity, (hashes % np.uint64(BUCKETS)).astype(np.int64), np.bincount(code, minlength=len(hashes)).astype(np.uint32))
        yield _blocks(rarity, _BLOCK)

    def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(x.view(np.uint32).astype(np.uint64) + y.view(np.uint32), (1 << 32) - 1).astype(np.uint32).view(np.uint8)

    return _merge(texts.mapInArrow(lean(run), _ROWS), BUCKETS * 4, _BLOCK, sums).view(np.uint32)


def _bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set in a packed table."""
    at = keys & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _bits_of(keys: DataFrame, n: int) -> np.ndarray:
    """A packed table with the bits of a column of longs set, ``BITS_EACH`` for each of ``n`` keys, and ``MOST_BITS`` at most."""
    size = min(MOST_BITS, 1 << max(20, (n * BITS_EACH).bit_length()))

    def mark(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64) & np.uint64(size - 1)
            np.bitwise_or.at(bits, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        yield _blocks(bits, _BLOCK)

    return _merge(keys.mapInArrow(lean(mark), _ROWS), size // 8, _BLOCK, np.bitwise_or)


def _ordered(hashes: np.ndarray, line: np.ndarray, code: np.ndarray, n_lines: int, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines' sets as hashes laid end to end, each from rare to frequent; and their sizes."""
    order = np.lexsort((hashes, rarity[(hashes % np.uint64(BUCKETS)).astype(np.int64)]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    both = np.sort(line * max(1, len(order)) + place[code])
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    line, at = np.divmod(both[new], max(1, len(order)))
    return hashes[order][at], np.bincount(line, minlength=n_lines)


def _signs(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each set's 96 parities, (sets, 3) of 32: a bit says whether an odd number of its words fall on it. Sets that differ in d words differ in d bits at most."""
    row = np.repeat(np.arange(len(n)), n)
    bit = (hashes >> np.uint64(40)).astype(np.int64) % 96
    odd = np.bincount(row * 96 + bit, minlength=96 * len(n)) & 1
    return np.packbits(odd.reshape(-1, 96).astype(np.uint8), axis=1).view("<u4").reshape(-1, 3)


def _pairs(size, start, end, most):
    """Slices of the pairs (i, j), i < j < end[i], about ``most`` at a time."""
    n = np.maximum(end - start, 0)
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        done = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        m = n[at:stop]
        i = np.repeat(np.arange(at, stop), m)
        if len(i):
            yield i, start[i] + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        at = stop


def _entries(hashes, n, keys, a: int, b: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An entry for each line's front words, ordered by the words' bucket, and the buckets: the first ``bits`` bits of a word's hash."""
    p = probe_prefix(n, a, b)
    row, pos = np.repeat(np.arange(len(n)), p), np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
    word = hashes[(np.cumsum(n) - n)[row] + pos]
    bucket = (word >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    row, pos, word = row[order], pos[order], word[order]
    k, kk = _halves(keys)
    signs = _signs(hashes, n).astype(np.uint64)
    out = np.empty(len(row), ENTRY)
    out["w"] = word >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)
    out["k"], out["kk"], out["n"], out["p"] = k[row], kk[row], n[row], pos
    out["s"], out["t"] = (signs[:, 0] << np.uint64(32) | signs[:, 1])[row], signs[:, 2][row]
    return out, bucket[order]


def _sorted(e: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By word, size and class, each class of a word once, though several tasks met it."""
    order = np.lexsort((side, e["k"], e["w"].astype(np.uint64) << np.uint64(32) | e["n"]))
    e, side = e[order], side[order]
    new = np.ones(len(e), bool)
    new[1:] = (e["w"][1:] != e["w"][:-1]) | (e["k"][1:] != e["k"][:-1]) | (e["kk"][1:] != e["kk"][:-1]) | (e["n"][1:] != e["n"][:-1]) | (side[1:] != side[:-1])
    return e[new], side[new]


def _may_match(e: np.ndarray, side: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which entries, as ``_sorted`` gives them, have another of their word that they may match. Lines of two different sides that aren't 0 meet; those of side 0 meet each other."""
    hit = np.zeros(len(e), bool)
    size, pos = e["n"].astype(np.int64), e["p"].astype(np.int64)
    number = np.cumsum(np.concatenate([[0], e["w"][1:] != e["w"][:-1]])) if len(e) else np.zeros(0, np.int64)
    width = (int(size.max()) * b // a + 2) if len(e) else 1
    key = number * width + size
    # At the first word that both have, what follows in either must hold all that they share.
    top = np.minimum(size * b // a, (size - pos) * (a + b) // a - size)
    end = np.searchsorted(key, number * width + np.clip(top, 0, width - 1), side="right")
    s, t = e["s"], e["t"]
    for i, j in _pairs(size, np.arange(len(e)) + 1, end, PAIRS):
        both = size[i] + size[j]
        least = -(-a * both // (a + b))
        differ = np.bitwise_count(s[i] ^ s[j]).astype(np.int64) + np.bitwise_count(t[i] ^ t[j])
        use = (differ <= both - 2 * least) & (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= least)
        i, j = i[use], j[use]
        use = ((e["k"][i] != e["k"][j]) | (e["kk"][i] != e["kk"][j])) & ((side[i] == 0) | (side[i] != side[j]))
        hit[i[use]] = hit[j[use]] = True
    return hit


def _meet(a: int, b: int, bits: int, meet: int = MEET, most: int = HELD):
    """From buckets of entries in order: the lines that may match one (k, and the meeting's number g), and the entries of words with too many lines (kind 1: g, n, data)."""

    def rows(kind, k, g, n, data):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), kind, np.int32)), pa.array(k), pa.array(g), pa.array(n), data], names=["kind", "k", "g", "n", "data"])

    def crowded(e, hot, bucket):
        """``e`` without the words in ``hot``, which are put aside."""
        if not hot:
            return e, None
        aside = np.isin(e["w"], np.array(sorted(hot), np.uint32))
        x = e[aside]
        first = np.flatnonzero(np.concatenate([[True], x["w"][1:] != x["w"][:-1]])) if len(x) else np.zeros(0, np.int64)
        # In parts, so that none is large.
        cut = np.unique(np.concatenate([first, np.arange(0, len(x), 4096)]))
        ends = np.append(cut[1:], len(x))[: len(cut)]
        g = bucket << 32 | x["w"][cut].astype(np.int64)
        return e[~aside], rows(1, np.zeros(len(cut), np.int64), g, ends - cut, rows_of(x.tobytes(), ends * ENTRY.itemsize))

    def busy(e, hot):
        words, n = np.unique(e["w"], return_counts=True)
        return hot | set(words[n > meet].tolist())

    def run(batches):
        held, size, now, hot = [], 0, None, set()

        def finish():
            nonlocal held, size, hot
            e, _ = _sorted(np.concatenate(held), np.zeros(size, np.int8))
            e, aside = crowded(e, busy(e, hot), now)
            if aside is not None:
                yield aside
            hit = e[_may_match(e, np.zeros(len(e), np.int8), a, b)]
            yield rows(0, hit["k"].view(np.int64), now << 32 | hit["w"].astype(np.int64), np.zeros(len(hit), np.int64), pa.nulls(len(hit), pa.binary()))
            held, size, hot = [], 0, set()

        for batch in batches:
            for bucket, data in zip(values(batch.column(0)), values(batch.column(1))):
                if bucket != now:
                    if held:
                        yield from finish()
                    now = bucket
                held.append(np.frombuffer(data, ENTRY))
                size += len(held[-1])
                if size > most:
                    e, _ = _sorted(np.concatenate(held), np.zeros(size, np.int8))
                    hot = busy(e, hot)
                    e, aside = crowded(e, hot, now)
                    if aside is not None:
                        yield aside
                    held, size = [e], len(e)
        if held:
            yield from finish()

    return run


def _meet_again(a: int, b: int):
    """The same for blocks of crowded words: rows (place, side, data) in order of place, (k, g) out."""

    def run(batches):
        held, sides, now = [], [], None

        def finish():
            e, side = _sorted(np.concatenate(held), np.concatenate(sides))
            hit = e[_may_match(e, side, a, b)]
            return pa.RecordBatch.from_arrays([pa.array(hit["k"].view(np.int64)), pa.array(np.full(len(hit), now, np.int64))], names=["k", "g"])

        for batch in batches:
            for place, side, data in zip(*(values(c) for c in batch.columns)):
                if place != now:
                    if held:
                        yield finish()
                    held, sides, now = [], [], place
                held.append(np.frombuffer(data, ENTRY))
                sides.append(np.full(len(held[-1]), side, np.int8))
        if held:
            yield finish()

    return run


def _in_blocks(batches):
    """Entries of crowded words (g, data, and the word's number of blocks), once for each pair of blocks that holds their own."""
    for batch in batches:
        place, sides, out = [], [], []
        for g, data, blocks in zip(*(values(c) for c in batch.columns)):
            e = np.frombuffer(data, ENTRY)
            own = (e["k"] % np.uint64(blocks)).astype(np.int64)
            for mine in np.unique(own).tolist():
                part = e[own == mine].tobytes()
                for other in range(blocks):
                    low, high = min(mine, other), max(mine, other)
                    place.append(int.from_bytes(_key(b"%d %d %d" % (g, low, high))[:8], "little", signed=True))
                    sides.append(0 if mine == other else 1 if mine < other else 2)
                    out.append(part)
                    if len(out) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(sides, pa.int32()), pa.array(out, pa.binary())], names=["place", "side", "data"])
                        place, sides, out = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(sides, pa.int32()), pa.array(out, pa.binary())], names=["place", "side", "data"])


def _overlaps(word: np.ndarray, n: np.ndarray, number: int):
    """A function that gives how many words sets i and j share; ``word``: the sets' words as numbers below ``number``, end to end."""
    row = np.repeat(np.arange(len(n)), n)
    times = np.bincount(word, minlength=number)
    shared = np.cumsum(times > 1) - 1
    use = times[word] > 1
    columns = ceil_div(int(shared[-1]) + 1 if number else 0, 64)
    if columns * 8 * len(n) <= MATRIX:
        bit = shared[word[use]]
        matrix = np.zeros((columns, len(n)), np.uint64)
        np.bitwise_or.at(matrix, (bit >> 6, row[use]), np.uint64(1) << (bit & 63).astype(np.uint64))

        def count(i, j):
            out = np.zeros(len(i), np.int64)
            for c in matrix:
                out += np.bitwise_count(c[i] & c[j])
            return out

        return count
    word, row = word[use], row[use]
    begin = np.searchsorted(row, np.arange(len(n) + 1))

    def count_sorted(i, j):
        out = np.zeros(len(i), np.int64)
        step = 4096
        for at in range(0, len(i), step):
            x, y = i[at : at + step], j[at : at + step]
            who = np.concatenate([x, y])
            m = begin[who + 1] - begin[who]
            pair = np.repeat(np.tile(np.arange(len(x)), 2), m)
            at_word = np.repeat(begin[who] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            both = np.sort(pair * number + word[at_word])
            twice = both[1:][both[1:] == both[:-1]] // number
            out[at : at + step] = np.bincount(twice, minlength=len(x))
        return out

    return count_sorted


def _compare(a: int, b: int, id_type: pa.DataType):
    """From rows (h, k, kk, n, first.., places, words) in order of place h: for each class with matches the copies of those and the earliest place of any."""
    names = ["k", "kk", "others", "o", "i", "t", "l"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), id_type, pa.int64(), pa.int32()]

    def place(h, rows):
        k, kk, times, o, ids, th, line, places, words = zip(*rows)
        m = len(rows)
        size = np.array([len(w) // 8 for w in words], np.int64)
        sets = np.frombuffer(b"".join(words), "<u8")
        order = np.argsort(size, kind="stable")
        begin = np.cumsum(size) - size
        size = size[order]
        sets = sets[np.repeat(begin[order] - np.cumsum(size) + size, size) + np.arange(len(sets))]
        found, word = np.unique(sets, return_inverse=True)
        signs = _signs(sets, size)
        s, t = signs[:, 0].astype(np.uint64) << np.uint64(32) | signs[:, 1], signs[:, 2]
        share = _overlaps(word, size, len(found))
        least_place = np.array([min(places[x]) for x in order.tolist()], np.int64)
        # Earlier by the id (null last), the text's hash, the line.
        earlier = sorted(range(m), key=lambda x: (o[x], 0 if o[x] else ids[x], th[x], line[x]))
        rank = np.empty(m, np.int64)
        rank[earlier] = np.arange(m)
        rank = rank[order]
        copies = np.array(times, np.int64)[order]
        others, first = np.zeros(m, np.int64), np.full(m, m, np.int64)
        end = np.searchsorted(size, size * b // a, side="right")
        for i, j in _pairs(size, np.arange(m) + 1, end, PAIRS):
            both = size[i] + size[j]
            differ = np.bitwise_count(s[i] ^ s[j]).astype(np.int64) + np.bitwise_count(t[i] ^ t[j])
            use = differ <= both - 2 * (-(-a * both // (a + b)))
            i, j, both = i[use], j[use], both[use]
            use = (a + b) * share(i, j) >= a * both
            i, j = i[use], j[use]
            # A pair that meets in several places counts at the first of them.
            use = (least_place[i] == h) & (least_place[j] == h)
            for x in np.flatnonzero((least_place[i] != least_place[j]) | (least_place[i] != h)).tolist():
                if least_place[i[x]] != least_place[j[x]]:
                    use[x] = min(set(places[order[i[x]]]) & set(places[order[j[x]]])) == h
            i, j = i[use], j[use]
            others += np.bincount(i, weights=copies[j], minlength=m).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=m).astype(np.int64)
            np.minimum.at(first, i, rank[j])
            np.minimum.at(first, j, rank[i])
        for x in np.flatnonzero(others).tolist():
            y, z = order[x], earlier[first[x]]
            yield k[y], kk[y], int(others[x]), o[z], ids[z], th[z], line[z]

    def run(batches):
        now, rows, out = None, [], []

        def emit(done):
            cols = list(zip(*done)) if done else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            for h, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if h != now:
                    if len(rows) > 1:
                        out += place(now, rows)
                        if len(out) > 20_000:
                            yield emit(out)
                            out = []
                    now, rows = h, []
                rows.append(row)
        if len(rows) > 1:
            out += place(now, rows)
        yield emit(out)

    return run


def candidates(texts: DataFrame, threshold: tuple[int, int] = THRESHOLD, meet: int = MEET) -> DataFrame:
    """A written table (k long, h long): the classes' first bits and the places to which lines that may match come together. Lines that may match share a place."""
    spark = texts.sparkSession
    a, b = threshold
    rarity = _rarity(texts)
    # About as many front words as there are words in lines, less those behind the front.
    entries = int(rarity.sum(dtype=np.uint64)) * (b - a) // b
    bits = min(30, max(6, (entries // BUCKET_ROWS).bit_length()))
    table = spark.sparkContext.broadcast(rarity)  # BUCKETS numbers of 32 bits
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def lay(batches):
        rarity, seen = table.value, set()
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE)):
            _, lines = _split(batch.column(0))
            fresh, keys = _fresh(values(lines.cast(pa.large_binary())), seen)
            ordered, n = _ordered(*_words(lines.take(pa.array(fresh, pa.int64()))), len(fresh), rarity)
            e, bucket = _entries(ordered, n, keys, a, b, bits)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(e) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(e))[: len(first)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), rows_of(e.tobytes(), ends * ENTRY.itemsize)], names=["bucket", "data"])

    laid = texts.mapInArrow(lean(lay), "bucket long, data binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    met = materialise(laid.mapInArrow(lean(_meet(a, b, bits, meet)), "kind int, k long, g long, n long, data binary"), "met", ["kind"])
    release(spark)
    found = met.where("kind = 0").select("k", "g")
    aside = met.where("kind = 1").select("g", "n", "data")
    if not aside.isEmpty():
        blocks = aside.groupBy("g").agg(F.sum("n").alias("lines")).select("g", (1 + F.floor(F.col("lines") / meet)).cast("long").alias("blocks"))
        again = aside.join(blocks, "g").select("g", "data", "blocks").mapInArrow(lean(_in_blocks), "place long, side int, data binary")
        again = again.repartition(partitions, "place").sortWithinPartitions("place").mapInArrow(lean(_meet_again(a, b)), "k long, g long")
        found = found.unionByName(again)
    # A meeting is drawn to the least meeting to which any of its lines goes. A line has no more meetings
    # than front words, and a meeting at most two blocks of lines, so that no window is wide.
    least = found.distinct().withColumn("l", F.expr("min(g) over (partition by k)"))
    drawn = least.withColumn("h", F.expr("min(l) over (partition by g)"))
    places = materialise(drawn.select("k", "h").distinct(), "places")
    large = places.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > meet).select(F.col("h").alias("_h"))
    if large.isEmpty():
        return places
    # A place that would draw more lines than a meeting may have leaves its meetings where they are.
    large = materialise(large, "large")
    kept = drawn.join(large, F.col("h") == F.col("_h"), "left").select("k", F.when(F.col("_h").isNull(), F.col("h")).otherwise(F.col("g")).alias("h"))
    return materialise(kept.distinct(), "places")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, meet: int = MEET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables: the documents (_id, _th, n_lines); the lines (_id, _th, line, k, kk) with words whose class has several or matches, and some others;
    and the classes of these (k, kk, n, first, others, earliest): a class's lines and first line, the lines of matching classes and their first. ``k`` and ``kk`` are a class's 96 bits."""
    spark = docs.sparkSession
    a, b = threshold
    id_type = docs.schema[id_col].dataType.simpleString()
    source = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    places = candidates(source.select("_text"), threshold, meet)
    per_class = materialise(places.groupBy("k").agg(F.collect_set("h").alias("places")), "per_class")
    n_classes = per_class.count()
    bits = spark.sparkContext.broadcast(_bits_of(per_class.select("k"), n_classes))

    def note(batches):
        hits, seen = bits.value, set()
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            n_lines, lines = _split(batch.column(1))
            raw = values(lines.cast(pa.large_binary()))
            names = list(map(_key, raw))
            k, kk = _halves(names)
            full = np.array([bool(x) and not x.isspace() for x in raw], bool)
            fresh, sets = [], []
            for i in np.flatnonzero(_bit(hits, k) & full).tolist():
                if names[i] not in seen:
                    seen.add(names[i])
                    fresh.append(i)
                    sets.append(_hashes(list(set(raw[i].split()))).tobytes())
            if len(seen) > SEEN:
                seen.clear()
            at = pa.array(np.repeat(np.arange(batch.num_rows), n_lines)[full])
            number = (np.arange(len(raw)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines))[full]
            k, kk = k.view(np.int64), kk.view(np.int32)
            yield _rows(0, batch.column(0), batch.column(2), n_lines, None, None, None)
            yield _rows(1, batch.column(0).take(at), batch.column(2).take(at), number, k[full], kk[full], None)
            yield _rows(2, pa.nulls(len(fresh), batch.column(0).type), pa.nulls(len(fresh), pa.int64()), np.zeros(len(fresh)), k[fresh], kk[fresh], pa.array(sets, pa.binary()))

    def _rows(kind, ids, th, number, k, kk, words):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [ids, th, pa.array(number.astype(np.int32)), pa.nulls(n, pa.int64()) if k is None else pa.array(k), pa.nulls(n, pa.int32()) if kk is None else pa.array(kk), pa.nulls(n, pa.binary()) if words is None else words, pa.array(np.full(n, kind, np.int32))],
            names=["_id", "_th", "number", "k", "kk", "words", "kind"],
        )

    schema = f"_id {id_type}, _th long, number int, k long, kk int, words binary, kind int"
    staged = materialise(source.select("_id", "_text", F.xxhash64("_text").alias("_th")).mapInArrow(lean(note), schema), "lines", ["kind"])
    documents = staged.where("kind = 0").select("_id", "_th", F.col("number").alias("n_lines"))
    lines = staged.where("kind = 1").select("_id", "_th", F.col("number").alias("line"), "k", "kk")
    # Lines that have neither copies nor candidates end here.
    copied = materialise(lines.groupBy("k", "kk").agg(F.count("*").alias("n")).where("n > 1").select("k"), "copied")
    busy = spark.sparkContext.broadcast(_bits_of(copied.unionByName(per_class.select("k")), copied.count() + n_classes))

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(_bit(busy.value, batch.column(3).to_numpy().view(np.uint64))))

    some = materialise(lines.mapInArrow(lean(keep), lines.schema), "some")
    order = F.struct(F.col("_id").isNull().alias("o"), F.col("_id").alias("i"), F.col("_th").alias("t"), F.col("line").alias("l"))
    known = materialise(some.groupBy("k", "kk").agg(F.count("*").alias("n"), F.min(order).alias("first")), "classes")
    whole = staged.where("kind = 2").select("k", "kk", "words").dropDuplicates(["k", "kk"])
    sets = whole.join(per_class, "k").join(known, ["k", "kk"])
    sent = sets.select(F.explode("places").alias("h"), "k", "kk", "n", "first.o", "first.i", "first.t", "first.l", "places", "words")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    compared = sent.repartition(partitions, "h").sortWithinPartitions("h").mapInArrow(lean(_compare(a, b, _arrow_type(docs, id_col))), f"k long, kk int, others long, o boolean, i {id_type}, t long, l int")
    near = compared.groupBy("k", "kk").agg(F.sum("others").alias("others"), F.min(F.struct("o", "i", "t", "l")).alias("earliest"))
    classes = materialise(known.join(near, ["k", "kk"], "left").where("n > 1 or others > 0"), "verdict")
    return documents, some, classes


def _arrow_type(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, meet: int = MEET) -> tuple[DataFrame, DataFrame]:
    """The documents (_id, _th, n_lines; a row each), and for those with words (_id, _th): removed
    (the removed lines' numbers in order, with the earliest line that each matches), n_same and n_near (removed as a copy; as a match),
    n_links (other lines of their classes, and of matching classes)."""
    documents, lines, classes = links(docs, id_col, text_col, threshold, meet)
    verdict = classes.select("k", "kk", "n", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce(F.col("earliest") < F.col("first"), F.lit(False)).alias("late"), F.coalesce(F.least("first", "earliest"), "first").alias("of"))
    own = join_counted(lines, verdict, ["k", "kk"], "n", lines.count())
    copy = ~((F.col("first.i").eqNullSafe(F.col("_id"))) & (F.col("first.t") == F.col("_th")) & (F.col("first.l") == F.col("line")))
    # A set, so that rows that are one document by id and text count once; it is as long as the document has lines.
    held = own.groupBy("_id", "_th").agg(F.collect_set(F.struct(F.col("line").alias("l"), copy.alias("c"), F.col("late").alias("t"), F.col("n_links").alias("n"), F.col("of.i").alias("i"), F.col("of.l").alias("m"))).alias("_s"))
    per_doc = held.select(
        "_id",
        "_th",
        F.array_sort(F.transform(F.filter("_s", lambda x: x.c | x.t), lambda x: F.struct(x.l.alias("l"), x.i.alias("i"), x.m.alias("m")))).alias("removed"),
        F.size(F.filter("_s", lambda x: x.c)).alias("n_same"),
        F.size(F.filter("_s", lambda x: x.t & ~x.c)).alias("n_near"),
        F.aggregate("_s", F.lit(0).cast("long"), lambda total, x: total + x.n).alias("n_links"),
    )
    return documents, per_doc


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, meet: int = MEET) -> DataFrame:
    """A row for each row of ``docs``: the id, n_lines, n_kept, n_same, n_near, n_links, removed (line
    numbers from 0, joined by commas) and matched (for each of them the id and line of the earliest line that it matches, as id:line)."""
    documents, per_doc = removed_lines(docs, id_col, text_col, threshold, meet)
    both = documents.alias("d").join(per_doc.alias("r"), F.expr("d._id <=> r._id and d._th <=> r._th"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    joined = lambda f: F.coalesce(F.array_join(F.transform("removed", f), ","), F.lit(""))
    return both.select(
        F.col("d._id").alias(id_col),
        F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - zero("n_same") - zero("n_near")).cast("long").alias("n_kept"),
        zero("n_same").alias("n_same"),
        zero("n_near").alias("n_near"),
        zero("n_links").alias("n_links"),
        joined(lambda x: x.l.cast("string")).alias("removed"),
        joined(lambda x: F.concat_ws(":", F.coalesce(x.i.cast("string"), F.lit("null")), x.m.cast("string"))).alias("matched"),
    )


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, meet: int = MEET) -> DataFrame:
    """``docs`` with its removed lines gone from the text; every row stays, if with an empty text. The other columns are as they were."""
    _, per_doc = removed_lines(docs, id_col, text_col, threshold, meet)
    rid, rth, kept, seen = unused(docs, 4)

    def flags(batches):
        for batch in batches:
            made = []
            for lines in values(batch.column(2)):
                made.append(np.ones(int(lines[-1]) + 1, bool))
                made[-1][lines] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.bool_()))], names=[rid, rth, kept])

    id_type = docs.schema[id_col].dataType.simpleString()
    # Whether each line stays, as far as the last that goes.
    changed = per_doc.where(F.size("removed") > 0).select("_id", "_th", "removed.l").mapInArrow(lean(flags), f"`{rid}` {id_type}, `{rth}` long, `{kept}` array<boolean>")
    text = F.col(f"`{text_col}`")
    named = docs.withColumn(seen, F.xxhash64(text))
    joined = named.join(changed, (F.col(f"`{id_col}`").eqNullSafe(F.col(rid))) & (F.col(seen) == F.col(rth)), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: F.coalesce(F.get(F.col(kept), i), F.lit(True))), "\n")
    return joined.select(*[F.when(F.col(kept).isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
