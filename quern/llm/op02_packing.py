"""Best-two-fit packing of token sequences.

Documents are cut only where they exceed the capacity. The pieces go to groups at
random, each group large enough that its own best packing is as good as one over all, and
small enough for one task. Inside a group only the number of pieces of each length matters:
bins are built from those counts, and a bin that can be repeated is repeated as often as the
counts allow, so that the work follows the number of different bins, not of pieces.

Nulls and the empty text give the end mark alone (one piece). Repeated rows are packed each by
itself. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.pieces import encoder as piece_encoder
from quern.llm.workers import lean
from quern.session import materialise, spread

#: Pieces of a group; also what one task holds at once (some tens of bytes each).
GROUP_PIECES = 400_000


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Bins for ``counts[n]`` items of each length n: (times, lengths), in the order made.

    A bin starts with the longest item left and takes, again and again, the longest that still
    fits. Then its smallest item gives way to the two items left that together fill the widened
    gap furthest, if they fill it further than the item did; this is repeated while it helps.
    """
    left = counts.astype(np.int64).copy()
    sizes = np.flatnonzero(left)
    sizes = sizes[sizes > 0]
    if len(sizes) and sizes[-1] > capacity:
        raise ValueError("an item is longer than the capacity")

    bins: list[tuple[int, list[int]]] = []
    while True:
        top = longest(left, capacity)
        if top == 0:
            return bins
        used: dict[int, int] = {}
        held: list[int] = []
        gap = capacity

        def take(n: int) -> None:
            held.append(n)
            used[n] = used.get(n, 0) + 1
            left[n] -= 1

        while gap > 0 and (n := longest(left, gap)) > 0:
            take(n)
            gap -= n
        while gap > 0 and held:
            small = min(held)
            room = gap + small
            best, pair = small, None
            a = longest(left, room - 1)
            while a > 0 and 2 * a > best:
                left[a] -= 1
                b = longest(left, min(a, room - a))
                left[a] += 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = longest(left, a - 1)
            if pair is None:
                break
            held.remove(small)
            used[small] -= 1
            left[small] += 1
            for n in pair:
                take(n)
            gap = room - best
        used = {n: k for n, k in used.items() if k}
        times = 1 + min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= (times - 1) * k
        bins.append((times, sorted(held, reverse=True)))


def longest(left: np.ndarray, n: int) -> int:
    """The longest length up to ``n`` of which an item is left; 0 if none."""
    at = np.flatnonzero(left[1 : n + 1]) if n > 0 else ()
    return int(at[-1]) + 1 if len(at) else 0


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item its bin's number and its offset there. Items of one length are alike and are given out in their order."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    at = np.concatenate([[0], np.cumsum(counts)])[:-1].copy()
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    first = 0
    for times, held in best_two_fit(counts, capacity):
        start = 0
        for n in held:
            who = order[at[n] : at[n] + times]
            at[n] += times
            bin_of[who] = first + np.arange(times)
            offset[who] = start
            start += n
        first += times
    return bin_of, offset


def pack(pieces: DataFrame, keys: list[str], length: str, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (long). Lengths run from 1 to ``capacity``; ``keys`` order like rows. ``pieces`` must read the same rows again each time, as a written table does."""
    groups = max(1, -(-pieces.count() // group_pieces))
    # By the row's place in the written table, so that repeated rows spread as well.
    spec = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    out = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def run(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        table = table.drop(["_group"])
        table = table.sort_by([(k, "ascending") for k in keys])
        bin_of, offset = place(table.column(length).to_numpy(), capacity)
        return table.append_column("sequence_id", pa.array(bin_of + (group << 40))).append_column("offset", pa.array(offset))

    return pieces.withColumn("_group", spec).groupBy("_group").applyInArrow(run, out)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut from the end into pieces of ``capacity``; the first may be shorter.

    Columns: the id, piece, start (ids before the piece), length, ids_crc32, and on demand ids (little-endian 32-bit, binary).
    """
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        encoder = piece_encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            who, cols = [], [[] for _ in fields]
            for i, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                data = np.concatenate([ids, end]).astype("<u4").tobytes()
                n = len(data) // 4
                stop = (n - 1) % capacity + 1
                start = piece = 0
                while start < n:
                    part = data[4 * start : 4 * stop]
                    who.append(i)
                    for c, v in zip(cols, (piece, start, stop - start, zlib.crc32(part), part)):
                        c.append(v)
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64()))] + [pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[id_col] + [f for f, _ in fields])

    return spread(docs.select(id_col, text_col)).mapInArrow(lean(run), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` ids."""
    pieces = materialise(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    return pack(pieces, [id_col, "piece", "ids_crc32", "length"], "length", capacity)
