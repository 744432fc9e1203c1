"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints of 64 bits link at ``DISTANCE`` or fewer differing bits. Of four segments of 16 bits
at least one is then equal, and of the two halves of the other 48 bits one differs in at most
one bit. The perfect [23,12] Golay code maps the 23 leading bits of a half to the index of the
one codeword within three bits; a half and all words one bit away fall on one codeword, or six.
So a fingerprint is stored under eight keys (equal segment, half, index) and looked up under up
to six for each; every linked pair meets, in either direction, and is verified.

Equal fingerprints are one node: copies are counted, never paired. Keys that more than ``HOT``
fingerprints share are left out of this join; fingerprints on them meet instead under the 56
choices of five equal ones of eight bytes (three errors spoil three bytes at most), so that no
link is lost and no crowded key is multiplied out.

A null or empty text, or one of white space, has fingerprint zero, which links like any other. Fewer words than a
shingle's make one shingle. A very long text is hashed whole, some thousand shingles at a time. Repeated rows count each other. Only the id and text are read,
so that other columns may have any name. Null ids have components by the ids that aren't null. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components, join_counted
from quern.llm.workers import lean
from quern.session import materialise, spread, unused

SHINGLE, SEED, DISTANCE = 3, 42, 3
HOT = 4096
_POLY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        v ^= (v >> np.uint32(bit) & np.uint32(1)) * np.uint32(_POLY << (bit - 11))
    return v


def _table() -> np.ndarray:
    """The error of up to three bits for each syndrome."""
    words = [sum(1 << b for b in c) for k in range(4) for c in combinations(range(23), k)]
    errors = np.array(words, np.uint32)
    out = np.zeros(2048, np.uint32)
    out[_syndrome(errors)] = errors
    return out


_ERRORS = _table()
_FLIPS = np.array([0, *(1 << b for b in range(23))], np.uint32)


def golay_index(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    v = v.astype(np.uint32)
    return (v ^ _ERRORS[_syndrome(v)]) >> np.uint32(11)


def golay_keys(v: np.ndarray) -> np.ndarray:
    """(n, 24): the indices of each word and of all words one bit away; at most six are different."""
    return golay_index((v.astype(np.uint32)[:, None] ^ _FLIPS).ravel()).reshape(len(v), 24)


def tables(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight tables: the equal segment with the table's number, and the half's 23 bits."""
    fp = fp.astype(np.uint64)
    seg = [(fp >> np.uint64(48 - 16 * i)) & np.uint64(0xFFFF) for i in range(4)]
    out = []
    for i in range(4):
        a, b, c = (seg[j] for j in range(4) if j != i)
        rest = a << np.uint64(32) | b << np.uint64(16) | c
        for half in range(2):
            word = rest >> np.uint64(25) if half == 0 else rest & np.uint64(0x7FFFFF)
            out.append(((np.uint64(2 * i + half) << np.uint64(16) | seg[i]).astype(np.int64), word.astype(np.uint32)))
    return out


def _store(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy()
        keys = [seg << 12 | golay_index(w).astype(np.int64) for seg, w in tables(fp.view(np.uint64))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.tile(fp, len(keys)))], names=["key", "fp"])


def _look_up(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy()
        keys, who = [], []
        for seg, w in tables(fp.view(np.uint64)):
            k = np.sort(golay_keys(w), axis=1)
            new = np.ones(k.shape, bool)
            new[:, 1:] = k[:, 1:] != k[:, :-1]
            row, col = np.nonzero(new)
            keys.append(seg[row] << 12 | k[row, col].astype(np.int64))
            who.append(fp[row])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(who))], names=["key", "fp"])


def _five_bytes(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        keys = []
        for n, c in enumerate(combinations(range(8), 5)):
            k = np.full(len(fp), n, np.uint64)
            for b in c:
                k = k << np.uint64(8) | (fp >> np.uint64(8 * b)) & np.uint64(255)
            keys.append(k.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(fp.view(np.int64), len(keys)))], names=["key", "fp"])


def simhash(text: bytes | None) -> int:
    from xxhash import xxh64_digest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        made = [xxh64_digest(b" ".join(words), SEED)]
    else:
        join = b" ".join
        made = [xxh64_digest(join(t), SEED) for t in zip(*(words[i:] for i in range(SHINGLE)))]
    total = np.zeros(64, np.int64)
    for at in range(0, len(made), 4096):  # a very long text bit by bit, 64 bytes a shingle
        total += np.unpackbits(np.frombuffer(b"".join(made[at : at + 4096]), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(made)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            made = np.array([simhash(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=[id_col, "fp"])

    return spread(docs.select(id_col, text_col)).mapInArrow(lean(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def near_pairs(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v), u < v, of different fingerprints in column fp at ``DISTANCE`` or less, each pair once. ``fps`` is a written table of distinct values."""
    fps = fps.select("fp")
    stored = fps.mapInArrow(_store, "key int, fp long")
    crowded = materialise(stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "crowded")
    looked = fps.mapInArrow(_look_up, "key int, fp long")
    more = None
    if not crowded.isEmpty():
        busy = looked.join(crowded, "key", "left_semi").select("fp").distinct()
        more = materialise(busy, "busy").mapInArrow(_five_bytes, "key long, fp long")
        stored, looked = stored.join(crowded, "key", "left_anti"), looked.join(crowded, "key", "left_anti")
    close = F.expr(f"u < v and bit_count(u ^ v) <= {DISTANCE}")
    found = looked.withColumnRenamed("fp", "u").join(stored.withColumnRenamed("fp", "v"), "key").where(close).select("u", "v")
    if more is not None:
        found = found.unionByName(more.withColumnRenamed("fp", "u").join(more.withColumnRenamed("fp", "v"), "key").where(close).select("u", "v"))
    return found.distinct()


def _links(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From a written table of fingerprints: (fp, n, n_near), n the rows that have it, and (fp, label) of those that link to others; a label is a fingerprint of the component."""
    nodes = materialise(made.groupBy("fp").agg(F.count("*").alias("n")), "nodes")
    pairs = materialise(near_pairs(nodes), "pairs")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(nodes.select(F.col("fp").alias("v"), "n"), "v").groupBy("u").agg(F.sum("n").alias("others"))
    counted = nodes.join(linked.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))
    return counted, components(pairs).withColumnRenamed("node", "fp")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the id, fingerprint (16 hex digits), n_near (other rows linked directly) and component_id."""
    made = materialise(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "_id"), "fingerprints")
    counted, labels = _links(made)
    first = made.groupBy("fp").agg(F.min("_id").alias("first")).join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    first = materialise(first, "labelled")
    least = first.groupBy("label").agg(F.min("first").alias("component_id"))
    per_node = materialise(first.join(least, "label").select("fp", "component_id").join(counted, "fp"), "per_node")
    return join_counted(made, per_node, ["fp"], "n", made.count()).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each component with the smallest id (null last; of equal ids the text with the smallest hash; of equal rows one). All columns stay, whatever their names."""
    th, ki, kt = unused(docs, 3)
    hashed = docs.withColumn(th, F.xxhash64(F.col(f"`{text_col}`")))

    def run(batches):
        for batch in batches:
            made = np.array([simhash(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made)], names=["_id", "_th", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    made = materialise(spread(hashed.select(F.col(f"`{id_col}`"), F.col(th), F.col(f"`{text_col}`"))).mapInArrow(lean(run), f"_id {id_type}, _th long, fp long"), "fingerprints")
    _, labels = _links(made)
    order = F.struct(F.col("_id").isNull().alias("o"), F.col("_id").alias("i"), F.col("_th").alias("t"))
    per_fp = made.groupBy("fp").agg(F.min(order).alias("first")).join(labels, "fp", "left")
    chosen = materialise(per_fp.groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("first").alias("first")).select(F.col("first.i").alias(ki), F.col("first.t").alias(kt)), "chosen")
    same = (F.col(f"`{id_col}`").eqNullSafe(F.col(ki))) & (F.col(th) == F.col(kt))
    kept = hashed.join(chosen, same, "left_semi")
    again = materialise(made.join(chosen, (F.col("_id").eqNullSafe(F.col(ki))) & (F.col("_th") == F.col(kt)), "left_semi").groupBy("_id", "_th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_id").alias(ki), F.col("_th").alias(kt)), "again")
    if again.isEmpty():
        return kept.drop(th)
    # Rows with the same id and text: one of them.
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, th])).drop(th)
