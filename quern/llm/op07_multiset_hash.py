"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines that aren't empty). Each paragraph is hashed to a wide vector,
and a text's fingerprint is the sum of its paragraphs' vectors, lane by lane modulo a power of
two: paragraphs may come in any order, and one is inserted or deleted by adding or subtracting its
vector. The vector has two parts.

* ``DENSE`` lanes modulo 2**64, filled from BLAKE2b of the paragraph: texts with equal multisets
  have equal sums, others don't, but for chance.
* ``SIGNS`` lanes modulo 2**32, the sum of +1 or -1 vectors hashed from the paragraph's sentences (long ones in runs of words).
  Products of such sums estimate how many sentences two texts share, so ``likeness`` needs only the
  two fingerprints: the shared sentences over all sentences of both.

A fingerprint is written as base64 of its lanes (little-endian). The text without paragraphs, and
null, give zeros. Two zeros are alike (1.0), a zero and another aren't (0.0). A very long text counts whole: lanes hold
two thousand million sentences before they wrap. Repeated rows get a fingerprint each; an empty table gives an
empty result. Ids may be of any type that orders. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.pieces import parts
from quern.llm.workers import lean
from quern.session import spread

DENSE, SIGNS = 16, 128
#: Bytes beyond which a sentence is taken as runs of words.
LONG = 160


def runs(sentence: bytes) -> list[bytes]:
    """A long sentence in runs of words that end where a word's own form says so, or after 16."""
    out, held = [], []
    for w in sentence.split():
        held.append(w)
        if (w[-1] + 3 * len(w)) & 7 == 0 or len(held) == 16:
            out.append(b" ".join(held))
            held = []
    return out + [b" ".join(held)] * bool(held) or [sentence]


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each text's fingerprint: uint64 (n, DENSE), uint32 (n, SIGNS)."""
    from xxhash import xxh3_128_digest

    dense, signs = np.zeros((len(texts), DENSE), np.uint64), np.zeros((len(texts), SIGNS), np.uint32)
    wide, bits, of_wide, of_bits = [], [], [], []
    for i, t in enumerate(texts):
        lines = [x for x in (t or "").encode().split(b"\n") if x]
        if not lines:
            continue
        of_wide.append((i, len(wide)))
        of_bits.append((i, len(bits)))
        for x in lines:
            wide.append(hashlib.blake2b(x).digest() + hashlib.blake2b(x, person=b"2").digest())
            for y in x.split(b". "):
                if len(y) > LONG:
                    bits += map(xxh3_128_digest, runs(y))
                else:
                    bits.append(xxh3_128_digest(y))
    if not wide:
        return dense, signs
    who, start = np.array(of_wide).T
    dense[who] = np.add.reduceat(np.frombuffer(b"".join(wide), "<u8").reshape(-1, DENSE), start, axis=0)
    who, start = np.array(of_bits).T
    ones = np.add.reduceat(np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(-1, SIGNS // 8), axis=1), start, axis=0, dtype=np.uint32)
    signs[who] = ones * np.uint32(2) - np.diff(start, append=len(bits)).astype(np.uint32)[:, None]
    return dense, signs


def to_string(dense: np.ndarray, signs: np.ndarray) -> str:
    return base64.b64encode(dense.astype("<u8").tobytes() + signs.astype("<u4").tobytes()).decode()


def from_string(s: str) -> tuple[np.ndarray, np.ndarray]:
    b = base64.b64decode(s)
    return np.frombuffer(b[: 8 * DENSE], "<u8"), np.frombuffer(b[8 * DENSE :], "<u4")


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of both texts' paragraphs, or with ``sign`` -1 of a's without b's."""
    (x, p), (y, q) = from_string(a), from_string(b)
    return to_string(x + y if sign > 0 else x - y, p + q if sign > 0 else p - q)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row, from 0 to 1; equal fingerprints give 1."""
    p, q = a[1].astype(np.int32).astype(np.float64), b[1].astype(np.int32).astype(np.float64)
    shared, total = (p * q).sum(1), (p * p).sum(1) + (q * q).sum(1)
    union = total - shared
    near = np.clip(np.divide(shared, union, out=np.zeros(len(p)), where=union > 0), 0, 1)
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    # Estimates of unequal texts stay below 1, which says equal.
    return np.where(same, 1.0, np.minimum(near, 1 - 1e-9))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the fingerprint of each row."""

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, 1)):
            made = [to_string(d, s) for d, s in zip(*vectors(batch.column(1).to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[id_col, "fingerprint"])

    return spread(docs.select(id_col, text_col)).mapInArrow(lean(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of ``following``, or all of it."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _number(rows: DataFrame, column: str) -> Column:
    """A number (double) that never falls as the column rises, so that ranges can be cut from it."""
    kind = rows.schema[column].dataType
    if isinstance(kind, T.NumericType | T.TimestampType):
        return F.col(column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.BooleanType):
        return F.col(column).cast("int").cast("double")
    if isinstance(kind, T.StringType | T.BinaryType):
        # Six bytes, from where the least and the greatest first differ.
        raw = F.col(column).cast("binary")
        low, high = (bytes(x or b"") for x in rows.agg(F.min(raw), F.max(raw)).first())
        same = len(os.path.commonprefix([low, high]))
        return F.conv(F.rpad(F.hex(F.substring(raw, same + 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.lit(0.0)  # one range


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text in ascending order of ids (null last, ties by text), edited with the next one; after the last comes the first.

    The texts cross the network once, into ranges of ids whose bounds come from the ids alone. The
    first row of a range goes to the range before it as well, where it follows the last row.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_x", F.when(F.col("_id").isNotNull(), _number(rows, "_id")))
    inner = sorted(set(keyed.select("_x").approxQuantile("_x", [i / n for i in range(1, n)], 1 / (4 * n)) or [0.0]))
    keyed = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_x", outputCol="_p", handleInvalid="keep").transform(keyed).withColumn("_p", F.coalesce(F.col("_p"), F.lit(len(inner) + 1.0)).cast("int"))
    # One row a range.
    firsts = sorted((r["_p"], r["first"]) for r in keyed.groupBy("_p").agg(F.min("_id").alias("first")).collect())
    before = {p: firsts[i - 1][0] for i, (p, _) in enumerate(firsts)}
    id_type = rows.schema["_id"].dataType.simpleString()
    guests = spark.createDataFrame([(p, first, before[p]) for p, first in firsts], f"_gp int, _gid {id_type}, _to int")
    sent = keyed.join(F.broadcast(guests), F.expr("_p = _gp and _id <=> _gid"), "left")
    own = F.struct(F.col("_p").alias("p"), F.lit(False).alias("guest"))
    sent = sent.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_to").alias("p"), F.lit(True).alias("guest"))))))
    sent = sent.select(F.col("_at.p").alias("_p"), F.col("_at.guest").alias("_guest"), "_id", "_text")
    laid = sent.repartitionById(len(inner) + 2, F.col("_p")).sortWithinPartitions("_p", "_guest", F.col("_id").asc_nulls_last(), F.col("_text").asc_nulls_first())

    def run(batches):
        last = None  # (range, id, text, parts) of the row that waits for the next
        done = None  # the range whose end has been met
        for batch in (part for whole in batches for part in parts(whole, 3)):
            p, guest, ids, texts = (batch.column(i).to_pylist() for i in range(4))
            texts = [t or "" for t in texts]
            dense, signs = vectors(texts)
            pairs = []
            for i in range(len(p)):
                if p[i] == done:
                    continue
                row = (p[i], ids[i], texts[i], (dense[i], signs[i]))
                if last is not None:
                    pairs.append((last, row))
                last = row
                if guest[i]:
                    done, last = p[i], None
            yield finish(pairs, batch.column(2).type)

    def finish(pairs, id_arrow):
        edited = [edit(a[2], b[2]) for a, b in pairs]
        changed = vectors(edited)
        part = lambda k, j: np.array([x[k][3][j] for x in pairs]).reshape(len(pairs), DENSE if j == 0 else SIGNS)
        mine, other = (part(0, 0), part(0, 1)), (part(1, 0), part(1, 1))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[1] for a, _ in pairs], id_arrow),
                pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([to_string(*a[3]) for a, _ in pairs], pa.string()),
                pa.array([to_string(d, s) for d, s in zip(*changed)], pa.string()),
                pa.array(likeness(mine, changed), pa.float64()),
                pa.array(likeness(mine, other), pa.float64()),
            ],
            names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return laid.mapInArrow(lean(run), f"`{id_col}` {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
