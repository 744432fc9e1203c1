"""A content-addressed store of token ids.

Each document's ids are cut where a rolling hash of the last ids meets a mask, so that a passage
shared by documents is cut alike wherever it stands. A chunk is named by the BLAKE2b digest of its
payload and is stored once. A document is a recipe: the digests of its chunks in order.

    chunks/     bucket int, digests binary (16 bytes each, ascending), lengths binary (ids of each chunk, 32-bit), payload binary
    recipes/    shard int, idx long, <id>, local_start long, n_tokens long, digests binary,
                lengths binary (ids of each chunk, 32-bit), leaf binary
    manifest/   shard int, n_docs long, n_tokens long, base long, root binary, store_root binary

Chunks come in pages, those of one bucket of digests together, and cross the network so. Recipes ascend by id through the shards (null ids first). A payload is the ids as little-endian words of 16 bits, or of 32 if
an id needs them. ``leaf`` is the SHA-256 of a recipe, ``root``
the Merkle root of a shard's leaves, and ``store_root`` that of all shards' roots. All three are
Parquet tables, so that a lost executor's files are written again by the committer's rules.

A null text counts as empty: its ids are the end id alone. Repeated rows are documents of their
own. Only the id and text columns are read. An empty table makes an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.pieces import encoder as piece_encoder
from quern.llm.pieces import parts as slices
from quern.llm.workers import bucket_count, lean, packed, rows_of, runs, values
from quern.session import release, spread

#: Chunks hold from MIN_IDS to MAX_IDS ids; beyond MIN_IDS one in AVG_IDS positions is a cut. A shared
#: passage is stored once only where it holds whole chunks, so these are well below a passage's 100 to 500 ids.
MIN_IDS, AVG_IDS, MAX_IDS, WINDOW = 16, 64, 1024, 8
#: Digests a task remembers to send a chunk on only once; documents of a shard beyond which there are more shards.
SEEN, SHARD_DOCS = 200_000, 250_000
#: A digest; a stored chunk's ids and CRC-32; a document's chunk with the ids that follow; what it adds to the document's CRC-32.
NAME = np.dtype([("hi", "<u8"), ("lo", "<u8")])
KNOWN, WANTED = np.dtype([("name", NAME), ("n", "<u4"), ("crc", "<u4")]), np.dtype([("name", NAME), ("row", "<i8"), ("after", "<i8")])
SUMS, TOTALS = np.dtype([("row", "<i8"), ("n", "<u4"), ("crc", "<u4")]), np.dtype([("row", "<i8"), ("n", "<i8"), ("crc", "<u4")])


def cuts(ids: np.ndarray, bounds: list[int]) -> list[list[int]]:
    """For each document ``ids[bounds[i]:bounds[i+1]]`` the ends of its chunks, counted from its start."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    # The sum over a window is that over its halves; WINDOW is a power of two.
    width, factor = 1, 0xD1342543DE82EF95
    while width < WINDOW:
        h[width:] += h[:-width] * np.uint64(factor)
        width, factor = 2 * width, factor * factor % 2**64
    h *= np.uint64(0xFF51AFD7ED558CCD)
    marks = np.flatnonzero(h < np.uint64(2**64 // AVG_IDS)) + 1
    where = np.searchsorted(marks, bounds)
    out = []
    for i in range(len(bounds) - 1):
        start, stop, ends, last = bounds[i], bounds[i + 1], [], bounds[i]
        for p in [*marks[where[i] : where[i + 1]].tolist(), stop]:
            while p - last > MAX_IDS:
                last += MAX_IDS
                ends.append(last - start)
            if p - last >= MIN_IDS or (p == stop and p > last):
                last = p
                ends.append(p - start)
        out.append(ends)
    return out


def unpack_ids(data: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a payload, as 32-bit words."""
    return np.frombuffer(data, f"<u{len(data) // n}").astype("<u4")


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 over pairs, a single last node carried up; of no leaves, the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256().digest()]
    while len(level) > 1:
        up = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(up) * 2 :]
    return level[0]


def leaf(doc_id, n_tokens: int, digests: bytes) -> bytes:
    return hashlib.sha256(f"{doc_id}:{n_tokens}:".encode() + digests).digest()


def _take(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches of ``flat`` laid end to end."""
    ends = np.cumsum(n)
    return flat[np.repeat(start - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """Digests' buckets, from their first 32 bits; names: (n, 16) bytes."""
    return np.ascontiguousarray(names[:, :4]).view(">u4").ravel().astype(np.int64) & (buckets - 1)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the store below ``path``.

    The ids cross the network once: a task sends a chunk to the page of its digest the first
    time it meets it, and a recipe to any partition; there chunks are stored once.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    shards, buckets = int(spark.conf.get("spark.sql.shuffle.partitions")), bucket_count(spark)

    def encode(batches):
        encoder = piece_encoder(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        seen, end = set(), np.array([end_id], np.uint32)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            all_ids = [x for ids in encoder.encode(values(batch.column(1))) for x in (ids, end)]
            flat = np.concatenate(all_ids) if all_ids else np.zeros(0, np.uint32)
            n_tokens = np.array([len(x) for x in all_ids[::2]], np.int64) + 1
            bounds = np.concatenate([[0], np.cumsum(n_tokens)])
            made = cuts(flat, bounds.tolist())
            per_doc = np.array([len(x) for x in made], np.int64)
            stop = np.concatenate([np.array(x, np.int64) for x in made]) + np.repeat(bounds[:-1], per_doc) if len(flat) else np.zeros(0, np.int64)
            start = np.concatenate([[0], stop[:-1]])[: len(stop)]
            laid = flat.astype(f"<u{width}")
            data, blake = memoryview(laid).cast("B"), hashlib.blake2b
            names = [blake(data[i:j], digest_size=16).digest() for i, j in zip((start * width).tolist(), (stop * width).tolist())]
            fresh = []
            for i, name in enumerate(names):
                if name not in seen:
                    seen.add(name)
                    fresh.append(i)
            if len(seen) > SEEN:
                seen.clear()
            joined, lengths, edge = b"".join(names), (stop - start).astype("<u4"), np.cumsum(per_doc)
            digests = np.frombuffer(joined, np.uint8).reshape(-1, 16)
            fresh = np.array(fresh, np.int64)
            where = _bucket(digests[fresh], buckets)
            order = np.argsort(where, kind="stable")
            fresh, where = fresh[order], where[order]
            first, last = runs(where)
            payload, inside = _take(laid, start[fresh], lengths[fresh].astype(np.int64)), np.cumsum(lengths[fresh].astype(np.int64)) * width
            # A recipe may go anywhere.
            place = np.random.default_rng(len(joined)).integers(0, buckets, len(n_tokens))
            a, b = len(n_tokens), len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(a, 0, np.int32)), pa.array(place), batch.column(0), pa.array(n_tokens), rows_of(joined, edge * 16), rows_of(lengths.tobytes(), edge * 4), pa.nulls(a, pa.binary())],
                names=["kind", "bucket", id_col, "n_tokens", "digests", "lengths", "payload"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b, 1, np.int32)), pa.array(where[first]), pa.nulls(b, batch.column(0).type), pa.nulls(b, pa.int64()), rows_of(digests[fresh].tobytes(), last * 16), rows_of(lengths[fresh].tobytes(), last * 4), rows_of(payload.tobytes(), inside[last - 1])],
                names=["kind", "bucket", id_col, "n_tokens", "digests", "lengths", "payload"],
            )

    def once(batches):
        held, now = [], None

        def page(like):
            names = np.frombuffer(b"".join(x for x, *_ in held), np.uint8).reshape(-1, 16)
            n = np.frombuffer(b"".join(x for _, x, _ in held), "<u4").astype(np.int64)
            data = np.frombuffer(b"".join(x for *_, x in held), np.uint8)
            width = len(data) // max(1, int(n.sum()))
            hi, lo = names.view(">u8").reshape(-1, 2).T
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            new = np.ones(len(order), bool)
            new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            order = order[new]
            data = _take(data.view(f"<u{width}"), (np.cumsum(n) - n)[order], n[order])
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([now]), pa.nulls(1, like), pa.nulls(1, pa.int64()), one(names[order]), one(n[order].astype("<u4")), one(data)], names=["kind", "bucket", id_col, "n_tokens", "digests", "lengths", "payload"])

        for batch in batches:  # in order of kind, then bucket
            chunk = batch.column(0).to_numpy() == 1
            if not chunk.all():
                yield batch.filter(pa.array(~chunk))
                batch = batch.filter(pa.array(chunk))
            like = batch.column(2).type
            for bucket, *row in zip(values(batch.column(1)), *(values(batch.column(i)) for i in (4, 5, 6))):
                if bucket != now:
                    if held:
                        yield page(like)
                    held, now = [], bucket
                held.append(row)
        if held:
            yield page(like)

    staged = f"kind int, bucket long, `{id_col}` {id_type}, n_tokens long, digests binary, lengths binary, payload binary"
    sent = spread(docs.select(id_col, text_col)).mapInArrow(lean(encode), staged).repartition(shards, "bucket").sortWithinPartitions("kind", "bucket")
    sent.mapInArrow(lean(once), staged).write.partitionBy("kind").option("compression", "uncompressed").parquet(f"{path}/chunks")
    del sent
    release(spark)
    read = spark.read.schema(staged).parquet(f"{path}/chunks")

    def order(batches):
        shard, idx, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            starts = start + np.cumsum(n) - n
            leaves = [leaf(d, k, x) for d, k, x in zip(batch.column(0).to_pylist(), n.tolist(), values(batch.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), shard, np.int32)), pa.array(idx + np.arange(len(n))), batch.column(0), pa.array(starts), pa.array(n), batch.column(2), batch.column(3), pa.array(leaves, pa.binary())],
                names=["shard", "idx", id_col, "local_start", "n_tokens", "digests", "lengths", "leaf"],
            )
            idx, start = idx + len(n), start + int(n.sum())

    recipe_schema = f"shard int, idx long, `{id_col}` {id_type}, local_start long, n_tokens long, digests binary, lengths binary, leaf binary"
    recipes = read.where("kind = 0").select(id_col, "n_tokens", "digests", "lengths")
    recipes = recipes.repartitionByRange(max(shards, -(-recipes.count() // SHARD_DOCS)), id_col).sortWithinPartitions(id_col, "digests")
    recipes.mapInArrow(order, recipe_schema).write.parquet(f"{path}/recipes")

    rows, base = [], 0
    found = shard_roots(spark, path)
    top = merkle_root([root for *_, root in found])
    for shard, n_docs, n_tokens, root in found:
        rows.append((shard, n_docs, n_tokens, base, bytearray(root), bytearray(top)))
        base += n_tokens
    spark.createDataFrame(rows, "shard int, n_docs long, n_tokens long, base long, root binary, store_root binary").coalesce(1).write.parquet(f"{path}/manifest")


def shard_roots(spark: SparkSession, path: str) -> list[tuple[int, int, int, bytes]]:
    """From the recipes' files, for each shard: its number, documents, ids and Merkle root. One short row a shard is collected; a shard has about SHARD_DOCS leaves."""

    def roots(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = table.column("n_tokens").to_numpy()
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), "n_docs": pa.array([len(n)], pa.int64()), "n_tokens": pa.array([int(n.sum())], pa.int64()), "root": pa.array([merkle_root(values(table.column("leaf").combine_chunks()))], pa.binary())})

    per_shard = spark.read.parquet(f"{path}/recipes").select("shard", "idx", "n_tokens", "leaf").groupBy("shard").applyInArrow(roots, "shard int, n_docs long, n_tokens long, root binary")
    return sorted((r.shard, r.n_docs, r.n_tokens, bytes(r.root)) for r in per_shard.collect())


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raise unless the recipes' leaves give the manifest's roots, and the shards hold as many documents and ids as it says. The leaves themselves are held against the recipes by those who read these."""
    rows = sorted(spark.read.parquet(f"{path}/manifest").collect())
    found = shard_roots(spark, path)
    if [(r.shard, r.n_docs, r.n_tokens, bytes(r.root)) for r in rows] != found:
        raise ValueError("the recipes don't give the manifest's shards")
    top, base = merkle_root([root for *_, root in found]), 0
    for r in rows:
        if bytes(r.store_root) != top or r.base != base:
            raise ValueError("the shards don't give the manifest's root")
        base += r.n_tokens


def recipes_of(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with ``start``, the ids of all documents before. The manifest has one row a shard."""
    r, m = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest").select("shard", "base")
    return r.join(F.broadcast(m), "shard").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket long, digests binary, lengths binary, payload binary, kind int").parquet(f"{path}/chunks").where("kind = 1").drop("kind")


def _cut(digests: bytes, lengths: bytes, payload: bytes):
    """A page's chunks: (digest, ids, payload), each held against its digest."""
    n = np.frombuffer(lengths, "<u4").astype(np.int64)
    ends = np.cumsum(n) * (len(payload) // max(1, int(n.sum())))
    start = 0
    for i, (k, stop) in enumerate(zip(n.tolist(), ends.tolist())):
        name, data = digests[16 * i : 16 * i + 16], payload[start:stop]
        if digest(data) != name:
            raise ValueError(f"chunk {name.hex()} doesn't give its digest")
        yield name, k, data
        start = stop


def chunks_of(spark: SparkSession, path: str) -> DataFrame:
    """The stored chunks: digest, n, payload."""

    def run(batches):
        for batch in batches:
            for page in zip(*(values(batch.column(i)) for i in (1, 2, 3))):
                name, n, data = zip(*_cut(*page))
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["digest", "n", "payload"])

    return pages_of(spark, path).mapInArrow(lean(run), "digest binary, n int, payload binary")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over two elements, modulo that of CRC-32, in its reflected order of bits."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(max(len(a), len(b)), np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ (b & np.uint32(1)) * np.uint32(0xEDB88320)
    return out


@cache
def _powers() -> np.ndarray:
    """For each k the products of all bytes, at each of the four places of a CRC-32, and 2**k bytes' power of x."""
    out, step = np.zeros((48, 4, 256), np.uint32), np.array([1 << 23], np.uint32)  # x to the 8th: one byte
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k in range(48):
        images = _times(np.broadcast_to(step, 32), bits).reshape(4, 8)
        for b in range(8):
            out[k, :, (np.arange(256) >> b & 1).astype(bool)] ^= images[:, b]
        step = _times(step, step)
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a text in which ``n_bytes`` follow: the text's CRC is the XOR of its parts' so shifted."""
    out, n, tables = crc.astype(np.uint32), n_bytes.astype(np.int64), _powers()
    for k in range(int(n.max()).bit_length() if len(n) else 0):
        at = np.flatnonzero(n >> k & 1)
        x, t = out[at], tables[k]
        out[at] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return out


def read_checksums(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """For every document, read from the store's files: id, start, n_tokens, ids_crc32 of its ids.

    The manifest's roots are held against the recipes' leaves, each leaf against its recipe, and each stored
    chunk, read once, against its digest. CRC-32 is linear, so
    a document's follows from its chunks' by ``shifted``; the chunks' bytes needn't be moved to
    their documents, as ``read_store`` does to give the ids themselves. What doesn't agree, a missing chunk, or a
    document without all its ids, is an error.
    """
    check_manifest(spark, path)
    recipes = recipes_of(spark, path)
    buckets, partitions = bucket_count(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sums(batches):
        """Each page's digests, with their chunks' ids and CRCs."""
        for batch in batches:
            for digests, lengths, payload in zip(*(values(batch.column(i)) for i in (1, 2, 3))):
                known = np.empty(len(digests) // 16, KNOWN)
                known["name"], known["n"] = np.frombuffer(digests, NAME), np.frombuffer(lengths, "<u4")
                wide, at, crc = memoryview(unpack_ids(payload, int(known["n"].sum(dtype=np.int64)))).cast("B"), 0, []
                for _, n, _ in _cut(digests, lengths, payload):
                    crc.append(zlib.crc32(wide[at : at + 4 * n]))
                    at += 4 * n
                known["crc"] = crc
                yield from by_bucket(known, known["name"], 0)

    def by_bucket(rows, names, kind):
        keys, data = packed(rows, _bucket(np.ascontiguousarray(names).view(np.uint8).reshape(-1, 16), buckets))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), kind, np.int32)), data], names=["bucket", "kind", "data"])

    def parts(batches):
        """The chunks that documents have, with the bytes that follow them."""
        for batch in (part for whole in batches for part in slices(whole, 3, 4 << 20)):
            shard, idx = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            digests, lengths = values(batch.column(3)), values(batch.column(4))
            for d, k, x, y in zip(batch.column(6).to_pylist(), values(batch.column(5)), digests, values(batch.column(2))):
                if leaf(d, k, x) != y:
                    raise ValueError(f"document {d}: its recipe doesn't give its leaf")
            count = np.array([len(x) // 16 for x in digests], np.int64)
            n = np.frombuffer(b"".join(lengths), "<u4").astype(np.int64)
            total = np.cumsum(n)
            wanted = np.empty(len(n), WANTED)
            wanted["name"], wanted["row"] = np.frombuffer(b"".join(digests), NAME), np.repeat((shard << 40) + idx, count)
            wanted["after"] = total[np.repeat(np.cumsum(count), count) - 1] - total if len(n) else 0
            yield from by_bucket(wanted, wanted["name"], 1)

    def meet(batches):
        now, held, known, wanted, size = None, [], None, [], 0

        def answer():
            nonlocal held, known, wanted, size
            if held:
                known = np.concatenate(held if known is None else [known, *held])
                known, held = known[np.lexsort((known["name"]["lo"], known["name"]["hi"]))], []
            x = np.concatenate(wanted)
            if known is None:
                raise ValueError("chunks of documents are missing")
            at = np.searchsorted(known["name"]["hi"], x["name"]["hi"])
            # Digests that share their first half stand side by side.
            todo = np.arange(len(x))
            while len(todo):
                inside = at[todo] < len(known)
                if not inside.all() or (known["name"]["hi"][at[todo]] != x["name"]["hi"][todo]).any():
                    raise ValueError("chunks of documents are missing")
                todo = todo[known["name"]["lo"][at[todo]] != x["name"]["lo"][todo]]
                at[todo] += 1
            out = np.empty(len(x), SUMS)
            out["row"], out["n"], out["crc"] = x["row"], known["n"][at], shifted(known["crc"][at], x["after"] * 4)
            where = ((out["row"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(partitions)).astype(np.int64)
            keys, data = packed(out, where)
            wanted, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), data], names=["bucket", "data"])

        for batch in batches:  # in order of bucket, then kind
            for bucket, kind, data in zip(*(values(c) for c in batch.columns)):
                if bucket != now:
                    if wanted:
                        yield answer()
                    now, held, known = bucket, [], None
                if kind == 0:
                    held.append(np.frombuffer(data, KNOWN))
                    continue
                wanted.append(np.frombuffer(data, WANTED))
                size += len(wanted[-1])
                if size > 1 << 18:
                    yield answer()
        if wanted:
            yield answer()

    def whole(batches):
        # What is added to a document's CRC and ids; sums of what has come so far stay small.
        held, size, most = [], 0, 1 << 20

        def summed():
            x = np.concatenate(held)
            x = x[np.argsort(x["row"], kind="stable")]
            first, _ = runs(x["row"])
            out = np.empty(len(first), TOTALS)
            out["row"], out["crc"], out["n"] = x["row"][first], np.bitwise_xor.reduceat(x["crc"], first), np.add.reduceat(x["n"].astype(np.int64), first)
            return out

        for batch in batches:
            for data in values(batch.column(1)):
                x = np.frombuffer(data, SUMS)
                held.append(x.astype(TOTALS))
                size += len(x)
                if size > most:
                    held = [summed()]
                    size = len(held[0])
                    most = max(most, 2 * size)
        if held:
            out = summed()
            yield pa.RecordBatch.from_arrays([pa.array(out["row"]), pa.array(out["crc"].astype(np.int64)), pa.array(out["n"])], names=["row", "ids_crc32", "_n"])

    pages = "bucket long, kind int, data binary"
    wanted = recipes.select("shard", "idx", "leaf", "digests", "lengths", "n_tokens", id_col).mapInArrow(lean(parts), pages)
    stored = pages_of(spark, path).mapInArrow(lean(sums), pages)
    met = stored.unionByName(wanted).repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lean(meet), "bucket int, data binary")
    sums_of = met.repartitionById(partitions, F.col("bucket")).mapInArrow(lean(whole), "row long, ids_crc32 long, _n long")
    named = recipes.select((F.shiftleft(F.col("shard").cast("long"), 40) + F.col("idx")).alias("_row"), F.col(id_col).alias("_id"), "start", "n_tokens")
    checked = F.when(F.col("_n") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document doesn't have all its ids")).cast("long"))
    return named.join(sums_of, F.col("_row") == F.col("row"), "left").select(F.col("_id").alias(id_col), "start", "n_tokens", checked.alias("ids_crc32"))


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Every document put together again from its chunks: id, start, n_tokens, ids_crc32, and on demand ids (32-bit little-endian).

    A chunk whose ids don't give its digest, or a document without all its ids, is an error.
    """
    recipes = recipes_of(spark, path)
    id_type = recipes.schema[id_col].dataType.simpleString()
    names = F.transform(F.sequence(F.lit(0), (F.length("digests") / 16 - 1).cast("int")), lambda i: F.struct(i.alias("pos"), F.col("digests").substr(i * 16 + 1, F.lit(16)).alias("digest")))
    parts = recipes.select("shard", "idx", id_col, "start", "n_tokens", F.explode(names).alias("p")).select("shard", "idx", id_col, "start", "n_tokens", "p.pos", "p.digest")
    # A chunk that is missing must fail the document, so the recipes' side is kept whole.
    joined = parts.join(chunks_of(spark, path).select("digest", F.col("n").alias("chunk_n"), "payload"), "digest", "left")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = joined.select("shard", "idx", "pos", id_col, "start", "n_tokens", "digest", "chunk_n", "payload").repartition(shards, "shard", "idx").sortWithinPartitions("shard", "idx", "pos")

    def rebuild(batches):
        key, held, row = None, [], None

        def finish():
            ids = np.concatenate(held)
            if len(ids) != row[2]:
                raise ValueError(f"document {row[0]}: {len(ids)} ids stored, {row[2]} expected")
            return (*row, ids.tobytes())

        def emit(done):
            cols = [pa.array([d[0] for d in done], id_arrow), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([zlib.crc32(d[3]) for d in done], pa.int64())]
            if with_ids:
                cols.append(pa.array([d[3] for d in done], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

        id_arrow = None
        for batch in batches:
            id_arrow, done, size = batch.column(3).type, [], 0
            for shard, idx, _, *rest, name, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, idx) != key:
                    if row is not None:
                        done.append(finish())
                        size += len(done[-1][3])
                    key, held, row = (shard, idx), [], rest
                    if size > 1 << 25:
                        yield emit(done)
                        done, size = [], 0
                if data is None:
                    raise ValueError(f"document {rest[0]}: chunk {name.hex()} is missing")
                held.append(unpack_ids(data, n))
            yield emit(done)
        if row is not None:
            yield emit([finish()])

    return laid.mapInArrow(rebuild, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def verify(spark: SparkSession, path: str, id_col: str = "doc_id") -> bool:
    """Whether recipes, shards and the whole store still give the roots in the manifest. Chunks are verified as they are read."""
    bad = spark.read.parquet(f"{path}/recipes").select(id_col, "n_tokens", "digests", "leaf").mapInArrow(_bad_leaves, "bad long").agg(F.sum("bad")).first()[0]
    try:
        check_manifest(spark, path)
    except ValueError:
        return False
    return not bad


def _bad_leaves(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(leaf(d, n, x) != y for d, n, x, y in zip(*(c.to_pylist() for c in batch.columns)))], pa.int64())], names=["bad"])
