"""An index as segments of Parquet tables.

A folder holds ``gen-N/<table>`` and pointers, ``pointer-N.json``. A write makes a new generation beside
those that are read, and then a pointer that names the segments of every table; pointers are
renamed into place and never overwritten, so that readers see the old index or the new one, and a
write that dies at any point leaves the old one. An update adds segments of what is new, and names
the rows of older segments that are gone; a reader leaves those out. When segments become many
they are written as one.

    chunks     the stored chunks with vectors, by id_bucket; postings  term, n, id, tf, dl by term_bucket
    names      n, id of a segment's postings
    docs       id, dl; stats  n_docs, total_len; manifest; cache; gone  key

An id is 71 bytes that don't compress to half of that, and would be most of the index: a posting has a hash n of it instead, and the id
itself only where two of a segment's ids have the same n. Readers get ids. A posting has its document's length, so that a keyword search reads the postings of its terms and one row of
sums, and the names of its hits. Whole chunks are read last, for the hits alone, from their buckets.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import schema
from quern.errors import IndexingError
from quern.operators import bm25
from quern.session import materialise, release, remove

#: Buckets of the postings by term, and of the chunks by id; segments of a table beyond which an update writes it as one.
TERM_BUCKETS, ID_BUCKETS, SEGMENTS = 64, 64, 8
#: Documents up to which an update writes its postings as one file.
FEW = 64
_SCHEMAS = {"chunks": schema.STORED, "manifest": schema.MANIFEST, "cache": schema.CACHE}
_POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType())])
_DOCS = T.StructType([T.StructField("id", T.StringType()), T.StructField("dl", T.IntegerType())])
_STATS = T.StructType([T.StructField("n_docs", T.LongType()), T.StructField("total_len", T.LongType())])
_SCHEMAS |= {"postings": _POSTINGS, "docs": _DOCS, "stats": _STATS}
#: Postings as they lie in files.
_STORED_POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("id", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType())])
#: Columns by whose values a table's files lie in folders.
_FOLDERS = {"postings": ("term_bucket", "term", TERM_BUCKETS), "chunks": ("id_bucket", "id", ID_BUCKETS)}
#: By which column rows of a table are named as gone.
_KEYS = {"chunks": "id", "postings": "id", "docs": "id", "manifest": "file_path"}
_NAMES = re.compile(r"(?:gen-|pointer-)(\d+)(?:\.json)?")


def number(c: Column) -> Column:
    """What stands for an id in postings."""
    return F.xxhash64(c)


def bucket(value: str, buckets: int) -> int:
    return zlib.crc32(value.encode()) % buckets


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._p(""))] if self._fs.exists(self._p("")) else []

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._p(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def pointer(self) -> dict:
        """{"generation": n, "tables": {name: [[generation, folder], ...]}, "gone": {column: [[generation, folder], ...]}}: the newest
        that can be read. Generation 0 is an index without tables."""
        pointers = sorted((int(m[1]), n) for n in self._names() if n.startswith("pointer-") and n.endswith(".json") and (m := _NAMES.fullmatch(n)))
        for _, name in reversed(pointers):
            try:
                out = json.loads(self._text(name))
                if isinstance(out["tables"], dict) and isinstance(out["gone"], dict):
                    return out
            except (TypeError, ValueError, KeyError, Py4JJavaError):
                continue
        return {"generation": 0, "tables": {}, "gone": {}}

    def has(self, table: str) -> bool:
        """Whether the index has the table, with a row or more."""
        return table in self.pointer()["tables"] and not self.read(table).isEmpty()

    def known(self, table: str) -> bool:
        """Whether the table has been written, even if without rows."""
        return table in self.pointer()["tables"]

    def read(self, table: str, among: list[str] | None = None) -> DataFrame:
        """A table as it now is; empty if there is none. ``among``: the rows of these terms (postings) or ids (chunks) alone; the folders of others aren't opened."""
        now = self.pointer()
        segments = now["tables"].get(table)
        own = _SCHEMAS[table]
        where = F.lit(True)
        full = lies = _STORED_POSTINGS if table == "postings" else own
        if table in _FOLDERS:
            folder, column, n = _FOLDERS[table]
            full = T.StructType([*lies.fields, T.StructField(folder, T.IntegerType())])
            if among is not None:
                where = F.col(folder).isin(*{bucket(x, n) for x in among}) & F.col(column).isin(*set(among)) if among else F.lit(False)
        if not segments:
            return self.spark.createDataFrame([], own)
        key, out = _KEYS.get(table), None
        # Segments to which the same rows are gone are read together.
        by_gone: dict[tuple, list[tuple[int, str]]] = {}
        for generation, folder in segments:
            by_gone.setdefault(tuple(f for g, f in now["gone"].get(key, []) if g > generation), []).append((generation, f"{self.path}/{folder}"))
        for gone, folders in by_gone.items():
            # One by one, so that each folder's partition column is read from its own root.
            part = None
            for generation, folder in folders:
                df = self.spark.read.schema(full).parquet(folder).where(where).select(*lies.fieldNames(), F.lit(generation).alias("_g"))
                part = df if part is None else part.unionByName(df)
            if table == "postings":
                part = self._named(part, now, {g for g, _ in folders})
            part = part.select(*own.fieldNames())
            if gone:
                left = self.spark.read.schema("key string").parquet(*[f"{self.path}/{f}" for f in gone])
                part = part.join(left.withColumnRenamed("key", key), key, "left_anti").select(*own.fieldNames())
            out = part if out is None else out.unionByName(part)
        return out

    def _named(self, part: DataFrame, now: dict, generations: set[int]) -> DataFrame:
        """Postings of some segments (with _g, theirs) with their ids."""
        names = None
        for generation, folder in now["tables"].get("names", []):
            if generation in generations:
                df = self.spark.read.schema("n long, _id string").parquet(f"{self.path}/{folder}").withColumn("_g", F.lit(generation))
                names = df if names is None else names.unionByName(df)
        return part if names is None else part.join(names, ["_g", "n"], "left").withColumn("id", F.coalesce("id", "_id"))

    def query_postings(self, terms: list[str]) -> DataFrame:
        """The postings of a query's terms."""
        return self.read("postings", list(terms))

    def fetch(self, ids: list[str], columns: tuple[str, ...] = schema.HIT) -> DataFrame:
        """The chunks of a few ids."""
        return self.read("chunks", list(ids)).select(*columns)

    def write(self, tables: dict[str, DataFrame], more: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None) -> int:
        """A new generation: ``tables`` in place of those of the same names, ``more`` beside what they have, without the older rows
        whose column (id or file_path) is in ``gone`` (a column ``key``). Returns its number."""
        now = self.pointer()
        # Not from the pointer alone: what a write that died has left is never written over.
        at_generation = 1 + max([0, *(int(m[1]) for n in self._names() if (m := _NAMES.fullmatch(n)))])
        folder = f"gen-{at_generation}"

        parts_of = {**tables, **(more or {})}
        # Without the documents of the postings each posting keeps its id.
        short = "postings" in parts_of and "docs" in parts_of
        shared: list[int] = []
        few = False
        if short:
            few = "postings" in (more or {}) and len(parts_of["docs"].head(FEW + 1)) <= FEW
            docs = parts_of["docs"].select(number(F.col("id").cast("string")).alias("n"), F.col("id").cast("string").alias("_id"))
            shared = [r["n"] for r in docs.groupBy("n").count().where("count > 1").collect()]  # of 10^7 ids, none but once in 10^5 times
            docs = docs.where(~F.col("n").isin(shared)) if shared else docs

        def put(name: str, df: DataFrame) -> None:
            out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _SCHEMAS[name].fields])
            at = f"{self.path}/{folder}/{name}"
            if name == "postings":
                out = out.withColumn("n", number(F.col("id")))
                if shared:
                    out = out.withColumn("id", F.when(F.col("n").isin(shared), F.col("id")))
                elif short:
                    out = out.drop("id")  # read as nulls
            if name in _FOLDERS:
                by, column, n = _FOLDERS[name]
                out = out.withColumn(by, F.pmod(F.crc32(column), F.lit(n)).cast("int"))
                parts = 1 + int(self.spark.conf.get("spark.sql.shuffle.partitions")) // n if name in tables else 1
                # Sorted, so that row groups are skipped by their least and largest; a document's rows of a bucket stay together.
                own = "n" if name == "postings" else "id"
                if few and name == "postings":
                    # One file, which has the bucket as a column, instead of one for nearly each term.
                    out.repartition(1).sortWithinPartitions(by, column, own).write.option("compression", "zstd").parquet(at)
                    return
                spread = out.repartition(F.col(by), F.pmod(F.xxhash64(own), F.lit(parts)))
                spread.sortWithinPartitions(by, column, own).write.option("compression", "zstd").partitionBy(by).parquet(at)
            else:
                out.write.option("compression", "zstd").parquet(at)

        old = {c: list(x) for c, x in now["gone"].items()}
        # The chunks come first, so that their shuffle's files are gone when the postings' come; the others don't wait for each other.
        if "chunks" in parts_of:
            put("chunks", parts_of["chunks"])
            release(self.spark)
        with ThreadPoolExecutor(4) as pool:
            jobs = [pool.submit(put, name, df) for name, df in parts_of.items() if name != "chunks"]
            if short:
                jobs.append(pool.submit(docs.write.option("compression", "zstd").parquet, f"{self.path}/{folder}/names"))
            for column, df in (gone or {}).items():
                jobs.append(pool.submit(df.select(F.col("key").cast("string")).write.parquet, f"{self.path}/{folder}/gone-{column}"))
                old.setdefault(column, []).append([at_generation, f"{folder}/gone-{column}"])
            for job in jobs:
                job.result()
        named = now["tables"] | {n: [[at_generation, f"{folder}/{n}"]] for n in tables}
        for n in more or {}:
            named[n] = [*named.get(n, []), [at_generation, f"{folder}/{n}"]]
        if "postings" in parts_of:
            named["names"] = [*(named.get("names", []) if "postings" not in tables else []), *([[at_generation, f"{folder}/names"]] if short else [])]
        # What is gone matters to older segments alone.
        first = {c: min((g for n, k in _KEYS.items() if k == c for g, _ in named.get(n, [])), default=at_generation) for c in old}
        old = {c: kept for c, x in old.items() if (kept := [[g, f] for g, f in x if g > first[c]])}
        self._point({"generation": at_generation, "tables": named, "gone": old})
        return at_generation

    def _point(self, pointer: dict) -> None:
        name = f"pointer-{pointer['generation']:012d}.json"
        at = self._p(f".{name}.new")
        stream = self._fs.create(at, True)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        if self._fs.exists(self._p(name)) or not self._fs.rename(at, self._p(name)):
            raise IndexingError(f"another write has made generation {pointer['generation']} of {self.path}")

    def compact(self, most: int = SEGMENTS) -> bool:
        """Write tables of more than ``most`` segments as one; True if there were any."""
        now = self.pointer()
        many = [n for n, s in now["tables"].items() if len(s) > most and n != "names"]
        if {"postings", "docs"} & {*many}:  # they are written together, as postings get their names from the documents
            many = [*{*many} | {"postings", "docs"} & {*now["tables"]}]
        if many:
            self.write({n: self.read(n) for n in many})
        return bool(many)

    def vacuum(self, keep: int = 1) -> int:
        """Remove pointers but the newest ``keep``, and generations that none of those names; returns how many generations."""
        names = self._names()
        pointers = sorted((int(m[1]), n) for n in names if n.startswith("pointer-") and (m := _NAMES.fullmatch(n)))
        now = self.pointer()
        used = set()
        for generation, name in pointers:
            if generation == now["generation"] or generation in {g for g, _ in pointers[-keep:]}:
                try:
                    used |= set(re.findall(r"gen-\d+", self._text(name)))
                except Py4JJavaError:
                    continue
            else:
                remove(self.spark, f"{self.path}/{name}")
        gone = [n for n in names if n.startswith("gen-") and n not in used]
        for g in gone:
            remove(self.spark, f"{self.path}/{g}")
        return len(gone)

    def size_bytes(self) -> int:
        """Of the current generation's segments."""
        now = self.pointer()
        return sum(self._fs.getContentSummary(self._p(folder)).getLength() for part in (now["tables"], now["gone"]) for segments in part.values() for _, folder in segments)

    def check_vectors(self, chunks: DataFrame) -> DataFrame:
        """``chunks``, made to fail on a row without a vector."""
        ok = F.col("vector").isNotNull() & (F.size("vector") > 0)
        return chunks.withColumn("vector", F.when(ok, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("no vector for "), F.col("id"))).cast("array<float>")))

    def keyword_tables(self, chunks: DataFrame, table: Callable[[DataFrame, str], DataFrame] = materialise) -> dict[str, DataFrame]:
        """Postings, lengths and sums of ``chunks``, whose ids differ, as a bootstrap from stored chunks makes them. ``table`` writes the lengths, a narrow table."""
        made = bm25.counted(chunks, unique=True)
        docs = table(made.select("id", "dl"), "lengths")
        return {"postings": bm25.unfold(made, "dl"), "docs": docs, "stats": bm25.corpus_stats(docs)}


def language_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.where("language != ''").groupBy("language").agg(F.count("*").alias("n"))


def counts_by_term(terms: list[str]) -> Counter:
    return Counter(terms)
