"""What the corpus operators share: durable tables, bounded filters, grouped streams, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.session import prepared, read_table, shared_dir

__all__ = ["LOWER", "UPPER", "Bits", "BoundedCache", "arrow_schema", "bits_of", "column", "components", "groups", "longs", "numbered", "per_text", "prepared", "read_table", "released", "unused", "without", "written"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, reread from Parquet in the shared folder: lineage ends there, and the loss of an
    executor costs nothing that was written. The folder goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stowage-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def released(work: Callable) -> Callable:
    """``work`` on a stream of batches; when the task ends, its worker, which goes on to other tasks, gives
    back the memory that Arrow and the allocator hold."""

    @functools.wraps(work)
    def run(stream):
        try:
            yield from work(stream)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, written with a number a row. Numbers made while reading would change with the splits of a
    scan, which depend on how many cores are there."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(array: pa.Array) -> np.ndarray:
    """An int64 column without nulls, as numpy."""
    return array.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def groups(stream: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys (long columns without nulls) of a sorted stream. Holds one run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in stream:
        if not batch.num_rows:
            continue
        cols = [longs(column(batch, k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        here = tuple(int(c[0]) for c in cols)
        change[0] = here != last
        cuts = np.flatnonzero(change)
        for i, at in enumerate(cuts):
            if i == 0 and at > 0:
                held.append(batch.slice(0, at))
            if held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, (cuts[i + 1] if i + 1 < len(cuts) else batch.num_rows) - at))
        if not len(cuts):
            held.append(batch)
        last = tuple(int(c[-1]) for c in cols)
    if held:
        yield pa.Table.from_batches(held)


class Bits:
    """A Bloom filter of ``2**log_bits`` bits with two probes. Its size is fixed, whatever the number of
    keys: a full one lets more rows through, which costs time and never a row."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        from stowage.llm.kernels import mix

        x = mix(keys.astype(np.int64, copy=False).view(np.uint64))
        y = mix(x + np.uint64(0x9E3779B97F4A7C15))
        return x & np.uint64(size * 64 - 1), y & np.uint64(size * 64 - 1)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.places(keys, len(self.words)):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


LEAST_BITS, MOST_BITS = 16, 27


def bits_of(df: DataFrame, key: str) -> Bits:
    """The filter of a long column without repeats, with some 16 bits a key, from 2**16 to 2**27 bits: the
    driver gets, and broadcasts, 16 MiB at most."""
    keys = df.select(key).where(F.col(key).isNotNull())
    size = 1 << (min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length())) - 6)

    def words(stream):
        for batch in stream:
            found = longs(column(batch, key))
            for p in Bits.places(found, size):
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    out = np.zeros(size, np.uint64)
    rows = keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return Bits(out)


def without(rows: DataFrame, number: str, gone: DataFrame, lost: str) -> DataFrame:
    """The rows whose number (a column of ``numbered``) is not in the column ``lost`` of ``gone``, a
    written table. Only rows that may be in it, by a filter of bounded size, are shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(bits_of(gone, lost))

    @F.arrow_udf("boolean")
    def hit(numbers: pa.Array) -> pa.Array:
        return pa.array(sent.value.hits(longs(numbers)))

    flag = unused(rows, "may_go")
    marked = rows.withColumn(flag, hit(F.col(number)))
    stay = marked.where(F.col(flag)).join(gone, F.col(number) == F.col(lost), "left_anti")
    return marked.where(~F.col(flag)).unionByName(stay).drop(flag)


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of the edges can reach, for all nodes but those
    that are it themselves, by alternating large and small stars. Each half step is a min by key and a join back, so that a hub's links are never
    gathered; each round is written, so that lineage stays short."""
    links = written(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    before = None
    while True:
        mark = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (mark["n"], mark["h"]) or not mark["n"]:
            break
        before = (mark["n"], mark["h"])
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links = written(small.where("u <> v").distinct(), name)
    return links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def per_text(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[list[str]], list[list]]]) -> DataFrame:
    """One row per row of ``df``: the id as doc_id and what ``make()`` gives for each whole text (null
    counts as empty). ``make`` runs once a task; its function gets texts and returns columns."""
    import pyspark.sql.types as T

    spark = prepared(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    out = T.StructType([T.StructField("doc_id", T.LongType()), *T._parse_datatype_string(schema).fields])
    arrow = arrow_schema(out)

    def run(stream):
        work = make()
        for batch in stream:
            texts = ["" if x is None else x for x in column(batch, "body").to_pylist()]
            made = work(texts)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), *(pa.array(x, f.type) for x, f in zip(made, list(arrow)[1:], strict=True))], schema=arrow)

    return source.mapInArrow(released(run), out)


class BoundedCache(dict):
    """A cache that forgets everything at ``most`` entries, so that any vocabulary fits in a worker."""

    def __init__(self, make: Callable, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
