"""Statistics of a packed column, and the report that says what a dictionary would save."""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.codec import KINDS, Codec, dictionary_id
from stowage.functions.packing import Dictionaries, _dictionaries, _pack, dictionary_id_of, equality_key, kind_name, logical_bytes
from stowage.policy import Policy
from stowage.registry import Registry, train_dictionary

WIDE = 1024  # longer values are not decoded; each counts as a distinct one
BUCKETS = (256, 1_024, 4_096, 16_384, 65_536)


def analyze_packed(df: DataFrame, column: str, kind: str = "text", registry: Registry | Dictionaries | None = None, most_common: int = 100) -> DataFrame:
    """One row (n_rows, null_fraction, average_width, n_distinct, distinct_fraction, n_most_common): the
    average stored bytes of values, and distinct values, as a negative fraction of the rows where they
    are more than a tenth. The most common values are those that repeat, at most ``most_common``."""
    held = _dictionaries(registry)
    c = df[column]
    header = df.agg(
        F.count("*").alias("n_rows"), F.count_if(F.isnull(c["rawlen"])).alias("nulls"), F.avg(c["stored_bytes"]).alias("average_width"), F.count_if(c["rawlen"] > WIDE).alias("wide")
    )
    narrow = df.where(c["rawlen"] <= WIDE).select(equality_key(c, kind, held).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    values = narrow.agg(F.count("*").alias("narrow"), F.least(F.count_if(F.col("n") > 1), F.lit(most_common)).alias("n_most_common"))
    both = header.crossJoin(F.broadcast(values))  # one row each
    distinct = F.col("wide") + F.col("narrow")
    share = distinct / F.greatest(F.col("n_rows"), F.lit(1))
    return both.select(
        "n_rows", (F.col("nulls") / F.greatest(F.col("n_rows"), F.lit(1))).alias("null_fraction"), "average_width", distinct.alias("n_distinct"),
        F.when(share > 0.1, -share).otherwise(distinct.cast("double")).alias("distinct_fraction"), "n_most_common",
    )


def most_common_values(df: DataFrame, column: str, kind: str = "text", registry: Registry | Dictionaries | None = None, most_common: int = 100, policy: Policy | str | None = None) -> DataFrame:
    """(value, n): the values of at most WIDE bytes that repeat, most common first. With a ``policy`` each
    is packed anew under it, whatever stored its rows (a JSON value from its equality key, which is equal)."""
    held = _dictionaries(registry)
    narrow = df.where(df[column]["rawlen"] <= WIDE).select(equality_key(df[column], kind, held).alias("value"))
    found = narrow.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "value").limit(most_common)
    if policy is None:
        return found
    return found.select(_pack(found["value"], kind, policy, registry if isinstance(registry, Registry) else None, False).alias("value"), "n")


def inspect_packed(df: DataFrame, column: str, registry: Registry) -> DataFrame:
    """``df`` with a struct ``inspected`` of the column's header; slot and name are null where no
    dictionary of the frame's id is registered. Reads no payload. The inventory has a row a dictionary
    (a few bytes each); up to 10,000 are broadcast, more are joined as Spark plans it."""
    inventory = registry.inventory().select(F.col("dict_id").alias("__id"), F.col("slot").alias("__slot"), F.col("name").alias("__name"))
    small = len(registry.entries()) <= 10_000
    out = df.join(F.broadcast(inventory) if small else inventory, dictionary_id_of(df[column]) == F.col("__id"), "left")
    c = df[column]
    fields = F.struct(
        kind_name(c).alias("kind"), F.when(c["codec"] == 0, "raw").when(c["codec"] == 1, "zstd").alias("codec"), c["level"].cast("int").alias("level"), c["format"].cast("int").alias("format"),
        c["rawlen"].alias("raw_length"), c["stored_bytes"].alias("stored_bytes"), dictionary_id_of(c).alias("dict_id"), F.col("__slot").alias("dict_slot"), F.col("__name").alias("dict_name"),
    )
    return out.withColumn("inspected", F.when(F.isnull(c["rawlen"]), F.lit(None)).otherwise(fields)).drop("__id", "__slot", "__name")


COSTS = ("pack_us", "pack_dictionary_us", "unpack_us", "unpack_dictionary_us")


def _cost(codec: Codec, code: int, raw: bytes, level: int, number: int) -> dict[str, float]:
    """Stored bytes and seconds of one value, without and with the dictionary."""
    began = time.perf_counter()
    plain = codec.encode(code, raw, level)
    packed_at = time.perf_counter()
    packed = codec.encode(code, raw, level, number)
    read_at = time.perf_counter()
    codec.decode(plain, code, cached=False)
    other_at = time.perf_counter()
    codec.decode(packed, code, cached=False)
    ended = time.perf_counter()
    seconds = (packed_at - began, read_at - packed_at, other_at - read_at, ended - other_at)
    return {"level": level, "plain": plain.stored_bytes, "packed": packed.stored_bytes, "raw": len(raw)} | {n: s * 1e6 for n, s in zip(COSTS, seconds, strict=True)}


def dictionary_report(df: DataFrame, column: str, kind: str = "text", levels: tuple[int, ...] = (1, 3, 6), dict_bytes: int = 112_640, every: int = 4, seed: int = 0, tail: str | None = None) -> DataFrame:
    """(level, bucket, n_values, raw_bytes, plain_bytes, dictionary_bytes, payback_values, and the mean
    microseconds a value of packing and unpacking without and with the dictionary): a dictionary is trained
    on the values whose hash modulo ``every`` is not 0, and the others are stored with and without it.
    ``tail``: a number or time to order by instead; the last of ``every`` parts (to a ten-thousandth of the
    rows) is held out, which shows how a dictionary ages; rows without it train.
    payback_values: how many values save as much as the dictionary has bytes; null if none."""
    if tail is None:
        held_out = F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(every)) == 0
    else:
        last = df.agg(F.percentile_approx(tail, 1 - 1 / every, 10_000)).first()[0]
        held_out = F.coalesce(F.col(tail) > F.lit(last), F.lit(False))
    data = train_dictionary(df.where(~F.coalesce(held_out, F.lit(False))).select(column), dict_bytes)
    sent = df.sparkSession.sparkContext.broadcast({dictionary_id(data): data})
    number, size, code = dictionary_id(data), len(data), KINDS[kind]

    fields = [("level", pa.int32()), ("plain", pa.int64()), ("packed", pa.int64()), ("raw", pa.int64()), *[(n, pa.float64()) for n in COSTS]]

    @F.arrow_udf("array<struct<level:int,plain:bigint,packed:bigint,raw:bigint," + ",".join(f"{n}:double" for n in COSTS) + ">>")
    def stored(values: pa.Array) -> pa.Array:
        codec, out = Codec(sent.value), []
        for v in values.to_pylist():
            made = None
            if v is not None:
                raw = logical_bytes(code, v)
                made = [_cost(codec, code, raw, n, number) for n in levels]
            out.append(made)
        return pa.array(out, pa.list_(pa.struct(fields)))

    rows = df.where(held_out).select(F.explode(stored(F.col(column))).alias("s")).select("s.*")
    bucket = F.lit(f">= {BUCKETS[-1]}")
    for b in reversed(BUCKETS):
        bucket = F.when(F.col("raw") < b, f"< {b}").otherwise(bucket)
    grouped = rows.withColumn("bucket", bucket).groupBy("level", "bucket").agg(F.count("*").alias("n_values"), F.sum("raw").alias("raw_bytes"), F.sum("plain").alias("plain_bytes"), F.sum("packed").alias("dictionary_bytes"), *[F.avg(n).alias(n) for n in COSTS])
    saved = (F.col("plain_bytes") - F.col("dictionary_bytes")) / F.col("n_values")
    return grouped.withColumn("payback_values", F.when(saved > 0, F.ceil(size / saved)))


def used_dictionaries(df: DataFrame, column: str) -> set[int]:
    """The dictionary ids that a column's frames name, from headers alone. There are no more than
    dictionaries in the registry."""
    return {r[0] for r in df.select(df[column]["dict_id"].alias("d")).where("d > 0").distinct().collect()}

