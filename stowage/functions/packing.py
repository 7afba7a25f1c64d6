"""Packed columns: envelope structs around one raw or zstd payload a value.

Metadata reads are plain struct leaves, so that Parquet reads nothing else. The kernels that touch
payloads are Arrow functions; a value is decoded once a kernel, by wrapping results in a bound variable
and marking readers nondeterministic (Catalyst would evaluate a deterministic one again in a filter).
"""

from __future__ import annotations

import functools
import uuid

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from stowage import jsonvalue
from stowage.codec import KIND_NAMES, KINDS, MAGIC, Codec, PackedError, Stored
from stowage.policy import DEFAULT, LEVELS, Policy, PolicyError
from stowage.registry import Registry

LEAVES = Stored._fields
KERNEL_TYPE = "struct<rawlen:int,level:tinyint,kind:tinyint,codec:tinyint,format:tinyint,magic:int,dict_id:bigint,stored_bytes:int,payload:binary>"
PACKED_TYPE = KERNEL_TYPE[:-1] + ",guard:variant>"
_ARROW = pa.struct([("rawlen", pa.int32()), ("level", pa.int8()), ("kind", pa.int8()), ("codec", pa.int8()), ("format", pa.int8()), ("magic", pa.int32()), ("dict_id", pa.int64()), ("stored_bytes", pa.int32()), ("payload", pa.binary())])

_codecs: dict[str, Codec] = {}


class CacheStats:
    """Sums over all workers of what their codecs did: dictionary loads and evictions, hits and misses of
    the decode cache, values encoded. A task that is run again counts again, as Spark's accumulators do."""

    NAMES = ("loads", "evictions", "hits", "misses", "encodes")

    def __init__(self, spark: SparkSession):
        self.sums = {n: spark.sparkContext.accumulator(0) for n in self.NAMES}

    def values(self) -> dict[str, int]:
        return {n: a.value for n, a in self.sums.items()}

    def add(self, counters) -> None:
        for n, a in self.sums.items():
            a.add(getattr(counters, n))
            setattr(counters, n, 0)


class Dictionaries:
    """A snapshot of a registry for the executors; an action sees one snapshot throughout. With ``stats``
    the workers report what their caches did."""

    def __init__(self, registry: Registry | None = None, ids: set[int] | None = None, stats: CacheStats | None = None):
        held = registry.snapshot(ids) if registry is not None else {}
        self.token = uuid.uuid4().hex if held or stats else ""
        self.stats = stats
        self.sent = SparkSession.active().sparkContext.broadcast(held) if held else None

    def codec(self) -> Codec:
        """This worker's codec; a worker keeps those of the last few snapshots."""
        if self.token not in _codecs:
            while len(_codecs) >= 4:
                del _codecs[next(iter(_codecs))]
            _codecs[self.token] = Codec(self.sent.value if self.sent is not None else {})
        return _codecs[self.token]


def counted(held: Dictionaries):
    """Makes a kernel report its caches after each batch, if anyone asked."""

    def around(kernel):
        if held.stats is None:
            return kernel

        @functools.wraps(kernel)
        def run(*arrays: pa.Array) -> pa.Array:
            out = kernel(*arrays)
            held.stats.add(held.codec().counters)
            return out

        return run

    return around


def _dictionaries(source: Registry | Dictionaries | None, ids: set[int] | None = None) -> Dictionaries:
    """The snapshot to use: as long as a registry holds the same dictionaries, all columns share one broadcast."""
    if source is None or isinstance(source, Dictionaries):
        return source or Dictionaries()
    key = tuple(e.dict_id for e in source.entries() if ids is None or e.dict_id in ids)
    if key not in source.sent:
        made = Dictionaries(source, ids)
        while len(source.sent) >= 4:
            del source.sent[next(iter(source.sent))]
        source.sent[key] = made
    return source.sent[key]


def _kind(name: str) -> int:
    if name not in KINDS:
        raise PolicyError(f"a packed column is text, json or bytes, not {name!r}")
    return KINDS[name]


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def leaves(c: Column | str) -> list[Column]:
    return [as_column(c)[name] for name in LEAVES]


def stored_rows(arrays: tuple[pa.Array, ...]) -> list[Stored | None]:
    """The values of the leaf arrays; a value whose payload and header are all null is null."""
    return [None if all(x is None for x in v) else Stored(*v) for v in zip(*(a.to_pylist() for a in arrays), strict=True)]


def packed_array(rows: list[Stored | None]) -> pa.Array:
    columns = [pa.array([None if r is None else r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)]
    return pa.StructArray.from_arrays(columns, fields=list(_ARROW), mask=pa.array([r is None for r in rows], pa.bool_()))


def guarded(kernel: Column) -> Column:
    """The envelope with its always-null guard, which keeps the analyzer from ordering or comparing it."""
    build = lambda x: F.when(x.isNotNull(), F.struct(*[x[n].alias(n) for n in LEAVES], F.lit(None).cast("variant").alias("guard")))
    return F.element_at(F.transform(F.array(kernel), build), 1)


def logical_bytes(kind: int, value) -> bytes:
    if kind == KINDS["bytes"]:
        return bytes(value)
    return (jsonvalue.canonical(value) if kind == KINDS["json"] else value).encode()


def _target(policy: Policy | str | None, registry: Registry | None, strict: bool = False) -> tuple[Policy, int]:
    if isinstance(policy, str):
        policy = Policy.parse(policy, registry.slot if registry is not None else None)
    policy = policy or DEFAULT
    if not policy.slot:
        return policy, 0
    if registry is None:
        raise PolicyError(f"policy {policy} needs a registry")
    return policy, registry.resolve(policy.slot, missing_ok=not strict)


def _pack(c: Column | str, kind_name: str, policy: Policy | str | None, registry: Registry | None, soft: bool) -> Column:
    kind = _kind(kind_name)
    policy, dict_id = _target(policy, registry)
    held = _dictionaries(registry, {dict_id}) if dict_id else Dictionaries()
    level = policy.level

    def rows(values: pa.Array) -> tuple[list[Stored | None], list[str | None]]:
        codec, out, problems = held.codec(), [], []
        for value in values.to_pylist():
            problem = made = None
            if value is not None:
                try:
                    made = codec.encode(kind, logical_bytes(kind, value), level, dict_id)
                except (PackedError, jsonvalue.JsonError) as error:
                    if not soft:
                        raise
                    problem = str(error)
            out.append(made)
            problems.append(problem)
        return out, problems

    if soft:

        @F.arrow_udf(f"struct<value:{KERNEL_TYPE},problem:string>")
        def kernel(values: pa.Array) -> pa.Array:
            made, problems = rows(values)
            return pa.StructArray.from_arrays([packed_array(made), pa.array(problems, pa.string())], names=["value", "problem"])

        build = lambda x: F.struct(guarded(x["value"]).alias("value"), x["problem"].alias("problem"))
        return F.element_at(F.transform(F.array(kernel(as_column(c))), build), 1)

    @F.arrow_udf(KERNEL_TYPE)
    def kernel(values: pa.Array) -> pa.Array:
        return packed_array(rows(values)[0])

    return guarded(kernel(as_column(c)))


def named(c: Column, name: str, kind: str, policy: Policy | None) -> Column:
    """The column under a name, with its policy as field metadata."""
    held = policy.metadata(kind) if policy else {"packed": {"kind": kind, "level": None, "slot": 0, "pending": False}}
    return c.alias(name, metadata=held)


def pack_text(c, policy=None, registry=None) -> Column:
    return _pack(c, "text", policy, registry, False)


def pack_json(c, policy=None, registry=None) -> Column:
    return _pack(c, "json", policy, registry, False)


def pack_bytes(c, policy=None, registry=None) -> Column:
    return _pack(c, "bytes", policy, registry, False)


def try_pack_text(c, policy=None, registry=None) -> Column:
    """struct<value, problem>: a value that can't be packed is null and has its problem beside it."""
    return _pack(c, "text", policy, registry, True)


def try_pack_json(c, policy=None, registry=None) -> Column:
    return _pack(c, "json", policy, registry, True)


def try_pack_bytes(c, policy=None, registry=None) -> Column:
    return _pack(c, "bytes", policy, registry, True)


def unpack(c, kind: str = "text", registry: Registry | Dictionaries | None = None) -> Column:
    """The logical value; raises on a value that fails any check."""
    number, held = _kind(kind), _dictionaries(registry)

    @F.arrow_udf("binary" if kind == "bytes" else "string")
    @counted(held)
    def read(*arrays: pa.Array) -> pa.Array:
        codec = held.codec()
        out = [None if v is None else codec.decode(v, number) for v in stored_rows(arrays)]
        return pa.array(out, pa.binary()) if kind == "bytes" else pa.array([None if x is None else x.decode() for x in out], pa.string())

    return read.asNondeterministic()(*leaves(c))


def raw_length(c) -> Column:
    """Bytes of the logical value, from the header."""
    return as_column(c)["rawlen"]


def stored_bytes(c) -> Column:
    return as_column(c)["stored_bytes"]


def dictionary_id_of(c) -> Column:
    """The dictionary ID of a frame; null where the value is raw or its frame names none."""
    return F.nullif(as_column(c)["dict_id"], F.lit(0).cast("long"))


def kind_name(c) -> Column:
    out = F.lit(None).cast("string")
    for number, name in KIND_NAMES.items():
        out = F.when(as_column(c)["kind"] == number, name).otherwise(out)
    return out


def header_problem(c, kind: str) -> Column:
    """What is wrong with the header, from the leaves alone; null if nothing."""
    c, number = as_column(c), _kind(kind)
    bad = (c["kind"] != number) | ~c["codec"].isin(0, 1) | (c["rawlen"] < 0) | ~c["level"].between(1, 22)
    wrong_format = c["format"] != (1 if kind == "json" else 0)
    message = F.concat(F.lit("unsupported JSON payload format "), c["format"].cast("string")) if kind == "json" else F.lit("invalid value header")
    return F.when(c["magic"] != MAGIC, "invalid or unsupported storage format").when(bad, "invalid value header").when(wrong_format, message)


def prefix(c, n: int, registry: Registry | Dictionaries | None = None) -> Column:
    """The first n bytes of a packed text, cut back to whole characters."""
    held = _dictionaries(registry)

    @F.arrow_udf("string")
    @counted(held)
    def read(*arrays: pa.Array) -> pa.Array:
        codec = held.codec()
        return pa.array([None if v is None else codec.prefix(v, n) for v in stored_rows(arrays)], pa.string())

    return read.asNondeterministic()(*leaves(c))


def validate(c, kind: str, registry: Registry | Dictionaries | None = None) -> Column:
    """Null if unpack would read the value, else the message that it would raise. Never raises."""
    number, held = _kind(kind), _dictionaries(registry)

    @F.arrow_udf("string")
    @counted(held)
    def check(*arrays: pa.Array) -> pa.Array:
        codec = held.codec()
        return pa.array([None if v is None else codec.validate(v, number) for v in stored_rows(arrays)], pa.string())

    return check.asNondeterministic()(*leaves(c))


def matches_policy(c, level: int, slot: int = 0, registry: Registry | None = None) -> Column:
    """Whether a value is stored as a policy asks: its level, and, unless raw, its dictionary."""
    if level not in LEVELS:
        raise PolicyError(f"level {level} is outside 1..22")
    c = as_column(c)
    wanted = registry.resolve(slot) if slot and registry is not None else 0
    if slot and not wanted:
        raise PolicyError(f"slot {slot} needs a registry")
    return (c["level"] == level) & ((c["codec"] == 0) | (c["dict_id"] == wanted))


def _rewritten(c: Column, rows_to_do: Column, trust_kind: str | None, policy: Policy, dict_id: int, held: Dictionaries) -> Column:
    level, number = policy.level, None if trust_kind is None else _kind(trust_kind)

    @F.arrow_udf(KERNEL_TYPE)
    @counted(held)
    def kernel(*arrays: pa.Array) -> pa.Array:
        codec = held.codec()
        return packed_array([None if v is None else codec.encode(v.kind, codec.decode(v, number), level, dict_id) for v in stored_rows(arrays)])

    # Rows that stay as they are reach the kernel as nulls.
    return guarded(kernel(*[F.when(rows_to_do, leaf) for leaf in leaves(c)]))


def coerce(c, policy: Policy | str | None, registry: Registry | None = None) -> Column:
    """The value under a policy: unchanged if it is stored so, else decoded and encoded once. No policy (a
    bare column) changes nothing. A raw value of 64 bytes or more is encoded anew where a dictionary is
    asked for, which might shorten it."""
    if policy is None or policy == "":
        return as_column(c)
    c = as_column(c)
    policy, dict_id = _target(policy, registry)
    stays = (c["level"] == policy.level) & F.when(c["codec"] == 1, c["dict_id"] == dict_id).otherwise(F.lit(dict_id == 0) | (c["rawlen"] < 64))
    made = _rewritten(c, c.isNotNull() & ~stays, None, policy, dict_id, _dictionaries(registry))
    return F.when(stays, c).otherwise(made)


def recompress(c, level: int = 6, slot: int = 0, registry: Registry | None = None) -> Column:
    """Decodes and encodes every value; a slot that is not registered is an error."""
    policy, dict_id = _target(Policy(level, slot), registry, strict=True)
    return _rewritten(as_column(c), as_column(c).isNotNull(), None, policy, dict_id, _dictionaries(registry))


def frame(c, portable: bool = False, registry: Registry | Dictionaries | None = None) -> Column:
    """One zstd frame a value of a packed text or bytes column: the stored frame as it is, raw values at
    level 1; ``portable`` encodes frames that name a dictionary anew without one."""
    c, held = as_column(c), _dictionaries(registry)
    passes = (c["codec"] == 1) & ((c["dict_id"] == 0) if portable else F.lit(True))
    refused = F.when(c["kind"] == KINDS["json"], F.raise_error(F.lit("packed JSON has no frame output")).cast("binary"))

    @F.arrow_udf("binary")
    def kernel(*arrays: pa.Array) -> pa.Array:
        codec = held.codec()
        return pa.array([None if v is None else codec.frame(codec.decode(v, None), 1) for v in stored_rows(arrays)], pa.binary())

    made = kernel(*[F.when(~passes, leaf) for leaf in leaves(c)])
    return refused.when(passes, c["payload"]).otherwise(made)


def frame_of(c, level: int = 1) -> Column:
    """One dictionary-free frame of a plain text or binary value, even of an empty one."""
    if level not in LEVELS:
        raise PolicyError(f"level {level} is outside 1..22")

    @F.arrow_udf("binary")
    def kernel(values: pa.Array) -> pa.Array:
        codec = Codec({})
        return pa.array([None if v is None else codec.frame(v, level) for v in values.cast(pa.binary()).to_pylist()], pa.binary())

    return kernel(as_column(c).cast("binary"))


def read_frame(c, registry: Registry | Dictionaries | None = None) -> Column:
    """The bytes of a column of zstd frames."""
    held = _dictionaries(registry)

    @F.arrow_udf("binary")
    def kernel(values: pa.Array) -> pa.Array:
        import zstandard

        codec, out = held.codec(), []
        for v in values.to_pylist():
            if v is not None:
                number = zstandard.get_frame_parameters(v).dict_id
                v = zstandard.ZstdDecompressor(dict_data=codec.dictionary(number) if number else None).decompress(v)
            out.append(v)
        return pa.array(out, pa.binary())

    return kernel(as_column(c))


def equality_key(c, kind: str = "text", registry: Registry | Dictionaries | None = None) -> Column:
    """What to group, join and hash by: the logical text or bytes; of JSON, a text that is the same for
    equal documents, whatever the order of keys and the scale of numbers."""
    if kind != "json":
        return unpack(c, kind, registry)
    held = _dictionaries(registry)

    @F.arrow_udf("string")
    @counted(held)
    def read(*arrays: pa.Array) -> pa.Array:
        codec = held.codec()
        return pa.array([None if v is None else jsonvalue.equality_key(jsonvalue.parse(codec.decode(v, KINDS["json"]).decode())) for v in stored_rows(arrays)], pa.string())

    return read.asNondeterministic()(*leaves(c))


def packed_eq(a, b, kind: str = "text", registry: Registry | Dictionaries | None = None) -> Column:
    """Equality of logical values. Equal stored bytes are equal, and texts or bytes of different raw
    lengths are not; neither looks at the payload. All else is decoded, and raises as unpack does."""
    number, held = _kind(kind), _dictionaries(registry)

    @F.arrow_udf("boolean")
    @counted(held)
    def same(*arrays: pa.Array) -> pa.Array:
        codec, out = held.codec(), []
        for x, y in zip(stored_rows(arrays[: len(LEAVES)]), stored_rows(arrays[len(LEAVES) :]), strict=True):
            if x is None or y is None:
                out.append(None)
            elif x == y:
                out.append(True)
            elif number != KINDS["json"] and x.rawlen != y.rawlen:
                out.append(False)
            else:
                p, q = codec.decode(x, number), codec.decode(y, number)
                out.append(p == q or number == KINDS["json"] and jsonvalue.equality_key(jsonvalue.parse(p.decode())) == jsonvalue.equality_key(jsonvalue.parse(q.decode())))
        return pa.array(out, pa.bool_())

    return same.asNondeterministic()(*leaves(a), *leaves(b))


def packed_ne(a, b, kind: str = "text", registry: Registry | Dictionaries | None = None) -> Column:
    return ~packed_eq(a, b, kind, registry)


def packed_hash(c, kind: str = "text", registry: Registry | Dictionaries | None = None, seed: int | None = None) -> Column:
    """The hash of the logical value: that of the same value in a plain column."""
    key = equality_key(c, kind, registry)
    return F.xxhash64(key) if seed is None else F.xxhash64(F.lit(seed).cast("long"), key)
