"""The functions in SQL: header reads as SQL functions (Catalyst inlines them), kernels as Arrow UDFs."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stowage import jsonpath, jsonvalue
from stowage.codec import DICTIONARY_MAX, FLOOR, JSON_FORMAT, KINDS, MAGIC, Stored
from stowage.functions.packing import KERNEL_TYPE, LEAVES, PACKED_TYPE, Dictionaries, logical_bytes, packed_array
from stowage.registry import Registry

HEADERS = {
    "raw_length": ("INT", "c.rawlen"),
    "packed_stored_bytes": ("INT", "c.stored_bytes"),
    "packed_dictionary_id": ("BIGINT", "nullif(c.dict_id, 0L)"),
    "packed_level": ("INT", "int(c.level)"),
}


def build_info() -> dict:
    """What writes and reads values here."""
    return {"library": "stowage", "magic": f"{MAGIC:#x}", "json_format": JSON_FORMAT, "zstd_version": ".".join(map(str, zstandard.ZSTD_VERSION)), "raw_floor": FLOOR, "dictionary_max": DICTIONARY_MAX}


def register(spark: SparkSession, registry: Registry | None = None) -> list[str]:
    """Registers the functions for SQL and gives their names. Packed arguments are envelope structs."""
    for name, (returns, body) in HEADERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(c {PACKED_TYPE.upper().replace(':', ': ')}) RETURNS {returns} RETURN {body}")
    held, names = Dictionaries(registry), list(HEADERS)

    def rows(packed: pa.Array) -> list[Stored | None]:
        fields = [packed.field(packed.type.get_field_index(n)).to_pylist() for n in LEAVES]
        return [None if not ok else Stored(*v) for ok, v in zip(packed.is_valid().to_pylist(), zip(*fields, strict=True), strict=True)]

    def put(name: str, udf) -> None:
        spark.udf.register(name, udf)
        names.append(name)

    def packer(kind: str):
        @F.arrow_udf(KERNEL_TYPE)
        def pack(values: pa.Array, levels: pa.Array) -> pa.Array:
            codec = held.codec()
            return packed_array([None if v is None or n is None else codec.encode(KINDS[kind], logical_bytes(KINDS[kind], v), n) for v, n in zip(values.to_pylist(), levels.to_pylist(), strict=True)])

        return pack

    def reader(kind: str):
        @F.arrow_udf("binary" if kind == "bytes" else "string")
        def unpack(packed: pa.Array) -> pa.Array:
            codec = held.codec()
            out = [None if v is None else codec.decode(v, KINDS[kind]) for v in rows(packed)]
            return pa.array(out, pa.binary()) if kind == "bytes" else pa.array([None if x is None else x.decode() for x in out], pa.string())

        return unpack.asNondeterministic()

    def checker(kind: str):
        @F.arrow_udf("string")
        def validate(packed: pa.Array) -> pa.Array:
            codec = held.codec()
            return pa.array([None if v is None else codec.validate(v, KINDS[kind]) for v in rows(packed)], pa.string())

        return validate

    for kind in KINDS:
        put(f"pack_{kind}", packer(kind))
        put(f"unpack_{kind}", reader(kind))
        put(f"validate_{kind}", checker(kind))

    def document(name: str, returns: str, answer) -> None:
        @F.arrow_udf(returns)
        def read(packed: pa.Array, given: pa.Array) -> pa.Array:
            codec, out = held.codec(), []
            for v, x in zip(rows(packed), given.to_pylist(), strict=True):
                out.append(None if v is None or x is None else answer(jsonvalue.parse(codec.decode(v, KINDS["json"]).decode()), x))
            return pa.array(out, pa.bool_() if returns == "boolean" else pa.string())

        put(name, read.asNondeterministic())

    slots = {0: 0} | ({e.slot: e.dict_id for e in registry.entries()} if registry is not None else {})

    def arrow(returns: str, kind: pa.DataType):
        """Registers a function of a row's values; any null gives null. Packed arguments come as Stored."""

        def add(work) -> None:
            @F.arrow_udf(returns)
            def run(*arrays: pa.Array) -> pa.Array:
                codec = held.codec()
                given = [rows(a) if pa.types.is_struct(a.type) else a.to_pylist() for a in arrays]
                out = [None if any(x is None for x in row) else work(codec, *row) for row in zip(*given, strict=True)]
                return packed_array(out) if returns == KERNEL_TYPE else pa.array(out, kind)

            put(work.__name__, run.asNondeterministic())

        return add

    @arrow("string", pa.string())
    def packed_prefix(codec, c, n):
        return codec.prefix(c, n)

    def rewritten(codec, c, level, slot):
        return codec.encode(c.kind, codec.decode(c, None), level, slots[slot])

    @arrow(KERNEL_TYPE, None)
    def recompress_packed(codec, c, level, slot):
        return rewritten(codec, c, level, slot)

    @arrow(KERNEL_TYPE, None)
    def coerce_packed(codec, c, level, slot):
        number = slots[slot]
        stays = c.level == level and (c.dict_id == number if c.codec else not number or c.rawlen < FLOOR)
        return c if stays else rewritten(codec, c, level, slot)

    @arrow("binary", pa.binary())
    def frame_packed(codec, c, portable):
        if c.kind == KINDS["json"]:
            raise ValueError("packed JSON has no frame output")
        return c.payload if c.codec and not (portable and c.dict_id) else codec.frame(codec.decode(c, None), 1)

    @arrow("binary", pa.binary())
    def frame_of(codec, value, level):
        return codec.frame(value, level)

    @arrow("binary", pa.binary())
    def read_frame(codec, frame):
        number = zstandard.get_frame_parameters(frame).dict_id
        return zstandard.ZstdDecompressor(dict_data=codec.dictionary(number) if number else None).decompress(frame)

    for kind in KINDS:

        def key(codec, c, kind=kind) -> bytes:
            value = codec.decode(c, KINDS[kind])
            return jsonvalue.equality_key(jsonvalue.parse(value.decode())).encode() if kind == "json" else value

        def pack_slot(codec, value, level, slot, kind=kind):
            return codec.encode(KINDS[kind], logical_bytes(KINDS[kind], value), level, slots[slot])

        def try_pack(codec, value, level, kind=kind):
            try:
                return codec.encode(KINDS[kind], logical_bytes(KINDS[kind], value), level)
            except ValueError:
                return None

        def eq(codec, a, b, key=key):
            return key(codec, a) == key(codec, b)

        def ne(codec, a, b, key=key):
            return key(codec, a) != key(codec, b)

        def hashed(codec, c, key=key):
            import xxhash

            return int.from_bytes(xxhash.xxh64_digest(key(codec, c), 42), "big", signed=True)  # as Spark's xxhash64

        for name, work, returns, made in (
            (f"pack_{kind}_slot", pack_slot, KERNEL_TYPE, None), (f"try_pack_{kind}", try_pack, KERNEL_TYPE, None), (f"packed_eq_{kind}", eq, "boolean", pa.bool_()),
            (f"packed_ne_{kind}", ne, "boolean", pa.bool_()), (f"packed_hash_{kind}", hashed, "bigint", pa.int64()),
        ):
            work.__name__ = name
            arrow(returns, made)(work)

    @arrow("boolean", pa.bool_())
    def packed_matches_policy(codec, c, level, slot):
        return c.level == level and (not c.codec or c.dict_id == slots[slot])

    numbers = {n: k for k, n in KINDS.items()}
    shown = [("kind", pa.string()), ("codec", pa.string()), ("level", pa.int32()), ("format", pa.int32()), ("raw_length", pa.int32()), ("stored_bytes", pa.int32()), ("dict_id", pa.int64())]

    @arrow("struct<kind:string,codec:string,level:int,format:int,raw_length:int,stored_bytes:int,dict_id:bigint>", pa.struct(shown))
    def inspect_packed(codec, c):
        return {"kind": numbers.get(c.kind), "codec": {0: "raw", 1: "zstd"}.get(c.codec), "level": c.level, "format": c.format, "raw_length": c.rawlen, "stored_bytes": c.stored_bytes, "dict_id": c.dict_id or None}

    document("json_has_any", "boolean", lambda v, keys: any(jsonvalue.has(v, k) for k in keys))
    document("json_has_all", "boolean", lambda v, keys: all(jsonvalue.has(v, k) for k in keys))
    document("json_field", "string", lambda v, k: jsonvalue.as_json(jsonvalue.field(v, k)))
    document("json_field_text", "string", lambda v, k: jsonvalue.as_text(jsonvalue.field(v, k)))
    document("json_element", "string", lambda v, i: jsonvalue.as_json(jsonvalue.element(v, i)))
    document("json_element_text", "string", lambda v, i: jsonvalue.as_text(jsonvalue.element(v, i)))
    document("json_path", "string", lambda v, p: jsonvalue.as_json(jsonvalue.at_path(v, p)))
    document("json_path_text", "string", lambda v, p: jsonvalue.as_text(jsonvalue.at_path(v, p)))
    document("json_has", "boolean", jsonvalue.has)
    document("json_contains", "boolean", lambda v, d: jsonvalue.contains(v, jsonvalue.parse(d)))
    document("json_contained", "boolean", lambda v, d: jsonvalue.contains(jsonvalue.parse(d), v))
    document("jsonpath_exists", "boolean", jsonpath.exists)
    document("jsonpath_match", "boolean", jsonpath.match)
    return names
