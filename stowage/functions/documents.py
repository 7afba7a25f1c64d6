"""Reading operators of packed JSON. Each decodes and parses a value once; json_extract answers many
questions from one decode. A null value, key or path gives null."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage import jsonpath, jsonvalue
from stowage.codec import KINDS
from stowage.functions.packing import LEAVES, Dictionaries, _dictionaries, leaves, stored_rows
from stowage.registry import Registry

Source = Registry | Dictionaries | None


_batch: list[Any] = [None, None]  # the last batch's payloads, and its values


def _parsed(codec, arrays: tuple[pa.Array, ...]) -> list[Any]:
    """The values of a batch. Several readers of one column get the same buffers, one after another, so
    the last batch is kept: it is decoded and parsed once for all of them."""
    payload = arrays[LEAVES.index("payload")]
    held, values = _batch
    if held is not None and payload.buffers()[1] is not None and held[0] is codec and held[1].buffers()[1].address == payload.buffers()[1].address and held[1].offset == payload.offset and len(held[1]) == len(payload):
        return values
    values = [jsonvalue.MISSING if v is None else jsonvalue.parse(codec.decode(v, KINDS["json"]).decode()) for v in stored_rows(arrays)]
    if len(payload) and payload.buffers()[1] is not None:
        _batch[:] = [(codec, payload), values]  # holding the array keeps its address from being used again
    return values


def _reader(returns: str, answer: Callable[[Any, Any], Any], c, source: Source, argument: Any, prepare: Callable[[Any], Any] = lambda x: x) -> Column:
    """``argument``: a column, or a constant, which ``prepare`` reads once a batch instead of once a row."""
    held = _dictionaries(source)
    kind = {"string": pa.string(), "boolean": pa.bool_()}[returns]
    by_row = isinstance(argument, Column)
    constant = None if by_row else [None if x is None else str(x) for x in argument] if isinstance(argument, list) else argument

    @F.arrow_udf(returns)
    def read(*arrays: pa.Array) -> pa.Array:
        values = _parsed(held.codec(), arrays[: len(LEAVES)])
        if by_row:
            given = [None if x is None else prepare(x) for x in arrays[-1].to_pylist()]
            out = [None if v is jsonvalue.MISSING or x is None else answer(v, x) for v, x in zip(values, given, strict=True)]
        elif constant is None:
            out = [None] * len(values)
        else:
            ready = prepare(constant)
            out = [None if v is jsonvalue.MISSING else answer(v, ready) for v in values]
        return pa.array(out, kind)

    return read.asNondeterministic()(*leaves(c), *([argument] if by_row else []))


def json_field(c, key, registry: Source = None) -> Column:
    """``->`` by key: canonical JSON; JSON null stays 'null', a missing key is null."""
    return _reader("string", lambda v, k: jsonvalue.as_json(jsonvalue.field(v, k)), c, registry, key)


def json_field_text(c, key, registry: Source = None) -> Column:
    """``->>`` by key: text; JSON null is null."""
    return _reader("string", lambda v, k: jsonvalue.as_text(jsonvalue.field(v, k)), c, registry, key)


def json_element(c, index, registry: Source = None) -> Column:
    """``->`` by position; negative positions count from the end."""
    return _reader("string", lambda v, i: jsonvalue.as_json(jsonvalue.element(v, i)), c, registry, index)


def json_element_text(c, index, registry: Source = None) -> Column:
    return _reader("string", lambda v, i: jsonvalue.as_text(jsonvalue.element(v, i)), c, registry, index)


def json_path(c, path, registry: Source = None) -> Column:
    """``#>``: a path of keys and positions."""
    return _reader("string", lambda v, p: jsonvalue.as_json(jsonvalue.at_path(v, p)), c, registry, path)


def json_path_text(c, path, registry: Source = None) -> Column:
    return _reader("string", lambda v, p: jsonvalue.as_text(jsonvalue.at_path(v, p)), c, registry, path)


def json_has(c, key, registry: Source = None) -> Column:
    """``?``: the object has the key, or the array the string."""
    return _reader("boolean", jsonvalue.has, c, registry, key)


def json_has_any(c, keys, registry: Source = None) -> Column:
    return _reader("boolean", lambda v, ks: any(jsonvalue.has(v, k) for k in ks if k is not None), c, registry, keys)


def json_has_all(c, keys, registry: Source = None) -> Column:
    return _reader("boolean", lambda v, ks: all(jsonvalue.has(v, k) for k in ks if k is not None), c, registry, keys)


def _document(text: str) -> tuple[Any]:
    return (jsonvalue.parse(text),)  # in a tuple, as a JSON null is a document too


def json_contains(c, document, registry: Source = None) -> Column:
    """``@>``: the packed document holds the given one (JSON text)."""
    return _reader("boolean", lambda v, d: jsonvalue.contains(v, d[0]), c, registry, document, _document)


def json_contained(c, document, registry: Source = None) -> Column:
    """``<@``: the given document (JSON text) holds the packed one."""
    return _reader("boolean", lambda v, d: jsonvalue.contains(d[0], v), c, registry, document, _document)


def jsonpath_exists(c, path, registry: Source = None) -> Column:
    """``@?``: the path finds something; null where it fails on the value."""
    return _reader("boolean", jsonpath.exists, c, registry, path)


def jsonpath_match(c, path, registry: Source = None) -> Column:
    """``@@``: the answer of a path predicate; null where it has none."""
    return _reader("boolean", jsonpath.match, c, registry, path)


def json_extract(c, paths: dict[str, list[str]], registry: Source = None) -> Column:
    """A struct of texts, one a path, from one decode a value."""
    held, names = _dictionaries(registry), list(paths)
    schema = "struct<" + ",".join(f"`{n}`:string" for n in names) + ">"

    @F.arrow_udf(schema)
    def read(*arrays: pa.Array) -> pa.Array:
        columns = [[] for _ in names]
        for value in _parsed(held.codec(), arrays):
            for out, name in zip(columns, names, strict=True):
                out.append(None if value is jsonvalue.MISSING else jsonvalue.as_text(jsonvalue.at_path(value, paths[name])))
        return pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in columns], names=names)

    return read.asNondeterministic()(*leaves(c))


def with_extracted(df: DataFrame, column: str, paths: dict[str, list[str]], registry: Source = None) -> DataFrame:
    """``df`` with plain text columns of paths of a packed document. Written with it, they take the place
    of an index on an expression: Parquet prunes by their statistics and reads no payload."""
    made = df.withColumn("__extracted", json_extract(df[column], paths, registry))
    return made.withColumns({name: F.col("__extracted")[name] for name in paths}).drop("__extracted")
