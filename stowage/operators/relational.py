"""Grouping, joins and set operations on packed columns: all by the logical value, whatever policy
stored it. A key column is projected once (one decode a row), and Catalyst plans the rest."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.packing import Dictionaries, _dictionaries, equality_key
from stowage.registry import Registry

Source = Registry | Dictionaries | None


class PackedRefusal(TypeError):
    """An operation that has no meaning on stored bytes."""


def with_keys(df: DataFrame, columns: dict[str, str], registry: Source = None) -> tuple[DataFrame, list[str]]:
    """``df`` with a key column for each packed column (name to kind). A JSON key is a canonical text."""
    held = _dictionaries(registry)
    names = [f"__key_{i}" for i in range(len(columns))]
    return df.withColumns({n: equality_key(df[c], kind, held) for n, (c, kind) in zip(names, columns.items(), strict=True)}), names


def group_packed(df: DataFrame, columns: dict[str, str], *aggregates: Column, registry: Source = None) -> DataFrame:
    """GROUP BY packed columns: one stored value represents each group."""
    keyed, names = with_keys(df, columns, registry)
    out = keyed.groupBy(*names).agg(*[F.first(c).alias(c) for c in columns], *aggregates)
    return out.drop(*names)


def distinct_packed(df: DataFrame, columns: dict[str, str], registry: Source = None) -> DataFrame:
    """DISTINCT rows of packed and plain columns."""
    keyed, names = with_keys(df, columns, registry)
    plain = [c for c in df.columns if c not in columns]
    return keyed.groupBy(*names, *plain).agg(*[F.first(c).alias(c) for c in columns]).select(*df.columns)


def union_packed(a: DataFrame, b: DataFrame, columns: dict[str, str], registry: Source = None) -> DataFrame:
    return distinct_packed(a.unionByName(b), columns, registry)


def _keyed_pair(a: DataFrame, b: DataFrame, columns: dict[str, str], registry: Source):
    held = _dictionaries(registry)
    left, names = with_keys(a, columns, held)
    right, _ = with_keys(b, columns, held)
    plain = [c for c in a.columns if c not in columns]
    right = right.select(*[F.col(n).alias(f"__r{n}") for n in names], *[F.col(c).alias(f"__r_{c}") for c in plain])
    same = [F.col(n).eqNullSafe(F.col(f"__r{n}")) for n in names] + [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in plain]
    return left, right, names, functools.reduce(lambda x, y: x & y, same)


def intersect_packed(a: DataFrame, b: DataFrame, columns: dict[str, str], registry: Source = None) -> DataFrame:
    left, right, names, same = _keyed_pair(a, b, columns, registry)
    plain = [c for c in a.columns if c not in columns]
    return left.join(right, same, "left_semi").groupBy(*names, *plain).agg(*[F.first(c).alias(c) for c in columns]).select(*a.columns)


def except_packed(a: DataFrame, b: DataFrame, columns: dict[str, str], registry: Source = None) -> DataFrame:
    left, right, names, same = _keyed_pair(a, b, columns, registry)
    plain = [c for c in a.columns if c not in columns]
    return left.join(right, same, "left_anti").groupBy(*names, *plain).agg(*[F.first(c).alias(c) for c in columns]).select(*a.columns)


def join_packed(a: DataFrame, b: DataFrame, left: str, right: str, kind: str = "text", how: str = "inner", registry: Source = None) -> DataFrame:
    """An equi-join of two packed columns; Spark chooses broadcast, hash or merge join for the key."""
    held = _dictionaries(registry)
    x = a.withColumn("__left_key", equality_key(a[left], kind, held))
    y = b.withColumn("__right_key", equality_key(b[right], kind, held))
    return x.join(y, F.col("__left_key") == F.col("__right_key"), how).drop("__left_key", "__right_key")


def in_packed(df: DataFrame, column: str, values: list, kind: str = "text", registry: Source = None) -> DataFrame:
    """The rows whose value is one of a list (JSON values as text)."""
    from stowage import jsonvalue

    wanted = [jsonvalue.equality_key(jsonvalue.parse(v)) for v in values] if kind == "json" else values
    keyed, (name,) = with_keys(df, {column: kind}, registry)
    return keyed.where(F.col(name).isin(wanted)).drop(name)


def sort_unpacked(df: DataFrame, column: str, kind: str = "text", descending: bool = False, limit: int | None = None, registry: Source = None) -> DataFrame:
    """ORDER BY the logical value, which has an order where the packed one has none."""
    keyed, (name,) = with_keys(df, {column: kind}, registry)
    out = keyed.orderBy(F.desc(name) if descending else F.asc(name))
    return (out.limit(limit) if limit is not None else out).drop(name)


def count_distinct_packed(df: DataFrame, column: str, kind: str = "text", registry: Source = None) -> DataFrame:
    """(n): distinct logical values. count(DISTINCT packed) would count stored bytes; see ``refused``."""
    keyed, (name,) = with_keys(df, {column: kind}, registry)
    return keyed.agg(F.count_distinct(name).alias("n"))


def refused(operation: str):
    """Stands for operations on a packed column that the analyzer can't be made to refuse."""
    raise PackedRefusal(f"{operation} is not defined on a packed column; unpack it, or use its key")


def count_distinct(*_):
    refused("count(DISTINCT ...)")


def collect_set(*_):
    refused("collect_set(...)")


def window_key(c, kind: str = "text", registry: Source = None) -> Column:
    """What to partition a window by; project it first, as a window takes no nondeterministic key."""
    return equality_key(c, kind, registry)


def grouping_sets_packed(df: DataFrame, columns: dict[str, str], *aggregates: Column, cube: bool = False, registry: Source = None) -> DataFrame:
    """ROLLUP or CUBE over the keys of packed columns, which take the columns' names as logical values."""
    keyed, names = with_keys(df, columns, registry)
    plain = keyed.drop(*columns).withColumnsRenamed(dict(zip(names, columns, strict=True)))
    return (plain.cube(*columns) if cube else plain.rollup(*columns)).agg(*aggregates)
