"""Packed tables: Parquet folders whose columns keep a policy, with deferred policy changes.

Policies live in field metadata and, as the authority, in a small file ``_policies.json`` beside the
data (Spark skips names that begin with an underscore). Data files are only added or replaced whole: a
rewrite puts new files into a folder of its own, and the small file then names it and the files it replaces.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stowage.functions.packing import PACKED_TYPE, _pack, coerce, matches_policy, named, unpack
from stowage.policy import DEFAULT, Policy, PolicyError
from stowage.registry import Folder, Registry

POLICIES = "_policies.json"
PART = re.compile(r"[A-Za-z0-9_.-]+")


MOVED = "__part"  # names the part that rewritten rows came from, in their folder's name only
FILE_NAME = "_metadata.file_name"
CORRUPT = "__corrupt"


def _name(file: str) -> str:
    return file.rsplit("/", 1)[1]


def packed_columns(df: DataFrame) -> dict[str, tuple[str, Policy | None]]:
    """Name to (kind, policy) of the packed columns, from field metadata."""
    return {f.name: (f.metadata["packed"]["kind"], Policy.of_metadata(f.metadata)) for f in df.schema.fields if "packed" in (f.metadata or {})}


def is_packed(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() == PACKED_TYPE


def apply_policies(df: DataFrame, policies: dict[str, tuple[str, Policy | str | None]], registry: Registry | None = None) -> DataFrame:
    """Every named column packed under its policy, whatever made it: plain values are packed once, packed
    values coerced (a bare column packs plain values at (6) and keeps packed ones as they are)."""
    out = []
    for c in df.columns:
        if c not in policies:
            out.append(F.col(f"`{c}`"))
            continue
        kind, policy = policies[c]
        if isinstance(policy, str):
            policy = Policy.parse(policy, registry.slot if registry is not None else None)
        made = coerce(df[c], policy, registry) if is_packed(df, c) else _pack(df[c], kind, policy or DEFAULT, registry, False)
        out.append(named(made, c, kind, policy))
    return df.select(*out)


class PackedTable:
    def __init__(self, spark: SparkSession, path: str, registry: Registry | None = None):
        self.spark, self.path, self.registry = spark, path.rstrip("/"), registry
        self.folder = Folder(spark, path)

    def _held(self) -> dict:
        raw = self.folder.read(POLICIES)
        return {"rewritten": [], "gone": []} | (json.loads(raw) if raw else {"columns": {}, "data": None})

    def _hold(self, held: dict) -> None:
        self.folder.write(POLICIES, json.dumps(held).encode(), replace=True)

    def policies(self) -> dict[str, tuple[str, Policy | None]]:
        return {c: (p["kind"], None if p["level"] is None else Policy(p["level"], p["slot"], p["pending"])) for c, p in self._held()["columns"].items()}

    def write(self, df: DataFrame, policies: dict[str, tuple[str, Policy | str | None]] | None = None, uncompressed: bool = False, part: str | None = None) -> None:
        """Writes or appends. The first write declares the policies; later ones follow them.
        ``uncompressed``: leaves Parquet's own compression off, as payloads are compressed already.
        ``part``: a name for these rows (letters, digits, ``_.-``); a second write of a part replaces it whole."""
        if part is not None and not PART.fullmatch(part):
            raise PolicyError(f"a part can't be named {part!r}")
        held = self._held()
        if policies is not None:
            if held["columns"]:
                raise PolicyError("the table has policies; use set_policy")
            for c, (kind, policy) in policies.items():
                if isinstance(policy, str):
                    policy = Policy.parse(policy, self.registry.slot if self.registry else None)
                held["columns"][c] = {"kind": kind, "level": policy.level if policy else None, "slot": policy.slot if policy else 0, "pending": bool(policy and policy.pending)}
        held["data"] = held["data"] or f"{self.path}/data-{uuid.uuid4().hex}"
        self._hold(held)
        if self.registry is not None:
            self.registry.new_write()
        made = apply_policies(df, self.policies(), self.registry)
        made.write.mode("append" if part is None else "overwrite").option("compression", "none" if uncompressed else "zstd").parquet(held["data"] + (f"/part-{part}" if part else ""))
        if part and held["rewritten"]:
            self._publish([f for f in self._files() if f"/{MOVED}={part}/" in f])

    def ingest(self, path: str, schema: str, form: str = "csv", on_error: str = "stop", policies: dict[str, tuple[str, Policy | str | None]] | None = None, **options) -> int:
        """Appends text files (``csv``, or ``json`` with a document a line) whose fields hold plain values.
        ``on_error``: "stop" raises at the first row that can't be read or packed and stores nothing, "ignore"
        skips such rows whole. Gives the number of rows skipped. A part that is written again after a lost
        executor counts once."""
        if on_error not in ("stop", "ignore"):
            raise PolicyError(f"on_error is stop or ignore, not {on_error!r}")
        if form not in ("csv", "json"):
            raise PolicyError(f"files of form {form!r} are not read here")
        reader = self.spark.read.format(form).options(**options)
        if on_error == "stop":
            self.write(reader.schema(schema).option("mode", "FAILFAST").load(path), policies)
            return 0
        df = reader.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).load(path)
        names = [c for c in df.columns if c != CORRUPT]
        declared = self.policies() or {c: (kind, Policy.parse(p, self.registry.slot if self.registry else None) if isinstance(p, str) else p) for c, (kind, p) in (policies or {}).items()}
        tried = df.select(CORRUPT, *[_pack(df[c], *declared[c], self.registry, True).alias(c) if c in declared else df[c] for c in names])
        bad = F.col(CORRUPT).isNotNull()
        for c in declared:
            bad = bad | F.col(c)["problem"].isNotNull()
        seen = Observation()
        kept = tried.observe(seen, F.count_if(bad).alias("skipped")).where(~bad)  # no filter moves below an observation, so that a value is packed once
        self.write(kept.select(*[F.col(c)["value"].alias(c) if c in declared else F.col(c) for c in names]), policies)
        return seen.get["skipped"]

    def _stored(self) -> DataFrame:
        """The rows of all files but replaced ones, which Spark leaves out when it lists files."""
        held = self._held()
        df = self.spark.read.option("recursiveFileLookup", "true").parquet(held["data"], *held["rewritten"])
        return df.where(~F.col(FILE_NAME).isin(held["gone"])) if held["gone"] else df

    def read(self) -> DataFrame:
        df, policies = self._stored(), self.policies()
        return df.select(*[named(F.col(c), c, *policies[c]) if c in policies else F.col(f"`{c}`") for c in df.columns])

    def logical(self) -> DataFrame:
        """The table with plain values: what an export or a dump carries."""
        df = self.read()
        return df.select(*[unpack(df[c], self.policies()[c][0], self.registry).alias(c) if c in self.policies() else F.col(f"`{c}`") for c in df.columns])

    def set_policy(self, column: str, level: int, dictionary: str | int | None = None) -> None:
        """Declares another policy without touching data; it is pending until finish_policy."""
        held = self._held()
        if column not in held["columns"]:
            raise PolicyError(f"{column!r} is no packed column of this table")
        slot = dictionary or 0
        if isinstance(slot, str):
            slot = int(slot) if slot.isdigit() else self.registry.slot(slot)
        Policy(level, slot)
        held["columns"][column] |= {"level": level, "slot": slot, "pending": True}
        self._hold(held)

    def behind(self, column: str) -> DataFrame:
        """The rows that are not stored as the policy asks, from headers alone."""
        policy = self.policies()[column][1] or DEFAULT
        df = self.read()
        return df.where(df[column]["rawlen"].isNotNull() & ~matches_policy(df[column], policy.level, policy.slot, self.registry))

    def finish_policy(self, column: str) -> bool:
        """Ends a pending change; refuses while values are not on the policy. False: none was pending."""
        held = self._held()
        if column not in held["columns"]:
            raise PolicyError(f"{column!r} is no packed column of this table")
        if not held["columns"][column]["pending"]:
            return False
        n = self.behind(column).count()
        if n:
            raise PolicyError(f"{n} values of {column!r} do not match the policy")
        held["columns"][column]["pending"] = False
        self._hold(held)
        return True

    def _files(self) -> list[str]:
        gone = set(self._held()["gone"])
        return [f for f in self._stored().inputFiles() if _name(f) not in gone]

    def _publish(self, replaced: list[str], folder: str | None = None) -> None:
        held = self._held()
        held["gone"] = sorted({*held["gone"], *map(_name, replaced)})
        held["rewritten"] += [folder] if folder else []
        self._hold(held)

    def _replace(self, files: list[str], change: Callable[[DataFrame], list]) -> None:
        """Writes the rows of some files as ``change`` makes them into a folder beside, then lets them take the
        files' place. Rows that others append meanwhile stay; if another write replaced one of the files, nothing
        is published."""
        names, folder = {_name(f) for f in files}, f"{self.path}/data-{uuid.uuid4().hex}"
        df = self._stored().where(F.col(FILE_NAME).isin(sorted(names)))
        part = F.regexp_extract(F.col("_metadata.file_path"), rf"/(?:part-|{MOVED}=)([^/]+)/[^/]+$", 1)
        parted = any(f"/{MOVED}=" in f or "/part-" in f.rsplit("/", 1)[0] for f in files)
        made = df.select(*change(df), *([F.when(part == "", "(none)").otherwise(part).alias(MOVED)] if parted else []))
        writer = made.write.option("compression", "zstd")
        (writer.partitionBy(MOVED) if parted else writer).parquet(folder)
        if not names <= {_name(f) for f in self._files()}:
            self.folder.fs.delete(self.folder._path(folder.rsplit("/", 1)[1]), True)
            raise PolicyError("another write replaced some of the files meanwhile; run it again")
        self._publish(files, folder)

    def vacuum(self) -> int:
        """Deletes the files that rewrites have replaced, for good; no reader may still use them. Gives their number."""
        held = self._held()
        gone, removed = set(held["gone"]), 0
        for f in self._stored().inputFiles():
            if _name(f) in gone:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(f))
                removed += bool(self.folder.fs.delete(path, False))
        held = self._held()
        held["gone"] = [n for n in held["gone"] if n not in gone]
        self._hold(held)
        return removed

    def catch_up(self, column: str, batches: int = 1, batch: int = 0) -> int:
        """Rewrites the files that hold values behind the policy, and no others; a slice of the files by hash
        at a time, so that it can stop and go on. Gives the number of values rewritten; a second call finds
        none. The driver sees a row a file, as it does when Spark lists them."""
        policies = self.policies()
        kind, policy = policies[column][0], policies[column][1] or DEFAULT

        def behind(c):
            return c["rawlen"].isNotNull() & ~matches_policy(c, policy.level, policy.slot, self.registry)

        df = self._stored()
        turn = F.pmod(F.xxhash64(F.col(FILE_NAME)), F.lit(batches)) == batch
        found = df.where(turn & behind(df[column])).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).collect()
        if found:
            put = lambda df: F.when(behind(df[column]), coerce(df[column], policy, self.registry)).otherwise(df[column])
            self._replace([r["file"] for r in found], lambda df: [named(put(df), x, kind, policies[column][1]) if x == column else df[x] for x in df.columns])
        return sum(r["n"] for r in found)

    def repack(self, column: str, policy: Policy | str) -> bool:
        """ALTER TYPE: rewrites the column under a policy; nothing to do where it is declared already."""
        if isinstance(policy, str):
            policy = Policy.parse(policy, self.registry.slot if self.registry else None)
        kind, old = self.policies()[column]
        if old == policy:
            return False
        self._replace(self._files(), lambda df: [named(coerce(df[x], policy, self.registry), x, kind, policy) if x == column else df[x] for x in df.columns])
        held = self._held()
        held["columns"][column] |= {"level": policy.level, "slot": policy.slot, "pending": policy.pending}
        self._hold(held)
        return True


def column_policies(tables: dict[str, PackedTable], registry: Registry | None = None) -> DataFrame:
    """(table, column, kind, has_policy, level, slot, pending, dict_name, dict_id), one row a packed
    column; a bare column shows (6, 0)."""
    rows, spark = [], next(iter(tables.values())).spark if tables else SparkSession.active()
    for name, table in sorted(tables.items()):
        for column, (kind, policy) in sorted(table.policies().items()):
            shown = policy or DEFAULT
            entry = registry.by_slot(shown.slot) if registry is not None and shown.slot else None
            rows.append((name, column, kind, policy is not None, shown.level, shown.slot, shown.pending, entry.name if entry else None, entry.dict_id if entry else None))
    return spark.createDataFrame(rows, "table string, column string, kind string, has_policy boolean, level int, slot int, pending boolean, dict_name string, dict_id long")


def policy_differences(here: DataFrame, publisher: DataFrame) -> DataFrame:
    """(table, column, difference) of two column_policies, where level or dictionary ID differ."""
    x, y = here.alias("x"), publisher.alias("y")
    joined = x.join(y, (F.col("x.table") == F.col("y.table")) & (F.col("x.column") == F.col("y.column")))
    mine, other, slot = F.col("x.dict_id"), F.col("y.dict_id"), F.col("x.slot")
    label = (
        F.when(mine.isNotNull() & other.isNull(), "dictionary here, none on the publisher")
        .when(other.isNotNull() & (slot > 0) & mine.isNull(), "slot not registered here")
        .when(other.isNotNull() & mine.isNull(), "no dictionary here")
        .when(mine != other, "different dictionary")
    )
    level = F.when(F.col("x.level") != F.col("y.level"), "different level")
    out = joined.select(F.col("x.table").alias("table"), F.col("x.column").alias("column"), F.concat_ws(", ", level, label).alias("difference"))
    return out.where("difference <> ''")


def partitioned_write(df: DataFrame, key: str, path: str, partitions: int) -> None:
    """Hash partitions by a plain key column (see relational.with_keys), which an equality can prune."""
    df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")).write.partitionBy("part").parquet(path)


def partitioned_read(spark: SparkSession, path: str, key: str, value, partitions: int) -> DataFrame:
    """The rows whose key equals a constant, from the one partition that can hold them."""
    part = F.pmod(F.xxhash64(F.lit(value)), F.lit(partitions)).cast("int")
    return spark.read.parquet(path).where((F.col("part") == part) & (F.col(key) == value))



def probe_write(df: DataFrame, key: str, path: str, expected: int = 1_000_000) -> None:
    """Writes the 64-bit hash of a plain key column beside the rows, with a Parquet bloom filter on it."""
    hashed = df.withColumn("key_hash", F.xxhash64(key))
    hashed.write.option("parquet.bloom.filter.enabled#key_hash", "true").option("parquet.bloom.filter.expected.ndv#key_hash", str(expected)).parquet(path)


def probe(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows whose key equals a constant; row groups whose bloom filter lacks its hash are not read."""
    wanted = spark.range(1).select(F.xxhash64(F.lit(value))).first()[0]
    return spark.read.parquet(path).where((F.col("key_hash") == wanted) & (F.col(key) == value)).drop("key_hash")


def export_logical(df: DataFrame, path: str, registry: Registry | None = None) -> None:
    """A dump: plain values in Parquet, that any reader can load. No frame leaves the table."""
    held = packed_columns(df)
    df.select(*[unpack(df[c], held[c][0], registry).alias(c) if c in held else F.col(f"`{c}`") for c in df.columns]).write.parquet(path)


def import_logical(table: PackedTable, path: str, policies: dict[str, tuple[str, Policy | str | None]] | None = None) -> None:
    """A restore: the values of a dump, encoded under the target's own policies."""
    table.write(table.spark.read.parquet(path), policies)
