"""The append-only registry of trained dictionaries: one write-once file a slot in a shared folder.

The folder can be any file system Spark knows. A slot is taken by creating its file exclusively, so two
writers never share one, and nothing ever changes or deletes a file. Its rows are few (each is a trained
dictionary of at most 1 MiB), so the driver reads them; executors get a snapshot of those they need.
"""

from __future__ import annotations

import base64
import datetime
import json
import time
import uuid
import warnings
from dataclasses import dataclass
from typing import Any

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.codec import PackedError, dictionary_id
from stowage.policy import MAX_SLOT

DICT_BYTES, SAMPLE_BYTES = 112_640, 8_192
MAX_SAMPLES, MAX_SAMPLE_TOTAL, MIN_SAMPLES = 20_000, 64 << 20, 8
SNAPSHOT_BYTES = 64 << 20


class RegistryError(ValueError):
    """``code``: duplicate, missing, invalid, null or read_only."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Entry:
    slot: int
    dict_id: int
    name: str
    data: bytes
    trained_from: str | None
    created_at: str


class Folder:
    """A folder of small files on any of Spark's file systems, read and written by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        base = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        self.base = base

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        if not self.fs.exists(self.base):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.base))

    def read(self, name: str) -> bytes | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes, replace: bool = False) -> bool:
        """Publishes a whole file: it is written under a hidden name and then renamed, so that nobody sees
        half of it. False if the file exists and isn't to be replaced."""
        self.fs.mkdirs(self.base)
        if not replace and self.fs.exists(self._path(name)):
            return False
        hidden = self._path(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if replace else rename.NONE
        target = self.fs.makeQualified(self._path(name))
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self.fs.makeQualified(hidden), target, how)
        except Exception as error:
            self.fs.delete(hidden, False)
            if "AlreadyExists" in str(error):
                return False
            raise
        return True


def train_dictionary(df: DataFrame, dict_bytes: int = DICT_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary trained on the one text or binary column of ``df``: at most 20,000 non-empty samples,
    each cut to ``sample_bytes``, 64 MiB in all (the first that does not fit ends the sample)."""
    if not 1 << 10 <= dict_bytes <= 1 << 20:
        raise RegistryError("invalid", f"dict_bytes {dict_bytes} is outside 1024..1048576")
    if not 1 <= sample_bytes <= 1 << 16:
        raise RegistryError("invalid", f"sample_bytes {sample_bytes} is outside 1..65536")
    if len(df.columns) != 1 or df.dtypes[0][1] not in ("string", "binary"):
        raise RegistryError("invalid", "training takes one column of text, JSON text or bytes")
    value = F.col(f"`{df.columns[0]}`").cast("binary")
    cut = F.substring(value, 1, sample_bytes)
    samples, total = [], 0
    for row in df.select(cut.alias("s")).where("s is not null and length(s) > 0").limit(MAX_SAMPLES).toLocalIterator():
        if total + len(row["s"]) > MAX_SAMPLE_TOTAL:
            break
        samples.append(bytes(row["s"]))
        total += len(row["s"])
    if len(samples) < MIN_SAMPLES:
        raise RegistryError("invalid", f"training takes {MIN_SAMPLES} samples at least, not {len(samples)}")
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except zstandard.ZstdError as error:
        raise RegistryError("invalid", f"could not train a dictionary: {error}") from None


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.folder = Folder(spark, path)
        self._held: dict[str, Entry] = {}
        self._warned: set[int] = set()
        self.sent: dict[tuple[int, ...], Any] = {}  # the last few snapshots that were broadcast, by their ids

    def reload(self) -> None:
        self._held.clear()

    def entries(self) -> list[Entry]:
        """All rows by slot. Files never change, so each is read once."""
        out = []
        for name in self.folder.names():
            if name.startswith("slot-") and name.endswith(".json"):
                if name not in self._held:
                    raw = self._published(name)
                    self._held[name] = Entry(raw["slot"], raw["dict_id"], raw["name"], base64.b64decode(raw["dict"]), raw["trained_from"], raw["created_at"])
                out.append(self._held[name])
        return sorted(out, key=lambda e: e.slot)

    def _published(self, name: str) -> dict:
        """A slot's file; one that another writer has only begun is read again."""
        for _ in range(20):
            try:
                return json.loads(self.folder.read(name))
            except ValueError:
                time.sleep(0.1)
        raise RegistryError("invalid", f"{name} is not a whole file")

    def _checked(self, name: str | None, data: bytes | None) -> int:
        if name is None or data is None:
            raise RegistryError("null", "a dictionary needs a name and bytes")
        if not name or name.isdigit():
            raise RegistryError("invalid", f"a dictionary's name is not empty and not digits only: {name!r}")
        try:
            return dictionary_id(data)
        except PackedError as error:
            raise RegistryError("invalid", str(error)) from None

    def _publish(self, slot: int, number: int, name: str, data: bytes, trained_from: str | None) -> bool:
        made = {"slot": slot, "dict_id": number, "name": name, "dict": base64.b64encode(data).decode(), "trained_from": trained_from, "created_at": datetime.datetime.now(datetime.UTC).isoformat()}
        return self.folder.write(f"slot-{slot:08d}.json", json.dumps(made).encode())

    def add(self, name: str, data: bytes, trained_from: str | None = None) -> int:
        """The slot after the highest; slots are never used again."""
        number = self._checked(name, data)
        while True:
            entries = self.entries()
            for e in entries:
                if e.name == name:
                    raise RegistryError("duplicate", f"a dictionary named {name!r} exists (slot {e.slot})")
                if e.dict_id == number:
                    raise RegistryError("duplicate", f"dictionary ID {number} exists (slot {e.slot})")
            slot = max((e.slot for e in entries), default=0) + 1
            if slot > MAX_SLOT:
                raise RegistryError("invalid", "no slot is left")
            if self._publish(slot, number, name, data, trained_from):
                return slot

    def collision(self, slot: int, name: str, number: int) -> bool:
        """True if the same row is there; raises for another row with the slot, id or name (the lowest
        slot first); False if nothing overlaps."""
        for e in self.entries():
            if (e.slot, e.name, e.dict_id) == (slot, name, number):
                return True
            if e.slot == slot:
                raise RegistryError("duplicate", f"slot {slot} holds dictionary {e.name!r}")
            if e.dict_id == number:
                raise RegistryError("duplicate", f"dictionary ID {number} is {e.name!r} in slot {e.slot}")
            if e.name == name:
                raise RegistryError("duplicate", f"the name {name!r} is taken by slot {e.slot}")
        return False

    def import_(self, slot: int, name: str, data: bytes, trained_from: str | None = None) -> int:
        """Keeps the slot of another registry. An identical row is a no-op."""
        if slot is None:
            raise RegistryError("null", "an import needs a slot")
        if not 1 <= slot <= MAX_SLOT:
            raise RegistryError("invalid", f"slot {slot} is outside 1..{MAX_SLOT}")
        number = self._checked(name, data)
        while not self.collision(slot, name, number):
            if self._publish(slot, number, name, data, trained_from):
                break
            self.reload()
        return slot

    def train_and_add(self, name: str, source: DataFrame | str, dict_bytes: int = DICT_BYTES) -> int:
        """Trains on a DataFrame or a query; the query is kept as trained_from."""
        df = self.spark.sql(source) if isinstance(source, str) else source
        return self.add(name, train_dictionary(df, dict_bytes), source if isinstance(source, str) else None)

    def slot(self, name: str) -> int:
        for e in self.entries():
            if e.name == name:
                return e.slot
        raise RegistryError("missing", f"no dictionary is named {name!r}")

    def bytes(self, number: int) -> bytes | None:
        return next((e.data for e in self.entries() if e.dict_id == number), None)

    def by_slot(self, slot: int) -> Entry | None:
        return next((e for e in self.entries() if e.slot == slot), None)

    def resolve(self, slot: int, missing_ok: bool = False) -> int:
        """The dictionary ID of a slot, 0 of slot 0. A missing one warns once, or raises."""
        if not slot:
            return 0
        entry = self.by_slot(slot)
        if entry:
            return entry.dict_id
        if not missing_ok:
            raise RegistryError("missing", f"dictionary slot {slot} is not registered")
        if slot not in self._warned:
            self._warned.add(slot)
            warnings.warn(f"dictionary slot {slot} is not registered; storing without a dictionary", stacklevel=3)
        return 0

    def new_write(self) -> None:
        """A write action begins: each missing slot may warn once more."""
        self._warned.clear()

    def snapshot(self, ids: set[int] | None = None) -> dict[int, bytes]:
        """id to bytes, of all rows or of the ids asked for; its size is checked before it is sent."""
        held = {e.dict_id: e.data for e in self.entries() if ids is None or e.dict_id in ids}
        total = sum(map(len, held.values()))
        if total > SNAPSHOT_BYTES:
            raise RegistryError("invalid", f"the dictionaries have {total} bytes; name the ids that the column uses")
        return held

    def inventory(self) -> DataFrame:
        """(slot, name, dict_id, dict_bytes, created_at), without the bytes and the training query."""
        rows = [(e.slot, e.name, e.dict_id, len(e.data), e.created_at) for e in self.entries()]
        return self.spark.createDataFrame(rows, "slot int, name string, dict_id long, dict_bytes int, created_at string")
