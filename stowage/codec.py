"""One value at a time: compress under a policy, decompress with every check, in plain Python.

The engine's Arrow functions call this module on the executors; messages are the same wherever a value
is read, so that validation reports what a cast would raise.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field
from typing import NamedTuple

import zstandard

MAGIC = 0x50434B31
RAW, ZSTD = 0, 1
KINDS = {"text": 1, "json": 2, "bytes": 3}
KIND_NAMES = {v: k for k, v in KINDS.items()}
JSON_FORMAT = 1
FLOOR = 64  # shorter values are stored as they are
MAX_VALUE = 0x3FFFFFFF
DECODE_CACHE_VALUE = 256 << 10
DICTIONARY_MIN, DICTIONARY_MAX = 8, 1 << 20
DEFAULT_BUDGET = 64 << 20


class PackedError(ValueError):
    """A value that can't be stored or read."""


class Stored(NamedTuple):
    rawlen: int
    level: int
    kind: int
    codec: int
    format: int
    magic: int
    dict_id: int
    stored_bytes: int
    payload: bytes


def dictionary_id(data: bytes) -> int:
    """The id inside trained dictionary bytes; raises where they are no dictionary."""
    if not DICTIONARY_MIN <= len(data) <= DICTIONARY_MAX:
        raise PackedError(f"a dictionary has {DICTIONARY_MIN} to {DICTIONARY_MAX} bytes, not {len(data)}")
    try:
        number = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT).dict_id()
    except zstandard.ZstdError as error:
        raise PackedError(f"not a trained dictionary: {error}") from None
    if not number:
        raise PackedError("not a trained dictionary: it has no id")
    return number


@dataclass
class Counters:
    loads: int = 0
    evictions: int = 0
    hits: int = 0
    misses: int = 0
    encodes: int = 0


@dataclass
class Codec:
    """Compressors and caches of one worker. ``dictionaries``: id to bytes, a snapshot of the registry."""

    dictionaries: dict[int, bytes]
    budget: int = DEFAULT_BUDGET
    counters: Counters = field(default_factory=Counters)

    def __post_init__(self):
        self._loaded: OrderedDict[int, zstandard.ZstdCompressionDict] = OrderedDict()
        self._writers: OrderedDict[tuple[int, int], zstandard.ZstdCompressor] = OrderedDict()
        self._readers: OrderedDict[int, zstandard.ZstdDecompressor] = OrderedDict()
        self._recent: OrderedDict[tuple, bytes] = OrderedDict()

    def dictionary(self, number: int) -> zstandard.ZstdCompressionDict:
        held = self._loaded.get(number)
        if held is not None:
            self._loaded.move_to_end(number)
            return held
        data = self.dictionaries.get(number)
        if data is None:
            raise PackedError(f"dictionary ID {number} is not available")
        held = self._loaded[number] = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT)
        self.counters.loads += 1
        while len(self._loaded) > 1 and sum(len(self.dictionaries[n]) for n in self._loaded) > self.budget:
            gone, _ = self._loaded.popitem(last=False)  # the least recent; the one in use stays
            self._readers.pop(gone, None)
            for key in [k for k in self._writers if k[1] == gone]:
                del self._writers[key]
            self.counters.evictions += 1
        return held

    def _writer(self, level: int, number: int) -> zstandard.ZstdCompressor:
        writer = self._writers.get((level, number))
        if writer is None:
            data = self.dictionary(number) if number else None
            writer = self._writers[level, number] = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True, write_content_size=True)
            while len(self._writers) > 8:
                self._writers.popitem(last=False)
        return writer

    def encode(self, kind: int, data: bytes, level: int, dict_id: int = 0) -> Stored:
        if len(data) > MAX_VALUE:
            raise PackedError(f"a value of {len(data)} bytes is too long")
        if dict_id:
            self.dictionary(dict_id)  # a wrong one shows even with a tiny value
        self.counters.encodes += 1
        codec, payload = RAW, data
        if len(data) >= FLOOR:
            made = self._writer(level, dict_id).compress(data)
            if len(made) < len(data):
                codec, payload = ZSTD, made
        return Stored(len(data), level, kind, codec, JSON_FORMAT if kind == KINDS["json"] else 0, MAGIC, dict_id if codec else 0, len(payload), payload)

    def frame(self, data: bytes, level: int) -> bytes:
        """One frame without a dictionary, even of no bytes."""
        return self._writer(level, 0).compress(data)

    @staticmethod
    def check_header(v: Stored, kind: int | None) -> None:
        if v.magic != MAGIC or None in (v.rawlen, v.level, v.kind, v.codec, v.format, v.payload):
            raise PackedError("invalid or unsupported storage format")
        if kind is not None and v.kind != kind or v.kind not in KIND_NAMES or v.codec not in (RAW, ZSTD) or v.rawlen < 0 or not 1 <= v.level <= 22:
            raise PackedError("invalid value header")
        if v.kind == KINDS["json"] and v.format != JSON_FORMAT:
            raise PackedError(f"unsupported JSON payload format {v.format}")
        if v.kind != KINDS["json"] and v.format:
            raise PackedError("invalid value header")

    @staticmethod
    def check_frame(v: Stored) -> zstandard.FrameParameters:
        try:
            found = zstandard.get_frame_parameters(v.payload)
        except zstandard.ZstdError:
            raise PackedError("invalid frame header") from None
        if found.content_size != v.rawlen or not found.has_checksum:
            raise PackedError("invalid frame header")
        return found

    def decode(self, v: Stored, kind: int | None, cached: bool = True) -> bytes:
        """The logical bytes. ``kind``: what the reader wants, None to trust the value."""
        self.check_header(v, kind)
        if v.codec == RAW:
            if len(v.payload) != v.rawlen:
                raise PackedError("invalid raw value length")
            return self._text_checked(v, v.payload)
        key = (v.payload, v.rawlen, v.kind)
        if cached and key in self._recent:
            self.counters.hits += 1
            self._recent.move_to_end(key)
            return self._recent[key]
        found = self.check_frame(v)
        reader = self._readers.get(found.dict_id)
        if reader is None:
            reader = self._readers[found.dict_id] = zstandard.ZstdDecompressor(dict_data=self.dictionary(found.dict_id) if found.dict_id else None)
        elif found.dict_id:
            self.dictionary(found.dict_id)
        try:
            data = reader.decompress(v.payload, max_output_size=v.rawlen, allow_extra_data=False)
        except zstandard.ZstdError as error:
            said = str(error)
            raise PackedError("unexpected trailing frame data" if "extra data" in said or "unused" in said or "trailing" in said else f"could not decompress value: {said}") from None
        if len(data) != v.rawlen:
            raise PackedError("invalid decompressed length")
        data = self._text_checked(v, data)
        if cached:
            self.counters.misses += 1
            if v.rawlen <= DECODE_CACHE_VALUE:
                self._recent[key] = data
                while len(self._recent) > 2:
                    self._recent.popitem(last=False)
        return data

    @staticmethod
    def _text_checked(v: Stored, data: bytes) -> bytes:
        if v.kind != KINDS["bytes"]:
            try:
                data.decode()
            except UnicodeDecodeError as error:
                raise PackedError(f"invalid byte sequence for encoding UTF-8 at byte {error.start}") from None
        return data

    def prefix(self, v: Stored, n: int) -> str:
        """The first n bytes of a text, cut back to whole characters. Reads no further than it needs, so
        the checksum at the end is not verified."""
        if n <= 0:
            self.check_header(v, KINDS["text"])
            return ""
        if v.codec != ZSTD or n >= (v.rawlen or 0):
            data = self.decode(v, KINDS["text"])
        else:
            self.check_header(v, KINDS["text"])
            found = self.check_frame(v)
            reader = zstandard.ZstdDecompressor(dict_data=self.dictionary(found.dict_id) if found.dict_id else None)
            try:
                with reader.stream_reader(v.payload) as stream:
                    data = stream.read(n)
            except zstandard.ZstdError as error:
                raise PackedError(f"could not decompress value: {error}") from None
        data = data[:n]
        for cut in range(4):
            try:
                return data[: len(data) - cut].decode()
            except UnicodeDecodeError as error:
                if error.end < len(data) - 3 and cut == 0 and error.reason != "unexpected end of data":
                    raise PackedError(f"invalid byte sequence for encoding UTF-8 at byte {error.start}") from None
        raise PackedError("invalid byte sequence for encoding UTF-8")

    def validate(self, v: Stored, kind: int) -> str | None:
        """None if a cast would read the value, else what it would raise. Leaves the caches alone."""
        try:
            self.decode(v, kind, cached=False)
        except PackedError as problem:
            return str(problem)
        return None
