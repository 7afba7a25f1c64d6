"""Exact deduplication through counting quotient filters.

A pass over the texts gives each document a 64-bit fingerprint. Every input partition builds a counting
quotient filter for each range of fingerprints. The filters of one range merge without loss, remainder by
remainder, because their runs are sorted. Only fingerprints with a count above one go on: the documents
that may have one are grouped by their whole normalised bytes, and the classes come from these groups;
all other documents are classes of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import bits_of, column, groups, longs, numbered, prepared, released, unused, without, written
from stowage.llm.kernels import flat


class QuotientFilter:
    """A counting quotient filter of the fingerprints in one range, the ones with the same high bits.

    Of the ``bits`` low bits of a fingerprint the upper ``quotient_bits`` name its home slot, the others
    are its remainder. The remainders of a quotient are one sorted run of slots, at its home or behind the
    run before it; slots after the last home take what overflows. Three bits a slot tell that a quotient
    is in use (occupied), that a run ends here (end), and that the slot holds a digit of the counter of
    the remainder before it (digit): counts above one take as many digits as they need.
    """

    def __init__(self, bits: int, quotient_bits: int, occupied: np.ndarray, end: np.ndarray, digit: np.ndarray, slots: np.ndarray):
        self.bits, self.quotient_bits, self.occupied, self.end, self.digit, self.slots = bits, quotient_bits, occupied, end, digit, slots

    @classmethod
    def of_sorted(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """From ascending distinct fingerprints (their low bits count) and their counts."""
        n = len(fingerprints)
        quotient_bits = min(bits - 1, max(1, (n + n // 4).bit_length()))
        remainder_bits = bits - quotient_bits
        low = fingerprints & np.uint64((1 << bits) - 1)
        quotients = (low >> np.uint64(remainder_bits)).astype(np.int64)
        width = -(-remainder_bits // 8)  # bytes a slot
        more = (counts - 1).astype(np.uint64)
        digits = np.zeros(n, np.int64)
        rest = more.copy()
        while rest.any():
            digits += rest > 0
            rest = rest >> np.uint64(8 * width) if width < 8 else rest * np.uint64(0)
        before = np.cumsum(1 + digits) - (1 + digits)
        place = np.maximum.accumulate(quotients - before) + before if n else quotients
        size = max(1 << quotient_bits, int(place[-1] + 1 + digits[-1]) if n else 0)
        occupied, end, digit = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
        slots = np.zeros((size, width), np.uint8)
        slots[place] = _bytes(low & np.uint64((1 << remainder_bits) - 1), width)
        for k in range(int(digits.max(initial=0))):
            with_more = np.flatnonzero(digits > k)
            at = place[with_more] + 1 + k
            digit[at] = True
            slots[at] = _bytes(more[with_more] >> np.uint64(8 * width * k), width)
        occupied[quotients] = True
        last = np.append(quotients[1:] != quotients[:-1], True) if n else np.zeros(0, bool)
        end[(place + digits)[last]] = True
        return cls(bits, quotient_bits, occupied, end, digit, slots)

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int) -> QuotientFilter:
        found, counts = np.unique(fingerprints, return_counts=True)
        return cls.of_sorted(found, counts, bits)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, ascending; counts): the runs in the order of their quotients."""
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.end)
        starts = np.maximum(quotients, np.append(0, ends[:-1] + 1)) if len(ends) else ends
        sizes = ends - starts + 1
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        of, digit = np.repeat(quotients, sizes), self.digit[at]
        values = _number(self.slots[at])
        heads = np.flatnonzero(~digit)
        counts = np.ones(len(at), np.int64)
        if digit.any():
            nth = np.arange(len(at)) - heads[np.cumsum(~digit) - 1] - 1
            counts[digit] = (values[digit] << (np.uint64(8 * self.slots.shape[1]) * nth[digit].astype(np.uint64))).astype(np.int64)
        counts = np.add.reduceat(counts, heads) if len(heads) else counts
        return (of[heads].astype(np.uint64) << np.uint64(self.bits - self.quotient_bits)) | values[heads], counts

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint was put in."""
        remainder_bits = self.bits - self.quotient_bits
        quotient, remainder = divmod(fingerprint & ((1 << self.bits) - 1), 1 << remainder_bits)
        if not self.occupied[quotient]:
            return 0
        run = int(self.occupied[: quotient + 1].sum())
        ends = np.flatnonzero(self.end)
        at, end = max(quotient, int(ends[run - 2]) + 1 if run > 1 else 0), int(ends[run - 1])
        while at <= end:
            n, digits = int(_number(self.slots[at : at + 1])[0]), 0
            while at + 1 + digits <= end and self.digit[at + 1 + digits]:
                digits += 1
            if n == remainder:
                return 1 + sum(int(_number(self.slots[at + 1 + k : at + 2 + k])[0]) << (8 * self.slots.shape[1] * k) for k in range(digits))
            at += 1 + digits
        return 0

    @classmethod
    def merge(cls, a: QuotientFilter, b: QuotientFilter) -> QuotientFilter:
        """Without loss, by one pass over the sorted remainders of both; equal ones add their counters."""
        return cls.of_sorted(*_merged(*a.items(), *b.items()), a.bits)

    def dumps(self) -> bytes:
        head = np.array([self.bits, self.quotient_bits, len(self.slots), self.slots.shape[1]], np.int64)
        return b"".join([head.tobytes(), *(np.packbits(x).tobytes() for x in (self.occupied, self.end, self.digit)), self.slots.tobytes()])

    @classmethod
    def loads(cls, data: bytes) -> QuotientFilter:
        bits, quotient_bits, size, width = np.frombuffer(data, np.int64, 4).tolist()
        flags = -(-size // 8)
        marks = [np.unpackbits(np.frombuffer(data, np.uint8, flags, 32 + k * flags), count=size).view(bool) for k in range(3)]
        return cls(bits, quotient_bits, *marks, np.frombuffer(data, np.uint8, size * width, 32 + 3 * flags).reshape(size, width))


def _bytes(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def _number(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), 8), np.uint8)
    out[:, : slots.shape[1]] = slots
    return out.view("<u8").ravel()


def _merged(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists without repeats, with their counts, as one: each element goes to its own
    position plus its rank in the other list."""
    values, counts = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
    at_a, at_b = np.arange(len(a)) + np.searchsorted(b, a, "left"), np.arange(len(b)) + np.searchsorted(a, b, "right")
    values[at_a], counts[at_a], values[at_b], counts[at_b] = a, m, b, n
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.add.reduceat(counts, starts) if len(starts) else counts


class Runs:
    """Ascending (fingerprints, counts) lists, merged when two are about as long, so that each fingerprint
    is merged a logarithmic number of times."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, fingerprints: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((fingerprints, counts))
        while len(self.held) > 1 and len(self.held[-2][0]) <= 2 * len(self.held[-1][0]):
            self.held[-2:] = [_merged(*self.held[-2], *self.held[-1])]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.held) > 1:
            self.held[-2:] = [_merged(*self.held[-2], *self.held[-1])]
        return self.held[0] if self.held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _normalised(texts: pa.Array) -> Iterator[bytes]:
    """Whole texts in UTF-8 with A-Z lower-cased; null counts as empty."""
    data, offsets = flat(texts)
    whole = data.tobytes().lower()  # bytes.lower() changes A-Z only
    for i in range(len(offsets) - 1):
        yield whole[offsets[i] : offsets[i + 1]]


RANGE_ROWS = 1 << 16  # documents whose fingerprints one range holds, on average


def exact_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_bits: int = 64, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``df``.

    Texts are equal when their bytes are equal after lower-casing A-Z; a null text counts as empty. Of
    equal texts the row with the largest id stays; a null id is below all others. Rows that repeat an id
    and a text are one group, of which one row stays. An empty table gives no rows; other columns, of
    whatever name, are ignored. ``fingerprint_bits`` only decides how many texts are verified.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    return _classes(texts.withColumn("no", F.monotonically_increasing_id()), fingerprint_bits, range_rows).drop("no")


def _classes(source: DataFrame, fingerprint_bits: int = 64, range_rows: int = RANGE_ROWS) -> DataFrame:
    """exact_classes of (id, body, no), with the rows' numbers ``no``, which are read once and stored."""
    spark = prepared(source.sparkSession)
    mask = np.uint64(2**fingerprint_bits - 1)

    def prints(hashes: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(h[:8] for h in hashes), "<u8").astype(np.uint64) & mask

    def digest(stream):
        for batch in stream:
            hashes = [hashlib.sha256(x).digest() for x in _normalised(column(batch, "body"))]
            yield pa.RecordBatch.from_arrays([column(batch, "id").cast(pa.int64()), column(batch, "no"), pa.array(hashes, pa.binary()), pa.array(prints(hashes).view(np.int64))], names=["id", "no", "sha", "print"])

    digests = written(source.mapInArrow(released(digest), "id long, no long, sha binary, print long"), "digests")
    range_bits = min(fingerprint_bits - 1, 24, max(0, (digests.count() // range_rows).bit_length()))
    repeated = written(_repeated(digests, fingerprint_bits, range_bits), "repeated")
    sent = spark.sparkContext.broadcast(bits_of(repeated, "print"))

    def route(stream):
        for batch in stream:
            texts = list(_normalised(column(batch, "body")))
            hashes = [hashlib.sha256(x).digest() for x in texts]
            at = np.flatnonzero(sent.value.hits(prints(hashes).view(np.int64)))
            if len(at):
                yield pa.RecordBatch.from_arrays([column(batch, "id").cast(pa.int64()).take(pa.array(at)), pa.array([hashes[i] for i in at], pa.binary()), pa.array([texts[i] for i in at], pa.binary())], names=["id", "sha", "body"])

    # Equal bytes meet here; the map side keeps one row per text and partition, however many copies.
    texts = source.select("id", "body").mapInArrow(released(route), "id long, sha binary, body binary").groupBy("sha", "body").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"))
    verified = texts.groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.max("keep_id").alias("keep_id")).where("n > 1")
    same = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest"))).otherwise(F.lit(True))
    classes = written(verified.where(same).select(F.col("sha").alias("class"), "n", "keep_id"), "classes")

    def mark(stream):
        for batch in stream:
            yield batch.append_column("may", pa.array(sent.value.hits(longs(column(batch, "print")))))

    marked = digests.mapInArrow(mark, "id long, no long, sha binary, print long, may boolean")
    routed = written(marked.where("may").join(classes, F.col("sha") == F.col("class"), "left").drop("print", "may"), "routed")
    # Rows that repeat the id that stays: one of them does.
    tops = routed.where("n is not null and id <=> keep_id").groupBy("class").agg(F.max("no").alias("keep_no")).select(F.col("class").alias("of"), "keep_no")
    member = routed.where("n is not null").join(written(tops, "tops"), F.col("class") == F.col("of"))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = marked.where("not may").select("id", "no", "sha").unionByName(routed.where("n is null").select("id", "no", "sha"))
    return member.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), (F.col("no") == F.col("keep_no")).alias("kept"), sha, "no").unionByName(
        alone.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha, "no")
    )


def _repeated(digests: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """(print, n): the fingerprints with a count above one in the merged filters of all partitions."""
    low = bits - range_bits

    def filters(stream):
        runs, held = Runs(), []
        for batch in stream:
            held.append(longs(column(batch, "print")).view(np.uint64))
            if sum(map(len, held)) >= 1 << 16:
                runs.add(*np.unique(np.concatenate(held), return_counts=True))
                held = []
        if held:
            runs.add(*np.unique(np.concatenate(held), return_counts=True))
        found, counts = runs.all()
        ranges = (found >> np.uint64(low) if low < 64 else np.zeros_like(found)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(ranges) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(found))
        for k in range(0, len(cuts), 64):
            made = [QuotientFilter.of_sorted(found[a:b], counts[a:b], low).dumps() for a, b in zip(cuts[k : k + 64], ends[k : k + 64], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ranges[cuts[k : k + 64]]), pa.array(made, pa.binary())], names=["range", "filter"])

    def merged(stream):
        for run in groups(stream, ["range"]):
            runs, high = Runs(), np.uint64(run["range"][0].as_py() << low if low < 64 else 0)
            for x in run["filter"]:
                runs.add(*QuotientFilter.loads(x.as_py()).items())
            found, counts = runs.all()
            whole = QuotientFilter.of_sorted(found, counts, low)
            found, counts = whole.items()
            more = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array((found[more] | high).view(np.int64)), pa.array(counts[more])], names=["print", "n"])

    parts = digests.select("print").mapInArrow(released(filters), "range long, filter binary")
    return parts.repartition("range").sortWithinPartitions("range").mapInArrow(released(merged), "print long, n long")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of equal texts (see exact_classes) the row
    with the largest id. Rows that agree in id and text are one row."""
    number, lost = unused(df, "row_no"), unused(df, "gone_no")
    rows = numbered(df, number)
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"), F.col(number).alias("no"))
    gone = written(_classes(source).where("not kept").select(F.col("no").alias(lost)), "gone")
    return without(rows, number, gone, lost).drop(number)
