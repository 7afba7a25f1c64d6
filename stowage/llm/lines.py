"""Line deduplication with a segment-partition edit join.

Of two lines within t edits, one of the t + 1 segments that partition the shorter one stands unchanged
in the longer one, near its place. Every distinct line puts its segments into an index under its length,
and probes the indexes of its own and the t smaller lengths with the substrings that may hold such a
segment. The segments of very short lines say little, but two lines within t edits have in common what
remains of each after t deletions at most: these remainders are their keys. Lines that meet under a key
are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import bits_of, column, components, groups, longs, prepared, released, unused, written
from stowage.llm.kernels import mix

EDITS = 2
SEGMENT = 8  # characters a segment has at least, unless line_classes is told to link shorter lines
SHORT = 4  # characters a segment has at least where lines of all lengths are linked
BLOCK = 1024
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SLICE = 1 << 19


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two strings is ``most`` at most.

    Bit t of ``alive[e]`` says that the first j - most + t characters of ``a`` become the first j of
    ``b`` with e edits: a band of 2 * most + 1 diagonals, all moved on by a few operations a character.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    head = _shared(a, b)
    a, b = a[head:], b[head:]
    tail = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a:
        return True  # the rest of b is its surplus length
    full = (1 << 2 * most + 1) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + most)
    alive = [((1 << e + 1) - 1) << most & full for e in range(most + 1)]
    for j, c in enumerate(b):
        match = places.get(c, 0) >> j & full
        before, moved = alive[0], alive[0] & match
        alive[0] = moved
        for e in range(1, most + 1):
            # a match; an edit that skips a character of b, swaps one, or skips one of a
            moved = (alive[e] & match | before >> 1 | before | moved << 1) & full
            before, alive[e] = alive[e], moved
        if not moved:
            return False
    return bool(alive[most] >> (most - len(b) + len(a)) & 1)


def _shared(a: str, b: str) -> int:
    """The length of the common prefix of two strings, the first no longer than the second."""
    low, high = 0, len(a)
    if b.startswith(a):
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _code_points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))])


def segment_keys(lines: list[str], edits: int, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line's number, whether an index entry) of lines, for links whose shorter line has ``least``
    and edits + 1 characters at least. An index entry is also the probe of its own length at its own place."""
    points, bounds = _code_points(lines)
    values = mix(points.astype(np.uint64) + np.uint64(0x51))
    n = len(points) + 1
    powers, undo = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    powers[0] = undo[0] = 1
    powers, undo = np.cumprod(powers), np.cumprod(undo)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:-1])])
    lengths, starts, parts = np.diff(bounds), bounds[:-1], edits + 1
    out = []

    def hashed(rows, length, segment, place, size):
        at = starts[rows] + place
        inner = (sums[at + size] - sums[at]) * undo[at]
        return mix(inner + mix(length.astype(np.uint64) * np.uint64(256) + np.uint64(segment)))

    for less in range(edits + 1):  # the length of the index that is probed: less than one's own
        rows = np.flatnonzero(lengths - less >= max(parts, least))
        length = lengths[rows] - less
        short, longer = length // parts, length % parts  # the last ``longer`` segments have one more
        for i in range(parts):
            size = short + (i >= parts - longer)
            place = i * short + np.maximum(0, i - (parts - longer))
            low = np.maximum(np.maximum(place - i, place + less - (edits - i)), 0)
            high = np.minimum(np.minimum(place + i, place + less + (edits - i)), lengths[rows] - size)
            for shift in range(-2 * edits, 3 * edits + 1):
                at = place + shift
                ok = (at >= low) & (at <= high)
                if ok.any():
                    own = np.full(int(ok.sum()), not less and not shift)
                    out.append((hashed(rows[ok], length[ok], i, at[ok], size[ok]), rows[ok], own))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    key, row, own = (np.concatenate(x) for x in zip(*out, strict=True))
    return key.view(np.int64), row, own


def remainder_keys(lines: list[str], edits: int, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line's number, True): what remains of a line after ``edits`` deletions at most, for links
    whose shorter line has less than ``below`` characters."""
    points, bounds = _code_points(lines)
    values = mix(points.astype(np.uint64) + np.uint64(0x51))
    lengths = np.diff(bounds)
    powers = np.cumprod(np.full(below + edits, _BASE, np.uint64))
    keys, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for length in np.unique(lengths[lengths < below + edits]).tolist():
        rows = np.flatnonzero(lengths == length)
        each = values[bounds[rows][:, None] + np.arange(length)]
        made = []
        for gone in range(min(edits, length) + 1):
            for places in itertools.combinations(range(length), gone):
                rest = np.delete(each, places, axis=1) * powers[: length - gone]
                made.append(mix(rest.sum(axis=1, dtype=np.uint64) + mix(np.full(len(rows), length - gone + (1 << 40), np.uint64))))
        found = np.sort(np.stack(made, axis=1), axis=1)
        once = np.ones(found.shape, bool)
        once[:, 1:] = found[:, 1:] != found[:, :-1]
        keys.append(found[once])
        numbers.append(np.broadcast_to(rows[:, None], found.shape)[once])
    key, row = np.concatenate(keys), np.concatenate(numbers)
    return key.view(np.int64), row, np.ones(len(key), bool)


def _lines_of(text: str) -> list[str]:
    return text.split("\n")


def _digest(text: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _document(doc: int | None, text: str) -> bytes:
    return _digest(f"{doc}\n{text}")


def _meeting(stream):
    """(key, line, own) of a stream of (key * 2, or one more for a probe; line; short) in order: the rows
    whose key has an index entry and two lines at least. Holds one batch, and of the key that goes on beyond it one row at most."""
    last, first, waits = None, 0, None  # the key that may go on, its first line, the row that waits for another line
    for batch in stream:
        if not batch.num_rows:
            continue
        keys, short = longs(column(batch, "key")), longs(column(batch, "short"))
        own, keys = keys & 1 == 0, keys >> 1
        rows = pa.RecordBatch.from_arrays([pa.array(keys), column(batch, "line"), pa.array(own)], names=["key", "line", "own"])
        runs = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(runs, len(keys)))
        goes_on = last is not None and keys[0] == last
        firsts, indexed = short[runs], own[runs].copy()
        if goes_on:  # a key without an index entry has first None
            indexed[0] = first is not None
            firsts[0] = first if first is not None else 0
        many = np.logical_or.reduceat(short != np.repeat(firsts, sizes), runs)
        if goes_on and first is not None and waits is None:
            many[0] = True  # the key's rows before have gone on already
        keep = np.flatnonzero(np.repeat(indexed & many, sizes))
        if goes_on and waits is not None and many[0]:
            yield waits
            waits = None
        if len(keep):
            yield rows.take(pa.array(keep))
        if not (goes_on and len(runs) == 1):
            last, first = int(keys[-1]), int(firsts[-1]) if indexed[-1] else None
            waits = rows.slice(int(runs[-1]), 1) if indexed[-1] and not many[-1] else None


def line_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, block: int = BLOCK, least: int | None = None) -> DataFrame:
    """(document, doc_id, line_no, line, class, n_links, kept): one row per line of each document.

    Lines are what "\\n" separates; a line of white space only is always kept and is in no class. Equal
    lines are one class; lines of ``least`` characters at least (by default (edits + 1) * SEGMENT; 1 for
    all lines) are linked within ``edits`` edits of characters, and a class holds all that links connect. n_links: the distinct lines that the
    line is linked with. Of a class the line of the smallest doc_id (null last), then line_no, is kept.
    ``document`` is a digest of id and text: rows that agree in both are one document.
    """
    spark = prepared(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))

    def occurrences(stream):
        for batch in stream:
            ids, texts = column(batch, "id").to_pylist(), column(batch, "body").to_pylist()
            for a in range(0, len(ids), 128):
                rows = []
                for doc, text in zip(ids[a : a + 128], texts[a : a + 128], strict=True):
                    text = text or ""
                    document = _document(doc, text)
                    rows += [(document, doc, i, None if not x or x.isspace() else _digest(x)) for i, x in enumerate(_lines_of(text))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["document", "doc_id", "line_no", "line"])

    lines = written(source.mapInArrow(occurrences, "document binary, doc_id long, line_no int, line binary"), "lines")
    least = (edits + 1) * SEGMENT if least is None else max(1, least)
    cut = (edits + 1) * SHORT  # links of shorter lines are found by remainders

    def probes(stream):
        seen: set[bytes] = set()

        def keyed(held, digests):
            key, row, own = segment_keys(held, edits, cut)
            if least < cut:
                key, row, own = (np.concatenate(x) for x in zip((key, row, own), remainder_keys(held, edits, cut), strict=True))
            key = key & -2 | ~own  # the last bit tells an index entry, which thus comes first
            digest = pa.array(digests, pa.binary())
            short = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
            for a in range(0, len(key), 1 << 17):
                part = slice(a, a + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), digest.take(pa.array(row[part])), pa.array(short[row[part]])], names=["key", "line", "short"])

        for batch in stream:
            held, digests, size = [], [], 0
            for text in column(batch, "body").to_pylist():
                for x in _lines_of(text or ""):
                    if len(x) < least or x.isspace() or (d := _digest(x)) in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(d)
                    held.append(x)
                    digests.append(d)
                    size += len(x)
                    if size >= _SLICE:
                        yield from keyed(held, digests)
                        held, digests, size = [], [], 0
            if held:
                yield from keyed(held, digests)

    keyed = source.select("body").mapInArrow(released(probes), "key long, line binary, short long")
    met = keyed.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(released(_meeting), "key long, line binary, own boolean")
    members = written(met.groupBy("key", "line").agg(F.max("own").alias("own")), "met")
    members = written(members.join(written(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes"), "key"), "members")
    wanted = members.select("line").distinct()
    first = lambda x: F.conv(F.hex(F.substring(x, 1, 7)), 16, 10).cast("long")
    suspects = spark.sparkContext.broadcast(bits_of(wanted.select(first("line").alias("short")).distinct(), "short"))

    def texts(stream):
        for batch in stream:
            held: dict[bytes, str] = {}
            for text in column(batch, "body").to_pylist():
                held |= {_digest(x): x for x in _lines_of(text or "") if len(x) >= least and not x.isspace()}
            short = np.array([int.from_bytes(d[:7], "big") for d in held], np.int64)
            at = np.flatnonzero(suspects.value.hits(short)) if len(short) else []
            digests, found = list(held), list(held.values())
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in at], pa.binary()), pa.array([found[i] for i in at], pa.string())], names=["line", "body"])

    bodies = source.select("body").mapInArrow(texts, "line binary, body string").join(wanted, "line", "left_semi").groupBy("line").agg(F.first("body").alias("body"))
    # A key with more members than a task should hold is compared block against block.
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("line"), blocks).cast("int")
    turns = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).cast("long").alias("i"), F.greatest(own, j).cast("long").alias("j")))
    spread = members.select("key", "line", "own", F.explode(turns).alias("turn")).select("key", "turn.i", "turn.j", "line", "own")
    laid = spread.join(bodies, "line").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def verify(stream):
        tested: dict[tuple[bytes, bytes], bool] = {}
        for run in groups(stream, ["key", "i", "j"]):
            digests, found, index = run["line"].to_pylist(), run["body"].to_pylist(), run["own"].to_pylist()
            out, lengths = [], np.fromiter(map(len, found), np.int64, len(found))
            for p in [i for i, x in enumerate(index) if x]:
                for q in np.flatnonzero(np.abs(lengths - lengths[p]) <= edits).tolist():
                    if p == q or index[q] and q < p:
                        continue
                    pair = (min(digests[p], digests[q]), max(digests[p], digests[q]))
                    if pair not in tested:
                        if len(tested) > 200_000:
                            tested.clear()
                        tested[pair] = within(found[p], found[q], edits)
                        if tested[pair]:
                            out.append(pair)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], names=["a", "b"])

    pairs = written(laid.mapInArrow(released(verify), "a binary, b binary").distinct(), "pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("line")).groupBy("line").agg(F.count("*").alias("n_links"))
    found = components(pairs, "a", "b", "line-links")
    roots = links.join(found, links["line"] == found["node"], "left").select(F.col("line").alias("node"), F.coalesce("root", "line").alias("root"), "n_links")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "document", "line_no")
    counted = lines.where("line is not null").groupBy("line").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    classed = counted.join(roots, counted["line"] == roots["node"], "left").select("line", "first", "n", F.coalesce("root", "line").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    classed = written(classed.where("n > 1 or n_links > 0"), "classed")
    tops = classed.groupBy("class").agg(F.min("first").alias("top"))
    known = written(classed.join(tops, "class").select(F.col("line").alias("of"), "class", "n_links", F.col("top.document").alias("top_document"), F.col("top.line_no").alias("top_line")), "line-classes")
    joined = lines.join(known, lines["line"] == known["of"], "left")
    kept = F.col("of").isNull() | ((F.col("document") == F.col("top_document")) & (F.col("line_no") == F.col("top_line")))
    return joined.select("document", "doc_id", "line_no", "line", F.coalesce("class", "line").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), kept.alias("kept"))


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """(doc_id, n_lines, n_kept, n_links, kept_lines), one row per row of ``df`` but that rows which agree
    in id and text are one: its lines, how many stay, the links of its lines, and the numbers (from 0)
    of the lines that stay. Lines of all lengths are linked. A null or empty text is one empty line. An empty table gives no rows; other
    columns are ignored."""
    rows = line_classes(df, id_col, text_col, edits, least=1)
    single = rows.groupBy("document", "doc_id", "line_no").agg(F.max("n_links").alias("n_links"), F.max("kept").alias("kept"))
    report = single.groupBy("document", "doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if("kept").alias("n_kept"), F.sum("n_links").alias("n_links"), F.array_sort(F.collect_list(F.when(F.col("kept"), F.col("line_no")))).alias("kept_lines")
    )
    return report.drop("document")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """The rows of ``df``, each text without the lines that line_classes drops among lines of all lengths. Null texts stay null."""
    own, of, lost = (unused(df, n) for n in ("own_document", "of_document", "lost_lines"))
    gone = line_classes(df, id_col, text_col, edits, least=1).where(~F.col("kept")).groupBy("document").agg(F.collect_set("line_no").alias(lost)).withColumnRenamed("document", of)

    @F.arrow_udf("binary")
    def document(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([_document(d, t or "") for d, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)], pa.binary())

    @F.arrow_udf("string")
    def without(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for text, drop in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
            drop = set(drop or ())
            out.append("\n".join(x for i, x in enumerate(_lines_of(text)) if i not in drop) if text is not None and drop else text)
        return pa.array(out, pa.string())

    rows = df.withColumn(own, document(F.col(id_col).cast("long"), F.col(text_col)))
    joined = rows.join(gone, F.col(own) == F.col(of), "left")
    return joined.withColumn(text_col, without(F.col(text_col), F.col(lost))).drop(own, of, lost)
