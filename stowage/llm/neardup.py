"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 32 symbols of 16 bits, in 8 chunks of 4. Two signatures that differ in at most 15
symbols agree in some chunk but for one symbol at most (pigeonhole: 8 * 2 = 16 > 15). So every allowed
error is enumerated: a chunk gives one key for each symbol left out, 32 keys a signature, and all pairs
within the distance share a key. Members of a key are linked on their full shingle sets: first all of
them with two hubs of the key, then, where that leaves a key's members in several components, those
outside the largest one with all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import bits_of, column, components, groups, longs, numbered, prepared, released, unused, without, written
from stowage.llm.kernels import minhash, mix, set_digest, shingle_sets

SYMBOLS, CHUNK = 32, 4
BLOCK = 2048  # members of a key that one task compares at a time
BLOCK_SHINGLES = 1 << 22  # shingles of members that one task holds at a time, or one document's
MAP_BITS = 4096


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """(rows x 32) keys of (rows x 32) symbols: each chunk with each of its symbols left out."""
    s = signatures.astype(np.uint64)
    out = np.empty((len(s), SYMBOLS), np.uint64)
    for c in range(SYMBOLS // CHUNK):
        for gone in range(CHUNK):
            a, b, d = (s[:, c * CHUNK + i] for i in range(CHUNK) if i != gone)
            place = c * CHUNK + gone
            out[:, place] = mix((a << np.uint64(32) | b << np.uint64(16) | d) + (np.uint64(place + 1) << np.uint64(48)))
    return out.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the intersection of two sorted sets is ``percent`` % of their union at least."""
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def spanning_links(sets: list[np.ndarray], percent: int, roots: list[int] | None = None, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Exact links among sets, as a spanning forest on top of what equal ``roots`` say is connected. Only
    pairs with an ``asked`` member are compared (all, if not given). Bitmaps bound an intersection from
    above, so that few pairs need their sets; a connected pair needs neither."""
    n = len(sets)
    first: dict[int, int] = {}
    parent = [first.setdefault(r, i) for i, r in enumerate(roots if roots is not None else range(n))]

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    sizes = np.array([len(s) for s in sets], np.int64)
    maps = np.zeros((n, MAP_BITS // 8), np.uint8)
    for i, s in enumerate(sets):
        bits = np.zeros(MAP_BITS, bool)
        bits[(s & np.uint64(MAP_BITS - 1)).astype(np.int64)] = True
        maps[i] = np.packbits(bits)
    # Central members first: what they link needs no other partner.
    common = np.zeros(MAP_BITS, np.int64)
    for i in range(0, n, 256):
        common += np.unpackbits(maps[i : i + 256], axis=1).sum(axis=0, dtype=np.int64)
    central = [float(common[np.unpackbits(m).view(bool)].sum()) / max(1, z) for m, z in zip(maps, sizes.tolist(), strict=True)]
    waiting = sorted(np.flatnonzero(asked).tolist() if asked is not None else range(n), key=lambda i: (-central[i], i))
    words, edges = maps.view(np.uint64), []
    for a in waiting:
        more = np.bitwise_count(words & ~words[a]).sum(axis=1, dtype=np.int64)
        less = np.bitwise_count(words[a] & ~words).sum(axis=1, dtype=np.int64)
        bound = np.minimum(sizes - more, sizes[a] - less)
        for b in np.flatnonzero((100 + percent) * bound >= percent * (sizes + sizes[a])).tolist():
            ra, rb = find(a), find(b)
            if ra != rb and linked(sets[a], sets[b], percent):
                parent[rb] = ra
                edges.append((a, b))
    return edges


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``df``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct ``width``-word
    shingles (as 64-bit hashes), or the whole sequence where there are fewer words. Two documents are
    linked if their intersection is ``percent`` % of their union at least. component_id is the smallest
    id that is reachable, and the document with that id is kept. A null text, or one without words, has
    no shingles and no links. Rows that share an id are one document with several sets, which is reachable
    through any of them. A row without an id links with none: its component_id is null, and it is kept. An
    empty table gives no rows; other columns are ignored.
    """
    spark = prepared(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))

    def sign(stream):
        for batch in stream:
            sizes, digests, signed = [], [], []
            for s in shingle_sets(column(batch, "body"), width):
                sizes.append(len(s))
                digests.append(set_digest(s) if len(s) else None)
                signed.append(minhash(s, SYMBOLS).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([column(batch, "id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.binary())], names=["id", "n", "set", "sig"])

    signed = written(source.mapInArrow(released(sign), "id long, n long, set binary, sig binary"), "signed")
    # Equal sets are one node, by the smallest id that has them.
    owned = signed.where("id is not null and n > 0")
    nodes = written(owned.groupBy("set").agg(F.min("id").alias("node"), F.first("sig").alias("sig"), F.first("n").alias("size")), "nodes")
    links, members = _hub_links(source, _members(nodes), width, percent, block)
    # The sets of one id are connected, whatever they hold.
    shared = owned.groupBy("id").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select(F.col("id").alias("of"))
    held = owned.join(shared, F.col("id") == F.col("of")).select("id", F.col("set").alias("own")).distinct()
    same = held.join(nodes, F.col("own") == F.col("set")).select(F.col("id").alias("a"), F.col("node").alias("b"))
    roots = written(components(links.union(same), "a", "b", "links"), "roots")
    more = _open_links(source, members, roots, width, percent, block)
    if not more.isEmpty():
        top = components(more, "a", "b", "root-links").select(F.col("node").alias("low"), F.col("root").alias("lowest"))
        through = roots.join(top, F.col("root") == F.col("low"), "left").select("node", F.coalesce("lowest", "root").alias("root"))
        alone = top.select(F.col("low").alias("node"), F.col("lowest").alias("root")).join(roots.select("node"), "node", "left_anti")
        roots = written(through.union(alone), "roots")
    classes = nodes.select(F.col("set").alias("own"), "node").join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    classes = written(classes.select("own", F.coalesce("root", "node").alias("root")), "classes")
    labelled = signed.select("id", "n", "set").join(classes, F.col("set") == F.col("own"), "left").select("id", "n", F.least(F.col("root"), F.col("id")).alias("root"))
    # All rows of an id have its component, those without words too.
    again = written(signed.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("id").alias("of")), "again")
    if not again.isEmpty():
        least = written(labelled.join(again, F.col("id") == F.col("of")).groupBy("of").agg(F.min("root").alias("least")), "least")
        labelled = labelled.join(least, F.col("id") == F.col("of"), "left").select("id", "n", F.coalesce("least", "root").alias("root"))
    root = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "id"))
    return labelled.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def _members(nodes: DataFrame) -> DataFrame:
    """(key, n, low, high, node, size): the nodes that meet under each key, their number, the smallest and
    the largest; of the keys with the same members only one."""

    def enumerate_keys(stream):
        for batch in stream:
            if batch.num_rows:
                keys = keys_of(np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(longs(column(batch, "node")), SYMBOLS)), pa.array(np.repeat(longs(column(batch, "size")), SYMBOLS))], names=["key", "node", "size"])

    schema = "key long, node long, size long"
    signed = nodes.select("sig", "node", "size")
    keyed = signed.mapInArrow(released(enumerate_keys), schema)
    # Most keys are met once. What repeats is counted first (a hot key is one row a map task) ...
    repeated = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    likely = nodes.sparkSession.sparkContext.broadcast(bits_of(repeated, "key"))

    def only_repeated(stream):
        for batch in enumerate_keys(stream):
            at = np.flatnonzero(likely.value.hits(longs(column(batch, "key"))))
            if len(at):
                yield batch.take(pa.array(at))

    # ... and only the rows that may have such a key are dealt to it.
    met = written(signed.mapInArrow(released(only_repeated), schema).join(repeated, "key"), "met")
    marks = met.groupBy("key", "n").agg(F.bit_xor(F.xxhash64("node")).alias("mark"), F.min("node").alias("low"), F.max("node").alias("high"))
    single = marks.where("low < high").groupBy("n", "mark", "low", "high").agg(F.min("key").alias("key")).select("key", "low", "high")
    return written(met.join(single, "key"), "members")


def _sets_of(source: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(of, shingles): the full sets of the wanted nodes, from their texts. ``wanted`` has them once each."""
    suspects = source.sparkSession.sparkContext.broadcast(bits_of(wanted, "node"))

    def resets(stream):
        for batch in stream:
            ids = longs(column(batch, "id"))
            at = np.flatnonzero(suspects.value.hits(ids))
            if len(at):
                texts = column(batch, "body").take(pa.array(at))
                found = [(i, s.tobytes()) for i, s in zip(ids[at].tolist(), shingle_sets(texts, width), strict=True) if len(s)]
                for k in range(0, len(found), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[k : k + 256], strict=True), (pa.int64(), pa.binary()), strict=True)], names=["of", "shingles"])

    return source.where("id is not null").mapInArrow(released(resets), "of long, shingles binary").join(wanted, F.col("of") == F.col("node"), "left_semi")


_EDGES = "a long, b long"


def _hub_links(source: DataFrame, members: DataFrame, width: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Links of each key's members with two of them, its hubs: the smallest and the largest. A pair is
    compared once, however many keys it has; a hub with many partners is dealt out to several tasks,
    which hold the hub's sets alone."""
    hubs = F.explode(F.when(F.col("n") > 2, F.array("low", "high")).otherwise(F.array("low"))).alias("hub")
    pairs = members.select(hubs, "node").where("hub <> node").select(F.least("hub", "node").alias("x"), F.greatest("hub", "node").alias("y"), "hub").groupBy("x", "y").agg(F.min("hub").alias("hub"))
    pairs = written(pairs.select("hub", F.when(F.col("hub") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("node")), "hub-pairs")
    cells = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cells"))
    cells = written(cells, "cells")
    rows = pairs.join(cells, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("cells")).cast("long").alias("cell"), F.lit(1).cast("long").alias("turn"), "node")
    heads = cells.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1)).alias("cell"), F.lit(0).cast("long").alias("turn"), F.col("hub").alias("node"))
    wanted = written(pairs.select("node").union(cells.select(F.col("hub").alias("node"))).distinct(), "wanted")
    laid = rows.union(heads).join(_sets_of(source, wanted, width), F.col("node") == F.col("of")).drop("of")

    def link(stream):
        last, own = None, []
        for batch in stream:
            out = []
            cells = zip(longs(column(batch, "hub")).tolist(), longs(column(batch, "cell")).tolist(), strict=True)
            for cell, turn, node, data in zip(cells, longs(column(batch, "turn")).tolist(), longs(column(batch, "node")).tolist(), column(batch, "shingles"), strict=True):
                if cell != last:
                    last, own = cell, []
                shingles = np.frombuffer(data.as_buffer(), np.uint64)
                if not turn:
                    own.append(shingles.copy())
                elif any(linked(x, shingles, percent) for x in own):
                    out.append((cell[0], node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    links = laid.repartition("hub", "cell").sortWithinPartitions("hub", "cell", "turn").mapInArrow(released(link), _EDGES)
    return written(links, "hub-links"), members


def _open_links(source: DataFrame, members: DataFrame, roots: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links, as pairs of roots, within the keys whose members the hubs have not all connected: each
    member outside the key's largest component against all members. Both sides of a large key are dealt
    out in blocks, bounded by members and by bytes."""
    known = roots.select(F.col("node").alias("at"), "root")
    rooted = members.where("n > 2").join(known, F.col("node") == F.col("at"), "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("size"))
    shape = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "root", "size")).alias("top"), F.sum("m").alias("m"), F.sum("size").alias("size")).where("parts > 1")
    blocks = lambda m, size: F.greatest(F.ceil(m / block), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    shape = written(shape.select(F.col("key").alias("open"), F.col("top.root").alias("top"), blocks(F.col("m"), F.col("size")).alias("all"), blocks(F.col("m") - F.col("top.m"), F.col("size") - F.col("top.size")).alias("few")), "open")
    if shape.isEmpty():
        return source.sparkSession.createDataFrame([], _EDGES)
    here = written(rooted.join(shape, F.col("key") == F.col("open")).drop("open"), "open-members")
    own_i, own_j = F.pmod(F.xxhash64("node"), F.col("all")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("few")).cast("int")
    asked = F.col("root") != F.col("top")
    across = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda j: F.struct(own_i.alias("i"), j.alias("j"), (asked & (j == own_j)).alias("asked")))
    down = F.filter(F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda i: F.struct(i.alias("i"), own_j.alias("j"), F.lit(True).alias("asked"))), lambda t: t["i"] != own_i)
    turns = F.when(asked, F.concat(across, down)).otherwise(across)
    spread = here.select("key", "node", "root", F.explode(turns).alias("turn")).select("key", F.col("turn.i").cast("long").alias("i"), F.col("turn.j").cast("long").alias("j"), "node", "root", "turn.asked")
    wanted = written(here.select("node").distinct(), "wanted")
    laid = spread.join(_sets_of(source, wanted, width), F.col("node") == F.col("of")).drop("of").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def link(stream):
        for run in groups(stream, ["key", "i", "j"]):
            roots = longs(run["root"].combine_chunks())
            asked = run["asked"].combine_chunks().to_numpy(zero_copy_only=False)
            found = spanning_links([np.frombuffer(x, np.uint64) for x in run["shingles"].to_pylist()], percent, roots.tolist(), asked)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(roots[a]), pa.array(roots[b])], names=["a", "b"])

    return written(laid.mapInArrow(released(link), _EDGES), "open-links")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns. Unlike in near_classes each row is a document
    of its own, with or without an id: of the rows that links connect, the one of the smallest id (null
    last) stays, one of them if they repeat it. Rows without words stay."""
    number, lost = unused(df, "row_no"), unused(df, "gone_no")
    rows = numbered(df, number)
    ids = rows.select(F.col(number).alias("no"), F.col(id_col).cast("long").alias("id"))
    found = near_classes(rows, number, text_col, width, percent).select(F.col("doc_id").alias("of"), "component_id")
    classes = written(ids.join(found, F.col("no") == F.col("of")).select("no", "id", "component_id"), "row-classes")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "no")
    tops = classes.groupBy("component_id").agg(F.min(order).alias("top")).select(F.col("top.no").alias("stays"))
    gone = classes.join(tops, F.col("no") == F.col("stays"), "left_anti").select(F.col("no").alias(lost))
    return without(rows, number, written(gone, "gone"), lost).drop(number)
