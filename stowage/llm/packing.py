"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

An individual is a set of bins. Crossover injects whole well-filled bins of one parent into the other,
takes out the bins that hold the same documents, and puts what was displaced back by best fit. Shards of
the documents start from best fit; a shard that is not at its lower bound is evolved on several islands,
each a task of its own, whose elites move on round a ring between rounds. Between epochs well-filled bins
stay, and the documents of the other bins migrate to fewer shards.
"""

from __future__ import annotations

import functools
import os
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import column, groups, longs, prepared, released, written
from stowage.llm.kernels import WordTable, gather, spans

CAPACITY = 4096
SHARD_ITEMS = 32768
ELITE = 0.995  # the fill from which a bin stays between epochs
ISLANDS, POPULATION, ROUNDS, GENERATIONS = 3, 4, 3, 8


class Plan:
    """Bins of items and what is left in each. Best fit is the lowest bit at or above a length."""

    def __init__(self, capacity: int):
        self.capacity, self._mask = capacity, 0
        self._open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.items: list[list[int]] = []
        self.left: list[int] = []

    def add(self, items: list[int], left: int) -> None:
        self._open[left].append(len(self.items))
        self.items.append(items)
        self.left.append(left)
        self._mask |= 1 << left

    def best_fit(self, order: list[int], lengths: list[int]) -> Plan:
        mask, spare, items, rest, capacity = self._mask, self._open, self.items, self.left, self.capacity
        for i in order:
            n = lengths[i]
            fits = mask >> n
            if fits:
                left = n + (fits & -fits).bit_length() - 1
                at = spare[left].pop()
                if not spare[left]:
                    mask ^= 1 << left
                items[at].append(i)
                rest[at] = left = left - n
            else:
                at, left = len(items), capacity - n
                items.append([i])
                rest.append(left)
            spare[left].append(at)
            mask |= 1 << left
        self._mask = mask
        return self

    @functools.cached_property
    def fitness(self) -> tuple[int, int]:
        """Fewer bins are better; among as many, the ones filled less evenly (their squares)."""
        return -len(self.items), sum((self.capacity - x) ** 2 for x in self.left)

    def dumps(self, n: int) -> bytes:
        """The bin of each of ``n`` items, as little-endian int32."""
        out = np.empty(n, "<i4")
        for b, items in enumerate(self.items):
            out[items] = b
        return out.tobytes()

    @classmethod
    def loads(cls, data: bytes, lengths: list[int], capacity: int) -> Plan:
        bins: list[list[int]] = []
        for i, b in enumerate(np.frombuffer(data, "<i4").tolist()):
            while len(bins) <= b:
                bins.append([])
            bins[b].append(i)
        out = cls(capacity)
        for items in bins:
            out.add(items, capacity - sum(lengths[i] for i in items))
        return out


def best_fit_decreasing(lengths: list[int], capacity: int) -> Plan:
    return Plan(capacity).best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths)


def lower_bound(lengths: list[int], capacity: int) -> int:
    return -(-sum(lengths) // capacity)


class Island:
    """A population of plans for the same items."""

    def __init__(self, lengths: list[int], capacity: int, plans: list[Plan], seed: int, population: int = POPULATION):
        self.lengths, self.capacity, self.draw, self.population = lengths, capacity, random.Random(seed), population
        self.plans = sorted(plans, key=lambda p: p.fitness, reverse=True)[:population]
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i]) if len(self.plans) < population else []
        while len(self.plans) < population:  # best fit in an order that is a little off
            off = sorted(order, key=lambda i: -lengths[i] * self.draw.uniform(0.8, 1))
            self.plans.append(Plan(capacity).best_fit(off, lengths))

    @property
    def elite(self) -> Plan:
        return max(self.plans, key=lambda p: p.fitness)

    def grow(self, generations: int) -> Island:
        least = lower_bound(self.lengths, self.capacity)
        for _ in range(generations):
            if len(self.elite.items) <= least:
                break
            child = self._cross(*self.draw.sample(self.plans, 2))
            if self.draw.random() < 0.5:
                child = self._mutated(child)
            worst = min(range(len(self.plans)), key=lambda i: self.plans[i].fitness)
            if child.fitness >= self.plans[worst].fitness:
                self.plans[worst] = child
        return self

    def _rebuilt(self, kept: list[tuple[list[int], int]], loose: list[int]) -> Plan:
        out = Plan(self.capacity)
        for items, left in kept:
            out.add(list(items), left)
        return out.best_fit(sorted(loose, key=lambda i: -self.lengths[i]), self.lengths)

    def _cross(self, a: Plan, b: Plan) -> Plan:
        best = sorted(range(len(b.items)), key=lambda i: b.left[i])[: max(1, len(b.items) // 2)]
        injected = [(b.items[i], b.left[i]) for i in self.draw.sample(best, self.draw.randint(1, len(best)))]
        inside = bytearray(len(self.lengths))
        for items, _ in injected:
            for i in items:
                inside[i] = 1
        kept, loose = [], []
        for items, left in zip(a.items, a.left, strict=True):
            if any(inside[i] for i in items):
                loose += [i for i in items if not inside[i]]
            else:
                kept.append((items, left))
        return self._rebuilt(kept + injected, loose)

    def _mutated(self, a: Plan) -> Plan:
        poor = sorted(range(len(a.items)), key=lambda i: -a.left[i])[: max(2, len(a.items) // 10)]
        gone = {*self.draw.sample(poor, min(len(poor), 2)), *self.draw.sample(range(len(a.items)), min(len(a.items), 2))}
        return self._rebuilt([(x, a.left[i]) for i, x in enumerate(a.items) if i not in gone], [i for g in gone for i in a.items[g]])


def evolve(lengths: list[int], capacity: int = CAPACITY, seed: int = 0, islands: int = ISLANDS, rounds: int = ROUNDS, generations: int = GENERATIONS) -> list[list[int]]:
    """Bins of items (lengths 1 to capacity), as few as the search finds, on islands of one process. It
    ends when their number is the lower bound ceil(sum / capacity), which best fit alone often reaches."""
    first, least = best_fit_decreasing(lengths, capacity), lower_bound(lengths, capacity)
    if len(first.items) <= least:
        return first.items
    worlds = [Island(lengths, capacity, [first], seed * islands + i) for i in range(islands)]
    for _ in range(rounds):
        elites = [w.grow(generations).elite for w in worlds]
        if any(len(e.items) <= least for e in elites):
            break
        worlds = [Island(lengths, capacity, [*w.plans, elites[i - 1]], w.draw.randrange(2**32)) for i, w in enumerate(worlds)]
    return max((w.elite for w in worlds), key=lambda p: p.fitness).items


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_MARKS = ".,;:!?*$%&#"
_LETTERS = "^[a-zß-öø-ÿÀ-ÖØ-Þ]+$"
_JOINED = 64


class WordIds:
    """Token ids of texts, as uint32. Runs between ASCII white space are encoded once: the tokenizer drops
    white space, so that a text's ids are those of its runs, one after another. Nor does a token cross
    from an ASCII letter or digit to the marks at a run's end, and A-Z count as a-z. A text that holds a
    special token's string, in any case, is encoded as a whole."""

    def __init__(self, path: str, most: int = 400_000):
        self.tokenizer, self.table = _tokenizer(path), WordTable(self._learn, most)
        self.specials = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary, mark = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # the tokens that end a word
        if mark:
            self.last[[n for t, n in vocabulary.items() if t.endswith(mark)]] = True

    def _coded(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of new words. Words of plain letters are joined by spaces, for fewer calls, and
        told apart by the tokens that end a word."""
        plain = pc.match_substring_regex(new, _LETTERS).to_numpy(zero_copy_only=False) if self.last.any() else np.zeros(len(new), bool)
        sizes, parts = np.zeros(len(new), np.int64), {}
        letters, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        for a in range(0, len(letters), 64 * _JOINED):
            at = letters[a : a + 64 * _JOINED]
            words = new.take(pa.array(at)).to_pylist()
            for k, ids in zip(range(0, len(at), _JOINED), self._coded([" ".join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)]), strict=True):
                own = at[k : k + _JOINED]
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(own):
                    sizes[own] = np.diff(ends, prepend=0)
                    parts.update(zip(own.tolist(), np.split(ids, ends[:-1]), strict=True))
                else:
                    others = np.append(others, own)
        for a in range(0, len(others), 4096):
            at = others[a : a + 4096]
            for i, ids in zip(at.tolist(), self._coded(new.take(pa.array(at)).to_pylist()), strict=True):
                sizes[i], parts[i] = len(ids), ids
        return np.concatenate([parts[i] for i in range(len(new))]) if len(new) else np.zeros(0, np.uint32), sizes

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        runs = lists.flatten().dictionary_encode()
        words, number = runs.dictionary, runs.indices.to_numpy(zero_copy_only=False)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        core = pc.ascii_rtrim(words, characters=_MARKS)
        closed = pc.and_(pc.not_equal(core, words), pc.match_substring_regex(core, "[0-9a-z]$"))
        core = pc.if_else(closed, core, words)
        both = pa.chunked_array([core, self._tails(words, core)]).dictionary_encode().combine_chunks()
        flat, starts, sizes = self.table(both.dictionary)
        own = both.indices.to_numpy(zero_copy_only=False)
        halves = np.stack([own[: len(words)], own[len(words) :]], axis=1).ravel()  # core, tail, core, tail ...
        flat = gather(flat, starts[halves], sizes[halves])
        sizes = sizes[halves].reshape(-1, 2).sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        bounds = lists.offsets.to_numpy(zero_copy_only=False)
        bounds = bounds - bounds[0]
        counts = np.concatenate([[0], np.cumsum(sizes[number])])[bounds]
        return gather(flat, starts[number], sizes[number]), np.diff(counts)

    @staticmethod
    def _tails(words: pa.Array, core: pa.Array) -> pa.Array:
        """What follows each core in its word."""
        data, offsets = _bytes_of(words)
        begin, end = offsets[:-1] + pc.binary_length(core).to_numpy(zero_copy_only=False), offsets[1:]
        sizes = end - begin
        out = np.zeros(len(words) + 1, np.int32)
        np.cumsum(sizes, out=out[1:])
        return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(out), pa.py_buffer(gather(data, begin, sizes))])

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty. Reads some megabytes of texts at a time."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special, low = np.zeros(len(texts), bool), pc.ascii_lower(texts)
        for content in self.specials:
            special |= pc.match_substring(low, content).to_numpy(zero_copy_only=False)
        for at, end in spans(texts):
            ids, counts = self._split(texts.slice(at, end - at))
            stops = np.cumsum(counts)
            for i in range(end - at):
                yield self._coded([texts[at + i].as_py()])[0] if special[at + i] else ids[stops[i] - counts[i] : stops[i]]


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), offsets


@functools.lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One a worker, so that its tasks share what is known."""
    return WordIds(path)


def document_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids if asked for): each whole text's ids and ``end_id``,
    cut into pieces of ``capacity`` ids where it is longer. A null or empty text is its ``end_id``; the
    string of a special token gives that token's id, as in the tokenizer."""
    spark = prepared(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 5 + keep_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
    tail, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(stream):
        encode = word_ids(path)
        for batch in stream:
            rows: list[tuple] = []
            for doc, ids in zip(column(batch, "doc_id").to_pylist(), encode(column(batch, "body")), strict=True):
                data = ids.astype("<u4").tobytes() + tail
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: 5 + keep_ids])
                if len(rows) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return source.mapInArrow(released(cut), schema)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids if asked for): all pieces of all
    documents, in sequences of at most ``capacity`` ids without a gap.

    A null or empty text is one piece of one id. A null id stays null, repeated rows are documents of
    their own, an empty table gives no rows. Other columns are ignored. Shards are drawn by a hash of a
    number of the row, so that no id is hot; a piece of ``capacity`` ids is a sequence by itself.
    """
    cut = document_pieces(df, path, id_col, text_col, end_id, capacity, keep_ids)
    pieces = written(cut.withColumn("no", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == capacity).select("*", (-1 - F.col("no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < capacity)
    rest, places, epoch = short.select("no", "length"), [], 0
    n = rest.count()
    while n:
        shards = -(-n // shard_items)
        packed = written(_places(_packed_shards(rest, epoch, shards, capacity), epoch, capacity), "packed")
        last = shards == 1
        if not last:
            left = packed.where(~F.col("elite")).count()
            last = 4 * left > n
        places.append((packed if last else packed.where("elite")).select(F.col("no").alias("of"), "sequence_id", "offset"))
        rest, n, epoch = packed.where(~F.col("elite")).select("no", "length"), 0 if last else left, epoch + 1
    out = whole
    if places:
        out = whole.unionByName(short.join(functools.reduce(DataFrame.union, places), F.col("no") == F.col("of")).drop("of"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


_SHARD = "shard long, island long, numbers binary, lengths binary, plan binary, fewest boolean"


def _shard_row(shard: int, island: int, numbers: bytes, lengths: list[int], plan: Plan, capacity: int) -> pa.RecordBatch:
    row = (shard, island, numbers, np.array(lengths, "<i4").tobytes(), plan.dumps(len(lengths)), len(plan.items) <= lower_bound(lengths, capacity))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], names=["shard", "island", "numbers", "lengths", "plan", "fewest"])


def _packed_shards(rest: DataFrame, epoch: int, shards: int, capacity: int) -> DataFrame:
    """A row for each shard of ``rest``: its items, their lengths and the best plan that the islands find."""
    tasks = min(shards, max(1, rest.sparkSession.sparkContext.defaultParallelism * 64))

    def start(stream):
        for run in groups(stream, ["shard"]):
            run = run.sort_by("no")
            lengths = longs(run["length"].combine_chunks()).tolist()
            yield _shard_row(run["shard"][0].as_py(), 0, longs(run["no"].combine_chunks()).astype("<i8").tobytes(), lengths, best_fit_decreasing(lengths, capacity), capacity)

    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("no", F.lit(epoch)), F.lit(shards))).repartition(tasks, "shard").sortWithinPartitions("shard")
    first = written(dealt.mapInArrow(released(start), _SHARD), "shards")
    done, worlds = first.where("fewest"), first.where("not fewest")
    if worlds.isEmpty():
        return first
    worlds = worlds.withColumn("island", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ISLANDS - 1).cast("long")))).select(first.columns)
    for turn in range(ROUNDS):
        worlds = written(_round(worlds, tasks, epoch * ROUNDS + turn, capacity), "worlds")
        if worlds.where("not fewest").isEmpty():
            break

    def best(stream):
        for run in groups(stream, ["shard"]):
            lengths = np.frombuffer(run["lengths"][0].as_py(), "<i4").tolist()
            plans = [Plan.loads(x, lengths, capacity) for x in run["plan"].to_pylist()]
            yield _shard_row(run["shard"][0].as_py(), 0, run["numbers"][0].as_py(), lengths, max(plans, key=lambda p: p.fitness), capacity)

    found = worlds.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(released(best), _SHARD)
    return done.unionByName(written(found, "best"))


def _round(worlds: DataFrame, tasks: int, turn: int, capacity: int) -> DataFrame:
    """Each island of each shard evolves in a group of its own; its elite goes on to the next island."""

    def live(stream):
        for run in groups(stream, ["shard", "island"]):
            shard, own, numbers = run["shard"][0].as_py(), run["island"][0].as_py(), run["numbers"][0].as_py()
            lengths = np.frombuffer(run["lengths"][0].as_py(), "<i4").tolist()
            plans = [Plan.loads(x, lengths, capacity) for x in sorted(set(run["plan"].to_pylist()))]
            island = Island(lengths, capacity, plans, (turn * ISLANDS + own) * 1_000_003 + shard).grow(GENERATIONS)
            for plan in [island.elite] if len(island.elite.items) <= lower_bound(lengths, capacity) else island.plans:
                yield _shard_row(shard, own, numbers, lengths, plan, capacity)
            yield _shard_row(shard, (own + 1) % ISLANDS, numbers, lengths, island.elite, capacity)

    dealt = worlds.repartition(tasks * ISLANDS, "shard", "island").sortWithinPartitions("shard", "island")
    return dealt.mapInArrow(released(live), _SHARD)


def _places(shards: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """(no, length, sequence_id, offset, elite): where the plan of each shard puts its items."""

    def put(stream):
        for batch in stream:
            for shard, numbers, lengths, plan in zip(*(column(batch, c).to_pylist() for c in ("shard", "numbers", "lengths", "plan")), strict=True):
                numbers, lengths, plan = np.frombuffer(numbers, "<i8"), np.frombuffer(lengths, "<i4").astype(np.int64), np.frombuffer(plan, "<i4").astype(np.int64)
                order = np.argsort(plan, kind="stable")
                ends = np.cumsum(lengths[order])
                new = np.append(True, plan[order][1:] != plan[order][:-1])
                offset = np.empty(len(plan), np.int64)
                offset[order] = ends - lengths[order] - np.repeat((ends - lengths[order])[new], np.diff(np.append(np.flatnonzero(new), len(plan))))
                elite = np.bincount(plan, weights=lengths)[plan] >= ELITE * capacity
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(lengths), pa.array((np.int64(epoch) << 56) | (np.int64(shard) << 24) | plan), pa.array(offset), pa.array(elite)], names=["no", "length", "sequence_id", "offset", "elite"])

    return shards.mapInArrow(released(put), "no long, length long, sequence_id long, offset long, elite boolean")
