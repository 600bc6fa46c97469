"""Filling fixed-capacity containers with texts (problem 7).

Texts are measured in tokens. Each full capacity of a longer text is a container of its own, its rest an item;
no other text is split. Items are dealt to shards by content: each text draws two of its tokens, with chances by
their BM25 weights and the same dice for all texts, so that texts alike in their telling tokens draw the same ones
and lie in one shard. A shard holds a BM25 inverted index of its texts. Its longest unused text is the seed of a
container; all its tokens are looked up, the index returns the NEIGHBOURS best unused texts that still fit, and the
longest of them is taken, until nothing fits. Containers with room left are then merged across shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.tokens import TOKENIZERS, build_lexicon, encoder, publish
from quillon.llm.words import slices
from quillon.runtime import cut, dim_join

CAPACITY = 2048
SHARD_ITEMS = 1000  #: about so many items make a shard; larger ones are split
NEIGHBOURS = 16  #: of so many best neighbours that fit the longest is taken
K1, B = 1.2, 0.75
ROOM = 0.95  #: containers filled less than this are merged across shards
DRAWN_ROWS = 500  #: texts whose tokens are weighed at a time
GROUP = 8  #: shards whose containers with room are merged together
ITEMS = "size int, terms array<int>, counts array<int>"


def measured(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, size in tokens, distinct tokens and their counts; null and empty texts are left out."""
    blob = build_lexicon(docs, "text", folder)
    source = publish(docs.sparkSession, blob, "lexicon")
    name = f"{id(source)}-{hash(blob)}"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(source, folder, name)
        for batch in batches:
            for s, e in slices(batch.column(1)):
                ids, size = own(batch.column(1).slice(s, e - s))
                owner = np.repeat(np.arange(e - s), size)
                key, count = np.unique(owner * (1 << 20) + ids, return_counts=True)
                edges = pa.array(np.searchsorted(key >> 20, np.arange(e - s + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(v.astype(np.int32))) for v in (key & ((1 << 20) - 1), count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(size.astype(np.int32)), *lists], ["doc_id", "size", "terms", "counts"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''")
    return rows.mapInArrow(run, f"doc_id {kind}, {ITEMS}")


@dataclass
class Statistics:
    """Number and mean length of all texts, and the weight of each token by the number of texts that hold it (an array over the vocabulary)."""

    texts: int
    mean: float
    idf: np.ndarray

    @classmethod
    def of(cls, frequency: np.ndarray, texts: int, mean: float) -> Statistics:
        return cls(texts, mean, np.log(1 + (texts - frequency + 0.5) / (frequency + 0.5)))

    def weights(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BM25 weight of each token in its text; ``length`` is that of its text."""
        return count * (K1 + 1) / (count + K1 * (1 - B + B * length / self.mean)) * self.idf[term]


def statistics(items: DataFrame) -> Statistics:
    """Over all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(seen))
            own[:len(seen)] += seen
            seen = own
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["term", "n"])

    rows = items.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    term, n = (rows.column(c).to_numpy() for c in ("term", "n"))
    one = items.agg(F.count(F.lit(1)), F.avg("size")).first()
    frequency = np.zeros(int(term.max(initial=-1)) + 1)
    frequency[term] = n
    return Statistics.of(frequency, one[0], float(one[1] or 1))


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(term: np.ndarray, weight: np.ndarray, first: np.ndarray, dice: int) -> np.ndarray:
    """One token of each text, by weight: that of the least exponential waiting time, whose chance is the token's own in all texts."""
    u = ((_hash(term.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(dice)) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    wait = -np.log(u) / weight
    owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(term)]))
    hit = np.flatnonzero(wait == np.minimum.reduceat(wait, first)[owner])
    return term[hit[np.unique(owner[hit], return_index=True)[1]]]


def _drawn_of(batch: pa.RecordBatch, known: Statistics) -> tuple[np.ndarray, np.ndarray]:
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 2]
    for at in range(0, batch.num_rows, DRAWN_ROWS):
        own = batch.slice(at, DRAWN_ROWS)
        terms, counts = (own.column(c) for c in ("terms", "counts"))
        edges = terms.offsets.to_numpy()
        term, count = terms.flatten().to_numpy(), counts.flatten().to_numpy()
        weight = known.weights(term, count, np.repeat(own.column("size").to_numpy(), np.diff(edges)))
        out.append(tuple(drawn(term, weight, edges[:-1] - edges[0], d) for d in (1, 2)))
    return tuple(np.concatenate(x) for x in zip(*out))


class Shards:
    """The shards of each first token: neighbouring tokens of few texts share one, those of many have several by their second token."""

    def __init__(self, counts: np.ndarray) -> None:
        """``counts``: texts per first token, an array over the vocabulary."""
        self.parts = np.maximum(1, -(-counts // SHARD_ITEMS))
        self.base = np.zeros(len(counts), np.int64)
        shard, held = 0, 0
        for t in np.flatnonzero(counts).tolist():
            n = int(counts[t])
            if held and held + n > SHARD_ITEMS:
                shard, held = shard + 1, 0
            self.base[t] = shard
            held += n
            if self.parts[t] > 1:
                shard, held = shard + int(self.parts[t]), 0
        self.number = shard + 1

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.base[first] + (_hash(second.astype(np.uint64)) % self.parts[first].astype(np.uint64)).astype(np.int64)


class Unused:
    """Unused items by length; ``fits`` tells whether one of at most a given length is left."""

    def __init__(self, size: np.ndarray) -> None:
        self.order = np.argsort(size, kind="stable")
        self.sorted = size[self.order]
        self.below = list(range(len(size) + 1))  # nearest unused place at or before, shifted by 1
        self.place = np.argsort(self.order)

    def find(self, i: int) -> int:
        below = self.below
        root = i
        while below[root] != root:
            root = below[root]
        while below[i] != root:
            below[i], i = root, below[i]
        return root

    def take(self, item: int) -> None:
        p = int(self.place[item]) + 1
        self.below[p] = p - 1

    def fit(self, most: int) -> int:
        """The longest unused item of at most this length, -1 if there is none."""
        at = self.find(int(np.searchsorted(self.sorted, most, "right")))
        return int(self.order[at - 1]) if at else -1


class Index:
    """BM25 postings of a shard's texts, with the statistics of all texts."""

    def __init__(self, terms: pa.Array, counts: pa.Array, length: np.ndarray, known: Statistics) -> None:
        n = len(length)
        size = np.diff(terms.offsets.to_numpy())
        owner = np.repeat(np.arange(n), size)
        term, count = terms.flatten().to_numpy(), counts.flatten().to_numpy()
        weight = known.weights(term, count, length[owner])
        order = np.argsort(term, kind="stable")
        kinds, first = np.unique(term[order], return_index=True)
        self.first, self.owner, self.weight, self.n = np.r_[first, len(term)], owner[order], weight[order], n
        self.terms, self.edges = np.searchsorted(kinds, term), np.r_[0, np.cumsum(size)]

    def scores(self, seed: int) -> np.ndarray:
        """Score of every text of the shard for all tokens of the seed."""
        own = self.terms[self.edges[seed]:self.edges[seed + 1]]
        at = [slice(a, b) for a, b in zip(self.first[own].tolist(), self.first[own + 1].tolist())]
        if not at:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.owner[s] for s in at]), np.concatenate([self.weight[s] for s in at]), self.n)


def fill(size: np.ndarray, index: Index | None) -> tuple[np.ndarray, np.ndarray]:
    """Container number and place in it of each item; without an index always the longest that fits is taken."""
    unused = Unused(size)
    box, place = np.full(len(size), -1), np.zeros(len(size), np.int64)
    number = 0
    for seed in np.argsort(-size, kind="stable").tolist():
        if box[seed] >= 0:
            continue
        box[seed] = number
        unused.take(seed)
        room, at, score = CAPACITY - int(size[seed]), 1, None
        while room > 0 and (pick := unused.fit(room)) >= 0:
            if index is not None:
                score = index.scores(seed) if score is None else score
                near = np.flatnonzero((box < 0) & (size <= room))
                if len(near) > NEIGHBOURS:
                    worst = np.partition(score[near], -NEIGHBOURS)[-NEIGHBOURS]
                    near = near[score[near] >= worst]
                pick = int(near[np.lexsort((near, -score[near], -size[near]))[0]])
            box[pick], place[pick] = number, at
            unused.take(pick)
            room, at = room - int(size[pick]), at + 1
        number += 1
    return box, place


def _pack_shard(known: Statistics):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id").combine_chunks()
        size = t.column("rest").to_numpy().astype(np.int64)
        lists = [t.column(c).combine_chunks() for c in ("terms", "counts")]
        lists = [pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        box, place = fill(size, Index(*lists, t.column("size").to_numpy().astype(np.float64), known))
        return pa.table({"doc_id": t.column("doc_id"), "shard": t.column("shard"), "part": t.column("part"), "box": pa.array(box), "place": pa.array(place), "rest": pa.array(size.astype(np.int32))})

    return run


def _merge(t: pa.Table) -> pa.Table:
    t = t.sort_by([("shard", "ascending"), ("part", "ascending"), ("box", "ascending")])
    group, _ = fill(t.column("used").to_numpy().astype(np.int64), None)
    first = np.full(int(group.max()) + 1, -1) if len(group) else group
    first[group[::-1]] = np.arange(len(group))[::-1]
    to = pa.array(first[group])
    names = ("shard", "part", "box")
    return pa.table({n: t.column(n) for n in names} | {f"to_{n}": t.column(n).take(to) for n in names})


def dealt(rests: DataFrame, known: Statistics) -> tuple[DataFrame, int]:
    """The items with their shard and part, and the number of shards.

    Counts of the first tokens (at most the vocabulary) come to the driver. A shard that is too large all the
    same, as of copies, is split by hash.
    """
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(np.stack(_drawn_of(batch, known), 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].astype(np.int64)) for i in (0, 1)] + [pa.array(n)], ["one", "two", "n"])

    pairs = cut(rests.select("size", "terms", "counts").mapInArrow(draw, "one long, two long, n long").groupBy("one", "two").agg(F.sum("n").alias("n")), "drawn")
    per = pairs.groupBy("one").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(known.idf) + 1, np.int64)
    counts[per.column("one").to_numpy()] = per.column("n").to_numpy()
    shards = Shards(counts)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shards.of(*(batch.column(i).to_numpy() for i in (0, 1)))), batch.column(2)], ["shard", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards.of(*_drawn_of(batch, known)))], [*batch.schema.names, "shard"])

    sizes = pairs.mapInArrow(number, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    parts = sizes.select("shard", F.ceil(F.col("n") / (1.25 * SHARD_ITEMS)).alias("_parts")).where("_parts > 1")
    schema = ", ".join([f"{n} {k}" for n, k in rests.dtypes] + ["shard long"])
    placed = dim_join(rests.mapInArrow(place, schema), parts, ["shard"], "left")
    return placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.coalesce("_parts", F.lit(1)))).drop("_parts"), shards.number


def pack(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """container, doc_id, start, length, place: every token of every text in exactly one container.

    Null and empty texts take no place. Texts of exactly the capacity fill one container. A doc_id that occurs
    again is packed again. Ties of length go to the more similar text, then to the smaller doc_id. An empty
    table gives no containers; other columns are ignored.
    """
    items = cut(measured(documents, folder).where("size > 0"), "items")
    known = statistics(items)
    rests = items.withColumn("rest", F.expr(f"size % {CAPACITY}")).where("rest > 0").select("doc_id", "size", "rest", "terms", "counts")
    placed, shards = dealt(rests, known)
    kind = documents.schema["doc_id"].dataType.simpleString()
    packed = cut(placed.repartition(max(shards, 8), "shard", "part").groupBy("shard", "part").applyInArrow(
        _pack_shard(known), f"doc_id {kind}, shard long, part long, box long, place long, rest int"), "packed")
    roomy = packed.groupBy("shard", "part", "box").agg(F.sum("rest").cast("long").alias("used")).where(f"used < {int(CAPACITY * ROOM)}")
    groups = max(1, -(-shards // GROUP))
    moves = cut(roomy.withColumn("group", F.pmod(F.xxhash64("shard", "part", "box"), F.lit(groups))).groupBy("group").applyInArrow(
        lambda t: _merge(t.select(["shard", "part", "box", "used"])), "shard long, part long, box long, to_shard long, to_part long, to_box long"), "moves")
    final = packed.join(moves, ["shard", "part", "box"], "left")
    names = ("shard", "part", "box")
    whole = F.concat_ws("-", F.lit("s"), *[F.coalesce(f"to_{n}", n) for n in names])
    stays = F.struct(*[F.coalesce(f"to_{n}", n) for n in names]) == F.struct(*names)
    moved = F.when(stays, F.lit(0)).otherwise(F.col("box") + 1)
    sizes = items.select("doc_id", "size").where(f"size > {CAPACITY}")
    rest = final.select(whole.alias("container"), "doc_id", F.col("rest").alias("length"), F.struct(moved, "shard", "part", "place").alias("order"))
    long = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / CAPACITY).cast("int") - 1)))
    pieces = long.select(F.concat_ws("-", F.lit("d"), "doc_id", "k").alias("container"), "doc_id", (F.col("k") * CAPACITY).alias("start"), F.lit(CAPACITY).alias("length"), F.lit(0).alias("place"))
    exact = items.where(f"size = {CAPACITY}").select(F.concat_ws("-", F.lit("d"), "doc_id", F.lit(0)).alias("container"), "doc_id", F.lit(0).alias("start"), F.lit(CAPACITY).alias("length"), F.lit(0).alias("place"))
    starts = sizes.select("doc_id", (F.floor(F.col("size") / CAPACITY) * CAPACITY).cast("int").alias("start")).dropDuplicates(["doc_id"])
    placed = rest.join(starts, "doc_id", "left").select(
        "container", "doc_id", F.coalesce("start", F.lit(0)).alias("start"), "length", (F.row_number().over(Window.partitionBy("container").orderBy("order")) - 1).alias("place"))
    return placed.unionByName(pieces).unionByName(exact)
