"""Encoding of a corpus with a public byte-level tokenizer (problem 6).

A first pass counts the words of all documents. The most frequent ones become a lexicon with their ids (a
minimal acyclic transducer, see ``lexicon``), written to the shared folder and mapped into memory by the
workers. The second pass cuts each batch into words, looks its distinct words up in the lexicon, merges unseen
ones exactly by the tokenizer's ranks, and spreads the ids over the documents.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.lexicon import Lexicon
from quillon.llm.words import slices, words_of
from quillon.runtime import new_path, write_bytes

TOKENIZERS = "/opt/tokenizers"
LEXICON_WORDS = 50_000  #: words in the lexicon; all others are merged by rank, with the same result
WORD_BYTES = 64  #: longer words stay out of the lexicon
COUNT_ROWS = 200_000  #: distinct words a task holds before it hands its counts on
MERGED_KEPT = 100_000  #: merged words a worker remembers


@cache
def ranks(folder: str, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def merger(folder: str):  # noqa: ANN201
    import tiktoken

    # the pattern is unused: words come from ``words_of``
    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks(folder), special_tokens={})._core_bpe.encode_single_piece


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """word, count over all documents; words longer than WORD_BYTES are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            whole = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": whole.column("word"), "n": whole.column("n_sum")})

        for batch in batches:
            texts = batch.column(0)
            for s, e in slices(texts):
                words, _ = words_of(texts.slice(s, e - s))
                words = words.filter(pc.less_equal(pc.binary_length(words), WORD_BYTES))
                counts = pc.value_counts(words)
                held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                if len(held) > 8:
                    held = [merged()]
                    if held[0].num_rows > COUNT_ROWS:
                        yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str, folder: str) -> bytes:
    top = count_words(docs, text).where("word <> ''").orderBy(F.desc("n"), "word").limit(LEXICON_WORDS).select("word").toArrow()
    encode = merger(folder)
    return Lexicon.build({w: encode(w) for w in (x.encode() for x in top.column("word").to_pylist())}).dump()


def publish(spark: SparkSession, blob: bytes, name: str):  # noqa: ANN201
    """A function that gives the array in a worker, mapped from the shared folder or, if that isn't a file system, from the copy that each executor fetches of it."""
    path = new_path(spark, name)
    write_bytes(spark, path, blob)
    if path.startswith("file:") or path.startswith("/"):
        return _Mapped("/" + path.removeprefix("file:").lstrip("/"))
    spark.sparkContext.addFile(path)
    return _Fetched(path.rsplit("/", 1)[1])


class _Mapped:
    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self) -> np.ndarray:
        return np.load(self.path, mmap_mode="r")


class _Fetched:
    def __init__(self, name: str) -> None:
        self.name = name

    def __call__(self) -> np.ndarray:
        return np.load(SparkFiles.get(self.name), mmap_mode="r")


class Encoder:
    """Encodes arrays of texts in a worker."""

    def __init__(self, lexicon: Lexicon, folder: str) -> None:
        self.lexicon, self.merge, self.merged = lexicon, merger(folder), {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each text."""
        words, count = words_of(texts)
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        kinds, at = coded.dictionary, coded.indices.to_numpy()
        rank = self.lexicon.rank(kinds)
        known = rank >= 0
        size = np.zeros(len(kinds), np.int64)
        size[known] = self.lexicon.start[rank[known] + 1] - self.lexicon.start[rank[known]]
        begin = np.zeros(len(kinds), np.int64)
        begin[known] = self.lexicon.start[rank[known]]
        rest = np.flatnonzero(~known)
        extra: list[int] = []
        base = len(self.lexicon.ids)
        if len(self.merged) > MERGED_KEPT:
            self.merged.clear()
        for i, w in zip(rest.tolist(), kinds.take(pa.array(rest)).to_pylist()):
            ids = self.merged.get(w)
            if ids is None:
                ids = self.merged[w] = self.merge(w.encode())
            begin[i], size[i] = base + len(extra), len(ids)
            extra += ids
        pool = np.r_[self.lexicon.ids, np.array(extra, np.int64)].astype(np.int32)
        n = size[at]
        ends = np.cumsum(n)
        out = pool[np.repeat(begin[at] - ends + n, n) + np.arange(ends[-1])]
        edges = np.r_[0, ends][np.r_[0, np.cumsum(count)]]
        return out, np.diff(edges)


_encoders: dict[str, Encoder] = {}


def encoder(source, folder: str, key: str) -> Encoder:  # noqa: ANN001
    """The worker's encoder, kept between tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Lexicon.of(source()), folder)
    return _encoders[key]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """key, ids: the ids of each text without special tokens.

    Null and empty texts give an empty list; special tokens' strings are ordinary text. Texts of any length
    are encoded whole. Repeated rows give repeated rows, an empty table an empty result. Other columns are
    ignored, whatever their names.
    """
    blob = build_lexicon(docs, text, folder)
    source = publish(docs.sparkSession, blob, "lexicon")
    name = f"{id(source)}-{hash(blob)}"
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(source, folder, name)
        for batch in batches:
            texts = batch.column(1)
            for s, e in slices(texts):
                ids, size = own(texts.slice(s, e - s))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), lists], ["key", "ids"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
