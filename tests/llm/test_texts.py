"""Encoding, packing and languages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import cells, languages, packing, tokens
from quillon.llm.lexicon import Lexicon
from quillon.llm.words import words_of

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokens.ranks(tokens.TOKENIZERS), special_tokens={})


ALPHABET = ["'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\r\n", "\t", "a", "Z", "é", "中", "1", "½", "!", "…", " ", "​", "　", "\x1c", "\x85", "😀", "é", "'S", "<|endoftext|>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join), min_size=1, max_size=5))
def test_words_agree_with_the_pattern(texts):
    import regex

    words, count = words_of(pa.array([*texts, None]))
    own = words.to_pylist()
    at = np.r_[0, np.cumsum(count)]
    # the pattern's white space is the Unicode property, without the separators 1C to 1F
    pattern = regex.compile(PATTERN.replace(r"\s", r"[\p{White_Space}]").replace(r"[^[\p{White_Space}]", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    for i, t in enumerate(texts):
        assert own[at[i]:at[i + 1]] == pattern.findall(t)
    assert count[-1] == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50000), min_size=1, max_size=4), max_size=40))
def test_lexicon_is_exact_and_minimal(words):
    words = {w.decode("latin-1").encode(): v for w, v in words.items()}
    lexicon = Lexicon.of(np.load(__import__("io").BytesIO(Lexicon.build(words).dump())))
    order = sorted(words)
    asked = [*order, *(w + b"x" for w in order), *(w[:-1] for w in order if len(w) > 1)]
    got = lexicon.rank(pa.array([w.decode("utf-8", "ignore") for w in asked]))
    for w, r in zip(asked, got.tolist()):
        w = w.decode("utf-8", "ignore").encode()
        assert (r >= 0) == (w in words)
        if r >= 0:
            assert order[r] == w and lexicon.ids[lexicon.start[r]:lexicon.start[r + 1]].tolist() == words[w]
    # shared suffixes: no more states than a trie has
    assert len(lexicon.final) <= 1 + sum(map(len, order))


def test_encoding_of_the_corpus(spark, plain):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r[0]: list(r[1]) for r in tokens.encode(docs.withColumn("key", F.lit("x"))).collect()}
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    assert got == {k: plain.encode_ordinary(t or "") for k, t in texts.items()}


def test_encoding_of_odd_texts(spark, plain):
    rng = random.Random(3)
    texts = [None, "", " ", "\n", "<|endoftext|>", "a" * 200_000, "=" * 100_000, " " * 50_000, "x y " * 600_000, *("".join(rng.choice(ALPHABET) for _ in range(30)) for _ in range(300))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] * 2, "doc_id long, text string, ids string")
    rows = tokens.encode(df).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert list(r["ids"]) == plain.encode_ordinary(texts[r["doc_id"]] or "")
    assert tokens.encode(df.limit(0)).count() == 0


# ---------------------------------------------------------------- packing


def test_every_token_is_packed_once(spark, plain):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = packing.pack(docs).toPandas()
    sizes = {r[0]: len(plain.encode_ordinary(r[1] or "")) for r in docs.select("doc_id", "text").collect()}
    assert got.groupby("container").length.sum().max() <= packing.CAPACITY
    for doc, own in got.groupby("doc_id"):
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == sizes[doc]
        assert len(own) == 1 or sizes[doc] > packing.CAPACITY
    assert set(got.doc_id) == {k for k, n in sizes.items() if n}
    assert got.container.nunique() <= 1.03 * -(-sum(sizes.values()) // packing.CAPACITY) + 1
    assert (got.groupby("container").place.max() + 1 == got.groupby("container").size()).all()


def test_packing_of_edge_sizes(spark):
    text = lambda n: " a" * n
    sizes = [2048, 2049, 4096, 1, 1, 1024, 1024, 2047, 5000]
    df = spark.createDataFrame([(i, text(n), 1) for i, n in enumerate(sizes)] + [(90, None, 1), (91, "", 1)], "doc_id long, text string, size int")
    got = packing.pack(df).toPandas()
    assert got.length.sum() == sum(sizes) and got.groupby("container").length.sum().max() <= 2048
    assert got.container.nunique() == -(-sum(sizes) // 2048)
    assert packing.pack(df.limit(0)).count() == 0 and packing.pack(df.where("doc_id >= 90")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 2047), min_size=1, max_size=60))
def test_filling(sizes):
    size = np.array(sizes)
    box, place = packing.fill(size, None)
    assert np.bincount(box, size).max() <= packing.CAPACITY and (box >= 0).all()
    assert len({*zip(box.tolist(), place.tolist())}) == len(sizes)


def _index(texts):
    lists = pa.array(texts, pa.list_(pa.int32()))
    known = packing.Statistics.of(np.bincount(np.concatenate(texts)), len(texts), float(np.mean([len(t) for t in texts])))
    return packing.Index(lists, pa.array([[1] * len(t) for t in texts], pa.list_(pa.int32())), np.array([len(t) for t in texts], float), known), known


def test_index_prefers_the_like():
    index, _ = _index([[1, 2, 3, 50], [1, 2, 3, 60], [7, 8, 9, 50], [7, 8, 9, 60]])
    score = index.scores(0)
    assert score[1] > score[2] and score[1] > score[3]


def _topics(rng, n, topics=12):
    """Texts of distinct tokens: common ones, and ones of their topic."""
    topic = rng.integers(0, topics, n)
    texts = [np.unique(np.r_[rng.integers(0, 200, 30), 1000 + 100 * t + rng.integers(0, 100, 20)]).tolist() for t in topic]
    return topic, texts, rng.integers(30, 1500, n).astype(np.int64)


def test_retrieval_brings_the_like_together():
    """Pairs of one topic within containers: far more than by best fit, at about as many containers."""
    topic, texts, size = _topics(np.random.default_rng(5), 600)
    index, _ = _index(texts)

    def alike(box):
        pairs = [(topic[m][:, None] == topic[m][None])[np.triu_indices(len(m), 1)] for m in (np.flatnonzero(box == b) for b in range(box.max() + 1))]
        return np.concatenate(pairs).mean()

    by_index, plain = packing.fill(size, index)[0], packing.fill(size, None)[0]
    assert alike(by_index) > 3 * alike(plain)
    assert by_index.max() + 1 <= 1.03 * -(-size.sum() // packing.CAPACITY)


def test_shards_hold_the_like():
    """The two tokens drawn by a text are those of its copies, and more often those of its topic than of others."""
    topic, texts, _ = _topics(np.random.default_rng(6), 400)
    _, known = _index(texts)
    term = np.concatenate(texts)
    first = np.r_[0, np.cumsum([len(t) for t in texts])[:-1]]
    weight = known.weights(term, np.ones(len(term)), np.repeat([len(t) for t in texts], [len(t) for t in texts]))
    one = packing.drawn(term, weight, first, 1)
    assert all(o in t for o, t in zip(one.tolist(), texts))
    assert (packing.drawn(np.r_[term, term], np.r_[weight, weight], np.r_[first, first + len(term)], 1)[400:] == one).all()
    same = one[:, None] == one[None]
    np.fill_diagonal(same, False)
    of_topic = topic[:, None] == topic[None]
    assert same[of_topic].mean() > 1.5 * same[~of_topic].mean()


def test_shards_of_heavy_tokens():
    counts = np.zeros(100, np.int64)
    counts[[3, 4, 5, 50]] = [10, 20, 5 * packing.SHARD_ITEMS, 7]
    shards = packing.Shards(counts)
    second = np.arange(1000)
    assert len(set(shards.of(np.full(1000, 5), second).tolist())) == 5
    of = {t: set(shards.of(np.full(1000, t), second).tolist()) for t in (3, 4, 5, 50)}
    assert of[3] == of[4] and not of[3] & of[5] and not of[50] & of[5] and max(max(o) for o in of.values()) < shards.number


def test_copies_are_spread_over_shards(spark, monkeypatch):
    """A third of all texts are one text; no shard takes them all, and nothing is lost."""
    monkeypatch.setattr(packing, "SHARD_ITEMS", 20)
    rows = [(i, "the same words again and again" if i % 3 == 0 else f"words of text {i} " * (i % 40 + 1)) for i in range(300)]
    items = packing.measured(spark.createDataFrame(rows, "doc_id long, text string"), tokens.TOKENIZERS)
    placed, _ = packing.dealt(items.withColumn("rest", F.col("size")).select("doc_id", "size", "rest", "terms", "counts"), packing.statistics(items))
    sizes = placed.groupBy("shard", "part").count().toPandas()["count"]
    assert sizes.sum() == 300 and sizes.max() < 90


# ---------------------------------------------------------------- languages


def test_cells_of_each_layout():
    prose = "This is a paragraph of prose that is long enough to count."
    percent = f"# %% [markdown]\r\n# Title\r\n\r\n{prose}\r\n\r\n| a | b |\r\n|---|---|\r\n\r\n# %% [code] In[1]\r\n# {prose}\r\n\r\n# %% [output] Out[1]\r\n{prose}\r\n"
    prompt = f"Text:\n{prose}\n\n$$ {prose} $$\n\n*{prose}*\nIn [ ]:\n'{prose}'\nOut [ ]:\n{prose}\n"
    fenced = f":::cell text\n```\n{prose}\n```\n\nshort\n\n- {prose}\n- {prose}\n:::cell code \n{prose}\n:::cell output 3\n{prose}"
    assert cells.prose(percent, "percent") == [prose]
    assert cells.prose(prompt, "prompt") == [prose]
    assert cells.prose(fenced, "fenced") == [f"{prose} {prose}"]
    assert cells.prose(fenced, None) == [f"{prose} {prose}"]
    assert cells.prose(prose, "percent") == [prose]
    assert cells.prose(None, None) == cells.prose("", "prompt") == cells.prose(" \n ", "x") == []


def test_held_out_accuracy(spark):
    """Documents with one language whose label denotes a language: label noise bounds the agreement from above."""
    folder = "/root/testdata/sf0.01"
    docs, names = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/lang_labels.parquet")
    found = languages.segments(docs.withColumn("_label", F.lit(1)), names).toPandas()
    assert len(found) == docs.count()
    some = found[(found.segments.map(len) > 0) & found.denoted.notna()]
    assert (some.lang == some.denoted).mean() > 0.9
    assert (some.confidence.between(0, 1 + 1e-9)).all()
    empty = found[found.segments.map(len) == 0]
    assert empty.lang.isna().all() and (empty.confidence == 0).all()
    odd = languages.undenoted(spark.createDataFrame(found[["doc_id", "denoted", "segments"]].head(0).to_dict("records"), f"doc_id long, denoted string, segments {languages.SEGMENTS}"))
    assert odd.count() == 0


def test_label_noise_is_found():
    rng = random.Random(5)
    words = [["the", "window", "shows", "values"], ["der", "wert", "zeigt", "fenster"], ["het", "venster", "toont", "waarde"]]
    texts, labels = [], []
    for i in range(300):
        c = i % 3
        texts.append(" ".join(rng.choice(words[c]) for _ in range(12)))
        labels.append(0 if rng.random() < 0.05 else (2 if c == 0 and rng.random() < 0.2 else c))
    model = languages.fit(texts, np.array(labels), np.arange(300) // 3, 3)
    got = model.probabilities([" ".join(w * 3) for w in words])
    assert got.argmax(1).tolist() == [0, 1, 2] and got.max(1).min() > 0.5


def test_languages_of_tables_without_rows_or_labels(spark):
    schema = "doc_id long, text string, lang string, layout string"
    names = spark.createDataFrame([("en", "en"), ("german", "de")], "label string, lang string")
    df = spark.createDataFrame([(1, None, " EN ", None), (2, "x" * 50, "??", "percent")], schema)
    assert languages.segments(df.limit(0), names).count() == 0
    rows = {r["doc_id"]: r for r in languages.segments(df, names).collect()}
    assert rows[1]["denoted"] == "en" and rows[2]["denoted"] is None and rows[2]["confidence"] == pytest.approx(0.5)
