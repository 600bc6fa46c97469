"""Languages of documents and of their paragraphs (problem 8).

A multinomial logistic regression on TF-IDF character n-grams (hashed) is trained with follow-the-regularised-
leader and elastic-net penalties on a bounded sample of labelled documents: at most about SAMPLE_DOCS documents
of each language and SAMPLE_PARAGRAPHS paragraphs of each. Labels are partly wrong, so paragraphs whose label
models of the other documents doubt are left out. A temperature fitted on held-out judgements calibrates the
confidence. Every paragraph of every document is then scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.cells import prose
from quillon.llm.tokens import publish
from quillon.llm.words import slices
from quillon.runtime import dim_join

GRAMS = (1, 2, 3)
BUCKETS = 1 << 16
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 150, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
EPOCHS, BATCH = 2, 64
SCALE = 20.0  #: sum of the feature values of a text
FOLDS, ROUNDS = 3, 2  #: of the judgement of labels
PRESENT = 0.5  #: least confidence of a language that is present


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of letters and single gaps; ordered by text within each n."""
    joined = "\n".join(texts).lower()
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    size = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)[:len(code)]
    plain = (code < 128) & ~((code >= 97) & (code <= 122)) & (code != 10)
    code = np.where(plain, 32, code)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code, owner = code[keep].astype(np.uint64), owner[keep]
    buckets, owners = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        # the hash of n characters from each place on
        h = h[: len(code) - n + 1] * np.uint64(1000003) + code[n - 1:] if len(code) >= n else h[:0]
        if n not in GRAMS:
            continue
        whole = owner[n - 1:] == owner[: len(h)]
        for k in range(n):
            whole &= code[k:len(code) - n + 1 + k] != 10
        if n == 1:
            whole &= code != 32
        x = h[whole] + np.uint64(n)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append(((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[: len(h)][whole])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """weights (BUCKETS, languages), idf per bucket, bias and temperature."""

    weights: np.ndarray
    idf: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        n, c = len(texts), self.weights.shape[1]
        bucket, owner = grams(texts)
        total = np.zeros((n, c), np.float64)
        # texts are contiguous within each n: sum stretches of one text, each once in a block
        at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        again = np.flatnonzero(np.diff(owner[at], prepend=-1) < 0)
        edges = np.unique(np.r_[0, again, np.arange(0, len(at), 1000), len(at)])
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            first, last = at[s], at[e] if e < len(at) else len(owner)
            total[owner[at[s:e]]] += np.add.reduceat(self.weights[bucket[first:last]], at[s:e] - first, axis=0)
        norm = np.bincount(owner, self.idf[bucket], n) if len(owner) else np.zeros(n)
        return self.bias + SCALE * total / np.maximum(norm, 1e-9)[:, None]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, classes: int, seed: int = 0) -> Model:
    """Follow the regularised leader over mini-batches; labels are class numbers."""
    bucket, owner = grams(texts)
    key, tf = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_counts=True)
    doc, feature = key // BUCKETS, key % BUCKETS
    df = np.bincount(feature, minlength=BUCKETS)
    idf = (np.log((1 + len(texts)) / (1 + df)) + 1).astype(np.float32)
    value = tf * idf[feature]
    value = SCALE * value / np.maximum(np.bincount(doc, value, len(texts)), 1e-9)[doc]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    z, g2 = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    bz, bias = np.zeros(classes), np.zeros(classes)
    rng = np.random.default_rng(seed)

    def weights(rows) -> np.ndarray:  # noqa: ANN001
        zz = z[rows]
        return np.where(np.abs(zz) <= L1, 0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(g2[rows])) / ALPHA + L2))

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            part = order[s:s + BATCH]
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in part])
            local = np.repeat(np.arange(len(part)), first[part + 1] - first[part])
            rows, inv = np.unique(feature[at], return_inverse=True)
            w = weights(rows)
            x = np.zeros((len(part), len(rows)), np.float32)
            x[local, inv] = value[at]
            error = softmax(bias + x @ w)
            error[np.arange(len(part)), labels[part]] -= 1
            grad = x.T @ error
            old = g2[rows]
            z[rows] += grad - (np.sqrt(old + grad**2) - np.sqrt(old)) / ALPHA * w
            g2[rows] = old + grad**2
            bz += error.sum(0)
            bias = -bz * 0.002
    w = weights(slice(None))
    return Model((w * idf[:, None]).astype(np.float32), idf, bias, 1.0)


def fit(texts: list[str], labels: np.ndarray, doc: np.ndarray, classes: int) -> Model:
    """The model from paragraphs whose label models of the other documents confirm, then the temperature.

    Documents are dealt to FOLDS; each fold is judged by a model trained without it, so no model can have
    learned the label it judges. The second time the models are trained on confirmed paragraphs only. The
    temperature is fitted on the judgements of confirmed paragraphs by those models.
    """
    trust = np.ones(len(texts), bool)
    z = np.zeros((len(texts), classes))
    for _ in range(ROUNDS):
        for k in range(FOLDS):
            own, other = np.flatnonzero(trust & (doc % FOLDS != k)), np.flatnonzero(doc % FOLDS == k)
            if len(own) and len(other):
                z[other] = train([texts[i] for i in own], labels[own], classes).logits([texts[i] for i in other])
        trust = z.argmax(1) == labels
    if not trust.any():
        trust[:] = True
    own = np.flatnonzero(trust)
    model = train([texts[i] for i in own], labels[own], classes)
    choice = [(-np.log(np.maximum(softmax(z[own] / t)[np.arange(len(own)), labels[own]], 1e-12)).mean(), t) for t in np.geomspace(0.3, 4, 40)]
    model.temperature = float(min(choice)[1])
    return model


def denoted(docs: DataFrame, names: DataFrame, label: str = "lang") -> DataFrame:
    """The language that the trimmed, lower-cased label of each row denotes, as ``_denoted``; null if none."""
    fixed = names.select(F.col("label").alias("_label"), F.col("lang").alias("_denoted")).dropDuplicates(["_label"])
    return dim_join(docs.withColumn("_label", F.lower(F.trim(F.regexp_replace(F.col(label), r"^\s+|\s+$", "")))), fixed, ["_label"], "left").drop("_label")


def learn(docs: DataFrame, names: DataFrame) -> tuple[list[str], Model]:
    """Languages and model from a bounded sample of ``denoted`` rows (columns doc_id, text, layout, _denoted)."""
    languages = sorted(r[0] for r in names.select("lang").distinct().collect())
    count = {r[0]: r[1] for r in docs.where("_denoted is not null and text is not null").groupBy("_denoted").count().collect()}
    share = F.coalesce(*[F.when(F.col("_denoted") == k, F.lit(min(1.0, SAMPLE_DOCS / n))) for k, n in count.items()], F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / 1_000_003.0

    def paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, k, p) for d, t, y, k in zip(*(c.to_pylist() for c in b.columns)) for p in prose(t, y)[:SAMPLE_PARAGRAPHS]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([str(r[0]) for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["doc", "lang", "text"])

    sample = docs.where(draw < share).select("doc_id", "text", "layout", "_denoted").mapInArrow(paragraphs, "doc string, lang string, text string")
    rows = sample.toArrow().sort_by([("doc", "ascending"), ("text", "ascending")])
    if not rows.num_rows:
        return languages, Model(np.zeros((BUCKETS, max(1, len(languages))), np.float32), np.ones(BUCKETS, np.float32), np.zeros(max(1, len(languages))), 1.0)
    number = {k: i for i, k in enumerate(languages)}
    doc = np.cumsum([1, *(a != b for a, b in zip(rows["doc"].to_pylist()[1:], rows["doc"].to_pylist()))])
    return languages, fit(rows["text"].to_pylist(), np.array([number[k] for k in rows["lang"].to_pylist()]), doc, len(languages))


def pack(model: Model) -> np.ndarray:
    return np.concatenate([np.array([model.weights.shape[1], model.temperature]), model.bias, model.idf, model.weights.ravel()]).astype(np.float32)


def unpack(flat: np.ndarray) -> Model:
    c = int(flat[0])
    bias, idf = np.asarray(flat[2:2 + c], np.float64), np.asarray(flat[2 + c:2 + c + BUCKETS])
    return Model(np.ascontiguousarray(flat[2 + c + BUCKETS:]).reshape(BUCKETS, c), idf, bias, float(flat[1]))


SEGMENTS = "array<struct<segment:int,lang:string,confidence:double,chars:int>>"
_models: dict[str, Model] = {}


def segments(documents: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, denoted (language of the label or null), lang and confidence of the document, and its segments.

    A segment is a paragraph of prose in a text cell, numbered in order of the text; texts are read whole. The
    document's language is that with the largest sum of probabilities weighted by length, its confidence the
    share of it. Null, empty and blank texts, and those without prose, have no segments and a null language
    with confidence 0. Repeated rows give repeated rows; an empty table gives an empty result. Other columns
    are ignored. Without any labelled row all languages are equally likely.
    """
    docs = denoted(documents.select("doc_id", F.col("text").cast("string"), F.col("layout").cast("string"), "lang"), names).drop("lang")
    languages, model = learn(docs, names)
    flat = pack(model)
    import io

    sink = io.BytesIO()
    np.save(sink, flat)
    source = publish(documents.sparkSession, sink.getvalue(), "languages")
    name = f"{id(source)}-{hash(flat.tobytes())}"
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models.clear()
            _models[name] = unpack(source())
        own = _models[name]
        for batch in batches:
            for s, e in slices(batch.column(1)):
                part = batch.slice(s, e - s)
                found = [prose(t, y) for t, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                size = np.array([len(f) for f in found], np.int64)
                texts = [p for f in found for p in f]
                p = own.probabilities(texts) if texts else np.zeros((0, len(languages)))
                best, top = p.argmax(1), p.max(1) if len(p) else np.zeros(0)
                chars = np.array([len(t) for t in texts], np.int64)
                edges = np.r_[0, np.cumsum(size)]
                number = np.arange(len(texts)) - np.repeat(edges[:-1], size)
                inner = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), pa.array(languages).take(pa.array(best)), pa.array(top), pa.array(chars.astype(np.int32))], ["segment", "lang", "confidence", "chars"])
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), inner)
                mass = np.zeros((len(found), len(languages)))
                np.add.at(mass, np.repeat(np.arange(len(found)), size), p * chars[:, None])
                share = mass / np.maximum(mass.sum(1), 1e-9)[:, None]
                lang = pa.array([languages[i] if n else None for i, n in zip(share.argmax(1).tolist(), size.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), lang, pa.array(share.max(1)), lists], ["doc_id", "denoted", "lang", "confidence", "segments"])

    return docs.select("doc_id", "text", "layout", "_denoted").mapInArrow(run, f"doc_id {kind}, denoted string, lang string, confidence double, segments {SEGMENTS}")


def undenoted(found: DataFrame) -> DataFrame:
    """doc_id and each language present in a document that its label doesn't denote."""
    present = F.array_distinct(F.transform(F.filter("segments", lambda s: s["confidence"] >= PRESENT), lambda s: s["lang"]))
    other = F.filter(present, lambda x: ~x.eqNullSafe(F.col("denoted")))
    return found.select("doc_id", F.explode(other).alias("lang"))
