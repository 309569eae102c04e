"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct character n-grams of ``SIZES`` lengths, lower-cased and hashed to ``DIMS`` places. Each has
the log ratio of its smoothed frequencies in toxic and other training texts; those whose ratio stands out from
chance are kept, and a logistic regression is fitted on presence times ratio. The fit runs on the driver over a
bounded sample of labelled rows (``per_class`` of label 1 and twice as many of label 0, the first by a hash of their id among
those of at most ``longest`` characters); the weights, of fixed size, go to the executors, which score every whole text in slices.

Null and empty texts have no features and get the score of the bias alone; null doc_ids are scored but never learnt from;
rows repeated in ``documents`` get the same score; ids with a null label aren't used, and where an id has
labels of both kinds the higher counts. Without toxic or without other training rows every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Box, columns, save, small_batches, with_null, without_null

SIZES = (3, 4, 5)
DIMS = 1 << 20
THRESHOLD = 0.7


@dataclass
class Model:
    place: np.ndarray  # by hashed n-gram: the feature's number from 1, or 0
    weight: np.ndarray  # by feature's number; 0 has none
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        doc, feature = grams(texts, self.place)
        total = np.bincount(doc, weights=self.weight[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _hashes(codes: np.ndarray):
    """For each size, the hash of the n-gram that starts at each place."""
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(codes) - n + 1] * np.uint32(2654435761) + codes[n - 1 :] + np.uint32(n)
        if n in SIZES:
            yield n, (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(12)


def _runs(lengths, chars: int):
    """Places (first, last) of runs of texts of about ``chars`` characters; a longer text is a run of its own."""
    first = 0
    while first < len(lengths):
        last, held = first, 0
        while last < len(lengths) and (last == first or held + lengths[last] <= chars):
            held += lengths[last]
            last += 1
        yield first, last
        first = last


def _known(codes: np.ndarray, own: np.ndarray, place: np.ndarray, most: int | None = None) -> np.ndarray:
    """Distinct keys (text's number * (len(place) + 1) + feature's number: from 1 to len(place)) of the n-grams that ``place`` knows and that begin before
    place ``most``. ``codes``: texts of lengths ``own`` one after the other, each length with a separator."""
    start = np.cumsum(own) - own
    keys = [np.zeros(0, np.int64)]
    for n, h in _hashes(codes) if len(codes) else ():
        f = place[h[:most]]
        at = np.flatnonzero(f)
        d = np.searchsorted(start, at, "right") - 1
        inside = at + n <= start[d] + own[d] - 1
        keys.append(d[inside] * (len(place) + 1) + f[at[inside]])
    return np.unique(np.concatenate(keys))


def grams(texts: list[str], place: np.ndarray, chars: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text's number, feature's number) of the n-grams that ``place`` knows. A text of over ``chars``
    characters goes in slices of as many, each with the characters that its last n-grams reach into."""
    docs, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    codes = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    for first, last in _runs([len(t) for t in texts], chars):
        if len(texts[first]) > chars:
            low, k = texts[first].lower(), np.zeros(0, np.int64)
            for at in range(0, len(low), chars):
                part = codes(low[at : at + chars + max(SIZES) - 1])
                k = np.union1d(k, _known(part, np.array([len(part) + 1], np.int64), place, chars))
        else:
            own = np.array([len(t.lower()) for t in texts[first:last]], np.int64) + 1
            k = _known(codes("\n".join(texts[first:last]).lower()), own, place)
        docs.append(k // (len(place) + 1) + first)
        features.append(k % (len(place) + 1))
    return np.concatenate(docs), np.concatenate(features)


def fit(texts: list[str], labels: np.ndarray, most: int = 4096, floor: float = 3.0, ridge: float = 0.002, rounds: int = 400) -> Model:
    """Log-count ratios, then logistic regression by accelerated gradient descent, classes weighing the same."""
    labels = np.asarray(labels, np.float64)
    n1, n0 = labels.sum(), (1 - labels).sum()
    if not n1 or not n0:
        return Model(np.zeros(DIMS, np.int32), np.zeros(1), -40.0)
    df1, df0 = np.zeros(DIMS), np.zeros(DIMS)
    every = np.arange(1, DIMS + 1, dtype=np.int32)
    lengths = [len(t) for t in texts]
    for first, last in _runs(lengths, 1 << 16):  # here all n-grams are known, and their keys take many times the texts' bytes
        d, f = grams(texts[first:last], every)
        toxic = labels[first + d] > 0
        df1 += np.bincount(f[toxic] - 1, minlength=DIMS)
        df0 += np.bincount(f[~toxic] - 1, minlength=DIMS)
    ratio = np.log((df1 + 1) / (n1 + 2)) - np.log((df0 + 1) / (n0 + 2))
    chance = np.sqrt(1 / (df1 + 1) + 1 / (df0 + 1))
    stands_out = np.abs(ratio) / chance
    kept = np.flatnonzero(stands_out >= floor)
    kept = np.sort(kept[np.argsort(-stands_out[kept], kind="stable")[:most]])
    place = np.zeros(DIMS, np.int32)
    place[kept] = np.arange(1, len(kept) + 1)
    scale = np.concatenate([[0.0], ratio[kept]])
    found, runs = [], list(_runs(lengths, 1 << 19))  # by run: the features of its texts one after the other, and the number of features of each text
    for first, last in runs:
        d, f = grams(texts[first:last], place)
        found.append((first, last, f.astype(np.uint16 if len(scale) <= 1 << 16 else np.int32), np.bincount(d, minlength=last - first)))

    def added(value: np.ndarray) -> np.ndarray:
        """For each text the sum of its features' values."""
        return np.concatenate([np.bincount(np.repeat(np.arange(b - a), n), weights=value[f], minlength=b - a) for a, b, f, n in found])

    def gathered(value: np.ndarray) -> np.ndarray:
        """For each feature the sum of its texts' values."""
        out = np.zeros(len(scale))
        for a, b, f, n in found:
            out += np.bincount(f, weights=np.repeat(value[a:b], n), minlength=len(scale))
        return out

    c = np.where(labels > 0, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(scale)), 0.0
    vw, vb, mw, mb = w.copy(), b, w.copy(), b
    lip = 0.25 * float((c * added(scale * scale)).sum()) + ridge + 0.25
    for t in range(1, rounds + 1):
        z = added(scale * vw) + vb
        r = c * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        gw = scale * gathered(r) + ridge * vw
        w, b = vw - gw / lip, vb - r.sum() / lip
        vw, vb = w + (t - 1) / (t + 2) * (w - mw), b + (t - 1) / (t + 2) * (b - mb)
        mw, mb = w, b
    return Model(place, w * scale, float(b))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 20_000) -> Model:
    """Fit on a bounded sample of the labelled rows whose crc32(doc_id) mod 3 isn't 1.

    Four times as many ids as wanted are looked up, so that long texts can be passed over for the next ones.
    """
    known = columns(labels, doc_id="long", toxic="int").filter("doc_id is not null and toxic is not null")
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    by_hash, most = F.xxhash64("doc_id"), {1: per_class, 0: 2 * per_class}
    picked = [known.filter(F.col("toxic") == k).orderBy(by_hash).limit(4 * n) for k, n in most.items()]
    rows = columns(docs, doc_id="long", text="string").filter(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    held = rows.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # at most 12 * per_class ids
    wanted = save(held.groupBy("toxic", "doc_id").agg(F.min("text").alias("text")), "toxic-sample")
    first = [wanted.select("toxic", "doc_id").filter(F.col("toxic") == k).orderBy(by_hash).limit(n) for k, n in most.items()]
    sample = wanted.join(F.broadcast(first[0].unionByName(first[1])), ["toxic", "doc_id"])  # at most 3 * per_class ids
    parts = sample.select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")).repartition(16)  # a job each
    found = sorted(parts.toLocalIterator())  # a part at a time, so that the driver's heap never holds all texts
    return fit([r["text"] for r in found], np.array([r["toxic"] for r in found], np.float64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (needs text) as a struct ``row`` (of a ``Box``), with ``score`` and ``predicted``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS places

    box = Box(docs)
    same = dict(docs.dtypes)["text"] == "string"  # then each text goes to Python once
    inner = box.rows if same else box.rows.withColumn("__text", box["text"].cast("string"))
    where = f"c{box.names.index('text')}" if same else "__text"

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(where).to_pylist()]
            columns = [batch.column(n) for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sent.value.score(texts))], names=[n for n in batch.schema.names if n != "__text"] + ["score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in box.rows.schema.fields)
    out = inner.mapInArrow(scored, fields + ", score double")
    return out.select(box.struct().alias("row"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    model = train(docs, labels)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for pdf in batches:
            pdf["score"] = sent.value.score(pdf["text"].tolist())
            yield pdf.drop(columns="text")

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = columns(docs, doc_id="long", text="string").select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    out = with_null(without_null(rows).mapInPandas(scored, "doc_id long, held_out boolean, __null boolean, score double"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    return score(docs, train(docs, labels), threshold).filter("predicted = 0").select(*Box(docs).out("row"))
