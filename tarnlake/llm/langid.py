"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is lower-cased, everything but letters becomes a blank, and its 1- to 3-grams are counted in
``BUCKETS`` hash buckets over the whole text. A bucket's weight is (1 + log count) times its inverse
document frequency, and the vector is scaled to length 1. Document frequencies are counted over all
training documents. The weights are trained by follow-the-regularised-leader with an L1 and an L2 penalty, on
the ``SAMPLE`` training documents with the smallest hash of their doc_id, and the ``EACH`` such documents of every
language, so that every language in the training documents can be predicted (a documented bound: at most ``SAMPLE``
+ ``EACH`` x languages sparse vectors of at most ``BUCKETS`` entries reach the driver, one for a doc_id); a fifth of
them is kept apart to fit the temperature that the scores are divided by.

Defined results: a null text, and one without letters (Unicode's: ``str.isalpha``), is ``und`` with score 0; so is
every text if nothing can be learned from; a null doc_id is neither learned from nor held out; documents with a null
lang are not learned from; of repeated rows with one doc_id the least (lang, text) is learned from, and each gets a
row; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import filled, hashed_sample, slices
from tarnlake.sources.scratch import settle

BUCKETS = 1 << 14
SAMPLE = 4_000
EACH = 50
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_AT_ONCE = 64


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(texts: list[str]) -> np.ndarray:
    """A row of bucket counts for each text."""
    plain = [f" {_OTHER.sub(' ', text.lower())} " for text in texts]
    code = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(plain)), [len(p) for p in plain])
    total = np.zeros(len(texts) * BUCKETS, np.int64)
    mixed = np.zeros(len(code), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(code) - order + 1
        if n <= 0:
            break
        mixed = mixed[:n] * np.uint64(0x100000001B3) + (code[order - 1 :] + np.uint64(order))
        if order in ORDERS:
            whole = owner[:n] == owner[order - 1 :]  # within one text
            bucket = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
            keys = owner[:n][whole] * BUCKETS + bucket[whole].astype(np.int64)
            total += np.bincount(keys, minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (or 0)."""
    weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * idf
    length = np.linalg.norm(weights, axis=1, keepdims=True)
    return weights / np.where(length > 0, length, 1)


def document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training documents each bucket occurs, and how many documents there are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, documents = np.zeros(BUCKETS, np.int64), 0
        for batch in slices(batches):
            texts = filled(batch["text"]).to_pylist()
            documents += len(texts)
            for at in range(0, len(texts), _AT_ONCE):
                found += (gram_counts(texts[at : at + _AT_ONCE]) > 0).sum(0)
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(found[seen], documents))], names=["bucket", "n"]
        )

    counted = training.select("text").mapInArrow(rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {row["bucket"]: row["n"] for row in counted.collect()}  # at most BUCKETS + 1 rows
    documents = found.pop(-1, 0)
    frequencies = np.zeros(BUCKETS, np.int64)
    frequencies[list(found)] = list(found.values())
    return frequencies, documents


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        return softmax((vectors @ self.weights + self.bias) / self.temperature)


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(-1, keepdims=True))
    return scores / scores.sum(-1, keepdims=True)


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: int,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.01,
    l2: float = 0.1,
    epochs: int = 4,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial model on sparse rows, trained one row at a time."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    order = np.random.default_rng(11)

    def leader(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, values = rows[i]
            w = leader(z[at], n[at])
            error = softmax(values @ w)
            error[labels[i]] -= 1
            gradient = values[:, None] * error[None, :]
            squared = gradient**2
            z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / alpha * w
            n[at] += squared
    weights = leader(z, n)
    return weights[:BUCKETS], weights[BUCKETS]


def calibrated(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest log loss; as if one more row had been wrong, so that it stays finite."""
    best, found = np.inf, 1.0
    for temperature in np.geomspace(0.05, 20, 121):
        p = np.maximum(softmax(scores / temperature), 1e-300)
        loss = -np.log(p[np.arange(len(labels)), labels]).sum() - np.log(p).mean()
        if loss < best:
            best, found = loss, float(temperature)
    return found


def sampled_ids(training: DataFrame, sample: int, each: int) -> DataFrame:
    """The ids with the smallest hashes: ``sample`` of all, and ``each`` of every language."""
    ids = settle(training.groupBy("doc_id").agg(F.min("lang").alias("lang")), "training-ids")
    # Of each language only ids whose hash is below a threshold are ranked, somewhat more than ``each``.
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    share = F.least(F.lit(1.0), F.lit(1.25 * (each + 100)) / F.col("n"))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = ids.join(F.broadcast(counts), "lang").where(rank < share * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(rank, "doc_id"))
    of_each = near.withColumn("place", place).where(F.col("place") <= each).select("doc_id")
    return hashed_sample(ids.select("doc_id"), "doc_id", sample, ids.count()).union(of_each).distinct()


def train(docs: DataFrame, sample: int = SAMPLE, each: int = EACH) -> Model | None:
    """A model of the documents in ``docs`` that have a lang; None if there are none."""
    training = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    training = training.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    frequencies, documents = document_frequencies(training)
    if not documents:
        return None
    idf = np.log((1 + documents) / (1 + frequencies)) + 1
    chosen = sampled_ids(training, sample, each)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = []
            for text in filled(batch["text"]).to_pylist():
                row = weighted(gram_counts([text]), idf)[0]
                at = np.flatnonzero(row)
                packed.append(at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["lang"], pa.array(packed, pa.binary())], names=["doc_id", "lang", "packed"]
            )

    # At most ``sample`` + ``each`` x languages ids: small enough to send to every task.
    picked = training.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id")
    picked = picked.agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.lang", "row.text")
    found = picked.mapInArrow(vectors, "doc_id long, lang string, packed binary").collect()
    found = sorted(found, key=lambda row: row["doc_id"])
    if not found:
        return None
    languages = sorted({row["lang"] for row in found})
    labels = np.array([languages.index(row["lang"]) for row in found])
    rows = []
    for row in found:
        n = len(row["packed"]) // 6
        at = np.frombuffer(row["packed"], "<u2", n).astype(np.int64)
        rows.append((np.append(at, BUCKETS), np.append(np.frombuffer(row["packed"], "<f4", n, 2 * n), 1.0)))
    apart = np.random.default_rng(12).random(len(rows)) < 0.2
    kept = np.flatnonzero(~apart) if not apart.all() else np.arange(len(rows))
    weights, bias = follow_the_leader([rows[i] for i in kept], labels[kept], len(languages))
    temperature = 1.0
    if apart.any():
        held = np.flatnonzero(apart)
        scores = np.array([rows[i][1][:-1] @ weights[rows[i][0][:-1]] + bias for i in held])
        temperature = calibrated(scores, labels[held])
    return Model(languages, idf, weights, bias, temperature)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score. Only the text is looked at."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = filled(batch["text"]).to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            lettered = [i for i, text in enumerate(texts) if model and has_letter(text)]
            for at in range(0, len(lettered), _AT_ONCE):
                part = lettered[at : at + _AT_ONCE]
                p = model.probabilities(weighted(gram_counts([texts[i] for i in part]), model.idf))
                best = p.argmax(1)
                scores[part] = p[np.arange(len(part)), best]
                for i, k in zip(part, best.tolist()):
                    names[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")
