"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are words and one end per document; a word is the 64-bit hash of its lower-cased bytes. Three passes:

1. Counts of all tokens of all training documents, as a table. Each task combines its own before shuffling.
2. Training over all training documents. The ``VOCABULARY`` most frequent tokens have vectors, all others
   share one (the class of rare words). Every task starts from the same parameters, runs through all its
   tokens with noise-contrastive estimation (noise from the unigram distribution, the same draws for all
   tokens of a batch, so that scores and gradients are matrix products), and its parameters are averaged
   with those of the others by their numbers of tokens, slice by slice, in two steps.
3. Scoring. The log-probability of a token is its logit less the logarithm of the sum over the whole
   vocabulary, which is a matrix product for a batch of distinct contexts. A rare word gets the class's
   probability times its smoothed share of the class, so probabilities add up to 1 over known and unseen.

The base score needs the count of every token. The ``HEAD`` most frequent ones travel to the tasks (a table
of that fixed size); the other tokens, a few per cent of the text, are joined to the counts by their hash.
None of those is hot, as the frequent ones are in the head.

Defined results: a null or empty text is one end token; a null doc_id is neither held out nor learned from;
repeated rows each get a row and count each; an empty table gives no rows; if nothing can be learned from,
both scores are those of an empty count table (0); other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import filled, slices, text_key
from tarnlake.llm.words import word_hashes
from tarnlake.sources.scratch import settle

VOCABULARY = 4096
HEAD = 1 << 17
DIMENSIONS = 16
NOISE = 16
ROUNDS = 2
BATCH = 2048
RATE = 0.05
SMOOTH = 0.1
END = 0  # the hash that stands for the end of a document
SLICES = 16
_LOG10 = np.log(10.0)


def token_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, each text closed by an end, and how many tokens each text has."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts + 1) - 1
    tokens = np.full(len(hashes) + len(counts), END, np.int64)
    is_word = np.ones(len(tokens), bool)
    is_word[ends] = False
    words = hashes.view(np.int64)
    tokens[is_word] = np.where(words == END, 1, words)
    return tokens, counts + 1


def token_counts(training: DataFrame) -> DataFrame:
    """token, n over all texts of ``training``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16 << 20):
            value, count = np.unique(token_rows(filled(batch["text"]))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count)], names=["token", "n"])

    counted = training.select("text").mapInArrow(rows, "token long, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """The most frequent tokens, by hash, and totals over all tokens."""

    tokens: np.ndarray  # sorted hashes of the head
    counts: np.ndarray
    classes: np.ndarray  # the class of each: 0.. for the vocabulary, ``rare`` for the others
    unigram: np.ndarray  # counts by class; the last is that of all rare words together
    total: int
    distinct: int
    rare_total: int
    rare_distinct: int

    @property
    def rare(self) -> int:
        return len(self.unigram) - 1

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head and whether it is there."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return at, self.tokens[at] == tokens

    def classes_of(self, tokens: np.ndarray) -> np.ndarray:
        at, found = self.find(tokens)
        return np.where(found, self.classes[at] if len(self.classes) else self.rare, self.rare)


def summarised(counts: DataFrame, head: int = HEAD, vocabulary: int = VOCABULARY) -> Counts:
    """At most ``head`` tokens and a few thousand totals reach the driver, whatever the number of distinct tokens.

    Tokens are first counted by the size of their count, in steps of a sixty-fourth of a doubling; the head is all
    tokens above the lowest step at which they are no more than ``head``.
    """
    step = F.floor(F.log2("n") * 64 + 1e-9).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("tokens"), F.sum("n").alias("n")).collect()
    held, lowest = 0, None
    for row in sorted(steps, key=lambda row: -row["step"]):
        held += row["tokens"]
        if held > head:
            break
        lowest = row["step"]
    totals = {"total": sum(row["n"] for row in steps), "distinct": sum(row["tokens"] for row in steps)}
    top = counts.where(step >= lowest).collect() if lowest is not None else []
    top.sort(key=lambda row: (-row["n"], row["token"]))
    tokens = np.array([row["token"] for row in top], np.int64)
    n = np.array([row["n"] for row in top], np.int64)
    classes = np.minimum(np.arange(len(top)), vocabulary)
    total, distinct = totals["total"], totals["distinct"]
    vocabulary = min(vocabulary, len(top))
    rare_total = total - int(n[:vocabulary].sum())
    order = np.argsort(tokens)
    return Counts(
        tokens[order], n[order], classes[order], np.append(n[:vocabulary], rare_total), total, distinct, rare_total,
        max(0, distinct - vocabulary),
    )


@dataclass
class Model:
    """logit(w | context) = sum of the context's vectors . target vector of w + bias of w."""

    contexts: np.ndarray  # classes + 1 (before the text) x dimensions
    targets: np.ndarray  # classes x dimensions
    bias: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
        random = np.random.default_rng(5)
        share = (unigram + SMOOTH) / (unigram + SMOOTH).sum()
        size = len(unigram)
        return cls(
            (random.standard_normal((size + 1, dimensions)) * 0.1).astype(np.float32),
            (random.standard_normal((size, dimensions)) * 0.1).astype(np.float32),
            np.log(share).astype(np.float32),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([self.contexts.ravel(), self.targets.ravel(), self.bias])

    def with_flat(self, flat: np.ndarray) -> Model:
        a, b = self.contexts.size, self.targets.size
        parts = np.split(flat.astype(np.float32), [a, a + b])
        return Model(parts[0].reshape(self.contexts.shape), parts[1].reshape(self.targets.shape), parts[2])

    def copy(self) -> Model:
        return Model(self.contexts.copy(), self.targets.copy(), self.bias.copy())

    def log_normalisers(self) -> np.ndarray:
        """For every context, the logarithm of the sum of its exponentiated logits; by batched products."""
        out = np.empty(len(self.contexts))
        for at in range(0, len(out), 512):
            logits = (self.contexts[at : at + 512] @ self.targets.T + self.bias).astype(np.float64)
            top = logits.max(1)
            out[at : at + 512] = top + np.log(np.exp(logits - top[:, None]).sum(1))
        return out

    def log_probabilities(self, context: np.ndarray, target: np.ndarray, normalisers: np.ndarray) -> np.ndarray:
        logits = np.einsum("ij,ij->i", self.contexts[context], self.targets[target]) + self.bias[target]
        return logits.astype(np.float64) - normalisers[context]


def contexts_of(classes: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """The class before each token; ``start`` before the first of a text."""
    context = np.empty_like(classes)
    context[1:] = classes[:-1]
    context[np.cumsum(counts) - counts] = start
    return context


class Steps:
    """Noise-contrastive steps on a model, each parameter with a rate that falls with its past gradients."""

    def __init__(self, model: Model, log_noise: np.ndarray, rate: float = RATE):
        self.model, self.log_noise, self.rate = model, log_noise, rate
        self.past = [np.ones_like(x) for x in (model.contexts, model.targets, model.bias)]

    def step(self, context: np.ndarray, target: np.ndarray, noise: np.ndarray) -> None:
        """One batch; ``noise`` are the draws that all its tokens share."""
        model, k, classes = self.model, len(noise), len(self.model.bias)
        c, t, s = model.contexts[context], model.targets[target], model.targets[noise]
        prior = self.log_noise + np.log(k)
        true = np.einsum("ij,ij->i", c, t) + (model.bias - prior)[target]
        false = c @ s.T + (model.bias - prior)[noise]
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # how far the token is from being told from noise
        down = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
        by_context, by_target = up[:, None] * t - down @ s, up[:, None] * c
        contexts = np.stack([np.bincount(context, g, classes + 1) for g in by_context.T], 1)
        targets = np.stack([np.bincount(target, g, classes) for g in by_target.T], 1)
        bias = np.bincount(target, up, classes)
        np.add.at(targets, noise, -(down.T @ c))
        np.add.at(bias, noise, -down.sum(0))
        for values, past, gradient in zip((model.contexts, model.targets, model.bias), self.past, (contexts, targets, bias)):
            past += gradient.astype(np.float32) ** 2
            values += (self.rate * gradient / np.sqrt(past)).astype(np.float32)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of slices with the same key, as they stream by."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for group, part, weight, values in zip(*(batch[c].to_pylist() for c in ("group", "slice", "weight", "values"))):
            found = np.frombuffer(values, np.float64)
            if (group, part) in held:
                held[group, part][0] += weight
                held[group, part][1] = held[group, part][1] + found
            else:
                held[group, part] = [weight, found]
    yield _slice_rows([(g, s, w, v) for (g, s), (w, v) in held.items()])


def _slice_rows(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([r[3].tobytes() for r in rows], pa.binary()),
        ],
        names=["group", "slice", "weight", "values"],
    )


def train(training: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """Parameters averaged over all tasks, each of which runs through all its training documents."""
    model = Model.start(counts.unigram)
    share = (counts.unigram + SMOOTH) / (counts.unigram + SMOOTH).sum()
    schema = "group int, slice int, weight long, values binary"
    for _ in range(rounds):
        begin = model

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, seen, task = begin.copy(), 0, TaskContext.get().partitionId()
            random, ladder = np.random.default_rng(17 + task), np.cumsum(share)
            steps = Steps(own, np.log(share).astype(np.float32))
            for batch in slices(batches):
                tokens, sizes = token_rows(filled(batch["text"]))
                target = counts.classes_of(tokens)
                context = contexts_of(target, sizes, len(share))
                for at in range(0, len(target), BATCH):
                    noise = np.minimum(np.searchsorted(ladder, random.random(NOISE)), len(share) - 1)
                    part = slice(at, at + BATCH)
                    steps.step(context[part], target[part], noise)
                seen += len(target)
            if seen:
                parts = np.array_split(own.flat().astype(np.float64) * seen, SLICES)
                yield _slice_rows([(task // 256, s, seen, part) for s, part in enumerate(parts)])

        near = training.select("text").mapInArrow(rows, schema).repartition("group", "slice").mapInArrow(_averaged, schema)
        total = near.withColumn("group", F.lit(0)).repartition("slice").mapInArrow(_averaged, schema)
        held = sorted((row["slice"], row["weight"], row["values"]) for row in total.collect())  # SLICES rows
        if held:
            model = model.with_flat(np.concatenate([np.frombuffer(v, np.float64) / w for _, w, v in held]))
    return model


def scores(docs: DataFrame, held_out, learn) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` and ``learn`` are conditions on the rows of ``docs``.
    """
    training = docs.where(learn)
    counted = settle(token_counts(training), "token-counts")
    counts = summarised(counted)
    model = train(training, counts)
    normalisers = model.log_normalisers()
    tail = pa.struct([("token", pa.int64()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_counts = np.log10(counts.counts + SMOOTH) if len(counts.counts) else np.zeros(1)
        for batch in slices(batches):
            tokens, sizes = token_rows(filled(batch["text"]))
            at, found = counts.find(tokens)
            classes = counts.classes_of(tokens)
            context = contexts_of(classes, sizes, counts.rare + 1)
            begin = np.cumsum(sizes) - sizes
            rare = classes == counts.rare
            known = np.where(found, log_counts[at], 0.0)
            log_p = model.log_probabilities(context, classes, normalisers) / _LOG10 + np.where(rare, known, 0.0)
            lists, ends = [], begin + sizes
            missing = ~found
            for a, b in zip(begin.tolist(), ends.tolist()):
                value, n = np.unique(tokens[a:b][missing[a:b]], return_counts=True)
                lists.append([{"token": v, "n": k} for v, k in zip(value.tolist(), n.tolist())])
            add = lambda x, begin=begin: np.add.reduceat(x, begin)  # noqa: E731  no text is without tokens
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], batch["held_out"], pa.array(sizes)]
                + [pa.array(add(found.astype(np.int64))), pa.array(add(rare.astype(np.int64)))]
                + [pa.array(add(known)), pa.array(add(log_p)), pa.array(lists, pa.list_(tail))],
                names=["doc_id", "text_key", "held_out", "n_tokens", "n_head", "n_rare", "base", "log_p", "tail"],
            )

    keyed = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key"), held_out.alias("held_out"))
    scored = keyed.mapInArrow(
        rows,
        "doc_id long, text_key long, held_out boolean, n_tokens long, n_head long, n_rare long, base double, "
        "log_p double, tail array<struct<token:long,n:long>>",
    )
    scored = settle(scored, "lm-scores")  # read twice
    tails = scored.select("doc_id", "text_key", "tail").dropDuplicates(["doc_id", "text_key"])
    tails = tails.select("doc_id", "text_key", F.explode("tail").alias("t")).select("doc_id", "text_key", "t.token", F.col("t.n").alias("k"))
    joined = tails.join(counted, "token", "left").groupBy("doc_id", "text_key").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("k_known"),
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("k_log"),
    )
    right = joined.withColumnsRenamed({"doc_id": "r_doc", "text_key": "r_key"})
    match = scored["doc_id"].eqNullSafe(right["r_doc"]) & (scored["text_key"] == right["r_key"])
    zero = F.lit(0.0)
    all_base = float(np.log10(counts.total + SMOOTH * (counts.distinct + 1)))
    all_rare = float(np.log10(counts.rare_total + SMOOTH * (counts.rare_distinct + 1)))
    return scored.join(right, match, "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("k_known", F.lit(0))).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("k_log", zero) - F.col("n_tokens") * all_base).alias("base_score"),
        (F.col("log_p") + F.coalesce("k_log", zero) - F.col("n_rare") * all_rare).alias("score"),
    )
