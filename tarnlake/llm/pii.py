"""PII by bootstrapped contextual extraction.

Every whole text is scanned for entities whose form alone gives them away (e-mail and IP addresses, card
and phone numbers); they are always reported, and they are the seeds. What else looks like an identifier
(a string with ``MIN_DIGITS`` digits that no seed covers) is only a candidate. The lexical patterns of a
seed or candidate are, from the narrowest to the widest, the two words before it, the word before, the word behind (a
quote or bracket that touches it is no word), and its own shape: which runs of how many digits or letters,
and what stands between them. Patterns and instances (values) form a graph:

* a pattern's score is the summed score of the instances at it, over all its occurrences in the whole corpus,
  whatever follows; it needs ``MIN_SEEDS`` different known values, and a shape as many seeds: found values show where
  identifiers stand, but not what they look like;
* an instance's score is 1 for a known value, else the best score among its patterns.

At first the seeds are known. Spark scores the graph for ``ROUNDS`` rounds; the candidates at patterns of at
least ``CONFIDENT`` become known, and the graph is scored anew with the patterns that now have enough known values,
until no new value appears. The candidates at the patterns that are confident then are reported as kind ``id``,
and so is every other place where their values stand.
Patterns without ``MIN_SEEDS`` different values of any kind can never score, so only the others are counted in the
corpus, once: a bit map of fixed size (``BITS`` bits, 512 KiB) lets each task skip other words and pairs before its
counts are joined exactly. Counts are combined in each task, so a frequent pair is one row a task.

Defined results: a null text is an empty one; a null doc_id is an id like any other; repeated rows each get
a row, and a value counts once for a pattern however often it occurs; an empty table gives no rows; other
columns are not looked at. A candidate without words around it has only its shape.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import SPACE, filled, known_bits, slices, text_key, unpacked
from tarnlake.llm.words import mix, runs, word_hashes
from tarnlake.sources.scratch import settle

KINDS = ("email", "ip", "card", "phone", "id")
MIN_DIGITS = 5
MIN_SEEDS = 3
CONFIDENT = 0.5
ROUNDS = 3
BITS = 1 << 22
COUNTED_AT_ONCE = 1 << 20

# The entity rules.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT_RUN = re.compile(r"[0-9][^\x20\x09-\x0D]*")
RUN = re.compile(r"[0-9]+|[A-Za-z]+")
_SALTS = {"before": 0x51A7E1, "behind": 0x51A7E2, "shape": 0x51A7E3}  # patterns of different forms never meet


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from the @ backwards: the part before it holds no @ itself."""
    found, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            free = m.end()
    return found


def ips(text: str) -> list[tuple[int, int]]:
    """Numbers joined by dots, four at a time from the left, as a leftmost search takes them."""
    found = []
    for m in NUMBERS.finditer(text):
        if m.group().count(".") < 3:
            continue
        numbers, at = m.group().split("."), m.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in four):
                found.append((at, end))
            at = end + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


def seed_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end), by kind and place."""
    found = [(0, *s) for s in emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        found += [(1, *s) for s in ips(text)] + [(2, *s) for s in cards(text)] + [(3, *s) for s in phones(text)]
    return found


def candidate_spans(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Strings between white space with enough digits that touch no seed, without punctuation at the ends."""
    found, free, taken, i = [], 0, sorted(s[1:] for s in seeds), 0
    for m in DIGIT_RUN.finditer(text):
        start, end = m.span()
        while start > free and text[start - 1] not in SPACE:
            start -= 1
        free = end
        if sum("0" <= c <= "9" for c in text[start:end]) < MIN_DIGITS:
            continue
        while not text[end - 1].isalnum():
            end -= 1
        while not text[start].isalnum():
            start += 1
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i == len(taken) or taken[i][0] >= end:
            found.append((start, end))
    return found


def words_before(text: str, start: int) -> str:
    """The two words before the one that holds ``start``, or as many as there are."""
    def back(at: int, inside: bool) -> int:
        while at and (text[at - 1] not in SPACE) == inside:
            at -= 1
        return at

    end = at = back(start, True)
    for _ in range(2):
        at = back(back(at, False), True)
    return text[at:end].strip(SPACE)


def word_behind(text: str, end: int) -> str:
    """The word after the one that ends at or after ``end``, or nothing."""
    n = len(text)

    def ahead(at: int, inside: bool) -> int:
        while at < n and (text[at] not in SPACE) == inside:
            at += 1
        return at

    start = ahead(ahead(end, True), False)
    return text[start : ahead(start, True)]


def shape(value: str) -> str:
    """Digits and letters as how many stand together, everything else as it is."""
    return RUN.sub(lambda m: f"{'d' if m.group()[0].isdigit() else 'a'}{m.end() - m.start()}", value)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _salted(hashes: np.ndarray, form: str) -> np.ndarray:
    return mix(hashes ^ np.uint64(_SALTS[form])).view(np.int64)


def patterns_of(texts: list[str], spans: list[list[tuple[int, int, bool]]]) -> list[list[int]]:
    """For every span its patterns: two words before, one word before, one behind, as far as there are; its shape last."""
    before = [words_before(t, s) for t, row in zip(texts, spans) for s, _, _ in row]
    behind = [word_behind(t, e) for t, row in zip(texts, spans) for _, e, _ in row]
    shapes = [shape(t[s:e]) for t, row in zip(texts, spans) for s, e, _ in row]
    single, n = word_hashes(pa.array(before, pa.large_string()))
    pairs, have = runs(single, n, 2)
    last = _salted(single, "before")
    after, m = word_hashes(pa.array(behind, pa.large_string()))
    after = _salted(after, "behind")
    formed = _salted(np.array([_hash(x) for x in shapes], np.int64).view(np.uint64), "shape").tolist()
    pair_at, last_at, after_at = np.cumsum(have) - 1, np.cumsum(n) - 1, np.cumsum(m) - 1
    found = []
    for i, form in enumerate(formed):
        row = [int(pairs[pair_at[i]].view(np.int64))] if have[i] else []
        row += [int(last[last_at[i]])] if n[i] else []
        row += [int(after[after_at[i]])] if m[i] else []
        found.append([*row, form])
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.struct(
        [
            ("start", pa.int32()),
            ("end", pa.int32()),
            ("patterns", pa.list_(pa.int64())),
            ("value", pa.int64()),
            ("seed", pa.bool_()),
        ]
    )
    for batch in slices(batches):
        texts, counts, bases, spans = filled(batch["text"]).to_pylist(), [], [], []
        for text in texts:
            seeds = seed_spans(text)
            counts.append([sum(k == kind for kind, _, _ in seeds) for k in range(4)])
            bases.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in seeds))
            row = [(s, e, True) for _, s, e in seeds]
            spans.append(row + [(s, e, False) for s, e in candidate_spans(text, seeds)])
        patterns, lists = iter(patterns_of(texts, spans)), []
        for text, row in zip(texts, spans):
            lists.append([{"start": s, "end": e, "patterns": next(patterns), "value": _hash(text[s:e]), "seed": z} for s, e, z in row])
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_key"]]
            + [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            + [pa.array([hashlib.sha256(b.encode()).hexdigest() for b in bases]), pa.array(bases)]
            + [pa.array(lists, pa.list_(part))],
            names=["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "parts"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Seeds and candidates of every row of ``docs``, with their patterns."""
    part = "struct<start:int,end:int,patterns:array<long>,value:long,seed:boolean>"
    return docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key")).mapInArrow(
        _scan,
        "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, "
        f"base_sha256 string, base string, parts array<{part}>",
    )


def pattern_occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: how often the words of each of the given patterns occur in all texts; shapes have no words."""
    known = known_bits(patterns, "pattern", BITS)

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        value, at = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        return value, np.bincount(at, np.concatenate([n for _, n in held]), len(value)).astype(np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held, size = unpacked(known), [], 0
        for batch in slices(batches):
            hashes, sizes = word_hashes(filled(batch["text"]))
            single, times = np.unique(hashes, return_counts=True)
            pairs, _ = runs(hashes, sizes, 2)
            found, n = pairs.view(np.int64), np.ones(len(pairs), np.int64)
            for found, n in [(found, n)] + [(_salted(single, form), times) for form in ("before", "behind")]:
                some = wanted[found % BITS]
                held.append(merged([(found[some], n[some])]))
                size += len(held[-1][0])
            if size > COUNTED_AT_ONCE:  # counts are added up over the whole task as long as they are few
                held = [merged(held)]
                size = len(held[0][0])
                if size > COUNTED_AT_ONCE // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), names=["pattern", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged(held))), names=["pattern", "n"])

    counted = docs.select("text").mapInArrow(rows, "pattern long, n long")
    return counted.groupBy("pattern").agg(F.sum("n").alias("total")).join(patterns, "pattern", "left_semi")


def confident(edges: DataFrame, docs: DataFrame, rounds: int = ROUNDS, least: float = CONFIDENT) -> tuple[DataFrame, DataFrame]:
    """The patterns whose score is at least ``least`` when no new value becomes known, and the values found by then.

    ``edges``: pattern, shape (whether it is one), value, seed and n, how often the value stands at the pattern.
    """
    enough = lambda known: F.count_distinct(F.when(known, F.col("value"))) >= MIN_SEEDS
    possible = settle(edges.groupBy("pattern").agg(enough(F.lit(True)).alias("enough")).where("enough").select("pattern"), "pii-patterns")
    total = settle(pattern_occurrences(docs, possible), "pii-totals")
    # Whatever has a shape is a seed or a candidate, so a shape occurs as often as its values do.
    edges = edges.join(possible, "pattern", "left_semi")
    shapes = edges.where("shape").groupBy("pattern").agg(F.sum("n").alias("total"))
    total = total.select("pattern", "total").unionByName(shapes)
    edges = settle(edges.join(total, "pattern").select("pattern", "shape", "value", "seed", "n", "total"), "pii-graph")
    values = settle(edges.select("value").limit(0), "pii-known")
    while True:
        found = values.withColumn("found", F.lit(True))
        known = F.col("seed") | F.coalesce("found", F.lit(False))
        marked = edges.join(found, "value", "left").select(*edges.columns, known.alias("known"))
        marked = settle(marked, "pii-marked")
        counted = (F.col("known") & ~F.col("shape")) | F.col("seed")
        ready = marked.where("known").groupBy("pattern").agg(enough(counted).alias("enough")).where("enough").select("pattern")
        graph = settle(marked.join(ready, "pattern", "left_semi"), "pii-graph")
        scores = None
        for _ in range(rounds):
            score = F.when(F.col("known"), 1.0).otherwise(F.lit(0.0) if scores is None else F.coalesce("score", F.lit(0.0)))
            weighed = graph if scores is None else graph.join(scores, "value", "left")
            patterns = weighed.groupBy("pattern").agg((F.sum(F.col("n") * score) / F.max("total")).alias("confidence"))
            behind = graph.where(~F.col("known")).join(patterns, "pattern")
            scores = behind.groupBy("value").agg(F.max("confidence").alias("score"))
        sure = settle(patterns.where(F.col("confidence") >= least).select("pattern"), "pii-sure")
        new = graph.where(~F.col("known")).join(sure, "pattern", "left_semi").select("value").distinct()
        new = settle(new, "pii-values")
        if new.isEmpty():
            return sure, values
        values = settle(values.union(new).distinct(), "pii-known")


def entity_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_sha256, all spans as text (seeds, then ids), and how many of ids
    and of all there are."""
    scanned = settle(scan(docs), "pii-scan")
    parts = scanned.select("doc_id", "text_key", F.explode("parts").alias("p")).select("doc_id", "text_key", "p.*")
    shape_at = F.size("patterns") - 1  # the last one
    edges = parts.select("value", "seed", shape_at.alias("last"), F.posexplode("patterns").alias("at", "pattern"))
    edges = edges.groupBy("pattern", (F.col("at") == F.col("last")).alias("shape"), "value", "seed").agg(F.count("*").alias("n"))
    sure, values = confident(settle(edges, "pii-edges"), docs)
    candidates = parts.where(~F.col("seed")).select("doc_id", "text_key", "start", "end", "value", F.explode("patterns").alias("pattern"))
    place = ["doc_id", "text_key", "start", "end"]
    found = candidates.join(sure, "pattern", "left_semi").select(place)
    found = found.union(candidates.join(values, "value", "left_semi").select(place)).distinct()
    ids = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ids"))
    ids = ids.select(
        F.col("doc_id").alias("r_doc"),
        F.col("text_key").alias("r_key"),
        F.size("ids").cast("long").alias("ids"),
        F.array_join(F.transform("ids", lambda s: F.concat_ws(":", F.lit("id"), s["start"], s["end"])), ",").alias("more"),
    )
    match = scanned["doc_id"].eqNullSafe(ids["r_doc"]) & (scanned["text_key"] == ids["r_key"])
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("more")).alias("spans")
    n_id = F.coalesce("ids", F.lit(0))
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    n_all = sum((F.col(c) for c in counts), n_id)
    return scanned.join(ids, match, "left").select(
        "doc_id", *counts, "base_sha256", both, n_id.alias("n_id"), n_all.alias("n_entities")
    )
