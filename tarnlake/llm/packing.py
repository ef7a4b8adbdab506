"""Best-fit packing with exact complements.

Documents become token ids with an end id; ids beyond ``capacity`` start a new piece. Which pieces share a
sequence depends only on their lengths, so the plan is made from the histogram of lengths, which has at most
``capacity`` rows however large the corpus is:

1. For every length from the longest, the gap it leaves is looked up among the single, pair and triple sums
   of the lengths still available; a combination that fills the gap exactly is used as often as the counts
   of its lengths allow.
2. What no combination completes is placed by best fit, longest first, into the fullest sequence with room.
3. The same is planned with pair sums at most, single lengths at most and none, and the shortest plan is used.

The plan is a list of (a way to fill a sequence, how many sequences). Each way takes, of each length it
uses, the next so many pieces. So a piece needs only its number among the pieces of its length: pieces are
counted per partition and length, the counts are summed up, and each piece is joined to the way that holds
its number. No sequence and no length is ever gathered in one task.

Defined results: a null text is empty and has the end id alone; a null doc_id is an id like any other;
repeated rows are packed each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import filled, slices
from tarnlake.sources.scratch import settle

CAPACITY = 4096
END_ID = 1
CACHED_WORDS, CACHED_BYTES = 600_000, 64 << 20
BLOCK = 4 << 20

# What the finer split of ``WordEncoder`` is known for.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
# No two characters below U+0300 compose, nor do dashes, quotes and other marks of general punctuation.
PLAIN = [*range(0x300), *range(0x2010, 0x2060)]
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)


class WordEncoder:
    """Ids of whole texts by a tokenizer that never joins what white space parts.

    Texts are split at blanks, tabs, line feeds and carriage returns, and every distinct string in between is
    encoded once; a bounded number of them is remembered. The vocabulary drops white space and splits at it,
    so the ids are those of the whole text (``tests/llm`` compares them).

    A vocabulary that composes, lower-cases and splits by the rules above is known to encode each run of letters,
    each digit and each run of other characters by itself. Strings of plain characters are lower-cased and split
    into these runs, of which fewer are distinct, and the runs skip those rules. A string with any other
    character, an apostrophe or the first character of an added token is encoded as it stands.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = self.runs = Tokenizer.from_file(path)
        self.kind = np.full(PLAIN[-1] + 2, ODD, np.uint8)  # by code point, the last stands for all beyond
        self.lower = np.arange(len(self.kind), dtype=np.uint32)
        self.kind[[ord(white) for white in " \n\t\r"]] = SPACE
        with open(path, encoding="utf-8") as file:
            self._split_finer(json.load(file))
        self._forget()

    def _split_finer(self, rules: dict) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        if (
            (rules["normalizer"] or {}).get("normalizers") != NORMALIZERS
            or (rules["pre_tokenizer"] or {}).get("pretokenizers") != PRE_TOKENIZERS
            or any(token["normalized"] for token in rules["added_tokens"])
        ):
            return
        normal, parts = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        for code in PLAIN:
            to = normal(chr(code))
            if len(to) == 1:  # else its lower case is longer
                self.lower[code] = ord(to)
                if not parts(to):
                    self.kind[code] = SPACE
                elif len(parts("a" + to)) == 1:
                    self.kind[code] = LETTER
                else:
                    self.kind[code] = DIGIT if len(parts(to + to)) == 2 else OTHER
        for first in "'", *(token["content"][0] for token in rules["added_tokens"]):
            self.kind[min(ord(first), len(self.kind) - 1)] = ODD
        self.runs = Tokenizer(self.tokenizer.model)
        self.runs.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids = np.empty(0, np.uint32)
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: pa.Array, odd: np.ndarray) -> None:
        """Remember the ids of new words; all of them lie one after the other in one array.

        Words are encoded joined by blanks, a few hundred in a call; where a token begins says whose it is.
        """
        strings, pieces, held = words.to_pylist(), [self.ids], len(self.ids)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for tokenizer, those in (self.runs, np.flatnonzero(~odd)), (self.tokenizer, np.flatnonzero(odd)):
            for some in (those[i : i + 500] for i in range(0, len(those), 500)):
                group = [strings[i] for i in some.tolist()]
                found = tokenizer.encode(" ".join(group), add_special_tokens=False)
                begins = np.cumsum([0] + [len(word) + 1 for word in group])
                at = np.fromiter((start for start, _ in found.offsets), np.int64, len(found.ids))
                stops = np.searchsorted(at, begins)
                sizes[some], starts[some] = np.diff(stops), held + stops[:-1]
                pieces.append(np.array(found.ids, np.uint32))
                held += len(at)
        self.ids = np.concatenate(pieces)
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])

    def _block(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each run of a text begins, how many ids it has, and the ids of all."""
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(chars, np.uint32(len(self.kind) - 1))
        kind, lower = self.kind[at], self.lower[at]
        if (odd := kind == ODD).any():  # then the whole string between white space is
            string = np.cumsum(kind == SPACE, dtype=np.int32)
            any_odd = np.zeros(int(string[-1]) + 1, bool)
            any_odd[string[odd]] = True
            odd = any_odd[string] & (kind != SPACE)
            kind[odd] = ODD
            lower[odd] = chars[odd]
            del string
        del chars, at, odd  # as long as the text
        held = kind != SPACE
        first = held.copy()
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begins = np.flatnonzero(first)
        kept = lower[held]
        wide = np.ones(len(kept), np.uint8)
        for more in (0x80, 0x800, 0x10000):
            wide += kept >= more
        offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(wide, np.flatnonzero(first[held]), dtype=np.int64))])
        data = kept.tobytes().decode("utf-32-le").encode()
        runs = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data))

        if len(self.words) > CACHED_WORDS or self.words.nbytes > CACHED_BYTES:
            self._forget()
        # The words known so far come first, so they keep their numbers.
        known = len(self.words)
        found = pa.concat_arrays([self.words, runs]).dictionary_encode()
        codes = found.indices.to_numpy()[known:]
        if len(found.dictionary) > known:
            odd = np.zeros(len(found.dictionary), bool)
            odd[codes] = kind[begins] == ODD
            self._learn(found.dictionary[known:], odd[known:])
            self.words = found.dictionary
        sizes = self.sizes[codes]
        stops = np.cumsum(sizes)
        last = int(stops[-1]) if len(stops) else 0
        return begins, sizes, self.ids[np.arange(last) + np.repeat(self.starts[codes] - stops + sizes, sizes)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a large-string array without nulls."""
        whole = texts.to_pylist()
        if not whole:
            return []
        text = "\n".join([*whole, ""])
        made, start = [], 0
        while start < len(text):  # blocks end in white space
            stop = start + BLOCK
            stop = max(text.rfind(white, start, stop) for white in " \n\t\r") + 1 or min(
                (i for white in " \n\t\r" if (i := text.find(white, stop)) >= 0)
            ) + 1
            begins, sizes, ids = self._block(text[start:stop])
            made.append((begins + start, sizes, ids))
            start = stop
        begins, sizes, ids = (np.concatenate(parts) for parts in zip(*made))
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum([len(one) + 1 for one in whole])
        return np.split(ids, stops[np.searchsorted(begins, ends[:-1])])


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids themselves) of every piece of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        for batch in slices(batches, 4 << 20):
            made: dict[str, list] = defaultdict(list)
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(filled(batch["text"]))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    made["doc_id"].append(doc)
                    made["piece"].append(piece)
                    made["start"].append(start)
                    made["length"].append(len(part))
                    made["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        made["ids"].append(part.astype(np.int32))
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64()}
            kinds |= {"ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
            yield pa.RecordBatch.from_arrays([pa.array(made[c], t) for c, t in kinds.items()], names=list(kinds))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


class Plan:
    """Ways to fill sequences, with the number of sequences of each."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {length: n for length, n in counts.items() if n}
        self.ways: list[tuple[tuple[int, ...], int]] = []

    def use(self, lengths: tuple[int, ...], most: int | None = None) -> int:
        """Fill as many sequences this way as there are pieces for."""
        need: dict[int, int] = defaultdict(int)
        for length in lengths:
            need[length] += 1
        times = min(self.left.get(length, 0) // n for length, n in need.items())
        times = times if most is None else min(times, most)
        if times:
            for length, n in need.items():
                self.left[length] -= times * n
                if not self.left[length]:
                    del self.left[length]
            self.ways.append((lengths, times))
        return times

    def exact(self, most: int = 3) -> None:
        """Gaps of each length, longest first, filled by one, two, ... ``most`` lengths that sum up to them."""
        self.use((self.capacity,))
        fill = [lambda n: self.use((n, self.capacity - n)), lambda n: self._pairs((n,), self.capacity - n), self._triples]
        for fitting in fill[:most]:
            for length in sorted(self.left, reverse=True):
                if length in self.left and length < self.capacity:
                    fitting(length)

    def _pairs(self, head: tuple[int, ...], gap: int) -> None:
        """Use up the pairs that sum up to ``gap``; the larger partner first."""
        have = np.zeros(self.capacity + 1, bool)
        have[list(self.left)] = True
        larger = np.arange(gap - 1, (gap - 1) // 2, -1)
        larger = larger[larger >= gap - larger]
        for a in larger[have[larger] & have[gap - larger]].tolist():
            if head[0] not in self.left:
                return
            self.use((*head, a, gap - a))

    def _triples(self, length: int) -> None:
        for a in sorted((x for x in self.left if x <= self.capacity - length - 2), reverse=True):
            if length not in self.left:
                return
            gap = self.capacity - length - a
            if a in self.left and 2 * a >= gap:
                self._pairs((length, a), gap)

    def best_fit(self) -> None:
        """What is left, longest first, into the fullest sequence with room; sequences that look alike go together."""
        open_ways: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by the room they have
        rooms: list[int] = []
        for length in sorted(self.left, reverse=True):
            n = self.left[length]
            while n:
                i = bisect.bisect_left(rooms, length)
                if i < len(rooms):
                    room = rooms[i]
                    way, have = open_ways[room].pop()
                    each = min(room // length, n)  # the same sequence stays the fullest until it is full
                    times = max(1, min(have, n // each))
                    if have > times:
                        open_ways[room].append((way, have - times))
                else:
                    room, way, times = self.capacity, (), 1
                    each = min(self.capacity // length, n)
                    times = n // each
                if room in open_ways and not open_ways[room]:
                    del open_ways[room]
                    rooms.pop(bisect.bisect_left(rooms, room))
                n -= times * each
                rest = room - each * length
                if rest not in open_ways:
                    bisect.insort(rooms, rest)
                open_ways[rest].append((way + (length,) * each, times))
        self.ways += [way for ways in open_ways.values() for way in ways]
        self.left = {}


def plan_of(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """The shortest of four plans: exact sums of up to three, two, one or no lengths, then best fit.

    Exact sums can leave lengths that fit badly together, so fewer of them sometimes need fewer sequences.
    """
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best, shortest = [], None
    for most in (3, 2, 1, 0):
        plan = Plan(counts, capacity)
        plan.exact(most)
        plan.best_fit()
        needed = sum(times for _, times in plan.ways)
        if shortest is None or needed < shortest:
            best, shortest = plan.ways, needed
        if shortest == least:
            break
    return best


def slots_of(ways: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first piece, number of pieces, copies, first sequence, offset): which pieces of a length go where.

    Equal lengths that stand together in a way are one slot with so many copies, so the number of slots
    depends on the lengths that occur, not on how many pieces there are or how short they are.
    """
    taken: dict[int, int] = defaultdict(int)
    slots, sequence = [], 0
    for lengths, times in ways:
        offset = 0
        for length, run in groupby(lengths):
            copies = len(list(run))
            slots.append((length, taken[length], times * copies, copies, sequence, offset))
            taken[length] += times * copies
            offset += length * copies
        sequence += times
    return slots


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) with sequence_id and offset."""
    spark = pieces.sparkSession
    kept = pieces.columns
    held = settle(pieces.withColumn("__part", F.spark_partition_id()), "pieces")
    counts = settle(held.groupBy("__part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    ways = plan_of({row["length"]: row["n"] for row in histogram}, capacity)
    slots = spark.createDataFrame(
        slots_of(ways), "s_length long, s_first long, s_pieces long, s_copies long, s_sequence long, s_offset long"
    )
    # The partitions are those the pieces were made in, not those they are read in: number within (part, length).
    ahead = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = Window.partitionBy("__part", "length").orderBy(*[c for c in ("doc_id", "piece") if c in kept] or ["length"])
    numbered = (
        held.withColumn("__in", F.row_number().over(within) - 1)
        .join(starts, ["__part", "length"])
        .withColumn("__number", F.col("__ahead") + F.col("__in"))
    )
    match = (
        (F.col("length") == F.col("s_length"))
        & (F.col("__number") >= F.col("s_first"))
        & (F.col("__number") < F.col("s_first") + F.col("s_pieces"))
    )
    nth = F.col("__number") - F.col("s_first")
    sequence = F.col("s_sequence") + F.floor(nth / F.col("s_copies"))
    offset = F.col("s_offset") + nth % F.col("s_copies") * F.col("length")
    return numbered.join(F.broadcast(slots), match).select(
        *kept, sequence.alias("sequence_id"), offset.alias("offset")
    )
