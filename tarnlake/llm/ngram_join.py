"""N-gram Jaccard join by a token-group matrix.

Documents are sets of hashed shingles. Two link if 100 * intersection >= 80 * union. Similar documents are
put into groups, each group's token union is stored, and a document (query) is compared with a group's
members only where its overlap with the union allows a link.

1. Equal sets are one class, compared through its smallest doc_id.
2. Groups: documents that agree in a pair of min-hashes are compared with the first of them; those that link
   form groups by connected components. Groups are an aid: none has to be complete.
3. The matrix: of every set only the prefix is used, its first n - ceil(0.8 n) + 1 tokens in one global order.
   Two sets that link share a token of their prefixes. The order puts tokens in frequent buckets of a sketch
   over all documents last, so passages that many documents share stay out of prefixes. Tokens of one
   set alone go first; what is left are rows (token, group).
4. A document of the smaller group becomes a query for every other group with which it shares a prefix token that
   is in the front of the shorter set, if that token's places in both leave room for the overlap and the shared prefix
   tokens are enough to bound it from below (``_least_shared``). Members are streamed first and make the union, then the queries: one whose overlap with the union is
   below 0.8 of its own size is done; the others are compared with the members exactly. Groups are
   dealt out in chunks of ``CHUNK`` members and ``QUERIES_AT_ONCE`` queries, so no task gets a whole hot group.
   The members of a group are compared with each other alike, chunk against chunk, each pair in one block.
5. Every pair of representatives that links is found in one block. The block hands out how many documents each of its
   rows links with (a link counts for every copy) and the edges of a spanning forest, so what is written follows
   the number of documents, not of pairs. ``pairs=True`` has the pairs themselves written instead.

No link is lost, whatever the sketch and the groups are: they only decide how much is compared. The sketch (``SKETCH`` bytes) and the bit maps (``BITS``) have a fixed size.

Defined results: null, empty and blank texts have an empty set and link with nothing; a null doc_id links with
nothing and has no component; rows with the same doc_id are one node with several sets; an empty table gives
no rows; other columns are not looked at. Links are between sets, so two texts of one doc_id may link as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import filled, known_bits, slices, unpacked
from tarnlake.llm.graph import components
from tarnlake.llm.words import mix, runs, word_hashes
from tarnlake.sources.scratch import settle

WORDS = 5
PERCENT = 80
BAND_KEYS = 3  # pairs of min-hashes
SKETCH = 1 << 22
SKETCH_SLICES = 64
BITS = 1 << 24
CHUNK = 256
QUERIES_AT_ONCE = 4096
LINKS_AT_ONCE = 1 << 16
LOOK_BACK = 8
FEW = 4  # sets; the sets of a token that no more hold are paired where they lie

_U = np.uint64
_SEEDS = mix(np.arange(1, 2 * BAND_KEYS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; a text with fewer words is one shingle."""
    hashes, counts = word_hashes(texts)
    found, have = runs(hashes, counts, words)
    ends, stops = np.cumsum(have), np.cumsum(counts)
    sets = []
    for i, count in enumerate(counts.tolist()):
        if count >= words:
            sets.append(np.unique(found[ends[i] - have[i] : ends[i]]))
        elif count:
            total = np.full(1, count, np.uint64)
            for h in hashes[stops[i] - count : stops[i]]:
                total = mix(total * _U(3) + h)
            sets.append(total)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of counts with the same key, added up as they stream by."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for group, part, counts in zip(*(batch[c].to_pylist() for c in ("group", "slice", "counts"))):
            values = np.frombuffer(zlib.decompress(counts), np.uint32)
            if (group, part) in held:
                sums = held[group, part].astype(np.uint64) + values
                held[group, part] = np.minimum(sums, 0xFFFFFFFF).astype(np.uint32)
            else:
                held[group, part] = values
    yield _slices(held)


def _slices(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([g for g, _ in held], pa.int32()),
            pa.array([s for _, s in held], pa.int32()),
            pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary()),
        ],
        names=["group", "slice", "counts"],
    )


def frequency_classes(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """For each of ``SKETCH`` buckets of hashes a byte that grows with the number of documents' tokens in it."""
    schema = "group int, slice int, counts binary"
    width = SKETCH // SKETCH_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(SKETCH, np.uint32)
        for batch in slices(batches):
            tokens = np.concatenate(shingle_sets(filled(batch["text"]), words))
            buckets, n = np.unique((tokens >> _U(40)) % _U(SKETCH), return_counts=True)
            counts[buckets] += n.astype(np.uint32)
        group = TaskContext.get().partitionId() // 256
        yield _slices({(group, s): counts[s * width : (s + 1) * width] for s in range(SKETCH_SLICES)})

    parts = docs.select("text").mapInArrow(count, schema)
    # Two steps, so that a task adds up the slices of 256 tasks, not of all.
    near = parts.repartition("group", "slice").mapInArrow(_summed, schema)
    total = near.withColumn("group", F.lit(0)).repartition("slice").mapInArrow(_summed, schema)
    classes = np.zeros(SKETCH, np.uint8)
    for row in total.collect():  # SKETCH_SLICES rows
        counts = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
        classes[row["slice"] * width : (row["slice"] + 1) * width] = 4 * np.log2(counts.astype(np.float64) + 1)
    return classes


def signatures(docs: DataFrame, classes: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, f1 and f2 (the set's fingerprint), bands (min-hash keys) and prefix (packed tokens)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, f1, f2, bands, prefixes = [], [], [], [], []
            for tokens in shingle_sets(filled(batch["text"]), words):
                size = len(tokens)
                n.append(size)
                f1.append(int(np.bitwise_xor.reduce(mix(tokens))) if size else 0)
                f2.append(int(np.add.reduce(mix(tokens ^ _U(0xA5A5A5A5A5A5A5A5)))) if size else 0)
                if not size:
                    bands.append([])
                    prefixes.append(b"")
                    continue
                least = [mix(tokens ^ seed).min() for seed in _SEEDS]
                keys = np.array([[least[2 * k], least[2 * k + 1]] for k in range(BAND_KEYS)], np.uint64)
                keys = mix(keys[:, 0] * _U(3) + keys[:, 1] + np.arange(BAND_KEYS, dtype=np.uint64))
                bands.append(keys.view(np.int64).tolist())
                length = size - (percent * size + 99) // 100 + 1
                order = np.lexsort((tokens, classes[(tokens >> _U(40)) % _U(SKETCH)]))[:length]
                prefixes.append(tokens[order].tobytes())
            signed = [pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), *signed]
                + [pa.array(bands, pa.list_(pa.int64())), pa.array(prefixes, pa.binary())],
                names=["doc_id", "n", "f1", "f2", "bands", "prefix"],
            )

    schema = "doc_id long, n long, f1 long, f2 long, bands array<long>, prefix binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def sets_of(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, f1 and packed tokens of the sets of the documents of ``wanted`` (and a few more, by the bit map)."""
    known = known_bits(wanted, "doc_id", BITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = unpacked(known)
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for part in slices([batch.filter(pa.array(held[ids % BITS]))]):
                sets = shingle_sets(filled(part["text"]), words)
                f1 = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(f1.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "f1", "tokens"],
                )

    known_docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    return known_docs.mapInArrow(rows, "doc_id long, f1 long, tokens binary")


def _opened(percent: int, pairs: bool):
    """All links of queries to the members that came before them, and with salt 0 those of members to each other.

    With ``pairs`` each link is a row (a, a_set, b, b_set, inside). Without, rows with ``far`` 0 are a spanning forest of
    the block's links, and the others, whose b is a, give in ``far`` how many documents of the block a links with.
    """
    names = (LINK if pairs else REACH).names

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = None
        members, union, owner, sizes, docs, marks, copies = [], None, None, None, None, None, None
        tree = far = None  # of the members: which of them hang together, and the documents each links with
        found, held = [], 0

        def gather() -> None:
            nonlocal union, owner, sizes, docs, marks, copies, tree, far
            sizes = np.array([len(t) for *_, t in members])
            union = np.concatenate([t for *_, t in members])
            owner = np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(union, kind="stable")
            union, owner = union[order], owner[order]
            docs, marks, copies = (np.array(c, np.int64) for c in list(zip(*members))[:3])
            tree, far = np.arange(len(members)), np.zeros(len(members), np.int64)

        def linked_with(tokens: np.ndarray, most: int) -> np.ndarray:
            low, high = np.searchsorted(union, tokens, "left"), np.searchsorted(union, tokens, "right")
            if 100 * (high > low).sum() < percent * len(tokens):
                return np.empty(0, np.int64)  # the group stays closed
            hits = np.repeat(low, high - low) + np.arange((high - low).sum())
            hits -= np.repeat(np.cumsum(high - low) - (high - low), high - low)
            shared = np.bincount(owner[hits], minlength=len(members))
            linked = np.flatnonzero(100 * shared >= percent * (sizes + len(tokens) - shared))
            return linked[linked < most]

        def add(*columns: np.ndarray) -> None:
            nonlocal held
            found.append(columns)
            held += len(columns[0])

        def compare(doc: int, mark: int, weight: int, tokens: np.ndarray, own: int | None, inside: bool) -> None:
            """``own`` is the number of a member that is compared with those before it."""
            linked = linked_with(tokens, len(members) if own is None else own)
            n = len(linked)
            if not n:
                return
            one = np.full(n, doc, np.int64), np.full(n, mark, np.int64)
            if pairs:
                add(*one, docs[linked], marks[linked], np.full(n, inside))
                return
            far[linked] += weight
            if own is None:
                add(*(c[:1] for c in one * 2), copies[linked].sum(keepdims=True))
            else:
                far[own] += copies[linked].sum()
            roots, at = np.unique(tree[linked], return_index=True)
            if own is not None:
                at, roots = at[roots != tree[own]], np.append(roots, tree[own])
            joined = linked[at]  # a member of each other tree that this row brings together
            add(*(c[: len(at)] for c in one), docs[joined], marks[joined], np.zeros(len(at), np.int64))
            tree[np.isin(tree, roots)] = roots[0]

        def full(most: int) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held >= most:
                yield packed(found)
                found.clear()
                held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            """When all of the block have come: the links among its members, and what was counted for them."""
            if key is not None and key[2] == 0 and len(members) > 1:
                if union is None:
                    gather()
                for i, (doc, mark, weight, tokens) in enumerate(members):
                    compare(doc, mark, weight, tokens, i, True)
                    yield from full(LINKS_AT_ONCE)
            if union is not None and not pairs:
                some = np.flatnonzero(far)
                if len(some):
                    add(docs[some], marks[some], docs[some], marks[some], far[some])

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("grp", "part", "salt", "is_query", "inside", "doc_id", "f1", "copies", "tokens"))
            for grp, part, salt, is_query, inside, doc, mark, weight, raw in zip(*columns):
                tokens = np.frombuffer(raw, np.uint64)
                if (grp, part, salt) != key:
                    yield from closed()
                    key, members, union = (grp, part, salt), [], None
                if (key, is_query, doc, mark) == last or not len(tokens):
                    continue  # a repeated row
                last = (key, is_query, doc, mark)
                if not is_query:
                    members.append((doc, mark, weight, tokens))
                elif members:
                    if union is None:
                        gather()
                    compare(doc, mark, weight, tokens, None, inside)
                    yield from full(LINKS_AT_ONCE)
        yield from closed()
        yield from full(1)

    return rows


LINK = pa.schema([("a", pa.int64()), ("a_set", pa.int64()), ("b", pa.int64()), ("b_set", pa.int64()), ("inside", pa.bool_())])
REACH = pa.schema([("a", pa.int64()), ("a_set", pa.int64()), ("b", pa.int64()), ("b_set", pa.int64()), ("far", pa.int64())])


def open_groups(
    members: DataFrame,
    queries: DataFrame,
    sets: DataFrame,
    percent: int = PERCENT,
    inside: bool = False,
    pairs: bool = True,
    copies: DataFrame | None = None,
) -> DataFrame:
    """Links of queries (grp, doc_id, f1) to members (grp, doc_id, f1), as ``_opened`` gives them, each in one block.

    With ``inside`` members link with each other too: those of one chunk where the chunk is, and those of two
    chunks where the members of the later one are dealt to the earlier one as queries. ``copies`` (doc_id, f1, copies)
    tells which sets more than one document has.
    """
    counts = queries.groupBy("grp").agg(F.count("*").alias("queries"))
    asking = F.coalesce("queries", F.lit(0)) + (F.col("members") if inside else F.lit(0))
    salts = F.greatest(F.ceil(asking / QUERIES_AT_ONCE), F.lit(1)).cast("int")
    parts = F.ceil(F.col("members") / CHUNK).cast("int")
    sizes = members.groupBy("grp").agg(F.count("*").alias("members")).join(counts, "grp", "left")
    sizes = sizes.select("grp", salts.alias("salts"), parts.alias("parts"))
    spread = lambda by, n: F.pmod(F.xxhash64("doc_id", F.lit(by)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    node = ["grp", "doc_id", "f1"]
    placed = members.join(sizes, "grp").select(*node, spread(1, "parts").alias("part"), "salts")
    m = placed.select(*node, "part", every(F.col("salts")).alias("salt"), F.lit(False).alias("is_query"), F.lit(True).alias("inside"))
    q = queries.join(sizes, "grp").select(*node, every(F.col("parts")).alias("part"), spread(2, "salts").alias("salt"))
    rows = m.unionByName(q.withColumn("is_query", F.lit(True)).withColumn("inside", F.lit(False)))
    if inside:
        own = placed.where("part > 0").select(*node, every(F.col("part")).alias("part"), spread(2, "salts").alias("salt"))
        rows = rows.unionByName(own.withColumn("is_query", F.lit(True)).withColumn("inside", F.lit(True)))
    if copies is None:
        rows = rows.withColumn("copies", F.lit(1))
    else:
        rows = rows.join(copies, ["doc_id", "f1"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    dealt = rows.join(sets, ["doc_id", "f1"]).repartition("grp", "part", "salt")
    # Repeated rows come one after the other; a document has one place as a query and one as a member.
    sorted_rows = dealt.sortWithinPartitions("grp", "part", "salt", "is_query", "doc_id", "f1")
    schema = "a long, a_set long, b long, b_set long, " + ("inside boolean" if pairs else "far long")
    return sorted_rows.mapInArrow(_opened(percent, pairs), schema)


def _prefix_tokens(known: np.ndarray | None):
    """The prefix tokens of every signature as rows, or only those whose bit is set, with their ``place`` in the prefix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if known is None else unpacked(known)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed = part["prefix"].to_pylist()
                tokens = np.frombuffer(b"".join(packed), np.int64)
                sizes = np.array([len(p) // 8 for p in packed], np.int64)
                row = np.repeat(np.arange(len(packed)), sizes)
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                if held is not None:
                    wanted = held[tokens % BITS]
                    tokens, row, place = tokens[wanted], row[wanted], place[wanted]
                names = [c for c in part.schema.names if c != "prefix"]
                columns = {c: part[c].take(pa.array(row)) for c in names}
                if known is not None:
                    columns["place"] = pa.array(place.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(tokens), *columns.values()], names=["token", *columns])

    return rows


def _least_shared(percent: int) -> Column:
    """How many prefix tokens a query of ``n`` tokens must share with a group of sizes ``g_low`` to ``g_high``.

    A link to a set of y tokens needs an overlap of percent / (100 + percent) of n + y. Whichever of the two
    prefixes ends first in the order, common tokens behind its end are less than percent of that set; all others
    are in both prefixes. So the overlap less percent of the larger set has to be shared there. As a function
    of y this is least at an end of the sizes that can link; a group without such a size shares nothing.
    """
    low = F.greatest(F.col("g_low"), F.ceil(F.col("n") * percent / 100))
    high = F.least(F.col("g_high"), F.floor(F.col("n") * 100 / percent))

    def need(y: Column) -> Column:
        overlap = F.ceil((F.col("n") + y) * percent / (100 + percent) - 1e-6)
        return overlap - F.ceil(F.greatest(F.col("n"), y) * percent / 100)

    return F.when(low <= high, F.least(need(low), need(high)))


def leading(matrix: DataFrame) -> DataFrame:
    """The tokens that do not follow one and the same other token in all sets that hold them (``before``, in order).

    The first token that two sets share is one of these: any other is shared together with the one it follows.
    """
    follows = F.try_element_at("before", F.lit(-1))
    of_token = matrix.groupBy("token").agg(
        F.min(follows).alias("low"), F.max(follows).alias("high"), F.count_if(F.size("before") == 0).alias("none")
    )
    return of_token.where("none > 0 OR low < high").select("token")


PAIR = ["g", "doc_id", "f1", "n", "g_low", "g_high"]


def _may_meet(percent: int) -> Column:
    """Whether a set of a smaller group and a group that share a token may link, by their sizes and the token's places."""
    smaller = (F.col("size") < F.col("g_size")) | ((F.col("size") == F.col("g_size")) & (F.col("grp") < F.col("g")))
    # Sets that link differ in size by no more than percent; a group must have a member of such a size.
    smaller &= (F.col("g_high") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("g_low") * percent)
    # What two sets share is this token, no more of those ahead of it than either has, and no more of the rest. So
    # sets that share one passage only, ahead of which each has tokens of its own, join if the passage is long enough.
    overlap = F.least("ahead", "g_ahead") + 1 + F.least("rest", "g_rest")
    smallest = F.greatest(F.col("g_low"), F.ceil(F.col("n") * percent / 100))
    return smaller & (overlap >= F.ceil((F.col("n") + smallest) * percent / (100 + percent) - 1e-6))


def _touching_by_few(matrix: DataFrame, percent: int) -> DataFrame:
    """The pairs (``PAIR``) that meet at a token of at most ``FEW`` sets: one shuffle brings these together."""
    columns = [c for c in matrix.columns if c not in ("token", "many", "before")]
    # Dealt out first, so that the lists are made after the shuffle only.
    held = matrix.repartition("token").groupBy("token").agg(F.collect_list(F.struct(*columns)).alias("held"))
    every = held.select(F.explode("held").alias("one"), "held").select("one", F.explode("held").alias("other"))
    other = [F.col(f"other.{c}").alias(f"g_{c}") for c in columns if c not in ("doc_id", "f1", "n", "grp")]
    every = every.select("one.*", F.col("other.grp").alias("g"), *other)
    # The shorter of two sets that link shares a token of its front.
    in_front = (F.col("front") & (F.col("g_high") >= F.col("n"))) | (F.col("g_front") & (F.col("g_low") < F.col("n")))
    return every.where(_may_meet(percent) & in_front).select(PAIR)


def _touching_by_many(matrix: DataFrame, percent: int) -> DataFrame:
    """The pairs (``PAIR``) that meet at a token of more sets, if they share none of the last tokens before it."""
    group = [F.col(c).alias(f"g_{c}") for c in ("size", "low", "high")]
    most = [F.max(c).alias(f"g_{c}") for c in ("front", "rest", "ahead")]
    # Of a group of several sets any may be the one that is met, so what is ahead in one of them tells nothing.
    alone = F.min_by(F.when(F.col("size") == 1, F.col("before")), "ahead").alias("g_before")
    of_group = matrix.groupBy("token", F.col("grp").alias("g"), *group).agg(*most, alone)
    of_group = settle(of_group, "group-tokens")
    met_at = of_group.join(leading(matrix), "token", "left_semi")
    # The shorter of two sets that link shares a token of its front, so a passage that fills most of many
    # sets, but of none so much that they link, joins nothing.
    smaller = _may_meet(percent) & ~F.coalesce(F.arrays_overlap("before", "g_before"), F.lit(False))
    below = matrix.where("front").join(met_at, "token").where(smaller & (F.col("g_high") >= F.col("n")))
    above = matrix.join(met_at.where("g_front"), "token").where(smaller & (F.col("g_low") < F.col("n")))
    return below.select(PAIR).union(above.select(PAIR))


class Similar(NamedTuple):
    """What the join finds.

    ``classes``: per row doc_id, n_shingles, component_id and n_links, the other documents it links with, its copies
    included. ``links``: with ``pairs`` a, a_set, b, b_set, every pair of different sets that links, once, each set by
    its smallest doc_id and its fingerprint; without, what ``_opened`` gives. ``copies``: doc_id, f1 (its set),
    rep, the smallest doc_id with an equal set, and copies, the documents that have it.
    """

    classes: DataFrame
    links: DataFrame
    copies: DataFrame


def similarity_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, n_links."""
    return similar(docs, words, percent).classes


def link_counts(links: DataFrame, copies: DataFrame, pairs: bool) -> DataFrame:
    """rep, f1, n_links for every set: its other copies and all copies of the sets it links with."""
    of_set = copies.where("doc_id = rep").select("rep", "f1", "copies").distinct()
    if pairs:
        both = links.select("a", "a_set", "b", "b_set").union(links.select("b", "b_set", "a", "a_set"))
        other = of_set.select(F.col("rep").alias("b"), F.col("f1").alias("b_set"), F.col("copies").alias("far"))
        links = both.join(other, ["b", "b_set"])
    far = links.groupBy(F.col("a").alias("rep"), F.col("a_set").alias("f1")).agg(F.sum("far").alias("far"))
    total = of_set.join(far, ["rep", "f1"], "left")
    return total.select("rep", "f1", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))


def similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, pairs: bool = False) -> Similar:
    """The whole join; the links and the copies are written."""
    signed = settle(signatures(docs, frequency_classes(docs, words), words, percent), "signatures")
    real = signed.where("n > 0 AND doc_id IS NOT NULL")
    held = settle(real.select("doc_id", "f1", "f2", "n").distinct(), "sets")
    by_set = held.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = settle(held.join(by_set, ["f1", "f2", "n"]).select("doc_id", "rep", "f1", "n", "copies"), "copies")
    reps = copies.where("doc_id = rep").select("doc_id", "f1", "n").distinct()

    bands = real.select("doc_id", "f1", F.explode("bands").alias("band")).join(reps, ["doc_id", "f1"], "left_semi")
    bands = settle(bands, "bands")
    first = F.min(F.struct("doc_id", "f1")).alias("first")
    firsts = bands.groupBy("band").agg(first, F.max("doc_id").alias("last")).where("first.doc_id < last")
    firsts = firsts.select("band", F.col("first.doc_id").alias("grp"), F.col("first.f1").alias("grp_f1"))
    queries = bands.join(firsts, "band").where("doc_id <> grp").select("grp", "grp_f1", "doc_id", "f1").distinct()
    queries = settle(queries, "near")
    members = queries.select("grp", F.col("grp").alias("doc_id"), F.col("grp_f1").alias("f1")).distinct()
    queries = queries.select("grp", "doc_id", "f1").distinct()
    wanted = queries.select("doc_id").union(members.select("doc_id"))
    near = settle(open_groups(members, queries, sets_of(docs, wanted, words), percent), "near-links")
    grouped = components(near.select("a", "b"))

    # Tokens of one set only cannot link anything; equal sets have equal fingerprints.
    marks = real.select("prefix", F.shiftright("f1", 16).alias("mark"))
    tokens = marks.mapInArrow(_prefix_tokens(None), "token long, mark long")
    shared = tokens.groupBy("token").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high")
    known = known_bits(shared, "token", BITS)
    rows = real.select("prefix", "doc_id", "f1").mapInArrow(
        _prefix_tokens(known), "token long, doc_id long, f1 long, place int"
    )
    labels = reps.join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labels = settle(labels.select("doc_id", "f1", "n", F.coalesce("component", "doc_id").alias("grp")), "groups")
    sizes = labels.groupBy("grp").agg(
        F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    sizes = settle(sizes, "group-sizes")
    matrix = settle(rows.join(labels.drop("n"), ["doc_id", "f1"]), "matrix")
    mixed = matrix.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("held"))
    mixed = mixed.where("low < high").select("token", (F.col("held") > FEW).alias("many"))
    matrix = matrix.drop("grp").join(mixed, "token")
    # How many tokens before this one in the order the set could share with another group (those of the matrix), and
    # the last of them; for a token of few sets these are not asked for.
    of_set = Window.partitionBy("doc_id", "f1").orderBy("place")
    ahead = F.row_number().over(of_set) - 1
    before = F.when(F.col("many"), F.collect_list("token").over(of_set.rowsBetween(-LOOK_BACK, -1)))
    matrix = matrix.select("token", "many", "doc_id", "f1", "place", ahead.alias("ahead"), before.alias("before"))
    # What is the same in all rows of a set comes in where they lie together, not before. ``rest`` are the tokens
    # of the set after this one; a set that links to one at least as large shares a token of its ``front``.
    matrix = matrix.join(labels.join(sizes, "grp"), ["doc_id", "f1"])  # two written sides: a hot group can be split
    n, place = F.col("n"), F.col("place")
    front = place < n - F.floor((n * (2 * percent) + 99 + percent) / (100 + percent)) + 1
    matrix = settle(matrix.withColumns({"front": front, "rest": n - place - 1}).drop("place"), "matrix")

    touching = _touching_by_few(matrix.where("NOT many"), percent).union(_touching_by_many(matrix.where("many"), percent))
    touching = settle(touching.distinct(), "pairs")
    # For those pairs all shared prefix tokens are counted.
    both = touching.join(matrix.select("doc_id", "f1", "token"), ["doc_id", "f1"])
    of_group = matrix.select(F.col("grp").alias("g"), "token", "size")
    of_group = of_group.where("size = 1").union(of_group.where("size > 1").distinct()).drop("size")
    met = both.join(of_group, ["g", "token"], "left_semi").groupBy(PAIR).agg(F.countDistinct("token").alias("shared"))
    asked = met.where(F.col("shared") >= _least_shared(percent)).select(F.col("g").alias("grp"), "doc_id", "f1").distinct()
    asked = settle(asked, "queries")
    of_many = sizes.where("size > 1").select("grp")
    opened = labels.join(asked.select("grp").union(of_many).distinct(), "grp", "left_semi").select("grp", "doc_id", "f1")
    wanted = asked.select("doc_id").union(opened.select("doc_id"))
    several = copies.where("doc_id = rep AND copies > 1").select("doc_id", "f1", "copies").distinct()
    links = settle(open_groups(opened, asked, sets_of(docs, wanted, words), percent, True, pairs, several), "links")

    same = copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # Inside a group the links to the first documents of bands are enough.
    far = links.where("NOT inside" if pairs else "far = 0").select("a", "b")
    found = components(near.select("a", "b").union(far).union(same)).withColumnRenamed("node", "doc_id")
    # A document with several texts is one node; its number of links is the largest of its sets'.
    counts = link_counts(links, copies, pairs).where("n_links > 0")
    counts = copies.join(counts, ["rep", "f1"]).groupBy("doc_id").agg(F.max("n_links").alias("n_links"))
    classes = signed.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").join(counts, "doc_id", "left")
    classes = classes.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return Similar(classes, links.drop("inside") if pairs else links, copies)
