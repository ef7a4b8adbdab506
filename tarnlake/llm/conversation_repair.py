"""Repair of the structure of conversations by cheapest edits.

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``. Edits: K keep a turn (free), R give it
the role user or assistant (1), D delete it (2), I insert an empty turn of user or assistant (5); a truncated turn
that stays costs 5 more, and blank and repeated turns have to go. The states of the pattern (nothing yet, after s,
after u, after a) times the number of turns passed are the nodes of a lattice, the edits its edges.

The search is a bidirectional Dijkstra over that lattice: one heap from the start, one from the accepting ends.
A label is the least cost and, of all edit strings with that cost, the least one; heaps are ordered by cost and
distance passed, so edges of no cost find all labels of their cost final. The search stops only when the two heaps'
least costs add up to more than the best crossing, so all crossings of equal cost are finished; the least of
their concatenated strings is the audit. It names the repair: which role R and I give follows from the state.

Distribution: turns are sorted over ranges of (conversation, turn, role, hash of the text, row), which cuts a
hot conversation, and even one of equal rows, into many tasks. Each cut gives chunks of at most ``CHUNK`` turns.
A conversation in one chunk is searched whole. Of one that lies in several, every chunk is searched for each pair of
states at its ends, without insertions at its end (the next chunk makes them), so that of two edit strings from the
same state neither begins with the other; then costs and ranks of the strings are enough to choose the states along
the chunks, and each chunk's string is taken by them. Only the repaired text's digest needs the turns of a
conversation one after the other: a task streams them, holding one turn at a time and one letter a turn.

Defined results: turns with a null turn come first, equal turns are in order of role and hash of the text, equal
rows are interchangeable. Null texts and roles are one space. A null conv_id is one conversation. A role that is
empty or begins otherwise than with s, u or a cannot be kept. Hashes of 64 bits stand for texts within one
conversation and role. ``gaps`` above what a long holds is the largest long. Other columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import SPACE
from tarnlake.sources.scratch import settle

CHUNK = 4096  # a power of two, so that chunks end where partitions do
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
WANTED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

Node = tuple[int, int]


def edits(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, next state, cost) of every edit that passes a turn."""
    yield "D", state, DELETE
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        if (state, initial) in KEPT:
            yield "K", KEPT[state, initial], more
        yield "R", WANTED[state], REROLE + more


def _search(initials: str, faults: str, begin: int, ends: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """Least cost and least edits of that cost from state ``begin`` over all turns to a state of ``ends``.

    ``tail`` allows insertions after the last turn.
    """
    n = len(initials)

    def ahead(node: Node) -> Iterator[tuple[str, Node, int]]:
        i, state = node
        if i < n or tail:
            yield "I", (i, WANTED[state]), INSERT
        if i < n:
            for letter, to, cost in edits(initials[i], faults[i], state):
                yield letter, (i + 1, to), cost

    def back(node: Node) -> Iterator[tuple[str, Node, int]]:
        i, state = node
        for before in range(4):
            if (i < n or tail) and WANTED[before] == state:
                yield "I", (i, before), INSERT
            if i:
                for letter, to, cost in edits(initials[i - 1], faults[i - 1], before):
                    if to == state:
                        yield letter, (i - 1, before), cost

    labels: list[dict[Node, tuple[int, str]]] = [{(0, begin): (0, "")}, {(n, end): (0, "") for end in ends}]
    heaps: list[list[tuple[int, int, Node]]] = [[(0, 0, node) for node in side] for side in labels]
    done: list[set[Node]] = [set(), set()]
    best = 0 if labels[0].keys() & labels[1].keys() else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = int(heaps[1][0][0] < heaps[0][0][0])
        mine, theirs = labels[side], labels[1 - side]
        cost, passed, node = heappop(heaps[side])
        if node in done[side]:
            continue
        done[side].add(node)
        text = mine[node][1]
        for letter, to, more in back(node) if side else ahead(node):
            new = (cost + more, letter + text if side else text + letter)
            old = mine.get(to)
            if old is None or new < old:
                mine[to] = new
                if old is None or new[0] < old[0]:
                    heappush(heaps[side], (new[0], n - to[0] if side else to[0], to))
                if to in theirs and (best is None or new[0] + theirs[to][0] < best):
                    best = new[0] + theirs[to][0]
    if best is None:
        return None
    met = [node for side in (0, 1) for node in done[side] if node in labels[1 - side]]
    sums = ((labels[0][node], labels[1][node]) for node in met)
    return best, min(f[1] + b[1] for f, b in sums if f[0] + b[0] == best)


@lru_cache(maxsize=20_000)
def _short_search(*problem) -> tuple[int, str] | None:
    return _search(*problem)


def search(initials: str, faults: str, begin: int = START, ends: tuple[int, ...] = ACCEPTING, tail: bool = True):
    """``_search``; those of short conversations, which repeat, are remembered."""
    return (_short_search if len(initials) <= 64 else _search)(initials, faults, begin, ends, tail)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the checksum of ``conv_id:turn`` names."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    times = F.when(hit == 3, 2).otherwise(1)
    return (
        conversations.where(hit != 0)
        .select("conv_id", "turn", F.when(hit == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), times.alias("times"))
        .select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_"))
        .drop("_")
    )


def _same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    same = F.lit(True)
    for c in columns:
        same &= left[c].eqNullSafe(right[c])
    return same


def sorted_turns(turns: DataFrame) -> DataFrame:
    """The turns written in order of conversation and turn, with ``place``, which grows along that order."""
    keys = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("hash"), F.asc("row")]
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("hash", F.xxhash64("text"))
    seen = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    fault = F.when(seen == "", "b").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-")
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return settle(
        ordered.select(
            F.monotonically_increasing_id().alias("place"),
            *["conv_id", "turn", "role", "text", "hash"],
            F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
            fault.alias("fault"),
        ),
        "turns",
    )


def chunks_of(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, its first place, initials and faults of its turns, and how many of each fault."""
    facts = turns.drop("text", "turn")
    firsts = facts.groupBy("conv_id", "role", "hash").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    firsts = settle(firsts.where("n > 1").drop("n"), "repeated-turns")
    repeated = (F.col("fault") != "b") & (F.col("place") > F.col("first"))
    fault = F.when(repeated, "d").otherwise(F.col("fault"))
    found = facts.join(firsts, _same(facts, firsts, "conv_id", "role", "hash"), "left").select(
        facts["conv_id"], "place", "initial", fault.alias("fault"), F.expr(f"place div {CHUNK}").alias("chunk")
    )
    listed = F.sort_array(F.collect_list(F.struct("place", "initial", "fault")))  # at most CHUNK of them
    count = lambda kind: F.count_if(F.col("fault") == kind)
    grouped = found.groupBy("conv_id", "chunk").agg(
        F.min("place").alias("place"), listed.alias("listed"), *[count(k).alias(f"n_{k}") for k in "bdt"]
    )
    text = lambda field: F.array_join(F.transform("listed", lambda s: s[field]), "").alias(field + "s")
    return settle(grouped.select("conv_id", "chunk", "place", text("initial"), text("fault"), "n_b", "n_d", "n_t"), "turn-chunks")


def _searched(chunks: DataFrame) -> DataFrame:
    """Each chunk with its ``ways`` (states at its ends, cost, rank of the edits, edits) and illegal neighbours."""
    along = Window.partitionBy("conv_id").orderBy("chunk")
    placed = chunks.select(
        "*",
        F.lag(F.right("initials", F.lit(1))).over(along).alias("ahead"),
        F.lead("chunk").over(along).isNull().alias("last"),
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {"illegal": [], "ways": []}
            for initials, faults, ahead, last in zip(*(batch[c].to_pylist() for c in ("initials", "faults", "ahead", "last"))):
                line = (ahead or "") + initials
                made["illegal"].append(sum(line[i : i + 2] not in LEGAL for i in range(len(line) - 1)))
                ways = []
                for begin in range(4) if ahead else (START,):
                    ends = [(-1, ACCEPTING)] if last else [(end, (end,)) for end in range(4)]
                    found = [(audit, end, cost) for end, to in ends for cost, audit in [search(initials, faults, begin, to, last) or (-1, "")] if cost >= 0]
                    ways += [
                        {"begin": begin, "end": end, "cost": cost, "rank": rank, "audit": audit}
                        for rank, (audit, end, cost) in enumerate(sorted(found))
                    ]
                made["ways"].append(ways)
            kept = [batch[c] for c in kept_columns]
            more = [pa.array(made["illegal"], pa.int64()), pa.array(made["ways"], way_type)]
            yield pa.RecordBatch.from_arrays(kept + more, names=[*kept_columns, "illegal", "ways"])

    kept_columns = ["conv_id", "chunk", "place", "n_b", "n_d", "n_t", "ahead", "last"]
    way_type = pa.list_(
        pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])
    )
    schema = "conv_id long, chunk long, place long, n_b long, n_d long, n_t long, ahead string, last boolean, illegal long"
    schema += ", ways array<struct<begin: int, end: int, cost: long, rank: int, audit: string>>"
    return settle(placed.mapInArrow(rows, schema), "searched-chunks")


def _chosen(key: tuple, ways: pa.Table) -> pa.Table:
    """The states along the chunks of one conversation: least cost, then least rank in the first chunk that differs."""
    of: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
    for row in ways.select(["chunk", "begin", "end", "cost", "rank"]).to_pylist():
        of.setdefault(row["chunk"], {}).setdefault(row["begin"], []).append((row["cost"], row["rank"], row["end"]))
    rest, steps = {-1: 0}, {}
    for chunk in sorted(of, reverse=True):
        best = {}
        for begin, found in of[chunk].items():
            fitting = [(cost + rest[end], rank, end) for cost, rank, end in found if end in rest]
            if fitting:
                cost, _, end = min(fitting)
                best[begin], steps[chunk, begin] = cost, end
        rest = best
    state, out = START, {"chunk": [], "begin": [], "end": []}
    for chunk in sorted(of):
        out["chunk"].append(chunk)
        out["begin"].append(state)
        state = steps[chunk, state]
        out["end"].append(state)
    kinds = {"chunk": pa.int64(), "begin": pa.int32(), "end": pa.int32()}
    made = {c: pa.array(out[c], t) for c, t in kinds.items()}
    return pa.table({"c_conv": pa.array([key[0].as_py()] * len(out["chunk"]), pa.int64()), **made})


def audits(searched: DataFrame) -> DataFrame:
    """conv_id, chunk, place, cost and edits of every chunk."""
    alone = F.col("ahead").isNull() & F.col("last")
    single = searched.where(alone).select("conv_id", "chunk", "place", F.col("ways")[0].alias("way"))
    several = searched.where(~alone).select("conv_id", "chunk", "place", F.explode("ways").alias("way"))
    costs = several.select("conv_id", "chunk", "way.begin", "way.end", "way.cost", "way.rank")
    chosen = costs.groupBy("conv_id").applyInArrow(_chosen, "c_conv long, chunk long, begin int, end int")
    chosen = settle(chosen.toDF("c_conv", "c_chunk", "c_begin", "c_end"), "chosen-states")
    taken = several.join(
        chosen,
        F.col("conv_id").eqNullSafe(F.col("c_conv"))
        & (F.col("chunk") == F.col("c_chunk"))
        & (F.col("way.begin") == F.col("c_begin"))
        & (F.col("way.end") == F.col("c_end")),
    ).select("conv_id", "chunk", "place", "way")
    found = single.unionByName(taken)
    return settle(found.select("conv_id", "chunk", "place", "way.cost", "way.audit"), "audits")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str | None, str | None]]:
    """(conv_id, letter, role, text) of every edit in order; a chunk's edits come right before its turns."""
    letters, at, conv, state = "", 0, None, START

    def inserts():
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            at, state = at + 1, WANTED[state]
            yield conv, "I", ROLE[state], ""

    started = False
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("conv_id", "role", "text", "audit"))
        for conv_id, role, text, audit in zip(*columns):
            if audit is not None:
                yield from inserts()  # the end of the chunk before
                if not started or conv_id != conv:
                    state, conv, started = START, conv_id, True
                letters, at = audit, 0
                continue
            yield from inserts()
            letter = letters[at]
            at += 1
            if letter == "K":
                state = KEPT[state, role[0]]
            elif letter == "R":
                state = WANTED[state]
                role = ROLE[state]
            yield (conv, letter, None, None) if letter == "D" else (conv, letter, role, text)
    yield from inserts()


def _in_order(turns: DataFrame, edits_of: DataFrame) -> DataFrame:
    """Turns and edits by conversation, each chunk's edits right before its turns."""
    text = turns.select("conv_id", "place", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("audit"))
    none = [F.lit(None).cast("string").alias(c) for c in ("role", "text")]
    marks = edits_of.select("conv_id", "place", F.lit(0).alias("kind"), *none, "audit")
    order = ["conv_id", "place", "kind"]
    return text.unionByName(marks).repartition("conv_id").sortWithinPartitions(*order)


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, position, edit, role and text of every turn of the repaired conversations."""
    ordered = sorted_turns(turns)
    found = audits(_searched(chunks_of(ordered)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "position", "edit", "role", "text")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        made, size, conv, position = [], 0, None, 0

        def batch():
            columns = zip(*made) if made else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))

        for conv_id, letter, role, text in _walk(batches):
            if conv_id != conv:
                conv, position = conv_id, 0
            if letter != "D":
                made.append((conv_id, position, letter, role, text))
                position, size = position + 1, size + len(text)
            if size > 1 << 20 or len(made) > 5000:
                yield batch()
                made, size = [], 0
        yield batch()

    schema = "conv_id long, position long, edit string, role string, text string"
    return _in_order(ordered, found).mapInArrow(rows, schema)


def _digests(ordered: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256, hashed as the turns stream by."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        conv, letters, digest, joint = None, [], None, b""

        def batch():
            columns = list(zip(*made)) if made else [[]] * 3
            kinds = (pa.int64(), pa.string(), pa.string())
            names = ["d_conv", "audit", "repaired_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for conv_id, letter, role, text in _walk(batches):
            if digest is None or conv_id != conv:
                if digest is not None:
                    made.append((conv, "".join(letters), digest.hexdigest()))
                    if len(made) >= 5000:
                        yield batch()
                        made = []
                conv, letters, digest, joint = conv_id, [], hashlib.sha256(), b""
            letters.append(letter)
            if letter != "D":
                digest.update(joint + f"{role}:{text}".encode())
                joint = b"\n"
        if digest is not None:
            made.append((conv, "".join(letters), digest.hexdigest()))
        yield batch()

    return ordered.mapInArrow(rows, "d_conv long, audit string, repaired_sha256 string")


def report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``: the faults of its ``turns``, cost, edits and digest of the repair."""
    ordered = sorted_turns(turns)
    searched = _searched(chunks_of(ordered))
    found = audits(searched)
    digests = settle(_digests(_in_order(ordered, found)), "digests")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    holes = F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count_distinct("turn")
    gaps = ordered.groupBy(F.col("conv_id").alias("g_conv")).agg(
        F.least(F.coalesce(holes, F.lit(0)), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("gaps")
    )
    total = lambda c, name: F.sum(c).alias(name)
    faults = searched.groupBy(F.col("conv_id").alias("f_conv")).agg(
        total("n_b", "blank"), total("n_d", "duplicate"), total("n_t", "truncated"), total("illegal", "illegal")
    )
    costs = found.groupBy(F.col("conv_id").alias("c_conv")).agg(total("cost", "cost"))
    out = conversations.select("conv_id").distinct()
    for part, key in ((gaps, "g_conv"), (faults, "f_conv"), (costs, "c_conv"), (digests, "d_conv")):
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(key)), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
