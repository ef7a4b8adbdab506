"""Mixing against explicit blocks, quotients one by one, and shares poured out step by step."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, src string, nil int, shard string, rank string, target string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", "y", 1, "z", "w", "v", 2) for d, t, s in rows], SCHEMA)


def by_quotients(weights, seats: int) -> list[int]:
    """Seats one after the other to the highest quotient."""
    given_, heap = [0] * len(weights), [(-w, i) for i, w in enumerate(weights) if w]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        given_[i] += 1
        heapq.heappush(heap, (-weights[i] / (2 * given_[i] + 1), i))
    return given_


@given(st.lists(st.integers(0, 60), min_size=1, max_size=12), st.integers(0, 80))
@settings(max_examples=300, deadline=None)
def test_sainte_lague_gives_the_highest_quotients(weights, seats):
    found = mixing.sainte_lague(np.array(weights), seats)
    assert found.tolist() == by_quotients(weights, seats)


def poured(words: list[int], weights=(5, 2, 1), most: int = 3) -> list[float]:
    """Shares by weight; what is above a limit is shared again until nothing is."""
    weight = [weights[i % len(weights)] for i in range(len(words))]
    target, full, total = [0.0] * len(words), [w == 0 for w in words], sum(words)
    while total - sum(target) > 1e-9 and not all(full):
        left, open_weight = total - sum(target), sum(w for w, f in zip(weight, full) if not f)
        for i in range(len(words)):
            if not full[i]:
                target[i] += left * weight[i] / open_weight
        for i, w in enumerate(words):
            if target[i] >= most * w:
                target[i], full[i] = most * w, True
    return target


def sources_of(rows) -> list[tuple]:
    return sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))


def count(text) -> int:
    return len([w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w])


def corpus(seed: int, n: int, names: list) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for i in range(n):
        name = names[min(int(r.expovariate(0.8)), len(names) - 1)]
        rows.append((i, " ".join("w" * r.randrange(1, 4) for _ in range(r.choice([0, 1, 3, 9, 40, 200]))), name))
    return rows


def slow(spark, rows, block: int) -> list[tuple]:
    """Documents in their line word by word, blocks one by one; hashes are taken from the operator."""
    documents = mixing.sized(frame(spark, rows))
    names, words = sources_of(rows), {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + count(t)
    target = dict(zip(names, poured([words[s] for s in names])))
    passes = {s: int(target[s] // words[s]) if words[s] else 0 for s in names}
    passes = {s: round(target[s] / words[s]) if words[s] and abs(target[s] / words[s] - round(target[s] / words[s])) < 1e-9 else passes[s] for s in names}
    rest = [max(target[s] - passes[s] * words[s], 0) for s in names]
    rest = [0 if x < 1e-6 else x for x in rest]
    blocks = dict(zip(names, by_quotients(rest, int(sum(rest) / block + 0.5))))
    starts = mixing.shard_quotas(documents, mixing.source_blocks(mixing.targets(mixing.ranked_sources(documents)), block), block)
    start = {(None if r["nil"] else r["src"], r["shard"]): r["start"] for r in starts.collect()}
    line: dict = {s: [] for s in names}
    for r in sorted(documents.collect(), key=lambda r: (r["rank"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"])):
        line[None if r["nil"] else r["src"]].append(r)
    out = []
    for s in names:
        owner = [r["shard"] for r in line[s] for _ in range(r["size"])]  # of each word
        shards = [owner[i] for i in range(0, len(owner), block)]  # of each block
        listed = sorted(set(owner))
        of = {h: [i for i, x in enumerate(shards) if x == h] for h in listed}
        quota = dict(zip(listed, by_quotients([len(of[h]) for h in listed], min(blocks[s], len(shards)))))
        taken = set()
        for h in listed:
            n, q = len(of[h]), quota[h]
            for k in range(n):
                place = (k + start[s, h]) % n
                if (place + 1) * q // n > place * q // n:
                    taken.add(of[h][k])
        at = 0
        for r in line[s]:
            chosen = sum((at + i) // block in taken for i in range(r["size"]))
            out.append((r["doc_id"], r["size"], words[s], round(target[s], 6), passes[s] * r["size"] + chosen))
            at += r["size"]
    return sorted(out, key=str)


def found(df, **parameters) -> list[tuple]:
    rows = mixing.mixed(df, **parameters).collect()
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows), key=str)


@pytest.mark.parametrize(("seed", "shards", "block"), [(1, 4096, 8), (2, 4, 8), (3, 1, 1), (4, 16, 50)])
def test_mixed_equals_explicit_blocks(spark, monkeypatch, seed, shards, block):
    monkeypatch.setattr(mixing, "SHARDS", shards)
    rows = corpus(seed, 160, ["b", "a", None, "", "é", "zz", "Z"])
    got = found(frame(spark, rows), block=block)
    assert got == slow(spark, rows, block)
    by: dict = {}
    for _, size, _, target, taken in got:
        assert 0 <= taken <= 3 * size
        by[target] = by.get(target, 0) + taken
    assert found(frame(spark, rows[::-1]).repartition(7), block=block) == got


def test_sources_meet_their_targets(spark):
    rows = corpus(7, 400, [f"s{i}" for i in range(25)] + [None])
    by: dict = {}
    for r in mixing.mixed(frame(spark, rows)).join(frame(spark, rows).select("doc_id", "source"), "doc_id").collect():
        total = by.setdefault(r["source"], [r["target"], 0])
        total[1] += r["taken"]
    assert len(by) == 26 or len(by) > 5
    assert all(abs(target - taken) < 2 * mixing.BLOCK for target, taken in by.values())


def test_more_seats_open_than_listed(spark):
    names = [f"s{i:03}" for i in range(60)]
    rows = [(i, " ".join("w" * 3 for _ in range(9)), name) for i, name in enumerate(names)]
    assert found(frame(spark, rows), weights=(1,)) == slow_equal(rows)


def slow_equal(rows) -> list[tuple]:
    """Equal weights and sizes: every source's target is its size, one whole pass."""
    return sorted(((d, 9, 9, 9.0, 9) for d, _, _ in rows), key=str)


def test_mixed_on_edge_cases(spark):
    assert found(frame(spark, [(1, "a", "s")]).limit(0)) == []
    assert found(frame(spark, [(1, None, "s"), (2, " \n", None)])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "x y", None), (None, None, None), (3, "w " * 20_000, "t"), (4, "", "u")]
    got = found(frame(spark, rows))
    assert got == slow(spark, rows, mixing.BLOCK)
    assert all(taken <= 3 * size for _, size, _, _, taken in got)
