"""Jaccard join, near-dedup and components against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlake.llm import embedding_dedup, ngram_join, words
from tarnlake.llm.graph import components

from .conftest import documents, prose


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def split(text: str | None) -> list[str]:
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered(text or "")) if w]


def shingles(text: str | None) -> set:
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def smallest(ids: list, links: list[tuple]) -> dict:
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], changed = low, True
    return label


def expected_classes(rows: list[tuple]) -> list[tuple]:
    sets = [(d, shingles(t)) for d, t in rows]
    links = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[:i]
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    label = smallest([d for d, _ in rows], links)
    return sorted(((d, len(s), label[d]) for d, s in sets), key=str)


def expected_links(rows: list[tuple]) -> dict:
    """Of each doc_id the largest number of documents that a set of it links with."""
    sets = {(d, frozenset(shingles(t))) for d, t in rows if d is not None and shingles(t)}
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    found: dict = {d: 0 for d, _ in rows}
    for d, s in sets:
        found[d] = max(found[d], sum(linked(s, o) for _, o in sets) - 1)
    return found


def classes(df) -> list[tuple]:
    found = ngram_join.similarity_classes(df).select("doc_id", "n_shingles", "component_id")
    return sorted(map(tuple, found.collect()), key=str)


@given(st.lists(st.text(alphabet=list("aB é\n\x0b\x1cßİ"), max_size=12), max_size=8))
@settings(max_examples=300, deadline=None)
def test_equal_words_have_equal_hashes(texts):
    hashes, counts = words.word_hashes(pa.array(texts, pa.large_string()))
    expected = [split(t) for t in texts]
    assert counts.tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    of = {}
    for word, h in zip(flat, hashes.tolist()):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)
    sets = ngram_join.shingle_sets(pa.array(texts, pa.large_string()))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]


def test_words_longer_than_a_block_are_hashed_alike():
    long = "ab" * (1 << 20)
    texts = [f"x {long} y {long}", long]
    hashes, counts = words.word_hashes(pa.array(texts, pa.large_string()))
    assert counts.tolist() == [4, 1] and hashes[1] == hashes[3] == hashes[4] != hashes[0]


def test_join_on_edge_cases(spark, edge, edge_rows, empty):
    assert classes(edge) == expected_classes(edge_rows)
    links = {r["doc_id"]: r["n_links"] for r in ngram_join.similarity_classes(edge).collect()}
    assert links == expected_links(edge_rows)
    assert classes(empty) == []


def corpus(seed: int) -> list[tuple]:
    """Copies, chains of edits across the threshold, a passage that many share, and texts of their own."""
    r = random.Random(seed)
    passage, rows = prose(seed + 1000, 40), []
    for k in range(40):
        rows.append(prose(seed * 100 + k, r.randrange(3, 90)) + (" " + passage if k % 2 else ""))
    for k in range(6):
        text = split(prose(seed * 100 + 70 + k, r.randrange(30, 120)))
        for _ in range(r.randrange(2, 14)):
            rows.append(" ".join(text))
            for _ in range(r.randrange(0, 3)):
                text[r.randrange(len(text))] = f"w{r.randrange(10**6)}"
    rows += rows[:5] + [passage] * 3 + [passage + " a", "z " + passage]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 3)  # several chunks and query batches even here
    monkeypatch.setattr(ngram_join, "QUERIES_AT_ONCE", 4)
    rows = corpus(seed)
    assert classes(documents(spark, rows)) == expected_classes(rows)


@pytest.mark.parametrize("few", [0, 2, 1000])
def test_only_tokens_of_many_sets_carry_the_tokens_before_them(spark, few, monkeypatch):
    """Most shared tokens are shared by two sets by chance; what is written for these stays short."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    settled, real = {}, ngram_join.settle
    monkeypatch.setattr(ngram_join, "settle", lambda df, label: settled.setdefault(label, []).append(real(df, label)) or settled[label][-1])
    rows = corpus(4)
    assert classes(documents(spark, rows)) == expected_classes(rows)
    matrix = settled["matrix"][-1].select("token", "before").collect()
    held = Counter(r["token"] for r in matrix)
    assert matrix and all((r["before"] is None) == (held[r["token"]] <= few) for r in matrix)
    assert all(held[r["token"]] > few for r in settled["group-tokens"][0].collect())


@pytest.mark.parametrize("look_back", [1, 8])
def test_texts_of_shared_sentences_equal_brute_force(spark, look_back, monkeypatch):
    """Short texts of a few common sentences in any order share many prefix tokens, in other places each."""
    monkeypatch.setattr(ngram_join, "LOOK_BACK", look_back)
    r = random.Random(look_back)
    pool = [prose(500 + k, r.randrange(6, 20)) for k in range(14)]
    rows = []
    for k in range(150):
        picked = r.sample(pool, r.randrange(3, 9))
        rows.append(" ".join(picked + ([f"own{k} words{k}"] if k % 3 else [])))
        if k % 5 == 0:
            rows.append(rows[-1] + " end")
    rows = list(enumerate(rows)) + [(3, rows[7]), (3, rows[7])]
    found = ngram_join.similarity_classes(documents(spark, rows)).collect()
    assert {r["doc_id"]: r["n_links"] for r in found} == expected_links(rows)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == expected_classes(rows)


def test_tokens_that_always_follow_another_do_not_lead(spark):
    rows = [(1, []), (2, [1]), (3, [1, 2]), (1, []), (2, [1]), (4, [9]), (4, [8]), (5, [7]), (5, [])]
    matrix = spark.createDataFrame(rows, "token long, before array<long>")
    assert {r["token"] for r in ngram_join.leading(matrix).collect()} == {1, 4, 5}


def test_every_link_of_a_family_is_listed_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    monkeypatch.setattr(ngram_join, "QUERIES_AT_ONCE", 4)
    rows = corpus(4) + [(0, prose(9, 60)), (1, None), (900, corpus(4)[0][1]), (900, corpus(4)[0][1])]
    text = split(prose(10, 120))
    rows += [(1000 + i, " ".join([*text[: 9 * i], f"w{i}", *text[9 * i + 1 :]])) for i in range(12)]  # all link
    sets = {(d, frozenset(shingles(t))) for d, t in rows if shingles(t)}
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    found = ngram_join.similar(documents(spark, rows), pairs=True)
    rep = {}
    for d, s in sorted(sets, key=lambda x: x[0]):
        rep.setdefault(s, d)
    expected = sorted(tuple(sorted((rep[x], rep[y]))) for x in rep for y in rep if id(x) < id(y) and linked(x, y))
    assert sorted(tuple(sorted((r["a"], r["b"]))) for r in found.links.collect()) == expected
    assert len(expected) >= 66
    for by_pairs in (found.classes, ngram_join.similarity_classes(documents(spark, rows))):
        assert {r["doc_id"]: r["n_links"] for r in by_pairs.collect()} == expected_links(rows)


def test_a_family_writes_rows_in_proportion_to_its_documents(spark):
    text = split(prose(11, 160))
    rows = [(i, " ".join([*text[: i % 150], f"w{i}", *text[i % 150 + 1 :]])) for i in range(600)]
    found = ngram_join.similar(documents(spark, rows))
    assert {r["n_links"] for r in found.classes.collect()} == {599}
    assert {r["component_id"] for r in found.classes.collect()} == {0}
    assert found.links.count() <= 5 * 600  # 179,700 pairs


def test_trees_of_a_block_that_grow_together(spark, monkeypatch):
    """Chains whose ends are far apart, in one chunk and in several, with copies."""
    rows = []
    for chain in range(3):
        text = split(prose(20 + chain, 60))
        for step in range(14):
            rows.append((100 * chain + step, " ".join(text)))
            text[4 * step] = f"new{chain}x{step}"
        rows += [(100 * chain + 50 + i, rows[-1][1]) for i in range(chain)]
    for chunk, at_once in ((256, 4096), (3, 2), (1, 1)):
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        monkeypatch.setattr(ngram_join, "QUERIES_AT_ONCE", at_once)
        found = ngram_join.similarity_classes(documents(spark, rows)).collect()
        assert {r["doc_id"]: r["n_links"] for r in found} == expected_links(rows)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == expected_classes(rows)


def test_components_of_paths_stars_and_cycles(spark):
    r = random.Random(3)
    ids = r.sample(range(10**6), 300)
    edges = [(ids[i], ids[i + 1]) for i in range(99)] + [(ids[100], ids[i]) for i in range(101, 160)]
    edges += [(ids[160 + i], ids[160 + (i + 1) % 20]) for i in range(20)] + [(ids[200], ids[200])]
    edges += [(r.choice(ids[210:]), r.choice(ids[210:])) for _ in range(60)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    expected = smallest(sorted(nodes), [e for e in edges if e[0] != e[1]])
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == expected and len(found) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(seed: int, groups: int = 30, size: int = 12, dim: int = 24) -> list[tuple]:
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = r.standard_normal(dim)
        base /= np.linalg.norm(base)
        for _ in range(size):
            rows.append((base + r.standard_normal(dim) * r.choice([0.01, 0.03, 0.045, 0.08])) * r.uniform(0.5, 3))
    rows += [x.copy() for x in rows[:7]] + list(r.standard_normal((200, dim)))
    return [(i, x.astype(np.float32).tolist()) for i, x in enumerate(rows)]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rows = vectors(1)
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", embedding_dedup.F.lit("x"))
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(found) == len(rows)
    links = np.array([found[i]["n_links"] for i in range(len(rows))])
    assert (links <= close.sum(1)).all()  # none below the threshold
    assert links.sum() >= 0.99 * close.sum()
    label = smallest(range(len(rows)), list(zip(*np.nonzero(close))))
    agree = [found[i]["component_id"] == label[i] for i in range(len(rows))]
    assert np.mean(agree) >= 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_near_duplicates_on_edge_cases(spark):
    a, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [
        (1, a), (2, [2.0, 4.0, 6.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]),
        (7, [1.0, None, 1.0]), (8, []), (9, [1.0, 2.0]), (10, [-1.0, -2.0, -3.0]), (11, a), (11, a), (None, a),
        (12, [1e-30, 2e-30, 3e-30]), (13, [0.0, 0.0, 0.0]), (14, [3e38, -3e38, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 13, 14)]
    linked = [(1, 3, 1, True), (2, 3, 1, False), (11, 3, 1, False), (11, 3, 1, False), (12, 3, 1, False)]
    assert found == sorted([*alone, *linked, (None, 0, None, False)], key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_window_gives_the_recall_it_is_asked_for():
    grid, n = 2, 20_000
    width = embedding_dedup.window(0.95, 0.99, grid, 16, 1)
    r = np.random.default_rng(0)
    x = r.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((n, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.95 * x + np.sqrt(1 - 0.95**2) * y
    a = embedding_dedup.directions(64, 16)
    hits = np.abs((x - near) @ a) <= width
    assert abs((hits[:, :grid].all(1) & (hits.sum(1) >= 15)).mean() - 0.99) < 0.02
