"""Packing, SentencePiece, language ID, LM scoring and line dedup."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlake.llm import langid, line_dedup, lm, packing, pieces, queries

from .conftest import documents, prose
from .test_similarity import split

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


# Packing


@given(st.lists(st.text(max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_whole_text(texts):
    texts = texts + ["a<|endoftext|>b", "don't  'll x\x1cy", "é ́"]
    encoder = packing.WordEncoder(BPE)
    whole = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(pa.array(texts, pa.large_string()))] == whole


ENCODER = packing.WordEncoder(BPE)
SHOWN = "aZéÉßñIİŸſK\u212a1²½.,-$€'’“—<|>=\u0301\u0338 \n\t\x0b\x1c\x85\xa0\u205f中😀"
MARKS = [".", ",", "!", ";", "...", "1", "42", "(", "é.", "—"]


@given(st.lists(st.text(SHOWN, max_size=40), max_size=5), st.integers(1, 99))
@settings(max_examples=150, deadline=None)
def test_ids_of_runs_are_those_of_the_whole_text(texts, block):
    texts = texts + ["He'll don'T ''s 'Tis <|ENDOFTEXT|>A<|endoftext|>B <|startoftext|", "I'İ Cafe\u0301-ÉCLAIR²½ =\u0338 ≠"]
    whole = [e.ids for e in ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "BLOCK", block)
        assert [x.tolist() for x in ENCODER.encode(pa.array(texts, pa.large_string()))] == whole


def test_every_character_has_its_ids_beside_others():
    texts = [f"x{c}Y {c}{c} 1{c}. .{c}1 {c}'s" for c in map(chr, range(0x3000))]
    whole = [e.ids for e in ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ENCODER.encode(pa.array(texts, pa.large_string()))] == whole


def test_words_are_encoded_once_whatever_stands_beside_them(monkeypatch):
    seen, learn = [], packing.WordEncoder._learn

    def counted(self, words, *more):
        seen.append(len(words))
        learn(self, words, *more)

    monkeypatch.setattr(packing.WordEncoder, "_learn", counted)
    words = ["packing", "straße", "niño"]
    written = [x for word in words for x in (word, word.title(), word.upper().replace("SS", "ß"))]
    texts = pa.array([f"{a}{x}{b}" for x in written for a in MARKS for b in MARKS], pa.large_string())
    encoder = packing.WordEncoder(BPE)
    first = [x.tolist() for x in encoder.encode(texts)]
    assert sum(seen) < 40  # 900 different strings
    assert [x.tolist() for x in encoder.encode(texts)] == first and len(seen) == 1


def test_words_are_forgotten_when_they_are_many(monkeypatch):
    encoder = packing.WordEncoder(BPE)
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    texts = [" ".join(f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20)) for j in range(20)]
    whole = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for text, ids in zip(texts, whole):
        assert encoder.encode(pa.array([text], pa.large_string()))[0].tolist() == ids
        assert len(encoder.words) <= 25


def test_a_vocabulary_with_other_rules_is_split_at_white_space(tmp_path):
    rules = json.loads(open(BPE, encoding="utf-8").read())
    rules["normalizer"] = None  # cases differ then
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    texts = ["Packing PACKING packing,", "don't É1"]
    encoder = packing.WordEncoder(str(path))
    whole = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(pa.array(texts, pa.large_string()))] == whole


@given(st.dictionaries(st.integers(1, 50), st.integers(0, 40), max_size=25))
@settings(max_examples=200, deadline=None)
def test_plans_use_every_piece_once(counts):
    ways = packing.plan_of(counts, 50)
    used = Counter()
    for lengths, times in ways:
        assert sum(lengths) <= 50 and times > 0
        for length in lengths:
            used[length] += times
    assert used == Counter({k: v for k, v in counts.items() if v})
    assert sum(times for lengths, times in ways if 2 * sum(lengths) <= 50) <= 1  # two of them would fit together


def test_exact_complements_are_found():
    assert len([1 for _, n in packing.plan_of({30: 5, 20: 5}, 50) for _ in range(n)]) == 5
    assert sum(n for _, n in packing.plan_of({25: 4, 15: 4, 10: 4}, 50)) == 4
    assert sum(n for _, n in packing.plan_of({20: 3, 13: 3, 10: 3, 7: 3}, 50)) == 3


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 60), max_size=25))
@settings(max_examples=200, deadline=None)
def test_no_plan_is_longer_than_best_fit_alone(counts):
    pieces, rooms = sorted((length for length, n in counts.items() for _ in range(n)), reverse=True), []
    for length in pieces:  # piece by piece
        fitting = [room for room in rooms if room >= length]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else 60) - length)
    assert sum(times for _, times in packing.plan_of(counts, 60)) <= len(rooms)


def test_packed_pieces_on_edge_cases(spark, edge, edge_rows, empty):
    made = packing.token_pieces(edge, BPE)
    found = packing.packed(made).collect()
    tokenizer = packing.WordEncoder(BPE).tokenizer
    expected = Counter()
    for doc, text in edge_rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected[doc, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    filled = defaultdict(list)
    for r in found:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= -(-sum(r["length"] for r in found) // 4096) + 1
    assert packing.packed(packing.token_pieces(empty, BPE)).count() == 0
    assert "ids" in packing.packed(packing.token_pieces(edge.limit(2), BPE, with_ids=True)).columns


# SentencePiece


def lattice(text: str) -> tuple[float, list[int]]:
    """The best path over the whole text at once."""
    marked = [pieces.BLANK if c == " " else "no piece" if c == pieces.BLANK else c for c in " " + text]
    best, back = [0.0] + [float("-inf")] * len(marked), [None] * (len(marked) + 1)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - PIECES.longest), end):
            found = PIECES.scores.get("".join(marked[start:end]))
            if found and best[start] + found[0] > best[end]:
                best[end], back[end] = best[start] + found[0], (start, [found[1]])
        if back[end] is None:
            c = pieces.BLANK if marked[end - 1] == "no piece" else marked[end - 1]
            best[end] = best[end - 1] + PIECES.byte_score
            back[end] = (end - 1, [PIECES.byte_ids[b] for b in c.encode()])
    ids, at = [], len(marked)
    while at:
        at, step = back[at]
        ids = step + ids
    return best[-1], ids


TEXTS = st.one_of(st.text(max_size=40), st.text(alphabet=list("abcdethin  ▁\néß日"), max_size=120))


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_streamed_ids_are_those_of_the_whole_lattice(text):
    ids = PIECES.encode(text)
    assert ids == (lattice(text)[1] if text else [])
    assert PIECES.decode(ids) == text
    if text:
        assert [i for part in PIECES.stream(" " + text) for i in part] == ids


def test_the_stream_commits_as_it_goes():
    parts = list(PIECES.stream(" " + "the quick brown fox " * 200))
    assert len(parts) > 50 and max(map(len, parts)) < 100
    long = "thequickbrownfox" * 300
    assert PIECES.decode(PIECES.encode(long)) == long


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_lanes_streams_and_blocks_agree(text):
    expected = lattice(text)[1] if text else []
    for lane, block in ((3, 1 << 20), (96, 8)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(pieces, "LANE", lane)
            patch.setattr(pieces, "BLOCK", block)
            PIECES._forget()
            assert PIECES.encode(text) == expected
            assert [i for part in PIECES.encode_parts(text) for i in part.tolist()] == expected
            crc = zlib.crc32(np.array(expected, "<u4").tobytes())
            assert list(PIECES.digest([text])) == [(len(text), len(expected), crc, True)]
    PIECES._forget()


def test_many_texts_at_once_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_CHARACTERS", 50)
    texts = ["", "one two", "", "one", "x" * 300 + " y", "été ▁ 日本", " ", "one two three " * 20, ""]
    for _ in range(3):
        ids, sizes = PIECES.encode_all(texts)
        assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == [lattice(t)[1] if t else [] for t in texts]
        assert [d[:2] for d in PIECES.digest(texts)] == [(len(t), n) for t, n in zip(texts, sizes.tolist())]
        assert all(d[3] for d in PIECES.digest(texts))


def test_paths_meet_where_no_piece_holds_the_pair():
    text = " the quick ▁ brown fox jumps  over日本 it"
    sure = PIECES.meetings(pieces.characters(text))
    for at in range(1, len(text)):
        pair = text[at - 1 : at + 1].replace(pieces.BLANK, "\0").replace(" ", pieces.BLANK)
        assert sure[at] == (not any(pair in piece for piece in PIECES.scores))


def test_sentencepiece_query_on_edge_cases(spark, edge, edge_rows, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.digests(edge, path).collect()
    assert len(rows) == len(edge_rows) and all(r["round_trip"] for r in rows)
    texts = pieces.decoded(pieces.encoded(edge, path), path).collect()
    assert sorted(r["text"] for r in texts) == sorted(t or "" for _, t in edge_rows)
    assert pieces.digests(empty, path).count() == 0


# Language ID


def test_languages_of_unseen_documents(spark, sf_dir):
    rows = queries.QUERIES["op8_language_id"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_numerals_are_no_letters(spark, edge):
    model = langid.train(edge)
    texts = ["½ 3", "² !", "Ⅷ", "٣", "_", "½ x", "日", None]
    rows = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] == "und" for r in sorted(rows)] == [True] * 5 + [False] * 2 + [True]


def test_a_document_repeated_very_often_is_learned_from_once(spark):
    often = spark.range(20_000).selectExpr("7L AS doc_id", "'the same text' AS text", "'en' AS lang")
    model = langid.train(often)
    assert model.languages == ["en"]
    other = spark.createDataFrame([(8, "un autre texte", "fr"), (7, "a later text", "zz")], often.schema)
    chosen = langid.sampled_ids(often.union(other), 4_000, 50)
    assert sorted(r[0] for r in chosen.collect()) == [7, 8]
    assert langid.train(often.union(other)).languages == ["en", "fr"]


def test_a_rare_language_can_be_predicted(spark):
    common = spark.range(12_000).selectExpr("id AS doc_id", "concat('the cat and the hat ', id) AS text", "'en' AS lang")
    rare = spark.createDataFrame([(20_000 + i, "þetta er íslenska og ekkert annað " * (1 + i % 3), "is") for i in range(2)], common.schema)
    model = langid.train(common.union(rare), sample=500)
    assert model.languages == ["en", "is"]
    found = langid.identify(rare, model).collect()
    assert {r["lang_pred"] for r in found} == {"is"}


def test_weights_are_those_of_a_plain_tf_idf(spark):
    texts = ["Ab ab", "ba, b!", "é"]
    counts = langid.gram_counts(texts)
    plain = [f" {re.sub(' +', ' ', ''.join(c if c.isalpha() else ' ' for c in t.lower()))} " for t in texts]
    grams = [Counter(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1)) for p in plain]
    for row, found in zip(counts, grams):
        assert sorted(row[row > 0]) == sorted(found.values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frequencies, documents = langid.document_frequencies(df)
    assert documents == 3 and sorted(frequencies[frequencies > 0]) == sorted(Counter(g for f in grams for g in f).values())
    idf = np.log(4 / (1 + frequencies)) + 1
    for row, found in zip(langid.weighted(counts, idf), grams):
        seen = Counter(g for f in grams for g in f)
        expected = sorted((1 + np.log(n)) * (np.log(4 / (1 + seen[g])) + 1) for g, n in found.items())
        assert np.allclose(sorted(row[row > 0]), np.array(expected) / np.linalg.norm(expected))


def test_one_pass_of_the_learner_step_by_step():
    """The same updates with plain numbers."""
    import math

    rows = [(np.array([0, 2]), np.array([0.6, 0.8])), (np.array([1, 2]), np.array([1.0, 0.5])), (np.array([0]), np.array([1.0]))]
    labels = np.array([0, 1, 1])
    weights, bias = langid.follow_the_leader(rows, labels, 2, epochs=1)
    z, n = {}, {}
    alpha, beta, l1, l2 = 0.5, 1.0, 0.01, 0.1

    def leader(key):
        zs, ns = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(zs) <= l1 else (math.copysign(l1, zs) - zs) / ((beta + math.sqrt(ns)) / alpha + l2)

    for i in np.random.default_rng(11).permutation(3):
        w = {(k, c): leader((k, c)) for k in rows[i][0].tolist() for c in (0, 1)}
        scores = [sum(w[k, c] * x for k, x in zip(rows[i][0].tolist(), rows[i][1])) for c in (0, 1)]
        p = [math.exp(s) / sum(map(math.exp, scores)) for s in scores]
        for k, x in zip(rows[i][0].tolist(), rows[i][1]):
            for c in (0, 1):
                g = x * (p[c] - (labels[i] == c))
                old = n.get((k, c), 0.0)
                z[k, c] = z.get((k, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[k, c]
                n[k, c] = old + g * g
    for k in range(3):
        assert np.allclose(weights[k], [leader((k, 0)), leader((k, 1))])
    assert not bias.any() and (weights != 0).sum() <= 6


def test_language_edge_cases(spark, edge, edge_rows, empty):
    model = langid.train(edge.where("doc_id IS NOT NULL"))
    rows = langid.identify(edge, model).collect()
    assert len(rows) == len(edge_rows)
    none = sorted([d for d, t in edge_rows if not any(c.isalpha() for c in t or "")], key=str)
    assert sorted([r["doc_id"] for r in rows if r["lang_pred"] == "und"], key=str) == none
    assert langid.train(empty) is None and langid.train(edge.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in langid.identify(edge, None).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_small_penalised_weights_are_zero():
    rows = [(np.array([i % 7, 100 + i % 2, langid.BUCKETS]), np.array([0.1, 1.0, 1.0])) for i in range(400)]
    weights, _ = langid.follow_the_leader(rows, np.arange(400) % 2, 2, l1=1.0)
    assert (weights[:7] == 0).all() and weights[100, 0] > 0 > weights[101, 0]


# LM scoring


def base_scores(rows: list[tuple]) -> dict:
    learn = [split(t) + [None] for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10 != 0]
    c = Counter(w for words in learn for w in words)
    n, v = sum(c.values()), len(c)
    out = defaultdict(list)
    for d, t in rows:
        tokens = split(t) + [None]
        score = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        held = d is not None and zlib.crc32(str(d).encode()) % 10 == 0
        out[d].append((held, len(tokens), sum(c[w] > 0 for w in tokens), n, score))
    return out


def check_base(found, rows):
    expected = base_scores(rows)
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]))
    assert by_doc.keys() == expected.keys()
    for doc, values in expected.items():
        for got, want in zip(sorted(by_doc[doc]), sorted(values)):
            assert got[:4] == want[:4] and got[4] == pytest.approx(want[4], rel=1e-9, abs=1e-9)


def scored(df):
    rest = F.crc32(F.col("doc_id").cast("string")) % 10
    return lm.scores(df, F.coalesce(rest == 0, F.lit(False)), rest != 0).collect()


def test_lm_on_edge_cases(spark, edge, edge_rows, empty, monkeypatch):
    check_base(scored(edge), edge_rows)
    monkeypatch.setattr(lm.summarised, "__defaults__", (8, 4))  # nearly all tokens by the join
    found = scored(edge)
    check_base(found, edge_rows)
    assert all(np.isfinite(r["score"]) for r in found)
    assert scored(empty) == []
    nothing = scored(edge.where("doc_id IS NULL"))
    assert [r["base_score"] for r in nothing] == [0.0, 0.0] and all(r["train_tokens"] == 0 for r in nothing)


def test_probabilities_add_up_to_one():
    model = lm.Model.start(np.array([5, 3, 2, 1]))
    normalisers = model.log_normalisers()
    for context in range(5):
        p = np.exp(model.log_probabilities(np.full(4, context), np.arange(4), normalisers))
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_the_model_beats_its_base_where_context_tells(spark):
    follow = {w: f"after{w}" for w in "abcdefghij"}
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"{w} {follow[w]}" for w in r.choice(list(follow), 60))) for i in range(400)]
    found = [x for x in scored(documents(spark, rows)) if x["held_out"]]
    assert sum(x["score"] for x in found) > 0.9 * sum(x["base_score"] for x in found)


# Line dedup


def kept_lines(rows: list[tuple]) -> dict:
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = defaultdict(list)
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [d is not None and len(h := holders.get(key(x), ())) >= 3 and d != max(h) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out[d].append((len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def line_rows(df) -> dict:
    out = defaultdict(list)
    for r in line_dedup.line_digests(df, line_dedup.keep_bitmaps(df)).collect():
        out[r["doc_id"]].append((r["n_lines"], r["n_dropped"], r["kept_sha256"]))
    return {d: sorted(x) for d, x in out.items()}


def test_lines_on_edge_cases(spark, edge, edge_rows, empty):
    assert line_rows(edge) == {d: sorted(x) for d, x in kept_lines(edge_rows).items()}
    assert line_rows(empty) == {}
    bitmaps = line_dedup.keep_bitmaps(edge)
    shorter = line_dedup.without_dropped_lines(edge, bitmaps)
    assert shorter.schema == edge.schema and shorter.count() == len(edge_rows)
    texts = {r["doc_id"]: r for r in shorter.collect()}
    assert "hold" not in texts[13]["text"] and texts[13]["n_chars"] == len(texts[13]["text"])
    assert texts[15]["text"].startswith("  a line that") and texts[1]["text"] is None


def test_a_line_of_every_document_over_many_ranges(spark):
    lines = [f"shared line number {k} of the corpus" for k in range(3)]
    rows = [(i, "\n".join([lines[0], prose(i, 5), lines[1 + i % 2], lines[0].upper() + " "] * (1 + i % 3))) for i in range(300)]
    df = documents(spark, rows).repartition(7)
    assert line_rows(df) == {d: sorted(x) for d, x in kept_lines(rows).items()}
