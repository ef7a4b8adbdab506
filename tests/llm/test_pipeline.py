"""The pipeline against plain Python, stage by stage, and the registered queries."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np

from tarnlake.llm import packing, queries, secrets

from .conftest import documents, prose
from .test_quality import counted
from .test_similarity import expected_classes
from .test_spans import base_secrets
from .test_text_models import BPE


def rows_of_corpus() -> list[tuple]:
    shared = "this very line stands in many documents"
    rows = [(i, prose(i, 60 + i % 30)) for i in range(20)]
    rows += [(30 + i, prose(i, 60 + i % 30)) for i in range(6)]  # copies
    rows += [(40 + i, prose(i, 60 + i % 30) + " one more") for i in range(4)]  # near copies
    rows += [(50 + i, f"{shared}\n{prose(50 + i, 70)}\n {shared.upper()}") for i in range(5)]
    rows += [(60 + i, f"{prose(60 + i, 55)} password=b7db7aa4a5fcc7830{i} {prose(70 + i, 9)} AKIASJDZWJNP6ZRYWK4{i}") for i in range(3)]
    rows += [(70, "too short"), (71, ""), (72, None), (73, "again and again " * 40), (74, prose(74, 9000))]
    return rows


def masked(text: str) -> str:
    out, at = [], 0
    spans = [s.split(":") for s in base_secrets(text).split(",") if s]
    for kind, start, end in spans:
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])


def without_shared_lines(rows: list[tuple]) -> list[tuple]:
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders: dict[str, set] = {}
    for doc, text in rows:
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    return [(d, "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d)) for d, t in rows]


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = rows_of_corpus()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]

    expected = [(d, t) for d, t in rows if not counted(t)[-1]]
    plain = [lambda r: r, without_shared_lines, lambda r: [x for x in r if x[0] in smallest_of(r)], lambda r: [(d, masked(t)) for d, t in r]]
    for (name, stage), step in zip(corpus_pipeline.STAGES, plain):
        docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)), f"test-{name}")
        expected = step(expected)
        assert sorted(map(tuple, docs.select("doc_id", "text").collect())) == sorted(expected), name
        assert docs.columns == ["doc_id", "text", *documents(spark, []).columns[2:]]
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer, pieces = packing.WordEncoder(BPE).tokenizer, Counter()
    for doc, text in expected:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            pieces[doc, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == pieces
    assert "AKIA" not in " ".join(t for _, t in expected) and secrets.strong_spans(expected[0][1]) == []


def smallest_of(rows: list[tuple]) -> set:
    return {component for _, _, component in expected_classes(rows)}


def test_stages_take_edge_cases_and_empty_tables(spark, edge, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        assert stage(spark, edge, str(tmp_path)).count() > 0


def test_odd_column_names_pass_through_the_stages(spark, sf_dir):
    odd = ["__key", "__bitmap", "__found", "__gone", "a.b", "row", "bitmap", "found", "__row", "f_doc", "s_length"]
    line = "a line that three documents hold, of some length\n"
    texts = [(i, line + " ".join(f"w{i}x{k}." for k in range(60)) + " token = abcdefghijklmnop") for i in range(4)]
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in odd)
    docs = spark.createDataFrame([(d, t, 7, *(f"{c}{d}" for c in odd)) for d, t in texts], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns and found.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        rows = [r.asDict() for r in found.collect()]
        assert len(rows) == 4 and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in odd), name
        if name == "line_dedup":
            assert {r["doc_id"] for r in rows if r["text"].startswith("a line")} == {3}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "secret_scans":
            assert all(r["text"].endswith("[assign]") for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 4


def test_every_operator_is_registered():
    numbers = [int(re.match(r"op(\d+)_", name).group(1)) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    with_sql = {"op2_ngram_jaccard_join", "op3_embedding_near_dedup", "op9_line_dedup", "op11_hard_negatives"}
    assert set(queries.ORACLES) == with_sql


def _answers(sf_dir: str, name: str) -> list[tuple]:
    import duckdb

    with duckdb.connect() as connection:
        for table in ("documents", "embeddings"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        cursor = connection.execute(queries.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        return sorted(tuple(row[columns.index(c)] for c in sorted(columns)) for row in cursor.fetchall())


def test_queries_equal_their_sql(spark, sf_dir):
    for name in queries.ORACLES:
        df = queries.QUERIES[name](spark, sf_dir)
        assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == _answers(sf_dir, name), name
