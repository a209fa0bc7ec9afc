"""The registered queries over whole tables of the smallest test data, against SQL or brute force."""

import os
import zlib
from pathlib import Path

import numpy as np
import pytest

from lodegraph.llm import entries
from tests.llm.test_exact import brute_repeats, brute_simhash, linked, order, rows, tokenizer_path

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def run(spark, name):
    return entries.queries()[name](spark, str(DATA))


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_against_sql(spark, duck, name):
    c = duck.execute(entries.oracle_sql()[name])
    cols = [d[0] for d in c.description]
    df = run(spark, name)
    assert sorted(df.columns) == sorted(cols)
    assert rows(df, *cols) == order(c.fetchall())


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    tok, at, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for d, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert rows(run(spark, "op1_token_store"), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_languages(spark, duck):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = run(spark, "op2_language_id").collect()
    assert len(got) == len(lang)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in got if r.held_out]) > 0.9


def test_near_classes(spark, docs):
    fps = [brute_simhash(t) for _, t in docs]
    want = [(d, f"{f:016x}", docs[r][0]) for (d, _), f, r in zip(docs, fps, linked(fps))]
    assert rows(run(spark, "op4_simhash"), "doc_id", "fingerprint", "component_id") == order(want)


def test_repeats(spark, docs):
    assert rows(run(spark, "op8_suffix_dedup"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(docs, 400)


def test_findings_packing_and_lines(spark, docs):
    text = dict(docs)
    for r in run(spark, "op5_secrets").filter("secret").collect():
        assert any(c in b"0123456789" for c in text[r.doc_id].encode()[r.start : r.end])
    pieces = run(spark, "op6_pack").toPandas()
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == {d: len((t or "").split()) + 1 for d, t in docs}
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in run(spark, "op7_line_dedup").collect()}
    assert {d: n for d, (n, _) in lines.items()} == {d: len((t or "").split("\n")) for d, t in docs}
    assert 0 < sum(n for _, n in lines.values()) < sum(n for n, _ in lines.values()) / 2
