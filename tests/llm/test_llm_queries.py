"""The queries of the subpackage on small tables: against SQL, or against plain versions."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import queries

from ..oracle import assert_same
from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.SQL[name], SF)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_op1_recall(spark):
    got = queries.QUERIES["op1_ann"](spark, SF).toPandas()
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    recall = []
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        exact = x @ x[ids == q][0]
        assert np.allclose(own.score, [exact[ids == i][0] for i in own.vec_id], rtol=1e-12)
        exact[ids == q] = -np.inf
        recall.append(len(set(own.vec_id) & set(ids[np.lexsort((ids, -exact))[:20]])) / 20)
    assert len(recall) == (ids % 20 == 0).sum() and np.mean(recall) >= 0.9


def test_op2_base_spans(spark, docs):
    texts = {i: t for i, t, _ in docs}
    for r in queries.QUERIES["op2_pii"](spark, SF).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)
        assert sum(r[f"n_{k}"] for k in brute.KINDS) == (base.count(",") + 1 if base else 0)


def test_op4_held_out_accuracy(spark, docs):
    truth = {i: x for i, _, x in docs}
    rows = queries.QUERIES["op4_language"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(docs) and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.97


def test_op6_round_trip(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_media"](spark, SF).collect()}
    for i, t, _ in docs:
        text = t.encode()
        payload = text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op7_equals_the_library(spark, docs, library):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_bpe"](spark, SF).collect()}
    for i, t, _ in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op8_equals_brute_force(spark, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op8_suffix_dedup"](spark, SF).collect()}
    assert got == brute.repeats([(i, t) for i, t, _ in docs])


def test_op9_packs_whole_documents(spark, docs, library):
    got = queries.QUERIES["op9_packing"](spark, SF).toPandas()
    for i, t, _ in docs:
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 4096))
        for r in own.itertuples():
            part = ids[r.start : r.start + 4096]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 4096 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) * 1.05 + 1
