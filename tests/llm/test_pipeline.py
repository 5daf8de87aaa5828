"""The stages one by one: each against brute force on its own input."""

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing
from tessera.llm.common import written
from tests.llm import test_decontamination, test_minhash, test_quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.lang, r.source) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        docs = written(stage(spark, docs, sf), name)
        seen.append(name)
        if name == "quality_rules":
            expect = {r[0] for r in test_quality.brute(before) if r[-1]}
        elif name == "near_duplicates":
            expect = {r[0] for r in test_minhash.brute([b[:2] for b in before]) if r[3]}
        elif name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            expect = {b[0] for b in before} - {i for i, _ in test_decontamination.brute([b[:2] for b in before], items)}
        elif name == "source_mixing":
            con = duckdb.connect()
            con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
            con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", before)
            taken = {r[0]: r[4] for r in con.sql(mixing.SHARES_SQL).fetchall()}
            held = {}
            for r in docs.collect():
                held[r.doc_id] = held.get(r.doc_id, 0) + len(r.text.split())
            assert held == {k: v for k, v in taken.items() if v}
            mixed = sorted((r.doc_id, r.text) for r in docs.collect())
            continue
        else:
            tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            rows = docs.orderBy("start").collect()
            assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
            assert [r.doc_id for r in rows] == [i for i, _ in mixed]
            assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in mixed)
            continue
        assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} == expect and len(expect) > 20
    assert len(seen) == 5
