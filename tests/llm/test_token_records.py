import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_records as tr
from tessera.llm.common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, start string"


@pytest.fixture(scope="module")
def encoder():
    return tr.WordEncoder(open(PATH, encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aZ's'tΣςσ é́\n\t\x0b\x0c\x1c\x85  1²#<|endoftext|>ßİ ")), max_size=30) | st.text(max_size=20), max_size=5))
def test_pieces_give_the_ids_of_whole_texts(encoder, texts):
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    ids, counts = encoder.encode([*texts])
    assert counts.tolist() == [len(e.ids) for e in whole]
    assert ids.tolist() == [i for e in whole for i in e.ids]


def test_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "Hello, world's end <|endoftext|>", "ñandú " * 30000] + ["".join(rng.choices("ab c,é\n", k=rng.randint(0, 80))) for _ in range(60)]
    rows = [(i * 7 % 61 if i % 9 else None, t, "x") for i, t in enumerate(texts)] + [(5, "same", "x"), (5, "same", "x")]
    got = tr.token_output(spark.createDataFrame(rows, DOCS).repartition(3), PATH).orderBy("start").collect()
    tok = Tokenizer.from_file(PATH)
    expect = sorted((-1 if i is None else i, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for i, t, _ in rows for e in [[*tok.encode(t or "", add_special_tokens=False).ids, 2]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expect
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    starts = [r.start for r in got]
    assert starts == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]


def test_empty_table(spark):
    assert tr.token_output(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_index_and_damage(spark):
    folder = shared_dir(spark, "tokens")
    manifest = tr.write_records(spark.createDataFrame([(1, "one", ""), (2, "two words", "")], DOCS).coalesce(1), folder, PATH, 2)
    path = manifest.collect()[0].path
    tok = Tokenizer.from_file(PATH)
    assert tr.read_sequence(path, 0)[-1] == 2
    data = open(f"{path}.rec", "rb").read()
    open(f"{path}.rec", "wb").write(data[:-7] + b"\x00" + data[-6:])
    with pytest.raises(Exception, match="damaged record"):
        tr.read_records(manifest, 2).collect()
    assert len(tok.encode("two words", add_special_tokens=False).ids) >= 2
