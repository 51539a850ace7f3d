import random

import pytest

from chronoloom.llm import encode as E
from chronoloom.llm.queries import VOCABULARY

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch([x or "" for x in xs], add_special_tokens=False)]


def texts():
    r = random.Random(1)
    odd = "".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x2FFF), r.randint(0x3000, 0xD7FF), 32, 10])) for _ in range(6000))
    return [None, "", " ", "a" * 3000, "ab" * 2000, "x  y\n\n\t z ", "I'LL we'll it's", "<|endoftext|> x", "\u0085 \x1c a\x00b", odd, "word " * 5000, "🧑🏽‍🚀", "Größe naïve", "same", "same"]


@pytest.mark.parametrize("words", [0, 3, 65_536])
def test_equals_tokenizer(spark, reference, words):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "x bigint, ids string, i int")
    got = {r.x: r.ids for r in E.encode_corpus(df, id="x", text="ids", vocabulary=VOCABULARY, lexicon_words=words).collect()}
    want = reference([t for _, t in rows])
    assert got == {i: w for (i, _), w in zip(rows, want)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert E.encode_corpus(df, id="doc_id", text="text", vocabulary=VOCABULARY).count() == 0


def test_documents(spark, reference):
    from chronoloom.llm.queries import p7_ids

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids for r in p7_ids(spark, sf).collect()}
    assert got == dict(zip([d.doc_id for d in docs], reference([d.text for d in docs])))


def test_lexicon_is_minimal_and_exact(tmp_path):
    ranks = E.read_ranks(VOCABULARY)
    words = [w.encode() for w in ("tap", "taps", "top", "tops", "stop", "stops", "t")]
    path = str(tmp_path / "l")
    E.compile_lexicon(words, ranks, path)
    lex = E.Lexicon(path)
    assert sorted(lex.find(words).tolist()) == list(range(7))
    assert lex.find([b"ta", b"", b"stopss", b"x", b"y" * 100]).tolist() == [-1] * 5
    for w, at in zip(words, lex.find(words)):
        assert lex.ids[lex.at[at] : lex.at[at + 1]].tolist() == E.merge(w, ranks)
    assert len(lex.final) == 7  # root, t, s, st, the shared ?op/ap, the shared s after p, and the end
