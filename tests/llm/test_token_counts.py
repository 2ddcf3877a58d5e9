import public_tokenizers
import pytest
import sentencepiece

from kilnspark.llm import bpe
from kilnspark.llm.token_counts import MARK, Counter, count_tokens, read_pieces


@pytest.fixture(scope="module")
def pieces():
    return read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library(pieces):
    """The library's own unigram tokenizer over the same pieces, a mark put before the text."""
    table = [("<unk>", 0.0, bpe.UNKNOWN), *((f"<0x{b:02X}>", 0.0, bpe.BYTE) for b in range(256))]
    model = bpe.model_bytes([*table, *((p, s, bpe.NORMAL) for p, s in pieces)], bpe.UNIGRAM, 0, True)
    norm = bpe._chunk(1, b"identity") + bpe._number(3, 1) + bpe._number(4, 0) + bpe._number(5, 1)
    return sentencepiece.SentencePieceProcessor(model_proto=model + bpe._chunk(3, norm))


def test_equal_to_library(spark, pieces, library):
    counter = Counter(pieces)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(80).collect()
    words = sorted({w for r in rows for w in (r.text or "").split()})
    words += ["日本語", "🙂x", "a  b", "\n", "é\tb ", " ", "   x   ", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    words += [" ".join(words[i : i + 6]) for i in range(0, len(words), 97)]
    assert [counter.count(w)[0] for w in words] == [len(library.encode(w)) for w in words]


def test_whole_texts_equal_the_library(spark, pieces, library):
    """Counts and scores of whole documents; the library's score is the sum over its pieces."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    score = dict(pieces)
    lowest = min(score.values()) - 10
    for r in count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect():
        found = library.encode(text[r.doc_id], out_type=str)
        assert r.n_tokens == len(found), r.doc_id
        known = [p for p in found if p in score]
        if len(known) == len(found):
            assert r.score == pytest.approx(sum(score[p] for p in known)), r.doc_id
        else:
            assert r.score <= sum(score[p] for p in known) + lowest


def test_scores_can_be_left_as_they_are(pieces):
    given = dict(read_pieces(public_tokenizers.path("piece_bpe_32k.model"), lift=False))
    lifted = dict(pieces)
    assert given.keys() == lifted.keys() and all(lifted[p] == s for p, s in given.items() if s > -1e8)


def test_ties_go_to_the_piece_that_starts_first():
    counter = Counter([(MARK, -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("bc", -1.0), ("c", -1.0)])
    assert counter.solve("ab") == (1, -2.0)
    assert counter.solve("abc") == (2, -2.0)
    assert counter.solve("é") == (2, -12.0)


def test_pieces_must_not_cross_words():
    with pytest.raises(ValueError):
        Counter([(f"a{MARK}b", -1.0)])


def test_documents(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (2, ""), (3, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as score", "2 as n_tokens")
    got = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got)[:4] == [(0, 2), (1, 0), (2, 0), (2, 0)]
    assert len(got) == 5 and count_tokens(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
