"""Token counts and byte BPE against the public libraries."""

import hashlib
import random

import pytest
import tiktoken
from public_tokenizers import PATTERN, path as place
from sentencepiece import SentencePieceProcessor

from findmill.llm import byte_bpe, token_count

ODD = [
    "", " ", "  ", "\n", "a\n\nb", " a", "a ", "a  b   c", "\t x\r\n", "▁x ▁ ▁▁y", "<s> </s> <unk> <0x41>", "日本語 テスト",
    "🙂🙂🏽 é", "a b　c", "x" * 5000, "ab " * 4000, "don't I'LL we've 'S", "1234567 1,000.5", "\x00\x1c\x1f\x85",
    "aa" * 777 + "b", "    indented\n        more", "é" * 300, "<|endoftext|> text",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "aeinrst  \n\t.,'0123äöéñ▁<s>日🙂 "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    ranks = byte_bpe.read_ranks(place("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_count_is_that_of_the_library():
    model = place("piece_bpe_32k.model")
    library, count = SentencePieceProcessor(model_file=model), token_count.counter(model).count
    for text in ODD + random_texts(400, 1):
        assert count(text) == len(library.encode(text)), repr(text[:80])


def test_count_without_cuts_is_the_same():
    model = place("piece_bpe_32k.model")
    whole = token_count.PieceCounter(token_count.counter(model).ranks)
    whole.segments = lambda text: [text]
    for text in ODD + random_texts(60, 2):
        assert whole.count(text) == token_count.counter(model).count(text)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "MEMO", 5)
    counter = token_count.PieceCounter(token_count.counter(place("piece_bpe_32k.model")).ranks)
    total = sum(counter.count(f"word{i}") for i in range(50))
    assert len(counter.memo) <= 5 and total == sum(token_count.counter(place("piece_bpe_32k.model")).count(f"word{i}") for i in range(50))


def test_ids_are_those_of_the_library(tiktoken_encoding):
    bpe = byte_bpe.vocabulary(place("byte_bpe_50k.tiktoken"), PATTERN)
    texts = ODD + random_texts(400, 3)
    for text, ids in zip(texts, bpe.encode(texts)):
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(text), repr(text[:80])
        assert bpe.decode(ids.tolist()) == text.encode()


def test_every_character_encodes_alike(tiktoken_encoding):
    bpe = byte_bpe.vocabulary(place("byte_bpe_50k.tiktoken"), PATTERN)
    points = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c} {c}{c}1{c}" for c in points]
    differ = [c for c, t, ids in zip(points, texts, bpe.encode(texts)) if ids.tolist() != tiktoken_encoding.encode_ordinary(t)]
    assert not differ, [hex(ord(c)) for c in differ[:20]]


def test_byte_table_is_a_bijection():
    assert len(set(byte_bpe.byte_table())) == 256


def test_split_characters_come_back_whole():
    bpe = byte_bpe.vocabulary(place("byte_bpe_50k.tiktoken"), PATTERN)
    text = "a🙂é日本 🏽"
    ids = next(bpe.encode([text])).tolist()
    assert "".join(bpe.text_pieces([i] for i in ids)) == text
    assert all(text[a:b] for a, b in bpe.offsets(text))


def test_operators_keep_columns_and_take_nulls(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (2, "", "y"), (2, "Hello  world 🙂", None)], "doc_id long, text string, n long_string".replace("long_string", "string")
    )
    counted = token_count.count_tokens(df, limit=3).collect()
    assert [(r.doc_id, r.n, r.n_bytes, r.over_limit) for r in counted] == [(1, "x", 0, False), (2, "y", 0, False), (2, None, 17, True)]
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(df)).collect()
    assert [bytes(r.decoded).decode() for r in back] == ["", "", "Hello  world 🙂"]
    assert token_count.count_tokens(df.limit(0)).count() == 0 and byte_bpe.encode_texts(df.limit(0)).count() == 0


def test_queries_against_the_libraries(spark, sf_dir, tiktoken_encoding):
    from findmill.llm import queries

    library = SentencePieceProcessor(model_file=place("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op10_token_count(spark, sf_dir).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(library.encode(texts[r.doc_id])))
        assert r.over_limit == (r.n_tokens > 4096)
    for r in queries.op5_byte_bpe(spark, sf_dir).collect():
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_round_trip_equals_encoding_and_decoding(spark):
    rows = [(1, "héllo  world\n", 1), (2, None, 2), (None, "", 3), (4, "日本 " * 60_000, 4), (4, "日本 " * 60_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, both int")
    once = byte_bpe.round_trip(docs)
    twice = byte_bpe.decode_ids(byte_bpe.encode_texts(docs))
    assert once.columns == twice.columns and sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0
