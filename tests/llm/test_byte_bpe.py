import hashlib
import random

import pytest
import tiktoken

from tidegauge.llm import byte_bpe
from tidegauge.llm.byte_bpe import Codec, byte_text, decode_documents, default_pattern, default_ranks, encode_documents, model_of, read_ranks

PIECES = read_ranks(default_ranks())
REFERENCE = tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks={p: i for i, p in enumerate(PIECES)}, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(PIECES, model_of(PIECES), default_pattern())


def texts(n=300):
    r = random.Random(5)
    pool = ["the ", "don't", " we'LL", "\n\n", "   ", "\t", "１２", "3.14", "naïve", "über", "日本語", "한국", "🙂👍🏽", "é", "\x1c", "\x85", " ", "　", "\x00", "<|endoftext|>", "Ā", "ǿ", "#!?", "привет"]
    return ["".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(n)]


def test_equals_tiktoken(codec):
    for text in [*texts(), "a" * 5000, "ab" * 3000, " " * 4000, "x" + "\n" * 999 + "y"]:
        ids = codec.ids([text])[0]
        assert ids == REFERENCE.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        assert codec.written(ids) == ",".join(map(str, ids)).encode()


def test_every_character_splits_alike(codec):
    for c in [*range(0x3100), *range(0xFE00, 0x10000), *range(0x1F600, 0x1F680)]:
        text = f"x{chr(c)}1{chr(c)} {chr(c)}{chr(c)}"
        assert codec.ids([text])[0] == REFERENCE.encode_ordinary(text), hex(c)


def test_a_piece_that_no_merge_reaches():
    pieces = [bytes([b]) for b in range(256)] + [b"abc", b"bc"]  # "abc" = a + bc, "xyz" cannot be merged from two
    pieces += [b"xyz"]
    own = Codec(pieces, model_of(pieces), default_pattern())
    reference = tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    for text in ["abc", "xyz", "xyz xyz", "xyzabc", "bcbc"]:
        assert own.ids([text])[0] == reference.encode_ordinary(text)
    assert own.ids(["xyz"])[0] == [258] and own.model.encode(byte_text(b"xyz"), out_type=int) == [ord("x"), ord("y"), ord("z")]


def test_windows_do_not_change_the_split(codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WINDOW", 7)
    monkeypatch.setattr(byte_bpe, "WORDS_KEPT", 20)
    for text in [*texts(150), "unbroken" * 50]:
        assert "".join(codec.windows(text)) == text
        assert codec.ids([text])[0] == REFERENCE.encode_ordinary(text)
        assert len(codec.known) <= 20 + len(text)


def test_bad_vocabularies(tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    (tmp_path / "gap").write_text("YQ== 1\n")
    for name in ("few", "gap"):
        with pytest.raises(ValueError):
            read_ranks(str(tmp_path / name))


def test_documents(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(texts(60))]
    rows += [(None, None, "x", 1), (70, "", "x", 1), (71, "same", "x", 1), (71, "same", "x", 1), (72, "long word " * 200_000, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Raw string, n_tokens int").repartition(3)
    found = encode_documents(docs, digests=True)
    assert found.columns == ["doc_id", "Raw", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, t, _, _ in rows:
        ids = REFERENCE.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()), key=str) == sorted(want, key=str)
    both = decode_documents(encode_documents(docs)).collect()
    assert len(both) == len(rows)
    for r in both:
        assert bytes(r.decoded) == (r.text or "").encode() and r.ids == REFERENCE.encode_ordinary(r.text or "")
    empty = spark.createDataFrame([], docs.schema)
    assert encode_documents(empty, digests=True).count() == 0 and decode_documents(encode_documents(empty)).count() == 0
