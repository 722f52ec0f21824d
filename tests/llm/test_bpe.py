import hashlib
import random

import numpy as np
import pytest

from tidegauge.llm import bpe
from tidegauge.llm.chunks import GEAR, gear_hash, least_limits, mask_limits

ODD = [
    None, "", " \n ", "Hello's  WORLD don't stop now　end", "<|startoftext|>x <|endoftext|> <|endoftext", "é ̈a ΑΣ Σ", "日本語 テキスト 12345",
    "a\x0bb\x0cc\x1cd\x1de\x85f g", "x" * 3000, "no_space_" * 2000, "\x00\x07 �", "İstanbul ſ K ß", "word​join ­ soft", "tab\tnew\nret\rend  ",
]


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiéöñ'-.<|>1 ") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(2000))
    rows = []
    for i in range(30):
        own = " ".join(rng.choice(words) for _ in range(rng.randint(0, 600)))
        cut = rng.randint(0, len(passage))
        rows.append(own + passage[cut : cut + rng.randint(0, 9000)] + rng.choice(["", " ", "x"]) + own[::-1])
    return rows + ["_".join(words) * 2] * 2


def want(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    t.no_padding()
    t.no_truncation()
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    return out


def test_equals_the_library(spark):
    texts = ODD + corpus()
    docs = spark.createDataFrame([(i, x, b"c", "d") for i, x in enumerate(texts)], "doc_id long, text string, ids binary, decoded string").repartition(4)
    assert len(bpe.shared_chunks(docs.selectExpr("cast(text as binary) raw"), bpe.default_tokenizer())) > 10
    got = {r.doc_id: r for r in bpe.encode_documents(docs).collect()}
    for i, (ids, decoded) in enumerate(want(texts)):
        assert bytes(got[i].ids) == ids and got[i].decoded == decoded, texts[i]
    again = {r.doc_id: r.decoded for r in bpe.decode_documents(bpe.encode_documents(docs)).collect()}
    assert again == {i: d for i, (_, d) in enumerate(want(texts))}
    short = bpe.encode_documents(docs.select("doc_id", "text"), digests=True)
    assert short.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in short.collect():
        ids, decoded = got[r.doc_id].ids, got[r.doc_id].decoded
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe.encode_documents(docs.limit(0), digests=True).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_joins_are_repaired(monkeypatch, seed):
    """Every chunk in the dictionary, with tiny chunks: all joins are between dictionary entries."""
    monkeypatch.setattr(bpe, "CHUNK", 16)
    encoder = bpe.Encoder(bpe.default_tokenizer())
    texts = corpus(seed + 10)[:8] + ODD[3:]
    dictionary = {}
    for x in texts:
        raw = x.encode()
        limits = mask_limits(raw, 16)
        for a, b in zip(limits, limits[1:]):
            if (span := bpe.inner(raw[a:b])) is not None:
                dictionary[bpe.key_of(raw[a:b])] = bpe.Shared(*span, encoder.whole([raw[a:b][slice(*span)]])[0][0])
    for x, (ids, decoded) in zip(texts, want(texts)):
        assert bpe.encode([x.encode()], encoder, dictionary) == [(ids, decoded.encode())]


def test_words_are_forgotten_when_there_are_many(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 10)
    encoder = bpe.Encoder(bpe.default_tokenizer())
    texts = corpus(3)[:3]
    assert [encoder.whole([x.encode()])[0] for x in texts] == [(i, d.encode()) for i, d in want(texts)]


def test_gear_hash_is_the_rolling_one():
    raw = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8).tobytes()
    h, out = 0, []
    for byte in raw:
        h = ((h << 1) + int(GEAR[byte])) % 2**32
        out.append(h)
    assert gear_hash(raw).tolist() == out


def test_limits_resist_insertions():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh é") for _ in range(6000)).encode()
    for cut in (lambda x: mask_limits(x, 64), lambda x: least_limits(x, 24)):
        a, b = cut(text), cut("ü new words ".encode() + text)
        shift = len("ü new words ".encode())
        assert len({x + shift for x in a[1:]} - set(b)) <= 2 and len(a) > 40
        for limits in (a, b):
            assert limits == sorted(set(limits))
    assert least_limits(b"", 24) == [0] and least_limits(b"ab" * 5, 24) == [0, 10] and mask_limits(b"", 64) == [0]


def test_a_column_named_raw_passes_through(spark):
    frame = spark.createDataFrame([(1, "some text", "x")], "doc_id long, text string, raw string")
    row = bpe.encode_documents(frame).first()
    assert row.raw == "x" and row.decoded and set(row.asDict()) == {"doc_id", "text", "raw", "ids", "decoded"}
