"""Encoding against the library itself, with the model's own character map and with a compiled one."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillgrid.llm import piece_bpe

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "the", " ", "  ", "▁", "é", "é", "Ⅷ", "ﬁ", "Ｋ", "　", "\t", "\n", "日", "本", "㍿", "​", "\x00", "𝔘", "😀", "한", "ᄒ", "ᅡ", "A", "1", "½", ".", "�", "ſ", "<s>", "<0x41>"]


def model(compiled, prefix, thin):
    """The public vocabulary with another way of normalising."""
    field = piece_bpe.Pieces._field
    norm = field(1, b"x") + (field(2, compiled) if compiled else b"") + field(3, prefix) + field(4, thin) + field(5, 1)
    return b"".join(field(n, x) for n, x in piece_bpe.fields(open(PATH, "rb").read()) if n != 3) + field(3, norm)


def compiled_map():
    whole = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return dict(piece_bpe.fields(next(x for n, x in piece_bpe.fields(whole) if n == 3)))[2]


def spans_by_library(library, text):
    at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).astype(int)
    return [(int(at[a]), int(at[b])) for a, b in library.encode_as_offset_mapping(text)["offsets"]]


@pytest.mark.parametrize("mapped", [False, True])
@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("thin", [0, 1])
def test_ids_spans_and_decoding_are_the_librarys(mapped, prefix, thin):
    proto, rng = model(compiled_map() if mapped else None, prefix, thin), random.Random(12)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), piece_bpe.Pieces(None, proto)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 14))) for _ in range(2500)] + ["the " * 3000, "x" * 5000, "日本" * 3000, " " * 4000]
    blank_only = 0
    for t, (ids, decoded, begins, ends) in zip(texts, own.encoded(texts), strict=True):
        expected = library.encode(t)
        assert ids == ",".join(map(str, expected)) and decoded == library.decode(expected), t
        if t.strip(" 　▁​"):
            assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == spans_by_library(library, t), t
        else:
            blank_only += 1
    assert blank_only < 200


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_tables_are_encoded_as_by_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()}
    rows = piece_bpe.query(spark, f"/root/testdata/sf{sf}").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.spans_sha256 == hashlib.sha256(np.array(spans_by_library(library, texts[r.doc_id]), "<u8").tobytes()).hexdigest()


def test_odd_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, "", " ", "one", "déjà vu " * 9000, "x" * 70_000, "日本語" * 20_000, "one", "퟿▁ a", " " * 1_000_000, "word " * 200_000]
    rows = [(i if i != 3 else None, t, "extra", 7) for i, t in enumerate(texts)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int").repartition(3)
    found = {r.doc_id: r for r in piece_bpe.encode(odd, PATH).collect()}
    assert len(found) == len(texts)
    for i, t, *_ in rows:
        raw, r = (t or "").encode(), found[i]
        assert r.ids == library.encode(t or "") and r.decoded == library.decode(r.ids)
        assert r.first_byte == sorted(r.first_byte) and (not raw or (r.first_byte[0], r.end_byte[-1]) == (0, len(raw)))
        assert b"".join(raw[a:b] for a, b in zip(r.first_byte, r.end_byte, strict=True)) == raw
    assert piece_bpe.digests(odd.where(F.lit(False)), PATH).collect() == []


def test_other_kinds_of_model_are_refused():
    field = piece_bpe.Pieces._field
    raw = b"".join(field(n, x) for n, x in piece_bpe.fields(open(PATH, "rb").read()) if n in (1, 3))
    with pytest.raises(ValueError, match="BPE"):
        piece_bpe.Pieces(None, raw + field(2, field(3, 1)))
