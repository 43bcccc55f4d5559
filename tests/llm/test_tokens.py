import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from roadpulse.llm import packing, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "a\n\nb", " \n x", "  x", "a  b\t c\n ", "don't ' x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "\0a b", "\r\n a", "é ́a", "AΣ Σb", "İ I", "\x1c a\x1db", "⟂ a⟂ b", "\x85 a\xa0b"]


@pytest.mark.parametrize("path, units", [(BYTE, tokens.byte_units), (WORD, tokens.word_units)])
def test_ids_are_the_library_s(path, units):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(" \n\tab'sé1.<|> ⟂") for _ in range(r.randint(0, 30))) for _ in range(500)]
    plain, own = Tokenizer.from_file(path), tokens.Codec(path, units)
    for text, (ids, _) in zip(texts, own.ids(texts)):
        assert ids == tokens._packed(plain.encode(text, add_special_tokens=False).ids), repr(text)


def test_tree_concatenation_is_exact():
    r, own, plain = random.Random(2), tokens.Codec(BYTE, tokens.byte_units), Tokenizer.from_file(BYTE)
    for alphabet in ("ab", "abcdefghij", "the", "éàö", "=-", "日本語字", "\n", "1234567890"):
        text = "".join(r.choice(alphabet) for _ in range(9000))
        assert own.long(text) == plain.encode(text, add_special_tokens=False).ids
        piece = "".join(r.choice(alphabet.strip("=-") or "ab") for _ in range(700))
        if piece.isalpha():
            assert own.tree(piece, 50) == plain.encode(piece, add_special_tokens=False).ids


def test_byte_bpe_round_trip(make, corpus):
    plain, texts = Tokenizer.from_file(BYTE), dict(corpus)
    out = tokens.byte_bpe_digests(make(corpus), BYTE).collect()
    assert len(out) == len(corpus)
    for r in out:
        ids = plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(tokens._packed(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert tokens.byte_bpe(make([]), BYTE).collect() == []


def test_packing_places_every_piece(make, corpus):
    import zlib

    plain = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(make(corpus + [corpus[-1]]), WORD).toPandas()
    for i, t in corpus[:-1]:
        ids = tokens._packed([*plain.encode(t or "", add_special_tokens=False).ids, 0])
        own = rows[rows.doc_id == i].sort_values("piece")
        assert list(own.start) == list(range(0, len(ids) // 4, 2048)) and own.length.sum() == len(ids) // 4
        assert list(own.ids_crc32) == [zlib.crc32(ids[k : k + 8192]) for k in range(0, len(ids), 8192)]
    filled = rows.sort_values(["sequence_id", "offset"])
    assert (filled.groupby("sequence_id").length.cumsum() - filled.length == filled.offset).all()
    assert filled.groupby("sequence_id").length.sum().max() <= 2048
    assert rows.sequence_id.nunique() <= packing.lower_bound(rows.length.to_numpy(), 2048) + 1
    assert packing.pack_documents(make([]), WORD).collect() == []


def test_bounds_hold_and_gaps_are_repacked(spark, monkeypatch):
    import numpy as np

    assert packing.lower_bound(np.array([5, 5, 5]), 8) == 3 and packing.lower_bound(np.array([4, 4, 4, 4]), 8) == 2
    r = np.random.default_rng(3)
    lengths = r.integers(300, 1500, 900)
    bins, _ = packing.best_fit_decreasing(lengths, 2048)
    assert np.bincount(bins, weights=lengths).max() <= 2048 and bins.max() + 1 >= packing.lower_bound(lengths, 2048)
    monkeypatch.setattr(packing, "GROUP_ROWS", 60)
    rows = packing.pack_pieces(spark.createDataFrame([(int(x),) for x in lengths], "length long")).toPandas()
    assert len(rows) == 900 and rows.groupby("sequence_id").length.sum().max() <= 2048


def test_words_by_number_match_the_library():
    """Ids of texts in a row equal the library's, in runs of rows of few bytes, with every kind of unit."""
    own = tokens.Codec(WORD, tokens.word_units)
    texts = ["", None, " \t\n", "The cat, the CAT's 12 cats\x0b\x0cend", "été Été naïve µª Straße", "a\x1cb\x1db <|endoftext|>x <|StartOfText|>", "　全角 ＡＢ é İ", "x" * 3000, "it's I'LL 3.14 --%%", f"a {tokens.SIGN} b{tokens.SIGN}c"]
    for _ in range(2):  # learned, then known
        flat, at = own.word_ids(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert flat[at[k] : at[k + 1]].tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids, text
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    cut = list(tokens.sized([batch, batch.slice(0, 0), batch.slice(2)], 0, 40))
    assert [t for b in cut for t in b.column(0).to_pylist()] == texts + texts[2:]
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(0).to_pylist()) <= 40 for b in cut)
