"""Alignment against whole texts through both libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from roadpulse.llm import alignment
from roadpulse.llm.alignment import aligner, alignments, common_units, cross_tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def encoded(whole, text):
    """Ids and byte strings of the whole text by both libraries; none where bytes differ."""
    t, sp = whole
    both = aligner(A, B)
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    part_a, part_b = [both.bytes_a[i] for i in a], [both.bytes_b[i] for i in b]
    good = b"".join(part_a) == b"".join(part_b) == (" " + text).encode()
    return (a, part_a, b, part_b) if good and text else ([], [], [], [])


def ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def brute(whole, rows):
    per, counts = [], Counter()
    for i, text in rows:
        a, pa, b, pb = encoded(whole, text or "")
        ea, eb = ends(pa), ends(pb)
        links = [(a[j], b[eb.index(e)]) for j, e in enumerate(ea) if e in set(eb)]
        cuts = sorted(set(ea) & set(eb))
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, e in zip(a, ea) if low < e <= c) + "|" + ",".join(str(x) for x, e in zip(b, eb) if low < e <= c))
            low = c
        counts.update(links)
        per.append((i, len(a), len(b), groups, links))
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted((i, na, nb, len(g), len(ln), sum(counts[x] == best[x[1]] for x in ln), sum(counts[x] for x in ln), digest(g)) for i, na, nb, g, ln in per)


ODD = [
    "a", " ", "  ", "   x", "x ", "x  ", "\n", "a\nb", "a\n\nb", "\na", "a\n", "a \n b", "x\t\ty", "a\r\nb;\r x", "\x00", "a\x00 b", "nbsp\xa0here", "é ﬁ ½", "日本語 テスト", "🙂🙂 🙂", "a▁b", "▁", "<s> </s> <unk> <0x0A>",
    "<|endoftext|> x<|endoftext|>", "don't we'll", "x" * 500, "ab" * 3000, "\x1c a \x1d", "　x  y", "é à", "1234567 12 345", "....!!! ??", "﻿bom", "​ z", "tail\u0085 x",
]


def test_pieces_encode_as_the_whole(whole):
    r = random.Random(4)
    texts = ODD + ["".join(r.choice(["a", "bc", " ", " ", "\n", "\t", "é", "日", "🙂", "1", ".", "'s", "\r", "\xa0", "▁", "<s>", "​", "\x1c", "word", "ing"]) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    both = aligner(A, B)
    for text, found in zip(texts, both.texts(texts)):
        assert "".join(common_units(text)) == " " + text
        a, _, b, _ = encoded(whole, text)
        assert (found is None) == (not a), text
        if found:
            got = ";".join(x[3] for x in found).split(";")
            assert [int(i) for g in got for i in g.split("|")[0].split(",")] == a and [int(i) for g in got for i in g.split("|")[1].split(",")] == b, text


@pytest.mark.parametrize("broadcast", [True, False])
def test_rows_equal_brute_force(spark, make, corpus, whole, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
        monkeypatch.setattr(alignment, "COMMON", 0.2)
    rows = [*corpus, *((500 + k, t) for k, t in enumerate(ODD)), (None, "no id"), (7, "again again"), (7, "again again")]
    docs = make(rows).repartition(3)
    got = cross_tokenizer(docs, A, B).collect()
    key = lambda r: tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in r)
    expected = brute(whole, [(i if i is not None else -1, t) for i, t in rows])
    found = sorted(tuple(-1 if x is None else x for x in r) for r in got)
    assert found == expected
    assert key and got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_empty_tables(spark, make):
    assert cross_tokenizer(make([]), A, B).count() == 0
    assert [tuple(r) for r in cross_tokenizer(make([(1, None), (2, "")]), A, B).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]
    assert alignments(make([(1, "a b"), (2, None)]), A, B).orderBy("doc_id").collect()[1]["groups"] == ""
