import re
from collections import Counter

from roadpulse.llm import quality


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(make, corpus):
    extra = [(300, "a b a b a b a"), (301, "x\nx\n \nx"), (302, "#*$%& |<>"), (303, "a b c"), (304, "a b c a b c"), (303, "a b c"), (None, "no id")]
    out = quality.quality(make(corpus + extra)).collect()
    assert len(out) == len(corpus) + len(extra)
    texts = dict(corpus + extra)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_symbol_junk_is_rejected_and_prose_kept(make, corpus):
    prose = [(i, t) for i, t in corpus if 10 <= i < 60]
    junk = [(i + 1000, " ".join(f"{w}{'%&*$'[k % 4] * 3}" for k, w in enumerate(t.split()))) for i, t in prose[:8]]
    kept = {r.doc_id: r.kept for r in quality.quality(make(prose + junk)).collect()}
    assert all(kept[i] for i, _ in prose) and not any(kept[i] for i, _ in junk)
    docs = make(prose + junk)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, _ in prose}


def test_empty_table(make):
    assert quality.quality(make([])).collect() == []
    assert quality.keep_good(make([])).collect() == []


def test_label_model_ranks_patterns():
    model = quality.fit([((1, 1), 90), ((-1, -1), 10)], 2)
    assert model.weights[0][2] > 0 > model.weights[0][0]
