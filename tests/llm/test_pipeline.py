import random
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from roadpulse.llm import line_dedup, packing, quality, simhash, tokens
from tests.llm.test_duplicates import connected, removed
from tests.llm.test_quality import counts


def test_pipeline_keeps_and_packs(spark, make, corpus, tmp_path):
    prose = [(i, t) for i, t in corpus if i >= 10]
    make(prose).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    assert ids and not ids & set(range(100, 120)) and ids <= {i for i, _ in prose}


def test_copies_do_not_make_their_lines_boilerplate(spark):
    page = [f"sentence number {k} of the copied page" for k in range(6)]
    own = lambda k: "\n".join(["Site menu", *(f"words {k} {j} of a page of its own" for j in range(4)), "All rights reserved"])
    near = lambda k: "\n".join(page[:5] + [f"edited line {k}"])
    texts = [own(k) for k in range(40)] + ["\n".join(page)] * 10 + [near(k) for k in range(10)] + [own(0)] * 3
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    for k, t in enumerate(texts):
        assert out[k] == "\n".join(x for x in t.split("\n") if x not in ("Site menu", "All rights reserved"))
    few = docs.where("doc_id between 36 and 45")
    assert {r.text for r in corpus_pipeline.line_deduplication(spark, few, "").where("doc_id >= 40").collect()} == {"\n".join(page)}


def judged(rows):
    """Documents that the quality rules keep, with counts, votes and the label model worked out row by row."""
    votes = {}
    for i, t in rows:
        n_words, chars, symbols, dup_lines, repeats = counts(t)
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        seen = {
            "symbols_per_word": symbols / max(n_words, 1), "symbols_per_char": symbols / max(chars, 1), "length_off": abs(chars / max(n_words, 1) - 5),
            "repeat_share": repeats / max(n_words, 1), "dup_line_share": dup_lines / max(len(lines), 1),
        }
        if n_words >= 50 and 100 * repeats <= 50 * n_words:
            votes[i] = tuple(-1 if seen[r.feature] >= r.bad else 1 if seen[r.feature] <= r.good else 0 for r in quality.RULES)
    model = quality.fit(sorted(Counter(votes.values()).items()), len(quality.RULES))
    good = lambda v: model.prior + sum(w[x + 1] for w, x in zip(model.weights, v)) >= 0
    return [(i, t) for i, t in rows if i in votes and good(votes[i])]


def without_boilerplate(rows):
    """Lines that more than a share of the pages have that say something else each, dropped; all pages are of one host."""
    key = lambda x: x.strip(" \t\x0b\x0c\r")
    lines = {i: t.split("\n") for i, t in rows}
    n = Counter(x for i in lines for x in {key(y) for y in lines[i]} - {""})
    suspect = {x for x, c in n.items() if c >= line_dedup.LEAST_DOCS and c / len(rows) > line_dedup.RATIO / 2}
    pages = set()
    for parts in lines.values():
        own = tuple(x for x in parts if key(x) not in suspect)
        if 0 < sum(len(key(x)) for x in own) and 2 * sum(len(key(x)) for x in own) >= sum(len(key(x)) for x in parts):
            pages |= {(own, x) for x in {key(y) for y in parts} & suspect} | {(own, None)}
    n = Counter(x for _, x in pages)
    drop = {x for x, c in n.items() if x is not None and c >= line_dedup.LEAST_DOCS and c / n[None] > line_dedup.RATIO}
    return [(i, "\n".join(x for x in parts if key(x) not in drop)) for i, parts in lines.items()]


def without_copies(rows):
    sets = {i: set(simhash.shingles(t, 5)) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = connected(pairs, ids)
    return [(i, t) for i, t in rows if groups[i] == i]


def without_repeats(rows):
    masks = removed(rows, 100)
    return [(i, bytes(c for c, m in zip(t.encode(), masks[i]) if not m).decode(errors="ignore")) for i, t in rows]


def test_run_against_brute_force(spark, corpus, tmp_path):
    r = random.Random(9)
    prose = [(i, t) for i, t in corpus if t]
    junk = [(i + 1000, " ".join(f"{w}{'%&*$'[k % 4] * 3}" for k, w in enumerate(t.split()))) for i, t in prose[10:18]]
    repeated = [(2000, "one two three " * 40)]
    near = []
    for k in range(30):  # copies of two texts with words changed, around the similarity
        words = prose[12 + k % 2][1].split(" ")
        for at in r.sample(range(len(words)), 1 + k // 10):
            words[at] = f"new{k}"
        near.append((3000 + k, " ".join(words)))
    shared = [(4000 + k, " ".join([*prose[30 + k][1].split(), *prose[40][1].split()[:40], *prose[36 + k][1].split()])) for k in range(3)]
    rows = corpus + junk + repeated + near + shared
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected = judged(rows)
    assert 0 < len(expected) < len(rows)
    for stage in (without_boilerplate, without_copies, without_repeats):
        after = stage(expected)
        assert after != expected  # each stage has something to do here
        expected = after
    found = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for i, t in expected:
        ids = tokens._packed([*plain.encode(t, add_special_tokens=False).ids, 0])
        pieces += [(i, k, at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192])) for k, at in enumerate(range(0, len(ids), 8192))]
    assert sorted(found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(pieces)
    filled = found.sort_values(["sequence_id", "offset"])
    assert (filled.groupby("sequence_id").length.cumsum() - filled.length == filled.offset).all() and filled.groupby("sequence_id").length.sum().max() <= 2048
    assert found.sequence_id.nunique() <= packing.lower_bound(found.length.to_numpy(), 2048) + 1
