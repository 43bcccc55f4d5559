import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from roadpulse.llm import fingerprints, line_dedup, repeats, simhash


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def connected(pairs, ids):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


# --- lines

def test_boilerplate_lines(make, corpus):
    rows = corpus + [(None, corpus[10][1])]
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(make(rows), counts=True).collect()}
    key = lambda x: x.strip(" \t\x0b\x0c\r")
    n = Counter(x for _, t in rows for x in {key(y) for y in (t or "").split("\n")} if x)
    for i, t in rows:
        if t is None:
            assert out[i].text is None
            continue
        kept = [x for x in t.split("\n") if not (key(x) and n[key(x)] >= 5 and n[key(x)] / len(rows) > line_dedup.RATIO)]
        assert out[i].text == "\n".join(kept) and out[i].n_dropped == len(t.split("\n")) - len(kept)
    assert any(r.n_dropped for r in out.values())


def test_hosts_are_apart_and_nulls_are_a_host(spark):
    rows = [(k, "same\nown %d" % k, "h" if k < 10 else None) for k in range(20)] + [(k, "same\nother %d" % k, "big") for k in range(20, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs.where("doc_id < 20 or doc_id > 190")).collect()}
    assert out[3] == "own 3" and out[12] == "own 12"
    assert line_dedup.drop_boilerplate(docs.limit(0)).collect() == []


# --- exact fingerprints

def test_edited_fingerprints(make, corpus, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    out = {r.doc_id: r for r in fingerprints.edited_fingerprints(make(corpus)).collect()}
    order = sorted(((i, t or "") for i, t in corpus), reverse=True)
    for k, (i, t) in enumerate(order):
        following, r = order[(k + 1) % len(order)][1], out[i]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.digest(fingerprints.canonical(t)) and r.edited_fingerprint == fingerprints.digest(fingerprints.canonical(edited))
        assert r.near_next == float(fingerprints.canonical(t) == fingerprints.canonical(following))


def test_edited_fingerprints_of_few_rows(make):
    assert fingerprints.edited_fingerprints(make([])).collect() == []
    (r,) = fingerprints.edited_fingerprints(make([(7, "Abc  d")])).collect()
    assert r.near_next == 1.0 and r.n_chars == 6
    rows = fingerprints.edited_fingerprints(make([(7, "a"), (7, "a"), (None, None), (3, "A ")])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.near_next) for r in rows if r.doc_id) == [(False, 3, 0.0), (False, 7, 1.0), (False, 7, 1.0)]


def test_groups_and_collisions(make, monkeypatch):
    rows = [(1, "Straße  x"), (2, "STRASSE x"), (3, "ﬁne"), (4, "fine"), (5, "other"), (None, "other")]
    out = {r.doc_id: r for r in fingerprints.exact_groups(make(rows)).collect()}
    assert (out[2].group_id, out[4].group_id, out[5].copies, out[None].group_id) == (1, 3, 2, 5)


def test_shared_fingerprints_are_found(spark):
    prints = spark.createDataFrame([("p",), ("p",), ("q",)], "fingerprint string")
    docs = spark.createDataFrame([("a",), ("b",)], "text string")
    assert fingerprints.shared_fingerprints(docs, prints).collect() == []
    found = spark.createDataFrame([("p", "l1"), ("q", "l2")], "fingerprint string, long string")
    out = fingerprints.lengthened(found, prints.where("fingerprint = 'p'").distinct(), ("fingerprint", "long")).collect()
    assert {r.fingerprint for r in out} == {"p-l1", "q"}


# --- SimHash

def simhash(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    parts = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(parts))


def test_links_within_three_bits(make, corpus):
    out = {r.doc_id: r for r in simhash_groups(make, corpus)}
    prints = {i: simhash(t) for i, t in corpus}
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    groups = connected(pairs, ids)
    for i in ids:
        assert (out[i].fingerprint, out[i].component_id) == (f"{prints[i]:016x}", groups[i])


def simhash_groups(make, rows):
    from roadpulse.llm import simhash as module

    return module.near_groups(make(rows)).collect()


def test_empty_and_single(make):
    assert simhash_groups(make, []) == []
    (r,) = simhash_groups(make, [(9, None)])
    assert (r.fingerprint, r.component_id) == ("0" * 16, 9)


def test_forest_and_long_runs_agree(monkeypatch):
    from roadpulse.llm import simhash as module

    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    rows = np.array([b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for b in base for x, y in r.integers(0, 63, (40, 2))], np.uint64)[:, None]
    keys = np.zeros(len(rows), np.int64)

    def groups(found):
        assert len(found) < len(rows)
        return connected([(a, b) for a, b, _ in found], range(len(rows)))

    expected = connected([(a, b) for a in range(len(rows)) for b in range(a) if int(rows[a, 0] ^ rows[b, 0]).bit_count() <= 3], range(len(rows)))
    assert groups(module.forest(rows, keys, 3)) == expected
    monkeypatch.setattr(module, "RUN", 10)
    assert groups(module.forest(rows, keys, 3)) == expected


def test_thresholds_cover_the_distance():
    from roadpulse.llm import simhash as module

    picked = module.allocate([[0, 5, 50], [0, 9, 90], [0, 1, 2], [0, 7, 70]], 3)
    assert sum(t + 1 for t in picked) == 4 and picked[2] == 1
    moments = np.eye(5) * 4 + 4
    moments[-1, -1] = 16
    moments[0, 3] = moments[3, 0] = 8
    moments[1, 2] = moments[2, 1] = 8
    assert module.grouped_bits(moments, 2) == [[0, 3], [1, 2]]


def test_near_duplicates_are_exact_on_shingles(make, corpus):
    from roadpulse.llm import simhash as module

    docs = make(corpus + [(None, "no id")])
    kept = {r.doc_id for r in module.drop_similar(docs).collect()}
    sets = {i: set(module.shingles(t or "", 5)) for i, t in corpus}
    ids = sorted(sets)
    same = lambda a, b: not (sets[a] or sets[b]) or len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= 0.8
    groups = connected([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if same(a, b)], ids)
    assert kept == {i for i in ids if groups[i] == i} | {None}
    assert module.drop_similar(make([])).collect() == []


def test_no_candidate_is_thinned_away(make, monkeypatch):
    from roadpulse.llm import simhash as module

    r = np.random.default_rng(3)
    base = [f"w{k}" for k in range(34)]
    rows = []
    for i in range(300):  # edited copies, most pairs of them just under or over the similarity
        words = list(base)
        for k in r.choice(34, r.integers(1, 3), replace=False):
            words[k] = f"x{r.integers(3)}"
        rows.append((i, " ".join(words)))
    rows += [(400, " ".join(["a b c d e"] * 30)), (401, " ".join(["a b c d e"] * 30) + " f g h i j k l m"), (402, "a b c d e " * 3 + "f")]
    for seed in (6, 10, 23):  # the third text is nearer in bits to each of two similar ones, and similar to none
        w = [f"s{seed}w{k}" for k in range(204)]
        rows += [(1000 + 10 * seed + k, " ".join(x)) for k, x in enumerate((w[:163], w[17:180], w))]
    sets = {i: set(module.shingles(t, 5)) for i, t in rows}
    words, parts = module.layout(len(rows), 0.8)
    nodes = module.wide_prints(make(rows), 5, words).groupBy("fingerprint").count()
    groups = [[64 * w + b for b in g] for w, m in enumerate(module.bit_moments(nodes, words)) for g in module.grouped_bits(m, parts)]
    assert sorted(sum(groups, [])) == list(range(64 * words))
    rate = module.flip_rate(0.8)
    most = int(64 * words * rate + 3 * (64 * words * rate * (1 - rate)) ** 0.5)
    prints = {i: module._rows(pa.array([module.simhash_wide(np.unique(module.hashes(list(s))), words)], pa.binary())) for i, s in sets.items()}
    values = {i: [int(module._values(x, g)[0]) for g in groups] for i, x in prints.items()}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    meet = lambda a, b: any(x == y for x, y in zip(values[a], values[b])) and int(np.bitwise_count(prints[a] ^ prints[b]).sum()) <= most
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if similar(a, b)]
    exact = connected(pairs, ids)
    for long_run in (module.LONG_RUN, 40):  # the second splits the common values
        monkeypatch.setattr(module, "LONG_RUN", long_run)
        out = {r.doc_id: r.component_id for r in module.similar_groups(make(rows)).collect()}
        assert all(out[a] == out[b] for a, b in pairs if meet(a, b))
        assert all(exact[out[i]] == exact[i] for i in ids)
        assert sum(out[i] != i for i in ids) >= 0.95 * sum(exact[i] != i for i in ids)
        assert [out[k] for k in (1062, 1232)] == [1062, 1232] and out[401] == 401


# --- repeated bytes

def removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        mask = bytearray(len(t))
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            if s in seen:
                mask[k : k + length] = b"\1" * length
            seen.add(s)
        out[i] = mask
    return out


def test_difference_cover():
    for m in (2, 3, 7, 31, 73):
        cover = repeats.difference_cover(m)
        assert {(a - b) % m for a in cover for b in cover} == set(range(m))


@pytest.mark.parametrize("length, prefix, periodic, long_name", [(100, 32, False, 1024), (20, 8, False, 1024), (100, 28, True, 1024), (20, 8, False, 3), (400, 32, False, 1024), (150, 32, False, 2)])
def test_repeated_bytes(make, corpus, length, prefix, periodic, long_name, monkeypatch):
    monkeypatch.setattr(repeats, "LONG_NAME", long_name)
    rows = corpus + [(400, "ab" * 150), (401, "é" * 120), (402, "ab" * 60)]
    masks = removed(rows, length)
    docs = make(rows)
    spans = {r.doc_id: repeats.merged([(s.low, s.high) for s in r.spans]) for r in repeats.repeated_spans(docs.select("doc_id", "text"), length, prefix, periodic).collect()}
    for i, t in rows:
        mask = bytearray(len(masks[i]))
        for a, b in spans.get(i, []):
            mask[a:b] = b"\1" * (b - a)
        assert mask == masks[i], i
    assert any(spans.values())
    with pytest.raises(ValueError):
        repeats.repeated_spans(docs, 1 << 17).collect()


def test_different_texts_of_one_id(make):
    r = np.random.default_rng(1)
    one, two = ("".join(r.choice(list("abcdefgh"), 300)) for _ in range(2))
    rows = [(1, one), (5, one), (5, two), (5, None), (9, two), (None, one)]
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.removal(make(rows)).collect())
    assert out == [(0, 300, 0), (1, 300, 0), (5, 0, 0), (5, 300, 0), (5, 300, 300), (9, 300, 300)]


def test_removal_rows(make, corpus):
    masks = removed(corpus, 100)
    for r in repeats.removal(make(corpus)).collect():
        data, mask = (dict(corpus)[r.doc_id] or "").encode(), masks[r.doc_id]
        kept = bytes(c for c, m in zip(data, mask) if not m)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(data), sum(mask), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == len(re.findall(b"\1+", bytes(mask)))
    assert repeats.removal(make([])).collect() == []


def test_rows_without_or_with_equal_ids(make):
    long = "word " * 60
    rows = [(None, long), (None, long), (5, long), (5, long), (6, None)]
    out = repeats.drop_repeats(make(rows)).collect()
    assert len(out) == 5 and sorted(len(r.text or "") for r in out)[-2:] == [len(long)] * 2
    assert {r.text for r in out if r.doc_id is None} == {long}


CLASH = ["span_doc", "span_low", "span_high", "span_hash", "span_text", "drop_list", "listed_host", "n_lines", "n_dropped", "kept_lines", "line_hash", "own", "row"]


@pytest.mark.parametrize("twice", [False, True])
def test_columns_of_the_operators_own_names(spark, make, twice):
    """Columns named as those that the operators add inside stay as they are."""
    long = "word " * 60
    docs = make([(1, long), (2, f"a line\n{long}"), (2 if twice else 3, "other"), (None, None)]).withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce("text", F.lit("-"))) for c in CLASH})
    for found in (repeats.drop_repeats(docs), line_dedup.drop_boilerplate(docs), line_dedup.drop_boilerplate(docs, copies=False)):
        assert found.columns == docs.columns
        assert sorted(map(str, found.drop("text").collect())) == sorted(map(str, docs.drop("text").collect()))
    counted = line_dedup.drop_boilerplate(docs, counts=True)
    assert counted.columns == [*docs.columns, "_n_lines", "_n_dropped"] and len(set(counted.columns)) == len(counted.columns)


def test_names_of_a_tasks_share_are_not_split(spark, make, monkeypatch):
    """A name that has no more places than a task's share of all is compared in its task, others string by string, with the same spans."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    passage = word(180)
    docs = make([(k, word(40) + passage + word(40)) for k in range(1200)]).select("doc_id", "text")
    keep, seen = repeats.stored, []
    monkeypatch.setattr(repeats, "stored", lambda df, label: seen.append(label) or keep(df, label))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for parts in (2, 64):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found[parts] = {x.doc_id: repeats.merged([(s.low, s.high) for s in x.spans]) for x in repeats.repeated_spans(docs).collect()}
            assert ("strings" in seen) == (parts == 64)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[2] == found[64] and set(found[2]) == set(range(1, 1200))
    assert all(low <= 40 and high >= 220 for ((low, high),) in found[2].values())


def test_forest_of_many_runs_in_little_memory():
    """Runs of near rows have as many links as pairs; the forest keeps one a row and few of the others at once."""
    import tracemalloc

    from roadpulse.llm.simhash import forest

    r = np.random.default_rng(1)
    rows = np.repeat(r.integers(0, 1 << 62, (40, 10), dtype=np.uint64), 250, axis=0)
    rows[:, 0] ^= np.uint64(1) << r.integers(0, 60, len(rows)).astype(np.uint64)
    keys, spare = np.repeat(np.arange(40), 250), set()
    tracemalloc.start()
    found = forest(rows, keys, 5, spare)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 40 * 249 and spare == set(range(40)) and all(keys[a] == keys[b] for a, b, _ in found)
    assert most < 60e6
