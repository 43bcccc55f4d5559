"""Mixes against plain loops, and their SQL."""

import hashlib
import math
import random
import re

import duckdb
import pytest

from roadpulse.llm import mixing
from roadpulse.llm.sql import ORACLES

SCHEMA = "doc_id long, text string, source string, size long, epoch int, target string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, 3, "x", 1) for i, t, s in rows], SCHEMA).repartition(3)


def brute(rows, weights=(5, 2, 1), share=1.5, most=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    stopped = set()
    while True:
        free = [s for s in sources if s not in stopped]
        left = share * sum(total.values()) - most * sum(total[s] for s in stopped)
        level = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > most * total[s]}
        if not above:
            break
        stopped |= above
    target = {s: float(most * total[s]) if s in stopped else weight[s] * level for s in sources}
    out = []
    for s in sources:
        budget, n = math.floor(target[s]), total[s]
        mine = sorted(((hashlib.md5(b"" if i is None else str(i).encode()).hexdigest(), i or 0, size(t), i) for i, t, x in rows if x == s))
        before = 0
        for _, _, k, i in mine:
            taken = 0 if not n else budget // n * k + max(0, min(k, budget % n - before))
            before += k
            out.append((i, k, n, target[s], taken))
    return sorted(out, key=str)


def corpus(seed, sources, n=120):
    r = random.Random(seed)
    return [(k, " ".join("w" for _ in range(r.randint(0, 12))), r.choice(sources)) for k in range(n)]


CASES = [
    corpus(1, ["a", "b", "c", "d", None, "é", "𝒳", ""]),
    corpus(2, ["hot"] * 20 + ["small", "tiny"]),
    [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", "b"), (4, "one two", None), (None, "x y z", "c"), (None, "x", "c"), (7, "p q", "c"), (7, "p q", "c"), (7, "p", "c")],
    [(1, None, "a"), (2, "", None)],
    [(k, "a b c", "only") for k in range(10)],
]


@pytest.mark.parametrize("rows", CASES)
def test_mix_equals_loops(spark, rows):
    got = mixing.mix(table(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["size"], r["source_size"], pytest.approx(r["target"]), r["taken"]) for r in got], key=lambda x: str(x[:3]) + str(x[4])) == sorted(brute(rows), key=lambda x: str(x[:3]) + str(x[4]))
    by_source = {}
    for r in got:
        by_source.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for rows_ in by_source.values():
        assert sum(r["taken"] for r in rows_) == math.floor(rows_[0]["target"])
    spark_rows = mixing.mix(table(spark, rows)).select("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    frame = table(spark, rows).select("doc_id", "text", "source").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    assert sorted(map(str, con.execute(ORACLES["op13_mixing"]).fetchall())) == sorted(str(tuple(r)) for r in spark_rows.collect())


def test_other_weights(spark):
    rows = corpus(3, ["a", "b", "c", "d"])
    got = mixing.mix(table(spark, rows), weights=(1.0, 3.0), share=0.4, most=1).collect()
    assert sorted([(r["doc_id"], r["taken"]) for r in got]) == sorted((x[0], x[4]) for x in brute(rows, (1, 3), 0.4, 1))
    over = mixing.mix(table(spark, rows), share=5.0).collect()
    assert all(r["taken"] == 2 * r["size"] for r in over)
    assert mixing.mix(table(spark, [])).count() == 0


def test_mixed_documents(spark):
    rows = [(k, f" {k}\t" + " \n".join(f"w{j}" for j in range(k % 9)) + " ", "ab"[k % 2]) for k in range(60)] + [(99, "z " * 30_000, "a")]
    taken = {r["doc_id"]: r for r in mixing.mix(table(spark, rows)).collect()}
    found = {}
    for r in mixing.mixed_documents(table(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append((r["_epoch"], r["text"]))
        assert r["size"] == 7 and r["epoch"] == 3
    texts = {i: t for i, t, _ in rows}
    for i, r in taken.items():
        parts = sorted(found.get(i, []))
        assert sum(len(t.split()) for _, t in parts) == r["taken"] and [e for e, _ in parts] == list(range(len(parts)))
        assert all(texts[i].startswith(t) for _, t in parts)
