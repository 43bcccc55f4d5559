"""Decoding of many trips at once against one path after the other."""

import itertools
import random

import pyarrow as pa
import pytest

from roadpulse.operators import decoding

KIND = pa.schema([("TRIP_ID", pa.string()), ("timedate", pa.timestamp("us")), ("id", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("p", pa.float64()), ("from_u", pa.list_(pa.int64())), ("from_v", pa.list_(pa.int64())), ("step", pa.list_(pa.float64()))])


def trips(seed, lengths, many):
    """Trips of random candidates; logs are of a few values, so ways tie."""
    r, rows, number = random.Random(seed), [], 0
    for t, n in enumerate(lengths):
        before = []
        for _ in range(n):
            here = sorted(r.sample([(u, v) for u in range(-2, 3) for v in range(3)], r.randint(1, many)))
            for u, v in here:
                ways = [(*e, -float(r.randint(0, 3))) for e in before if r.random() < 0.5]
                lists = [[w[k] for w in ways] for k in range(3)] if ways else [None] * 3
                rows.append((f"t{t:03}", number * 1000, number, u, v, -float(r.randint(0, 3)), *lists))
            before, number = here, number + 1
    return rows


def likeliest(rows):
    """The first of the best paths, by each row's best score."""
    out = []
    for _, trip in itertools.groupby(rows, key=lambda x: x[0]):
        fixes = [list(f) for _, f in itertools.groupby(trip, key=lambda x: x[2])]
        paths = [[(x[5], (k,)) for k, x in enumerate(fixes[0])]]
        for last, now in zip(fixes, fixes[1:]):
            scores = []
            for k, x in enumerate(now):
                ways = {(u, v): p for u, v, p in zip(*(y or () for y in x[6:9]))}
                lead = max(range(len(last)), key=lambda j: paths[-1][j][0])
                found = [(paths[-1][j][0] + ways[y[3:5]], -j) for j, y in enumerate(last) if y[3:5] in ways]
                value, j = max([*found, (paths[-1][lead][0] - 60.0, -lead)])
                scores.append((x[5] + value, paths[-1][-j][1] + (k,)))
            paths.append(scores)
        best = max(paths[-1], key=lambda s: s[0])[1]
        out += [(f[k][0], f[k][2], f[k][3], f[k][4]) for f, k in zip(fixes, best)]
    return out


def run(rows, block, batch):
    table = pa.Table.from_pylist([dict(zip(KIND.names, x)) for x in rows], KIND)
    found = [b for b in decoding.decoded(-60.0, block)(iter(table.to_batches(max_chunksize=batch)))]
    return [(x["TRIP_ID"], x["id"], x["u"], x["v"]) for b in found for x in b.to_pylist()]


@pytest.mark.parametrize("seed", range(6))
def test_equals_one_trip_after_the_other(seed):
    r = random.Random(seed)
    rows = trips(seed, [r.choice([1, 1, 2, 5, 30, 90]) for _ in range(25)], 1 + seed)
    want = likeliest(rows)
    for block, batch in ((10**6, 10**6), (1, 1), (7, 3), (50, 20), (400, 64)):
        assert sorted(run(rows, block, batch)) == sorted(want)
    assert run([], 10, 10) == []


def test_memory_of_a_long_trip():
    """Of a trip over many blocks only undecided candidates stay."""
    rows = trips(1, [5000], 4)
    decoder, most, out = decoding.Decoder(-60.0), 0, []
    starts = [k for k in range(len(rows)) if not k or rows[k][2] != rows[k - 1][2]] + [len(rows)]
    for a, b in zip(starts[::100], [*starts[100::100], len(rows)]):
        if a < b:
            table = pa.Table.from_pylist([dict(zip(KIND.names, x)) for x in rows[a:b]], KIND)
            out += decoder.decode(table, b == len(rows)).to_pylist()
            most = max(most, len(decoder.open) if decoder.open is not None else 0)
    assert [(x["TRIP_ID"], x["id"], x["u"], x["v"]) for x in out] == likeliest(rows) and most < 200
