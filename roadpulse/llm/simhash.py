"""SimHash fingerprints and their links within a Hamming distance, by generalised pigeonhole.

Bits are grouped into partitions. If partition i is probed with all values within t_i bits and
the sum of (t_i + 1) is the distance plus 1, fingerprints within the distance meet in at least
one partition. Number and thresholds t_i (-1: not probed) of the partitions are those of least
estimated cost. Fingerprints that meet are compared in full. Of the links found among those of
one value only a spanning forest goes on: it has the same groups, and its size is that of the rows.
Values that very many fingerprints share are split by the partitions of their other bits.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import few_rows, stored
from roadpulse.llm.tokens import slices

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Runs of rows with one value up to this length are compared all at once, longer ones row by row.
RUN = 256
#: Values that more rows share are split by further bits.
LONG_RUN = 2048
#: Rows of whole runs that are compared before the next are, and links that are made Python's at once.
PIECE, AT_ONCE = 2048, 16384
#: What sending a row costs, in comparisons.
ROW_COST = 16
#: The most partitions (a key is value * PARTS + partition).
PARTS = 1024


def shingles(text: str, size: int) -> list[str]:
    """Space-joined runs of ``size`` words, repeats included; fewer words are one run, none none."""
    w = _WORD.findall(text.translate(_LOWER))
    return [" ".join(x) for x in zip(*(w[k:] for k in range(size)))] if len(w) >= size else [" ".join(w)] if w else []


def hashes(found: list[str]) -> np.ndarray:
    """The unsigned XXH64, seed 42, of each shingle's UTF-8 bytes."""
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.fromiter((one(s, 42) for s in found), np.uint64, len(found))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def majority(h: np.ndarray) -> np.ndarray:
    """Bytes whose bits are set in over half of the rows of ``h`` (n, bytes), most significant first."""
    n, width = h.shape
    if not n:
        return np.zeros(width, np.uint8)
    counts = np.bincount((h + np.arange(width) * 256).ravel(), minlength=256 * width).reshape(width, 256) @ _BITS
    return np.packbits(2 * counts > n, axis=1).ravel()


def simhash64(text: str, size: int = 3) -> int:
    h = hashes(shingles(text, size))
    return int.from_bytes(majority(h.astype(">u8").view(np.uint8).reshape(-1, 8)).tobytes(), "big")


def simhash_wide(h: np.ndarray, words: int) -> bytes:
    """``words`` 64-bit SimHashes side by side, each over its own mix of the hashes."""
    h = h[:, None] ^ (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    h ^= h >> np.uint64(31)
    return majority(h.astype(">u8").view(np.uint8).reshape(len(h), 8 * words)).tobytes()


def with_fingerprints(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (8 bytes) of every row; a null text has no words."""

    def run(batches):
        for batch in slices(batches):
            made = [simhash64(t or "", size).to_bytes(8, "big") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint binary")


def wide_prints(docs: DataFrame, size: int, words: int) -> DataFrame:
    """doc_id, fingerprint (8 * ``words`` bytes) and same (16 bytes, a hash of the whole set) of the shingle set of every row."""

    def run(batches):
        import xxhash

        for batch in slices(batches):
            sets = [np.unique(hashes(shingles(t or "", size))) for t in batch.column(1).to_pylist()]
            made = pa.array([simhash_wide(h, words) for h in sets], pa.binary())
            same = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made, same], ["doc_id", "fingerprint", "same"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint binary, same binary")


def _rows(column: pa.Array) -> np.ndarray:
    """Equal-length binaries as an array of unsigned 64-bit words, one row each."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), ">u8").astype(np.uint64).reshape(len(values), -1) if values else np.empty((0, 1), np.uint64)


def _unpacked(rows: np.ndarray) -> np.ndarray:
    return np.unpackbits(rows.astype(">u8").view(np.uint8).reshape(len(rows), -1), axis=1)


def bit_moments(prints: DataFrame, words: int) -> list[np.ndarray]:
    """How often each two bits of one 64-bit word are set together, over all fingerprints, and their number.

    One matrix a word, of 65 rows: the last holds the number. Tasks send one row of sums a bit.
    """

    def run(batches):
        total, n = np.zeros((words, 64, 64), np.int64), 0
        for batch in slices(batches, 4096):
            x = _unpacked(_rows(batch.column(0))).astype(np.float32).reshape(batch.num_rows, words, 64)
            for w in range(words):
                total[w] += (x[:, w].T @ x[:, w]).astype(np.int64)
            n += len(x)
        bit = np.arange(64 * words)
        if n:
            sums = total.reshape(64 * words, 64)
            yield pa.RecordBatch.from_arrays([pa.array(bit), pa.array(np.full(len(bit), n)), *(pa.array(sums[:, k]) for k in range(64))], ["bit", "n", *(f"s{k}" for k in range(64))])

    names = ["n", *(f"s{k}" for k in range(64))]
    told = prints.select("fingerprint").mapInArrow(run, "bit long, " + ", ".join(f"{c} long" for c in names))
    out = np.zeros((words, 65, 65))
    for r in told.groupBy("bit").agg(*(F.sum(c).alias(c) for c in names)).collect():
        w, i = divmod(r["bit"], 64)
        out[w, i, :64] = [r[f"s{k}"] for k in range(64)]
        out[w, 64, 64] = r["n"]
    return list(out)


def grouped_bits(moments: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` equal groups, each grown from a free bit by those most correlated with it."""
    n, both = max(moments[-1, -1], 1), moments[:-1, :-1]
    mean = np.diag(both) / n
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((both / n - np.outer(mean, mean)) / np.outer(sd, sd))
    free, groups = list(range(len(both))), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].mean(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds of least total cost with sum(t + 1) = distance + 1; costs[i][t + 1], first 0."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picked) in best.items():
            for t1, c in enumerate(row):
                if used + t1 <= distance + 1 and (used + t1 not in after or cost + c < after[used + t1][0]):
                    after[used + t1] = (cost + c, [*picked, t1 - 1])
        best = after
    return best[distance + 1][1]


def _values(rows: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of ``group`` of each row, as one number."""
    out = np.zeros(len(rows), np.uint64)
    for b in group:
        out = (out << np.uint64(1)) | ((rows[:, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1))
    return out


def probes(prints: DataFrame, groups: list[list[int]], thresholds: list[int], *others: str) -> DataFrame:
    """key, fingerprint and ``others`` for each partition's value and, with a threshold, the values near it."""
    names = ["key", "fingerprint", *others]

    def run(batches):
        for batch in slices(batches, 2048):
            rows = _rows(batch.column(0))
            for k, (group, t) in enumerate(zip(groups, thresholds)):
                if t < 0:
                    continue
                flips = [sum(1 << b for b in c) for n in range(t + 1) for c in combinations(range(len(group)), n)]
                value = _values(rows, group)
                for flip in flips:
                    key = (value ^ np.uint64(flip)).astype(np.int64) * PARTS + k
                    yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names)

    taken = prints.select(*names[1:])
    return taken.mapInArrow(run, "key long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in taken.schema))


def estimated(prints: DataFrame, groups: list[list[int]], most: int) -> list[list[float]]:
    """Cost of each partition for thresholds -1 to ``most``: candidates, by the counts of its values, and rows sent."""
    met = probes(prints, groups, [0] * len(groups)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = met.groupBy((F.pmod("key", F.lit(PARTS))).alias("part")).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("rows")).collect()
    by = {r["part"]: (float(r["pairs"]), float(r["rows"])) for r in rows}
    out = []
    for k, group in enumerate(groups):
        pairs, n = by.get(k, (0.0, 0.0))
        ways, around = 1, [1]
        for t in range(1, most + 1):
            ways = ways * (len(group) - t + 1) // t
            around.append(around[-1] + ways)
        # values near one another are no likelier than any: a ball of values meets as many rows as its size says
        beside = n * n / 2 ** len(group)
        out.append([0.0, *(pairs + beside * (a - 1) + ROW_COST * n * a for a in around)])
    return out


def forest(rows: np.ndarray, keys: np.ndarray, distance: int, spare: set[int] | None = None) -> list[tuple[int, int, int]]:
    """Minimum spanning forests of the rows that share a key and differ in ``distance`` bits or fewer.

    Links are (row, row, bits). Keys that have links beside the forest go to ``spare``, as do all
    keys of long runs. Runs of up to RUN rows are compared by shifting the array on itself;
    in longer runs each row that joins is held against those still outside. Without ``spare``
    their forest is any, not a minimum one.
    """
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)) if len(keys) else np.empty(0, int)
    out, at = [], 0
    while at < len(keys):  # links grow with a piece's rows times RUN
        end = int(ends[max(np.searchsorted(ends, at + PIECE, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        out += [(at + a, at + b, d) for a, b, d in _piece_forest(rows[at:end], keys[at:end], distance, spare)]
        at = end
    return out


def _piece_forest(rows: np.ndarray, keys: np.ndarray, distance: int, spare: set[int] | None) -> list[tuple[int, int, int]]:
    n = len(keys)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if n else np.empty(0, int)
    lengths = np.diff(np.append(starts, n))
    found: list[np.ndarray] = []
    small = np.repeat(lengths <= RUN, lengths)
    for lag in range(1, int(lengths[lengths <= RUN].max(initial=1))):
        at = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
        if not len(at):
            break
        d = np.bitwise_count(rows[at] ^ rows[at + lag]).sum(1, dtype=np.int64)
        good = d <= distance
        found.append(np.stack([d[good], at[good], at[good] + lag], 1))
    links = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    order = np.argsort(links[:, 0], kind="stable")
    for k in range(0, len(order), AT_ONCE):
        for d, a, b in links[order[k : k + AT_ONCE]].tolist():
            x, y = top(a), top(b)
            if x != y:
                root[x] = y
                out.append((a, b, d))
    if spare is not None:
        run = np.repeat(np.arange(len(lengths)), lengths)
        more = np.bincount(run[links[:, 1]], minlength=len(lengths)) > np.bincount(run[[x[0] for x in out]], minlength=len(lengths)) if out else np.zeros(len(lengths), bool)
        spare.update(keys[starts[more | (lengths > RUN)]].tolist())
    long = _any_forest if spare is None else _nearest_forest
    for start, length in zip(starts[lengths > RUN], lengths[lengths > RUN]):
        out += long(rows[start : start + length], int(start), distance)
    return out


def _nearest_forest(rows: np.ndarray, start: int, distance: int) -> list[tuple[int, int, int]]:
    """Prim's algorithm over one run, in memory of the run's size."""
    outside = np.arange(1, len(rows))
    near = np.bitwise_count(rows[1:] ^ rows[0]).sum(1, dtype=np.int64)
    by = np.zeros(len(outside), np.int64)
    out = []
    while len(outside):
        k = int(near.argmin())
        x = int(outside[k])
        if near[k] <= distance:
            out.append((start + int(by[k]), start + x, int(near[k])))
        keep = np.arange(len(outside)) != k
        outside, near, by = outside[keep], near[keep], by[keep]
        d = np.bitwise_count(rows[outside] ^ rows[x]).sum(1, dtype=np.int64)
        closer = d < near
        near[closer], by[closer] = d[closer], x
    return out


def _any_forest(rows: np.ndarray, start: int, distance: int) -> list[tuple[int, int, int]]:
    """A spanning forest of one run, in memory of the run's size: rows that join are not looked at again."""
    outside = np.arange(len(rows))
    out = []
    while len(outside):
        queue, outside = [int(outside[0])], outside[1:]
        while queue and len(outside):
            x = queue.pop()
            d = np.bitwise_count(rows[outside] ^ rows[x]).sum(1, dtype=np.int64)
            near = d <= distance
            joined = outside[near].tolist()
            out += [(start + x, start + y, int(n)) for y, n in zip(joined, d[near].tolist())]
            queue += joined
            outside = outside[~near]
    return out


def links(met: DataFrame, distance: int) -> DataFrame:
    """The links (a, b: fingerprints) of the forests of all keys."""

    def run(batches):
        kept_keys, kept = np.empty(0, np.int64), []

        def told(keys, prints):
            rows = np.frombuffer(b"".join(prints), ">u8").astype(np.uint64).reshape(len(prints), -1)
            found = forest(rows, keys, distance)
            if found:
                return pa.RecordBatch.from_arrays([pa.array([prints[x[k]] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([kept_keys, batch.column(0).to_numpy()])
            prints = kept + batch.column(1).to_pylist()
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys[::-1] != keys[-1], True)) if keys[0] != keys[-1] else len(keys)
            done = len(keys) - cut  # the last key's rows may go on in the next batch
            if done and (made := told(keys[:done], prints[:done])) is not None:
                yield made
            kept_keys, kept = keys[done:], prints[done:]
        if len(kept) > 1 and (made := told(kept_keys, kept)) is not None:
            yield made

    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of ``edges`` (a, b: longs).

    Each round takes the least label around a node, then the label of that label; it ends when
    nothing changes. Every round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = stored(labels, "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels["node"] == around["a"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        after = stored(nearer.join(jump, "next", "left").select("node", F.col("label").alias("last"), F.least("next", F.coalesce("far", "next")).alias("label")), "labels")
        if after.where("label <> last").limit(1).count() == 0:
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")


def planned(distinct: DataFrame, distance: int, words: int) -> tuple[list[list[int]], list[int]]:
    """Groups of correlated bits and their thresholds: of the plans with 2 and with distance + 1 partitions the cheaper.

    With many rows wide partitions with probes around their values win over narrow ones, as the
    rows that share a narrow value grow with the table.
    """
    moments, best = bit_moments(distinct, words), None
    for parts in sorted({2, distance + 1}):
        groups = [[64 * w + b for b in g] for w, m in enumerate(moments) for g in grouped_bits(m, parts)]
        costs = estimated(distinct, groups, -(-(distance + 1) // parts))
        thresholds = allocate(costs, distance)
        total = sum(c[t + 1] for c, t in zip(costs, thresholds))
        if best is None or total < best[0]:
            best = total, groups, thresholds
    return best[1:]


def split_long(met: DataFrame, most: int) -> DataFrame:
    """``met`` with the rows of each key that more than ``most`` rows share dealt to pairs of blocks.

    Every two rows of a key meet in some pair of its blocks, so nothing is lost and no task
    holds more than two blocks of one key.
    """
    n = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    long = stored(n.select(F.col("key").alias("long_key"), F.ceil(F.col("n") / most).cast("int").alias("blocks")), "long-keys")
    if long.first() is None:
        return met
    rows = met.join(few_rows(long), met["key"] == long["long_key"], "left")
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    key = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    return rows.withColumn("key", key).select(*met.columns)


def fingerprint_groups(prints: DataFrame, distance: int) -> DataFrame:
    """doc_id, fingerprint and component_id of ``prints`` (doc_id, fingerprint of 64 bits): the smallest doc_id that links reach."""
    prints = stored(prints, "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    if distinct.first() is None:
        return prints.select("doc_id", "fingerprint", F.col("doc_id").alias("component_id"))
    groups, thresholds = planned(distinct, distance, 1)
    found = links(split_long(probes(distinct, groups, thresholds), LONG_RUN), distance)
    named = _named(distinct, found)
    return prints.join(few_rows(named), "fingerprint", "left").select("doc_id", "fingerprint", F.coalesce("component_id", "doc_id").alias("component_id"))


def _named(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """fingerprint and component_id of those that several rows have or that ``found`` connects: the least doc_id of all."""
    number = distinct.select("fingerprint", F.conv(F.hex("fingerprint"), 16, -10).cast("long").alias("node"), "first", "n")
    edges = found.select(*(F.conv(F.hex(c), 16, -10).cast("long").alias(c) for c in ("a", "b")))
    labels = components(edges)
    ends = number.join(labels, "node")
    least = stored(ends.groupBy("component").agg(F.min("first").alias("least")), "least")
    parts = number.join(few_rows(labels), "node", "left").join(few_rows(least), "component", "left")
    return stored(parts.where("n > 1 or component is not null").select("fingerprint", F.coalesce("least", "first").alias("component_id")), "named")


def near_groups(docs: DataFrame, size: int = 3, distance: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs``.

    A null text has no words and the fingerprint zero; it links like any other. Rows without
    id belong to components but never name one; repeated rows repeat; other columns are
    ignored.
    """
    found = fingerprint_groups(with_fingerprints(docs, size, doc_id, text), distance)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def flip_rate(similarity: float) -> float:
    """The share of SimHash bits in which two sets of equal size and this Jaccard similarity differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def jaccard(a: str, b: str, size: int) -> float:
    x, y = set(shingles(a, size)), set(shingles(b, size))
    return len(x & y) / len(x | y) if x or y else 1.0


def judged(docs: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``pairs`` (a, b: ids) and good: whether their texts have the similarity, by exact Jaccard on their shingles."""
    ends = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ends")
    texts = docs.select("doc_id", "text").join(few_rows(ends), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("text").alias("text"))
    texts = stored(texts, "texts")
    first = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("one")), "a")
    both = first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("two")), "b")

    def run(batches):
        for batch in slices(batches):
            good = [jaccard(x or "", y or "", size) >= similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "good"])

    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long, good boolean")


def whole_keys(batches):
    """Tables of the rows of ``batches``, which are sorted by their first column, with no value of it in two tables."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (kept and kept[-1].column(0)[0].as_py() != keys[0]):
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks()
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _paired(pairs: list[tuple], names: str = "a b key") -> pa.RecordBatch:
    columns = zip(*pairs) if pairs else [()] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names.split())


def _dealt(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key")


def first_pairs(met: DataFrame, distance: int) -> DataFrame:
    """a, b (nodes, a < b) of the forests of all keys, and the key if it has candidates beside its forest."""

    def run(batches):
        for table in whole_keys(batches):
            keys, nodes, spare = table["key"].to_numpy(), table["node"].to_pylist(), set()
            found = forest(_rows(table["fingerprint"]), keys, distance, spare)
            named = ((nodes[a], nodes[b], int(keys[a])) for a, b, _ in found)
            yield _paired([(min(a, b), max(a, b), key if key in spare else None) for a, b, key in named])

    return _dealt(met).mapInArrow(run, "a long, b long, key long").distinct()


def prefixes(docs: DataFrame, members: DataFrame, size: int, similarity: float) -> DataFrame:
    """(shingle, node, label, n, at): each member's rarest shingles, of which two similar sets share one.

    ``members`` has node and label. Shingles are ordered by the number of members that have
    them; sets of n shingles with a Jaccard similarity of ``similarity`` share one of their
    first n - ceil(similarity * n) + 1; ``at`` is its place.
    """
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(few_rows(members.select("node")), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def run(batches):
        for batch in slices(batches):
            sets = [np.unique(hashes(shingles(t or "", size))).view(np.int64) for t in batch.column(1).to_pylist()]
            if any(map(len, sets)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), batch.column(0).take(pa.array(np.repeat(np.arange(len(sets)), list(map(len, sets)))))], ["shingle", "node"])

    each = stored(texts.mapInArrow(run, "shingle long, node long"), "shingles")
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = each.join(few_rows(stored(shared, "shared-shingles")), "shingle", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "shingle"))).alias("s"))
    n = F.size("s")
    first = F.slice("s", F.lit(1), (n - F.ceil(F.lit(similarity) * n - 1e-9) + 1).cast("int"))
    placed = ranked.select("node", n.alias("n"), F.posexplode(first).alias("at", "x")).where("x.df > 1")
    return placed.join(few_rows(members), "node").select(F.col("x.shingle").alias("shingle"), "node", "label", "n", "at")


def bounded_pairs(nodes: np.ndarray, labels: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float, most: int | None) -> list[tuple[int, int]]:
    """Pairs of the rows of one shingle that have different labels and may be similar by sizes and places.

    Of each row only the ``most`` likeliest are given, if that is set. Rows of the commonest
    label are not held against each other.
    """
    values, counts = np.unique(labels, return_counts=True)
    if len(values) < 2:
        return []
    common, place = labels == values[counts.argmax()], np.arange(len(nodes))
    rest, out = n - at, []
    for i in np.flatnonzero(~common).tolist():
        # the sets have nothing in common before the first shingle they share
        bound = np.minimum(rest, rest[i]) - similarity / (1 + similarity) * (n + n[i])
        ok = np.flatnonzero((bound >= -1e-9) & (labels != labels[i]) & (common | (place > i)))
        if most is not None and len(ok) > most:
            ok = ok[np.argpartition(-bound[ok], most)[:most]]
        out += [(min(int(nodes[i]), j), max(int(nodes[i]), j)) for j in nodes[ok].tolist()]
    return out


def next_pairs(firsts: DataFrame, labels: DataFrame, similarity: float, most: int | None) -> DataFrame:
    """a, b (nodes) of ``firsts`` (see ``prefixes``) that may be similar and have different labels now."""
    now = labels.select("node", F.col("component").alias("now"))
    rows = firsts.join(few_rows(now), "node", "left").select(F.col("shingle").alias("key"), "node", F.coalesce("now", "label").alias("label"), "n", "at")
    rows = stored(rows, "prefixes")
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rows = rows.join(few_rows(stored(mixed, "mixed")), "key", "left_semi")

    def run(batches):
        for table in whole_keys(batches):
            key, *columns = (table[c].to_numpy() for c in ("key", "node", "label", "n", "at"))
            ends = np.flatnonzero(np.diff(key)) + 1
            pairs: set[tuple[int, int]] = set()
            for start, end in zip([0, *ends], [*ends, len(key)]):
                pairs.update(bounded_pairs(*(c[start:end] for c in columns), similarity, most))
                if len(pairs) > AT_ONCE or pairs and end == len(key):
                    yield _paired(list(pairs), "a b")
                    pairs.clear()

    return _dealt(rows).mapInArrow(run, "a long, b long").distinct()


def layout(rows: int, similarity: float, recall: float = 0.95) -> tuple[int, int]:
    """64-bit words of a wide SimHash and partitions a word for a table of so many rows.

    Partitions grow wider with the table, so that few rows share a value by chance; there are so
    many of them that a pair of exactly the similarity agrees in one with probability ``recall``.
    """
    parts = 4 if rows <= 1 << 22 else 3 if rows <= 1 << 27 else 2
    meets = (1 - flip_rate(similarity)) ** (64 / parts)
    return -(-int(np.ceil(np.log(1 - recall) / np.log1p(-meets))) // parts), parts


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id of every row: documents that chains of similar pairs connect.

    Similar pairs have a Jaccard similarity of their ``size``-word shingle sets of ``similarity``
    or more. Candidates differ in few bits of a wide SimHash and meet in one of its partitions,
    which are groups of correlated bits with thresholds by dynamic programming. Of the
    candidates of one value a spanning forest is compared exactly. Where a link of it fails,
    all documents of that value are compared further, those of different components alone:
    pairs that share none of their rarest shingles, or too late, can't be similar; of the others
    first the likeliest, then all are compared exactly. Candidates that differ in more bits than the mean
    of a pair at the bound and three standard deviations aren't compared: about one in 700 of such pairs. A null text has no words; texts without
    words form one group; rows without id join no group; repeated rows repeat.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    words, parts = layout(source.count(), similarity)
    prints = stored(wide_prints(source, size, words), "wide-prints")
    nodes = stored(prints.where("doc_id is not null").groupBy("fingerprint", "same").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "distinct")
    groups = [[64 * w + b for b in g] for w, m in enumerate(bit_moments(nodes, words)) for g in grouped_bits(m, parts)]
    thresholds = allocate(estimated(nodes, groups, 1), len(groups) - 1)
    rate = flip_rate(similarity)
    distance = int(64 * words * rate + 3 * (64 * words * rate * (1 - rate)) ** 0.5)
    met = split_long(probes(nodes, groups, thresholds, "node"), LONG_RUN)
    found = stored(first_pairs(met, distance), "candidates")
    tested = stored(judged(source, found.select("a", "b").distinct(), size, similarity), "judged")
    labels = components(tested.where("good").select("a", "b"))
    keys = stored(found.where("key is not null").join(tested.where("not good"), ["a", "b"], "left_semi").select("key").distinct(), "keys")
    if keys.first() is not None:
        members = met.join(few_rows(keys), "key", "left_semi").join(few_rows(labels), "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
        members = stored(members, "members")
        mixed = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        members = stored(members.join(few_rows(stored(mixed, "mixed")), "key", "left_semi").select("node", "label").distinct(), "members")
        firsts = stored(prefixes(source, members, size, similarity), "prefixes")
        for most in (8, None):
            pairs = next_pairs(firsts, labels, similarity, most).join(tested.select("a", "b"), ["a", "b"], "left_anti")
            now = stored(judged(source, stored(pairs, "candidates"), size, similarity), "judged")
            tested = tested.unionByName(now)
            if now.where("good").first() is not None:
                labels = components(tested.where("good").select("a", "b"))
    copies = stored(nodes.where("n > 1").select("same", "node"), "same")
    named = prints.where("doc_id is not null").select("doc_id", "same").join(few_rows(copies), "same", "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"))
    named = named.join(few_rows(labels), "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return named.unionByName(prints.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id")))


def drop_similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the document of smallest id of each group alone; rows without id all stay.

    Rows that share an id stay or go together.
    """
    extra = similar_groups(docs, size, similarity, doc_id=doc_id, text=text).where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    extra = stored(extra, "copies")
    return docs.join(few_rows(extra), doc_id, "left_anti").select(*docs.columns)
