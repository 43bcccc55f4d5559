"""Removal of byte strings that occur earlier in the corpus.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of
smaller id, or in the same document before. Strings never cross documents.

The sorted order of suffixes is only needed down to ``length`` bytes, and only where strings
repeat. So a sample of positions is taken such that equal strings hold equal samples at equal
places (a cover: each string of ``length`` bytes has one, at the same offset in every copy).
Samples are named by their prefix, names are sorted, and what follows and precedes equal names
is compared: first whole contexts, then, where contexts differ, every string around the sample.
Names of very many different contexts are compared string by string instead, in no task of one name.
The sample is content-defined (local minima of prefix hashes) rather than periodic: README.md
has the figures of both.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import few_rows, free_name, stored
from roadpulse.llm.tokens import slices

LENGTH = 100
#: Bytes in a sample's prefix.
PREFIX = 32
#: Documents whose samples are settled among themselves before they are dealt out.
SLICE = 1024
#: Names of more places with different contexts than a task's share of all of them are split into the strings around
#: them; a share counts as SHORT_NAME places at least and as LONG_NAME at most.
SHORT_NAME, LONG_NAME = 1024, 16384
#: Low bits of a place that hold the bytes of context after the prefix.
REST_BITS = 16
_ONE, _TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Rolling:
    """Hashes of all substrings of a byte string, from prefix sums of powers of an odd number."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        if base not in self.powers or len(self.powers[base][0]) < n:
            size = max(1 << 16, 2 * n)
            self.powers[base] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        up, self.down = self.powers[base]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def sample(names: np.ndarray, width: int) -> np.ndarray:
    """Positions whose name is least in some ``width`` neighbouring positions."""
    least = sliding(names, width, np.minimum)
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(sliding(around, width, np.maximum) == names)


def difference_cover(modulus: int) -> list[int]:
    """Residues such that every residue is the difference of two of them: all small ones, then multiples of the step."""
    if modulus == 73:  # the powers of two are a perfect difference set: 72 differences of 9 residues
        return sorted(pow(2, k, 73) for k in range(9))
    step = max(1, int(modulus**0.5))
    return sorted({*range(step), *range(step - 1, modulus, step), modulus - 1})


def settled(name, context, doc, place, reach: int, prefix: int):
    """The samples of some documents, later copies of a context among them replaced by spans.

    A passage that many documents share thus leaves a task once for every few documents. Spans
    are merged per document; as rows they have place -1, context low * 2**32 + high, and a name
    that only spreads them.
    """
    order = np.lexsort((place, doc, context, name))
    name, context, doc, place = name[order], context[order], doc[order], place[order]
    head = np.append(True, (name[1:] != name[:-1]) | (context[1:] != context[:-1]))
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (doc != doc[first]) | (place != place[first])
    at, of = place[later] >> REST_BITS, doc[later]
    low, high = np.maximum(at - reach, 0), at + prefix + (place[later] & ((1 << REST_BITS) - 1))
    order = np.lexsort((low, of))
    low, high, of = low[order], high[order], of[order]
    number = np.cumsum(np.append(False, of[1:] != of[:-1])) if len(of) else of
    ends = np.maximum.accumulate(number * (1 << 32) + high) if len(of) else of
    starts = np.append(True, (number[1:] != number[:-1]) | (number[1:] * (1 << 32) + low[1:] > ends[:-1])) if len(of) else np.empty(0, bool)
    begin = np.flatnonzero(starts)
    last = np.append(begin[1:], len(of)) - 1 if len(begin) else begin
    span = low[begin] * (1 << 32) + (ends[last] & 0xFFFFFFFF)
    spread = mixed((of[begin].astype(np.uint64) * np.uint64(_ONE)) ^ span.astype(np.uint64)).view(np.int64)
    keep = ~later
    return tuple(np.concatenate(x) for x in ((name[keep], spread), (context[keep], span), (doc[keep], of[begin]), (place[keep], np.full(len(begin), -1))))


def samples(docs: DataFrame, length: int, prefix: int, periodic: bool = False) -> DataFrame:
    """(name, context, doc_id, place) of each sample; place is position * 2**REST_BITS + bytes of context after the prefix.

    With ``periodic`` the positions of a difference cover modulo length - prefix + 1 are taken.
    """
    reach = length - prefix
    if not 0 < reach < 1 << REST_BITS:
        raise ValueError(f"length has to be above {prefix} and below {prefix + (1 << REST_BITS)}")
    cover = np.array(difference_cover(reach + 1)) if periodic else None

    def run(batches):
        for batch in slices(batches, SLICE):
            parts = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                n = len(data)
                if n < length:
                    continue
                one = Rolling(data, _ONE)
                at = np.arange(n - prefix + 1)
                names = one.of(at, at + prefix)
                at = at[np.isin(at % (reach + 1), cover)] if periodic else sample(names, reach + 1)
                left, right = np.maximum(at - reach, 0), np.minimum(at + length, n)
                context = mixed(Rolling(data, _TWO).of(left, right) + ((at - left) * (1 << REST_BITS) + right - at).astype(np.uint64) * np.uint64(_ONE))
                parts.append((names[at].view(np.int64), context.view(np.int64), np.full(len(at), k), at * (1 << REST_BITS) + right - at - prefix))
            if parts:
                name, context, row, place = (np.concatenate(x) for x in zip(*parts))
                made = settled(name, context, batch.column(0).to_numpy()[row], place, reach, prefix)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["name", "context", "doc_id", "place"])

    return docs.mapInArrow(run, "name long, context long, doc_id long, place long")


def _runs(batches):
    """Batches cut so that rows of one name (the first column) stay together."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        key = table.column(0).to_numpy()
        if not len(key):
            continue
        done = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if done:
            yield table.slice(0, done).combine_chunks()
        kept = table.slice(done)
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks()


def same_contexts(found: DataFrame, length: int, prefix: int) -> DataFrame:
    """From samples: (doc_id, low, high, name): a span to remove, or where low is null, a place whose context differs from others of its name."""
    reach = length - prefix

    def run(batches):
        last = (None, None, None, None)  # name, context, doc_id, place of the last row
        pending = None  # the first row of the run's first context, told once a second context shows up
        for batch in batches:
            name, context, doc, place = (batch.column(k).to_numpy() for k in range(4))
            doc_out, low, high, named = [], [], [], []
            ready = place < 0  # spans that the samples' task has found
            doc_out.append(doc[ready])
            low.append(context[ready] >> 32)
            high.append(context[ready] & 0xFFFFFFFF)
            named.append(np.full(len(doc_out[0]), -1))
            name, context, doc, place = (x[~ready] for x in (name, context, doc, place))
            if not len(name):
                if len(doc_out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(doc_out[0]), pa.array(low[0]), pa.array(high[0]), pa.nulls(len(doc_out[0]), pa.int64())], ["doc_id", "low", "high", "name"])
                continue
            same_name = np.append(name[0] == last[0], name[1:] == name[:-1])
            same_context = same_name & np.append(context[0] == last[1], context[1:] == context[:-1])
            # a later copy of a context: all strings around it are found earlier
            head = np.flatnonzero(~same_context)
            group = np.cumsum(~same_context) - 1
            first_doc = np.where(group >= 0, doc[head[group]] if len(head) else 0, last[2] if last[2] is not None else 0)
            first_place = np.where(group >= 0, place[head[group]] if len(head) else 0, last[3] if last[3] is not None else 0)
            later = same_context & ((doc != first_doc) | (place != first_place))
            at = place[later] >> REST_BITS
            doc_out.append(doc[later])
            low.append(np.maximum(at - reach, 0))
            high.append(at + prefix + (place[later] & ((1 << REST_BITS) - 1)))
            named.append(np.full(len(at), -1))
            # first rows of a name's contexts, where it has two or more
            lead_same = same_name[head]
            follows = np.append(lead_same[1:], False)
            if len(head) and lead_same[0] and pending is not None:
                doc_out.append(np.array([pending[2]]))
                named.append(np.array([pending[0]]))
                low.append(np.array([-1]))
                high.append(np.array([pending[3] >> REST_BITS]))
                pending = None
            ask = head[lead_same | follows]
            doc_out.append(doc[ask])
            named.append(name[ask])
            low.append(np.full(len(ask), -1))
            high.append(place[ask] >> REST_BITS)
            if len(head):
                pending = None if lead_same[-1] else (name[head[-1]], context[head[-1]], doc[head[-1]], place[head[-1]])
                last = (name[head[-1]], context[head[-1]], doc[head[-1]], place[head[-1]])
            doc_out, low, high, named = (np.concatenate(x) for x in (doc_out, low, high, named))
            if len(doc_out):
                asked = low < 0
                yield pa.RecordBatch.from_arrays([pa.array(doc_out), pa.array(low, mask=asked), pa.array(high), pa.array(named, mask=~asked)], ["doc_id", "low", "high", "name"])

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(n, "name").sortWithinPartitions("name", "context", "doc_id", "place")
    return dealt.mapInArrow(run, "doc_id long, low long, high long, name long")


def contexts(docs: DataFrame, asked: DataFrame, length: int, prefix: int) -> DataFrame:
    """(name, doc_id, at, before, bytes) around each asked place (doc_id, high: position, name)."""
    reach = length - prefix
    wanted = asked.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("high").alias("at"), "name")).alias("places"))
    joined = docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "places.at", "places.name")

    def cut(batches):
        for batch in slices(batches):
            out = []
            for doc, text, ats, names in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for at, name in zip(ats, names):
                    low = max(0, at - reach)
                    out.append((name, doc, at, at - low, data[low : at + length]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["name", "doc_id", "at", "before", "bytes"])

    return joined.mapInArrow(cut, "name long, doc_id long, at long, before long, bytes binary")


def different_contexts(around: DataFrame, length: int, prefix: int) -> DataFrame:
    """(doc_id, low, high) of the strings around asked places that another place of the name has earlier."""
    reach = length - prefix

    def run(batches):
        for table in _runs(batches):
            name, doc, at, before = (table.column(k).to_numpy() for k in range(4))
            size = 2 * reach + prefix
            data = np.zeros((len(name), size), np.uint8)
            sizes = np.zeros(len(name), np.int64)
            for k, x in enumerate(table.column(4).to_pylist()):
                low = reach - before[k]
                data[k, low : low + len(x)] = np.frombuffer(x, np.uint8)
                sizes[k] = low + len(x)
            out = [np.zeros((len(name), reach + 1), bool)]
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _TWO, np.uint64)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, pow(_TWO, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
            sums = np.zeros((len(name), size + 1), np.uint64)
            for k in range(0, len(name), 1024):  # little at once beside the sums
                np.cumsum((data[k : k + 1024].astype(np.uint64) + np.uint64(1)) * up, axis=1, out=sums[k : k + 1024, 1:])
            run_key = mixed(name.view(np.uint64))
            for start in range(reach + 1):  # string from ``start``: reach - start bytes before the place
                valid = np.flatnonzero((start >= reach - before) & (start + length <= sizes))
                key = mixed((sums[valid, start + length] - sums[valid, start]) * down[start]) ^ run_key[valid]
                order = np.argsort(key, kind="stable")  # rows come sorted by document and place
                k = key[order]
                # the first of equal keys, and rows of the very same place, stay
                head = np.append(True, k[1:] != k[:-1])
                lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(order) else order
                again = (doc[valid[order]] != doc[valid[lead]]) | (at[valid[order]] != at[valid[lead]])
                out[0][valid[order[again]], start] = True
            hit = out[0]
            padded = np.pad(hit, ((0, 0), (1, 1))).astype(np.int8)
            step = np.diff(padded, axis=1)
            (row, low), (_, high) = np.nonzero(step == 1), np.nonzero(step == -1)
            base = at[row] - reach
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(base + low), pa.array(base + high - 1 + length)], ["doc_id", "low", "high"])

    n = int(around.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return around.repartition(n, "name").sortWithinPartitions("name", "doc_id", "at").mapInArrow(run, "doc_id long, low long, high long")


def by_strings(around: DataFrame, length: int, prefix: int) -> DataFrame:
    """What ``different_contexts`` gives, by a sort of all strings around the places of ``around``.

    A task tells of later copies that it sees itself and sends on the first of each string alone;
    dealt by string and sorted, those are read as a stream.
    """
    reach = length - prefix

    def strings(batches):
        for batch in slices(batches, 4096):
            doc, at, before = (batch.column(k).to_numpy() for k in (1, 2, 3))
            keys, docs, starts = [], [], []
            for d, a, b, x in zip(doc.tolist(), at.tolist(), before.tolist(), batch.column(4).to_pylist()):
                data = np.frombuffer(x, np.uint8)
                n = len(data) - length + 1
                if n > 0:
                    begin = np.arange(n)
                    keys.append(Rolling(data, _TWO).of(begin, begin + length))
                    docs.append(np.full(n, d))
                    starts.append(a - b + begin)
            if not keys:
                continue
            key, d, start = np.concatenate(keys), np.concatenate(docs), np.concatenate(starts)
            order = np.lexsort((start, d, key))
            key, d, start = key[order], d[order], start[order]
            head = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = (d != d[first]) | (start != start[first])
            # runs of later strings of a document are one span
            order = np.lexsort((start[later], d[later]))
            of, low = d[later][order], start[later][order]
            begin = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (low[1:] > low[:-1] + length))) if len(of) else np.empty(0, int)
            last = np.append(begin[1:], len(of)) - 1 if len(begin) else begin
            ready = pa.nulls(len(begin), pa.int64())
            yield pa.RecordBatch.from_arrays([ready, pa.array(of[begin]), pa.array(low[begin]), pa.array(low[last] + length)], ["string", "doc_id", "low", "high"])
            yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), pa.array(d[head]), pa.array(start[head]), pa.array(start[head] + length)], ["string", "doc_id", "low", "high"])

    def later_ones(batches):
        last = None  # the string, document and start of the current run's first row
        for batch in batches:
            key, doc, low, high = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            head = np.append(last is None or key[0] != last[0], key[1:] != key[:-1])
            at = np.where(head, np.arange(len(key)), -1)
            at = np.maximum.accumulate(at)
            first_doc, first_low = np.where(at >= 0, doc[at], last[1] if last else 0), np.where(at >= 0, low[at], last[2] if last else 0)
            later = (doc != first_doc) | (low != first_low)
            yield pa.RecordBatch.from_arrays([pa.array(x[later]) for x in (doc, low, high)], ["doc_id", "low", "high"])
            last = (key[-1], int(first_doc[-1]), int(first_low[-1]))

    told = stored(around.mapInArrow(strings, "string long, doc_id long, low long, high long"), "strings")
    n = int(around.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = told.where("string is not null").repartition(n, "string").sortWithinPartitions("string", "doc_id", "low")
    found = dealt.mapInArrow(later_ones, "doc_id long, low long, high long")
    return told.where("string is null").select("doc_id", "low", "high").unionByName(found)


def repeated_spans(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, periodic: bool = False) -> DataFrame:
    """doc_id and spans (array of low, high) of the bytes to remove, overlaps included; ``docs`` has doc_id and text, ids are unique."""
    source = docs.where("doc_id is not null and text is not null")
    told = stored(same_contexts(samples(source, length, prefix, periodic), length, prefix), "contexts")
    asked = told.where("low is null").select("doc_id", "high", "name").distinct()
    share = told.where("low is null").count() // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(LONG_NAME, max(SHORT_NAME, share))
    long = stored(asked.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("name"), "long-names")
    some = long.first() is not None
    around = contexts(source, asked, length, prefix)
    if some:  # written once, as each reading of the contexts shuffles the texts
        around = stored(around, "around")
        many, around = (around.join(few_rows(long), "name", how) for how in ("left_semi", "left_anti"))
    spans = told.where("low is not null").select("doc_id", "low", "high").union(different_contexts(around, length, prefix))
    if some:
        spans = spans.union(by_strings(many, length, prefix))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for low, high in spans:
        parts.append(data[at:low])
        at = high
    return b"".join([*parts, data[at:]])


def _with_spans(docs: DataFrame, length: int, doc_id: str, text: str, kept: list, low: str = "span_low", high: str = "span_high") -> DataFrame:
    """``kept`` columns of ``docs`` with ``low`` and ``high``, arrays; ``docs`` has no columns of these names."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own, hashed, said = (free_name(docs, c) for c in ("span_doc", "span_hash", "span_text"))
    ends = lambda spans, key: spans.select(F.col("doc_id").alias(key), F.col("spans.low").alias(low), F.col("spans.high").alias(high))
    ids = source.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1").limit(1).count() == 0:
        return docs.join(ends(repeated_spans(source, length), own), F.col(doc_id) == F.col(own), "left").select(*kept, low, high)
    # different texts of one id are documents of their own, numbered in order of id and text
    rows = source.where("doc_id is not null and text is not null").distinct().orderBy("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "numbered")
    spans = ends(repeated_spans(rows.select(F.col("row").alias("doc_id"), "text"), length), "row")
    named = rows.join(spans, "row").select(F.col("doc_id").alias(own), F.xxhash64("text").alias(hashed), F.col("text").alias(said), low, high)
    same = (F.col(doc_id) == F.col(own)) & (F.xxhash64(docs[text]) == F.col(hashed)) & (docs[text] == F.col(said))
    return docs.join(named, same, "left").select(*kept, low, high)


def _spans(low, high) -> list[tuple[int, int]]:
    return merged(list(zip(low or (), high or ())))


def removal(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    A null text counts as empty. Ids order the documents; different texts of one id are documents
    in the order of their texts; rows of one id and text count as one document. Rows without
    id neither lose bytes nor make others lose them. Other columns are ignored.
    """

    def run(batches):
        for batch in slices(batches):
            out = []
            for doc, t, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                data, spans = (t or "").encode(), _spans(low, high)
                out.append((doc, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(data, spans)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.string(),))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), length, "doc_id", "text", ["doc_id", "text"])
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated bytes removed from ``text``; a character that loses a byte goes whole."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or low is None else without(t.encode(), merged(list(zip(low, high)))).decode(errors="ignore") for t, low, high in zip(texts, lows, highs)], dtype=object)

    low, high = free_name(docs, "span_low"), free_name(docs, "span_high")
    rows = _with_spans(docs, length, doc_id, text, [docs[c] for c in docs.columns], low, high)
    shown = kept(F.col(text), low, high)
    return rows.select(*(shown.alias(c) if c == text else F.col(c) for c in docs.columns))
