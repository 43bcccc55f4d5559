"""Exact fingerprints of canonical texts.

A text's canonical form is its NFKC normal form, case-folded, with white space folded to single
spaces. Its fingerprint is the 128-bit xxHash of that form. Texts with one fingerprint are
compared byte by byte: a fingerprint that two canonical forms share is lengthened by their
SHA-256, so equal fingerprints always mean equal canonical forms.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import few_rows, stored
from roadpulse.llm.tokens import slices

#: Rows of a range of neighbouring ids, and the most ranges; larger ranges are read as a stream.
RANGE_ROWS, MAX_RANGES = 8_000, 4_096


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split())
    return " ".join(text.lower().split())


def digest(form: str) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(form.encode())


def long_digest(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


def _squeezer():
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def shared_fingerprints(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """The fingerprints in ``prints`` that stand for more than one canonical form (seldom any).

    Only texts whose fingerprint occurs twice are compared. Each task compares the forms that it
    reads byte by byte and sends on each form once a batch, so a large group of copies shrinks
    where it lies; the smallest and the largest form of each fingerprint are compared at last.
    """
    twice = stored(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"), "repeated-prints")
    if twice.first() is None:
        return twice

    def forms(batches):
        squeeze, _ = _squeezer()
        for batch in batches:
            made: dict[str, set[str]] = {}
            for part in slices([batch]):
                for t in part.column(0).to_pylist():
                    form = canonical(t or "")
                    made.setdefault(digest(form), set()).add(form)
            rows = [(k, squeeze(x.encode())) for k, found in made.items() for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.binary())], ["fingerprint", "form"])

    found = docs.select("text").mapInArrow(forms, "fingerprint string, form binary").join(few_rows(twice), "fingerprint", "left_semi")
    return found.groupBy("fingerprint").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("fingerprint")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_id (smallest id with the canonical form) and copies.

    A null text counts as empty; rows without id belong to their group but never name it;
    repeated rows count as copies; other columns are ignored.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def prints(batches):
        for batch in slices(batches):
            made = [canonical(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(x) for x in made]), pa.array([long_digest(x) for x in made])], ["doc_id", "fingerprint", "long"])

    found = stored(source.mapInArrow(prints, "doc_id long, fingerprint string, long string"), "prints")
    found = lengthened(found, stored(shared_fingerprints(source, found), "shared-prints"), ("fingerprint", "long"))
    groups = stored(found.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "groups")
    rows = found.select("doc_id", "fingerprint").join(few_rows(groups), "fingerprint", "left")
    lone = F.col("copies").isNull()
    return rows.select("doc_id", "fingerprint", F.when(lone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def lengthened(found: DataFrame, shared: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Each (fingerprint, long) pair of columns, lengthened where ``shared`` has the fingerprint."""
    for short, long in pairs:
        marked = shared.select(F.col("fingerprint").alias("shared_print"), F.lit(True).alias("is_shared"))
        found = found.join(few_rows(marked), found[short] == marked["shared_print"], "left")
        found = found.withColumn(short, F.when(F.col("is_shared"), F.concat_ws("-", short, long)).otherwise(F.col(short))).drop("shared_print", "is_shared", long)
    return found


def _ranges(source: DataFrame) -> tuple[list[int], dict[int, int]]:
    """Lower ends of ranges of ids, and to which other range each range's largest id goes.

    Texts are in descending order of id: a range's largest id follows the smallest of the next
    range with rows above it, and the largest of all follows the smallest of all.
    """
    n = source.count()
    parts = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    cuts = sorted(set(source.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 and n else []
    edges = [int(x) for x in cuts]
    number = F.lit(0)
    if edges:
        # coarse steps first, then the fine ones of that step: no long scan over all edges
        step = max(1, int(len(edges) ** 0.5))
        fine = F.array(*(F.array(*(F.lit(e) for e in edges[k : k + step])) for k in range(0, len(edges), step)))
        coarse = F.array(*(F.lit(edges[k]) for k in range(0, len(edges), step)))
        at = F.size(F.filter(coarse, lambda e: e <= F.col("doc_id")))
        number = F.when(at == 0, 0).otherwise((at - 1) * step + F.size(F.filter(F.get(fine, at - 1), lambda e: e <= F.col("doc_id"))))
    most = {r["part"]: r["most"] for r in source.groupBy(F.coalesce(number, F.lit(0)).alias("part")).agg(F.max("doc_id").alias("most")).collect()}
    filled = sorted(most)
    return edges, {p: filled[(k + 1) % len(filled)] for k, p in enumerate(filled)} | {~p: most[p] for p in filled}


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint and that of its edited text.

    The edited text has its last floor(n_chars / 3) code points replaced by as many from the
    start of the next document, in descending order of id; the first follows the last. Rows:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Being exact, likeness is 1 for equal canonical forms and else 0. A null text counts as
    empty; rows without id come last in the order; rows of equal ids come in a fixed order,
    that of their compressed texts; a lone row follows itself; other columns are ignored.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    edges, follows = _ranges(source.select("doc_id"))

    def deal(batches):
        from bisect import bisect_right

        squeeze, _ = _squeezer()
        for batch in slices(batches):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = 0 if i is None else bisect_right(edges, i)
                packed = squeeze((t or "").encode())
                rows.append((part, False, i, packed))
                if follows[~part] == i:
                    rows.append((follows[part], True, i, packed))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int64(), pa.binary()))], ["part", "border", "doc_id", "packed"])

    def made(row, following):
        text, form = row[1], row[2]
        k = len(text) // 3
        edited = text[: len(text) - k] + following[1][:k]
        its = canonical(edited)
        return row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(form), long_digest(form), digest(its), long_digest(its), float(form == its), float(form == following[2])

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "long", "edited_fingerprint", "edited_long", "near_edited", "near_next"]

    def compare(batches):
        _, spread = _squeezer()
        part, last, closed = None, None, False
        for batch in slices(batches):
            out = []
            for p, border, i, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if p == part and closed:
                    continue  # a further row with the border's id
                text = spread(packed).decode()
                row = (i, text, canonical(text))
                if p == part:
                    out.append(made(last, row))
                part, last, closed = p, row, border
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    dealt = source.mapInArrow(deal, "part int, border boolean, doc_id long, packed binary")
    n = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(edges) + 1)
    ordered = dealt.repartition(n, "part").sortWithinPartitions("part", "border", F.col("doc_id").desc_nulls_last(), F.col("packed").desc())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, long string, edited_fingerprint string, edited_long string, near_edited double, near_next double"
    found = stored(ordered.mapInArrow(compare, schema), "prints")
    out = lengthened(found, stored(shared_fingerprints(source, found), "shared-prints"), ("fingerprint", "long"), ("edited_fingerprint", "edited_long"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
