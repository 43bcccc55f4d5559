"""Alignment of two tokenizers' tokens over the same bytes.

A text is cut where both tokenizers always cut; each new piece between is encoded by both and
aligned once a worker. Groups of one token each that are the identity map's pair for their
bytes are counted in vectors as long as the vocabulary, one a task. Only the last pairs of
all other groups are shuffled by pair.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import stored
from roadpulse.llm.tokens import byte_letters

#: Pieces a worker keeps for good.
KEPT = 300_000
#: Pairs that are joined by broadcast, about 24 bytes each.
BROADCAST_PAIRS = 500_000
#: Pairs held by more than this share of all documents are joined by broadcast however many others there are; fewer than links a text / share.
COMMON = 0.001

_IRREGULAR = re.compile(r"\s\s|[^\S \n]|\x00")
_AFTER_WORD = re.compile(r"(?<=[^ ])(?= \S)")


def common_units(text: str) -> list[str]:
    """Pieces of space + text that both tokenizers encode alone as they do in the whole.

    Byte-level patterns always cut before a space that a visible character follows, and around
    a lone newline; pieces of the other vocabulary have spaces at their start alone, and no
    newline beside other characters.
    """
    text = f" {text}"
    if _IRREGULAR.search(text):
        return _AFTER_WORD.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n")[1:].split("\0")


class Aligner:
    """The two tokenizers, the map of ids with the same bytes, and the pieces aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task on every core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        if any("▁" in (p := self.b.id_to_piece(i)).lstrip("▁") or "\n" in p for i in range(size)):
            raise ValueError(f"{path_b}: pieces with a space inside or a newline")
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        self.mark = self.b.piece_to_id("▁")
        whole = {x: i for i, x in enumerate(self.bytes_b) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        letters, specials = byte_letters(), self.a.get_added_tokens_decoder()
        self.bytes_a = [b"" if i in specials else bytes(letters[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        self.same = [whole.get(x, -1) if x else -1 for x in self.bytes_a]  # the identity map
        self.known: dict[str, tuple | None] = {}

    def pieces(self, units: list[str]) -> list[list[int]]:
        """Ids of the second tokenizer, which adds a space: one that units have at their start already, or before a newline is a token of its own."""
        out = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [ids[1:] if u[0] != " " else ids or [self.mark] for u, ids in zip(units, out)]

    def align(self, unit: str, ids_a: list[int], ids_b: list[int]) -> tuple | None:
        """(tokens a, tokens b, groups, their text, packed regular a ids, packed irregular pairs); None where bytes differ."""
        whole = unit.encode()
        parts_a, parts_b = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            return None
        regular, irregular, groups = [], [], []
        j = at_b = end_b = at_a = end_a = 0
        for k, part in enumerate(parts_a):
            end_a += len(part)
            while end_b < end_a:
                end_b += len(parts_b[j])
                j += 1
            if end_b > end_a:
                continue
            left, right = ids_a[at_a : k + 1], ids_b[at_b:j]
            if len(left) == len(right) == 1 and self.same[left[0]] == right[0]:
                regular.append(left[0])
            else:
                irregular.append((left[-1] << 32) | right[-1])
            groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
            at_a, at_b = k + 1, j
        return len(ids_a), len(ids_b), len(groups), ";".join(groups), np.asarray(regular, "<u4").tobytes(), np.asarray(irregular, "<u8").tobytes()

    def texts(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """The aligned pieces of each text; None for null and empty ones and where bytes differ."""
        split = [common_units(t) if t else [] for t in texts]
        new = list(set().union(*split) - self.known.keys())
        full = len(self.known) > KEPT
        if new:
            ids_a = self.a.encode_batch_fast(new, add_special_tokens=False)
            self.known.update((u, self.align(u, a.ids, b)) for u, a, b in zip(new, ids_a, self.pieces(new)))
        out = [[self.known[u] for u in units] for units in split]
        if full:  # common pieces came early
            for u in new:
                del self.known[u]
        return [x if x and None not in x else None for x in out]


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process and pair of files."""
    return Aligner(path_a, path_b)


_ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, ids array<int>, times array<long>, pairs array<long>, counts array<long>, tally boolean"


_KINDS = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in _ROWS.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(x, _KINDS[t]) for x, t in zip(zip(*rows), kinds)], names)


def _counted(found: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(np.frombuffer(b"".join(found), kind), return_counts=True)
    return values.astype(np.int64 if kind == "<u8" else np.int32), counts


def _aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str, digest: bool) -> DataFrame:
    """A row per document (its regular ids, distinct irregular pairs and their counts) and a row per task (tally): its regular ids and counts."""

    def align(batches):
        both = aligner(path_a, path_b)
        total = np.zeros(len(both.same), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                row, doc, texts = (batch.column(k).slice(at, 128).to_pylist() for k in range(3))
                rows, all_ids = [], [b""]
                for k, units in enumerate(both.texts(texts)):
                    if units is None:
                        rows.append((row[k], doc[k], 0, 0, 0, "", [], [], [], [], False))
                        continue
                    n_a, n_b, n, groups, ids, pairs = zip(*units)
                    groups = ";".join(groups)
                    all_ids += ids
                    shown = hashlib.sha256(groups.encode()).hexdigest() if digest else groups
                    rows.append((row[k], doc[k], sum(n_a), sum(n_b), sum(n), shown, *_counted(ids, "<u4"), *_counted(pairs, "<u8"), False))
                total += np.bincount(np.frombuffer(b"".join(all_ids), "<u4"), minlength=len(total))
                yield _table(rows)
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 10_000):
            part = seen[at : at + 10_000]
            yield _table([(None, None, 0, 0, 0, "", part, total[part], [], [], True)])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(align, _ROWS)


def alignments(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's groups: doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``; empty without tokens)."""
    return _aligned(docs, path_a, path_b, doc_id, text, False).where("not tally").select("doc_id", "n_a", "n_b", "n_groups", "groups")


def link_counts(aligned: DataFrame, same: list[int]) -> tuple[np.ndarray, DataFrame]:
    """Links of each regular id of the first tokenizer (a vector as long as its vocabulary), and a table pair, n of all other pairs."""
    tallies = aligned.where("tally").select(F.explode(F.arrays_zip("ids", "times")).alias("x")).groupBy("x.ids").agg(F.sum("x.times").alias("n"))
    vector = np.zeros(len(same), np.int64)
    table = tallies.toArrow()  # at most the vocabulary
    vector[table["ids"].to_numpy()] = table["n"].to_numpy()
    links = aligned.where("not tally").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    return vector, stored(links.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"), F.count(F.lit(1)).alias("texts")), "pairs")


def _best(vector: np.ndarray, same: list[int], pairs: DataFrame, size: int) -> np.ndarray:
    """The highest count of each id of the second tokenizer."""
    best = np.zeros(size, np.int64)
    table = pairs.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("n")).toArrow()  # at most the vocabulary
    best[table["b"].to_numpy()] = table["n"].to_numpy()
    paired = np.array(same)
    np.maximum.at(best, paired[paired >= 0], vector[paired >= 0])
    return best


def _regular(docs: DataFrame, vector: np.ndarray, top: np.ndarray) -> DataFrame:
    """The documents with links, best links and summed counts of their regular groups."""

    def add(batches):
        for batch in batches:
            lists, times = batch.column(6), batch.column(7).flatten().to_numpy(zero_copy_only=False)
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            summed = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x * times)])[ends]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], summed(top[ids]), summed(vector[ids])], [*names, "best", "total"])

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups"]
    return docs.select(*names, "ids", "times").mapInArrow(add, "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, best long, total long")


def _priced(links: DataFrame, pairs: DataFrame, texts: int) -> DataFrame:
    """``links`` (row, pair, count) with n, top of their pair."""
    if pairs.count() <= BROADCAST_PAIRS:
        return links.join(F.broadcast(pairs.select("pair", "n", "top")), "pair")
    usual = F.col("texts") > COMMON * texts
    common, rest = F.broadcast(pairs.where(usual).select("pair", "n", "top")), pairs.where(~usual).select("pair", "n", "top")
    return links.join(common, "pair").unionByName(links.join(common, "pair", "left_anti").join(rest, "pair"))


def cross_tokenizer(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's tokens by two tokenizers, groups, links and the links' corpus-wide counts.

    ``path_a`` is a byte-level BPE file of tokenizers, ``path_b`` a sentencepiece model with byte
    fallback that adds a space before the text; the first encodes space + text. Columns: doc_id,
    n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Null and empty texts, and those
    whose tokens' bytes aren't those of space + text (a U+2581 is one), have zeros and an empty
    digest. A link is the last pair of a group. Of equal counts all are the best. Repeated rows
    count and return each; a null id stays null; other columns are ignored.
    """
    aligned = stored(_aligned(docs, path_a, path_b, doc_id, text, True), "aligned")
    both = aligner(path_a, path_b)
    vector, pairs = link_counts(aligned, both.same)
    best = _best(vector, both.same, pairs, len(both.bytes_b))
    same = np.array(both.same)
    top = np.where(same >= 0, vector == best[same], False)
    highest = docs.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(best) if n], "b int, most long")  # at most the vocabulary
    pairs = pairs.join(F.broadcast(highest), F.col("pair").bitwiseAND(0xFFFFFFFF) == F.col("b")).withColumn("top", (F.col("n") == F.col("most")).cast("long"))
    rows = aligned.where("not tally")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("count"))
    per = _priced(links, pairs, rows.count()).groupBy("row").agg(F.sum(F.col("count") * F.col("top")).alias("more_best"), F.sum(F.col("count") * F.col("n")).alias("more"))
    out = _regular(rows, vector, top).join(per, "row", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), (F.col("best") + n("more_best")).alias("n_best"), (F.col("total") + n("more")).alias("count_sum"), F.col("groups").alias("groups_sha256")
    )
