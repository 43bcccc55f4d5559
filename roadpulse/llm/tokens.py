"""Encoding and decoding with public tokenizer files, whole texts, exactly as the library does.

A text is cut only where the tokenizer's own pattern always cuts: the byte-level one before a
space that a visible character follows and around a lone newline, the word one at ASCII
white space. What lies between is a unit; a worker encodes each new unit once and keeps it in
a bounded table. Of byte-level units over LONG characters the pieces that no pattern splits
are encoded by tree concatenation: leaves together, in threads where there are many, then
neighbours joined level by level with windows that grow until both sides agree.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units longer than this many characters go through tree concatenation, in leaves of LEAF.
LONG, LEAF = 16, 8
#: Leaves that one call encodes; several calls run in threads.
CHUNK, THREADS = 4096, 4
#: Units a worker keeps for good.
KEPT = 600_000

#: A character between units that are encoded together; units that hold it are encoded alone.
SIGN = "\u27c2"

_LATIN = re.compile("[!-~\xa1-\xac\xae-\xff]+")
#: Lower-case letters of Latin-1.
_LETTERS = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+")
#: Such letters and signs of ASCII after them, none an apostrophe.
_LETTERS_SIGNS = re.compile("([a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]+)")
_IRREGULAR = re.compile(r"\s\s|[^\S \n]|\x00")
_BEFORE_SPACE = re.compile(r"(?= \S)")


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def byte_units(text: str) -> list[str]:
    """Pieces that the byte-level tokenizer encodes alone as it does in ``text``."""
    if _IRREGULAR.search(text):
        return [x for x in _BEFORE_SPACE.split(text) if x]
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def word_units(text: str) -> list[str]:
    """Pieces between white space, which the word tokenizer drops."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for split(), not for the tokenizer
        return text.split(" ")
    return text.split()


class Codec:
    """A tokenizer of one file with its table of encoded units."""

    def __init__(self, path: str, units):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task on every core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.units = units
        self.bare, self.blanks = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)  # the model is shared
        self.bare.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.blanks.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)  # tokens that end a word
        self.last[[k for x, k in vocab.items() if x.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.odd: dict[str, str] = {}  # units that decode to something else
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _encode_words(self, units: list[str]) -> dict[str, bytes]:
        """Packed ids of many units.

        Latin-1 units are their own NFC form, so lower case is all that the normaliser does to
        them. Those of letters alone are one piece by the pattern and end with a token that ends a
        word, so they are encoded in long texts that are cut at blanks alone; letters and signs
        after them are two pieces; the others are encoded in texts with a sign that no unit has between them.
        """
        low = {u: u.lower() for u in units if _LATIN.fullmatch(u)}
        together = "\n".join(low.values())
        if any(x in together for x in self.specials):
            low = {u: x for u, x in low.items() if not any(s in x for s in self.specials)}
        out: dict[str, bytes] = {}
        if len(low) < len(units):
            rest = [u for u in units if u not in low]
            out.update(zip(rest, map(_packed, self._encode(rest))))
        plain = set(low.values())
        letters = set(filter(_LETTERS.fullmatch, plain))
        ends = {u: m.groups() for u in plain - letters if (m := _LETTERS_SIGNS.fullmatch(u))}
        letters = list(letters.union(x for x, _ in ends.values()))
        known: dict[str, bytes] = {}
        parts = [letters[k : k + 2000] for k in range(0, len(letters), 2000)]
        for part, e in zip(parts, self.blanks.encode_batch_fast(list(map(" ".join, parts)), add_special_tokens=False)):
            ids = np.asarray(e.ids, "<u4")
            hit = np.flatnonzero(self.last[ids]) + 1
            if len(hit) == len(part):  # else some letter isn't in the vocabulary
                packed, at = ids.tobytes(), 0
                for u, end in zip(part, (hit * 4).tolist()):
                    known[u] = packed[at:end]
                    at = end
        signed = list({x for u in plain if u not in known for x in ends.get(u, (u,)) if x not in known})
        sign = self.bare.encode(SIGN, add_special_tokens=False).ids
        parts = [signed[k : k + 2000] for k in range(0, len(signed), 2000)]
        for part, e in zip(parts, self.bare.encode_batch_fast([f" {SIGN} ".join([*x, ""]) for x in parts], add_special_tokens=False)):
            ids = np.asarray(e.ids, "<u4")
            hit = np.flatnonzero(np.logical_and.reduce([ids[k : len(ids) - len(sign) + 1 + k] == x for k, x in enumerate(sign)]))
            packed, at = ids.tobytes(), 0
            for u, end in zip(part, (hit * 4).tolist()):
                known[u] = packed[at:end]
                at = end + 4 * len(sign)
        known.update((u, known[a] + known[b]) for u, (a, b) in ends.items())
        out.update((u, known[x]) for u, x in low.items())
        return out

    def word_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` in a row, and where each text's begin and the last one's end, by the word tokenizer.

        Arrow cuts at ASCII white space, which that tokenizer drops, and numbers the units, so only different units are looked up.
        """
        cut = pc.ascii_split_whitespace(texts.fill_null(""))
        numbered = pc.dictionary_encode(cut.flatten())
        units, at = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        new = [u for u in units if u not in self.known]
        full = len(self.known) > KEPT
        if new:
            self.learn(new, False)
        found = list(map(self.known.__getitem__, units))
        if full:
            for u in new:
                del self.known[u]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = sizes[at]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], each)
        place += np.arange(len(place))
        offsets = cut.offsets.to_numpy().astype(np.int64)
        return np.frombuffer(b"".join(found), "<u4")[place], ends[offsets - offsets[0]]

    def learn(self, new: list[str], decoding: bool) -> None:
        if self.units is word_units:
            self.known.update(self._encode_words(new))
            return
        short = [u for u in new if len(u) <= LONG]
        found = dict(zip(short, self._encode(short)))
        if len(short) < len(new):
            found.update((u, self.long(u)) for u in new if u not in found)
        if decoding:
            back = self.tokenizer.decode_batch([found[u] for u in new], skip_special_tokens=False)
            self.odd.update((u, b) for u, b in zip(new, back) if u != b)
        self.known.update((u, _packed(i)) for u, i in found.items())

    def ids(self, texts: list[str], decoding: bool = False) -> list[tuple[bytes, str]]:
        """(little-endian ids, decoded text) of each text; the text itself without ``decoding``."""
        split = [self.units(t) for t in texts]
        new = list(set().union(*split) - self.known.keys())
        full = len(self.known) > KEPT
        if new:
            self.learn(new, decoding)
        out = [(b"".join(map(self.known.__getitem__, units)), t) for units, t in zip(split, texts)]
        if decoding and self.odd:
            out = [(ids, "".join(self.odd.get(u, u) for u in units)) for units, (ids, _) in zip(split, out)]
        if full:  # common units came early; what a full table lacks is rare
            for u in new:
                del self.known[u]
                self.odd.pop(u, None)
        return out

    def long(self, unit: str) -> list[int]:
        """Ids of a long unit: its pattern's pieces, the long ones by tree concatenation."""
        if any(s in unit for s in self.specials):
            return self._encode([unit])[0]
        out: list[int] = []
        for piece in _pattern().findall(unit):
            out += self.tree(piece) if len(piece) > LEAF else self._encode([piece])[0]
        return out

    def tree(self, piece: str, leaf: int = LEAF) -> list[int]:
        """Encodes leaves of one unsplit piece together, then joins neighbours level by level."""
        parts = [piece[i : i + leaf] for i in range(0, len(piece), leaf)]
        chunks = [parts[i : i + CHUNK] for i in range(0, len(parts), CHUNK)]
        if len(chunks) > 1:  # the library lets go of the interpreter while it encodes
            with ThreadPoolExecutor(THREADS) as pool:
                level = [ids for found in pool.map(self._encode, chunks) for ids in found]
        else:
            level = self._encode(parts)
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def join(self, left: list[int], right: list[int], width: int = 8) -> list[int]:
        """The encoding of two encoded neighbours' text.

        A window of tokens around the join is encoded again and grown until its first token is
        the left side's there and its last token the right side's. Every two neighbours in
        the result then stand next to each other in some encoding by the same merges, which
        makes the whole the encoding of the text.
        """
        while True:
            a, b = self._whole(left, len(left) - width, -1), self._whole(right, width, 1)
            text = b"".join(map(self.bytes_of, left[a:] + right[:b])).decode()
            mid = self._encode([text])[0]
            if (a == 0 or mid[0] == left[a]) and (b == len(right) or mid[-1] == right[b - 1]):
                return left[:a] + mid + right[b:]
            width *= 2

    def _whole(self, ids: list[int], at: int, step: int) -> int:
        """The nearest place from ``at`` on where a character begins."""
        at = max(0, min(at, len(ids)))
        while 0 < at < len(ids) and self.bytes_of(ids[at])[0] & 0xC0 == 0x80:
            at += step
        return at

    def bytes_of(self, token: int) -> bytes:
        return bytes(byte_letters()[c] for c in self.tokenizer.id_to_token(token))


@lru_cache(1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself where it prints, else the next from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(4)
def codec(path: str, kind: str) -> Codec:
    """One per worker process and file."""
    return Codec(path, byte_units if kind == "byte" else word_units)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches, rows: int = 256):
    """Batches cut into small ones, so that what is made of one stays small too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized(batches, column: int, most: int = 4 << 20):
    """Batches cut into runs of rows whose strings of a column have ``most`` bytes together, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def byte_bpe(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text with a byte-level tokenizer file.

    One row per row of ``docs``: doc_id, ids (binary, little-endian unsigned 32 bits) and
    decoded. A null text counts as empty and gives no ids; a null id stays null; repeated
    rows give repeated rows; other columns are ignored.
    """
    return _encoded(docs, path, doc_id, text, "doc_id long, ids binary, decoded string", lambda i, t: (i, t))


def byte_bpe_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``byte_bpe``, with the number and SHA-256 of the ids and the decoded text's SHA-256."""
    digest = lambda ids, t: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    return _encoded(docs, path, doc_id, text, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _encoded(docs: DataFrame, path: str, doc_id: str, text: str, schema: str, of) -> DataFrame:
    def encode(batches):
        c = codec(path, "byte")
        names = [x.split()[0] for x in schema.split(", ")]
        types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        kinds = [types[x.split()[1]] for x in schema.split(", ")]
        for batch in slices(batches):
            made = [of(*x) for x in c.ids([t or "" for t in _column(batch, "text")], decoding=True)]
            columns = [batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*made), kinds[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, schema)


def token_pieces(docs: DataFrame, path: str, doc_id: str, text: str, size: int, end_id: int, extra: list[str]) -> DataFrame:
    """Each text's word-tokenizer ids and an end id, cut into pieces of ``size`` ids.

    Rows: ``extra`` columns of ``docs`` as they are, doc_id, piece, start, length, ids_crc32.
    """
    kept = [doc_id, *extra]
    source = docs.select(*(F.col(c) for c in kept), F.col(text).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    end = _packed([end_id])

    def cut(batches):
        c = codec(path, "word")
        for batch in sized(batches, len(kept)):
            rows, made = [], []
            flat, starts = c.word_ids(batch.column(batch.num_columns - 1))
            for k, (low, high) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                ids = flat[low:high].tobytes() + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append(k)
                    made.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                columns = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(batch.num_columns - 1)]
                columns += [pa.array(x, t) for x, t in zip(zip(*made), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(cut, f"{kinds}, piece int, start long, length long, ids_crc32 long")
