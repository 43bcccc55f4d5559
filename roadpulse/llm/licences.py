"""Licence notices by a positional index of rare words, in DataFrame functions only.

Templates are licence notices, short and full ones. The index lists the places of the licence words of their
key phrases that are rarest in the corpus, two of each template. All of these are looked up in a
text; a template is a candidate at a place where its two agree on its position (a key phrase
with one licence word: where that stands), so none whose key phrase stands is passed over. There the template is compared word by
word, and its mandatory key phrase has to stand complete.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import stored

#: Phrases and labels of the base scan (fixed by the query's contract).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Template:
    """A notice; the words between brackets are its key phrases."""

    label: str
    notice: str

    @property
    def words(self) -> list[str]:
        return re.findall(r"[a-z0-9]+", self.notice)

    @property
    def key(self) -> list[int]:
        """The places of the words of the key phrases."""
        out, at = [], 0
        for k, part in enumerate(re.split(r"[\[\]]", self.notice)):
            n = len(re.findall(r"[a-z0-9]+", part))
            out += range(at, at + n) if k % 2 else ()
            at += n
        return out


TEMPLATES = (
    Template("apache-2.0", "licensed under the [apache license version 2 0]"),
    Template("gpl-2.0", "licensed under the [gnu general public license version 2]"),
    Template("gpl-3.0", "licensed under the [gnu general public license version 3]"),
    Template("lgpl", "under the terms of the [gnu lesser general public license]"),
    Template("mit", "released under the [mit license]"),
    Template("mit", "[permission is hereby granted free of charge to any person] obtaining a copy of this software"),
    Template("bsd-3-clause", "[redistribution and use in source and binary forms with or without modification are permitted]"),
    Template("mpl-2.0", "subject to the terms of the [mozilla public license v 2 0]"),
    Template("cc-by-4.0", "licensed under [cc by 4 0]"),
    Template("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    Template("cc-by-sa-4.0", "licensed under [cc by sa 4 0]"),
    Template("cc-by", "licensed under a [creative commons attribution] license"),
    Template("agpl", "under the terms of the [gnu affero general public license]"),
    Template("boost-1.0", "distributed under the [boost software license version 1 0]"),
    Template("unlicense", "[this is free and unencumbered software released into the public domain]"),
    Template("isc", "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted] provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache-2.0", """licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    Template("mit", """[permission is hereby granted free of charge to any person] obtaining a copy of this software and associated documentation files the software to deal in the software without
        restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a
        particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability"""),
    Template("bsd-3-clause", """[redistribution and use in source and binary forms with or without modification are permitted] provided that the following conditions are met redistributions of source code
        must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of
        conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""),
    Template("gpl-2.0", """this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation
        either [version 2] of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty"""),
    Template("gpl-3.0", """this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation
        either [version 3] of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty"""),
    Template("mpl-2.0", """this source code form is subject to the terms of the [mozilla public license v 2 0] if a copy of the mpl was not distributed with this file you can obtain one at http mozilla
        org mpl 2 0"""),
)
#: Words that say little of a licence, wherever they stand.
COMMON = frozenset("a and any are by for in into is of or the this to with without 0 1 2 3 4 v".split())
#: Words of the key phrases that the index lists.
LICENCE_WORDS = tuple(sorted({t.words[k] for t in TEMPLATES for k in t.key} - COMMON))
#: Rarest licence words of a template's key phrase that are looked up; least share of a template's words in place.
LOOKED_UP, LEAST_SCORE = 2, 0.6
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_SHIFT = 1 << 32


def _array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _places(docs: DataFrame) -> DataFrame:
    """Per document its number of words, its licence words with their places, and, where it has any, all its words."""
    w = docs.withColumn("w", F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(f"({_WORD})"), 1)).drop("text")
    marked = F.transform("w", lambda x, i: F.when(x.isin(*LICENCE_WORDS), F.struct(x.alias("w"), i.alias("i"))))
    w = w.withColumn("hits", F.filter(marked, lambda x: x.isNotNull()))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), "hits", F.when(F.size("hits") > 0, F.col("w")).alias("w"))


def _base(hits: Column, w: Column) -> Column:
    """(label, place) of each place where a phrase stands."""
    return F.concat(*(_phrase(hits, w, phrase.split(), label) for phrase, label in PHRASES))


def _phrase(hits: Column, w: Column, phrase: list[str], label: str) -> Column:
    def stands(h: Column) -> Column:
        good = h["w"] == phrase[0]
        for k, x in enumerate(phrase[1:], 1):
            good = good & (F.coalesce(F.get(w, h["i"] + k), F.lit("")) == x)
        return good

    return F.transform(F.filter(hits, stands), lambda h: F.struct(F.lit(label).alias("label"), h["i"].alias("i")))


def rarity(places: DataFrame) -> list[str]:
    """The licence words, rarest first, by the number of documents that have them."""
    seen = places.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["w"]: r["n"] for r in seen}
    return sorted(LICENCE_WORDS, key=lambda x: (n.get(x, 0), x))


def _postings(order: list[str]) -> dict[str, list[tuple[int, int]]]:
    """(template, place) of each word that is looked up."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, x in enumerate(TEMPLATES):
        key = {p: x.words[p] for p in x.key if x.words[p] in LICENCE_WORDS}
        rarest = sorted(set(key.values()), key=order.index)[:LOOKED_UP]
        for p, word in key.items():
            if word in rarest:
                out.setdefault(word, []).append((t, p))
    return out


def _aligned(hits: Column, order: list[str]) -> Column:
    """template * 2**32 + start of each candidate, as often as looked-up words agree on it, sorted."""
    found = _postings(order)
    words = _array(found)
    postings = F.array(*(F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.lit(p).alias("p")) for t, p in places)) for places in found.values()))
    looked = F.filter(F.transform(hits, lambda h: F.struct(F.array_position(words, h["w"]).cast("int").alias("r"), h["i"].alias("i"))), lambda x: x["r"] > 0)
    starts = F.flatten(F.transform(looked, lambda x: F.transform(F.get(postings, x["r"] - 1), lambda y: y["t"] * _SHIFT + (x["i"] - y["p"]).cast("long") + 4096)))
    return F.sort_array(starts)


def _agreed(starts: Column) -> Column:
    alone = [t for t, x in enumerate(TEMPLATES) if len({x.words[p] for p in x.key} & set(LICENCE_WORDS)) < LOOKED_UP]
    return F.array_distinct(F.filter(starts, lambda x, i: F.coalesce(F.get(starts, i + 1) == x, F.lit(False)) | (x / _SHIFT).cast("int").isin(alone)))


def _verified(agreed: Column, w: Column) -> Column:
    """(template, score) of each candidate whose key phrase stands and whose words are mostly there."""
    texts, keys = F.array(*(_array(t.words) for t in TEMPLATES)), F.array(*(_array(t.key) for t in TEMPLATES))

    def judged(x):
        t, start = (x / _SHIFT).cast("int"), (x % _SHIFT - 4096).cast("int")
        text = F.get(texts, t)
        same = lambda k: F.coalesce(F.when(start + k >= 0, F.get(w, start + k)), F.lit("")) == F.get(text, k)
        n = F.size(F.filter(F.sequence(F.lit(0), F.size(text) - 1), same))
        return F.struct(t.alias("t"), F.when(F.forall(F.get(keys, t), same), n / F.size(text)).otherwise(0.0).alias("score"))

    return F.filter(F.transform(agreed, judged), lambda x: x["score"] >= LEAST_SCORE)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words and no labels; repeated rows are scanned one by one;
    other columns are ignored.
    """
    places = stored(_places(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "licence-words")
    out = places.withColumn("base", _base(F.col("hits"), F.col("w"))).withColumn("starts", _aligned(F.col("hits"), rarity(places)))
    out = out.withColumn("agreed", _agreed(F.col("starts")))
    out = out.withColumn("found", F.when(F.size("agreed") > 0, _verified(F.col("agreed"), F.col("w"))).otherwise(F.array()))
    base, named = F.col("base.label"), F.transform("found", lambda x: F.get(_array([t.label for t in TEMPLATES]), x["t"]))
    return out.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.i").cast("long").alias("first_word"),
        F.array_max("base.i").cast("long").alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, named)).alias("labels"),
        F.coalesce(F.array_max("found.score"), F.lit(0.0)).alias("score"),
    )
