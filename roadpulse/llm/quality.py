"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the
counts of vote patterns estimates how each rule votes on good and on bad documents; a
document's verdict is its posterior probability of being good. The pattern table that the
driver sees has at most 3 ** len(RULES) rows, whatever the corpus holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import free_name, stored, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Characters that prose hardly uses (fixed by the query's contract).
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Votes bad at ``bad`` or beyond, good up to ``good``, and abstains between them."""

    name: str
    feature: str
    good: float
    bad: float

    def vote(self, features: Column) -> Column:
        x = features[self.feature]
        return F.when(x >= self.bad, -1).when(x <= self.good, 1).otherwise(0)


RULES = (
    Rule("symbols_per_word", "symbols_per_word", 0.05, 0.2),
    Rule("symbols_per_char", "symbols_per_char", 0.01, 0.05),
    Rule("word_length", "length_off", 2.0, 2.5),
    Rule("repeated_words", "repeat_share", 0.30, 0.45),
    Rule("repeated_lines", "dup_line_share", 0.40, 0.60),
)


#: Low bits of a packed window that hold its place; longer texts take the unpacked way.
PLACE_BITS = 20


def window_hash(w: Column, i: Column) -> Column:
    return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def packed_windows(w: Column) -> Column:
    """44 bits of each 3-word window's hash with its place below them, sorted as plain longs.

    Null for texts of under 4 words or of more words than PLACE_BITS can number.
    """
    n = F.size(w)
    each = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(window_hash(w, i), PLACE_BITS).bitwiseOR(i.cast("long")))
    return F.when((n >= 4) & (n < 1 << PLACE_BITS), F.sort_array(each))


def likely_places(w: Column, packed: Column) -> Column:
    """Places of windows that may be repeated: all that are, and seldom others."""
    top = lambda x: F.shiftright(x, PLACE_BITS)
    near = F.filter(packed, lambda x, i: F.coalesce(top(F.get(packed, i + 1)) == top(x), F.lit(False)) | F.coalesce(top(F.get(packed, i - 1)) == top(x), F.lit(False)))
    place = F.transform(near, lambda x: x.bitwiseAND((1 << PLACE_BITS) - 1).cast("int"))
    return F.when(packed.isNotNull(), place).when(F.size(w) >= 4, F.sequence(F.lit(0), F.size(w) - 3))


def window_hashes(w: Column, places: Column) -> Column:
    """(hash, place) of the 3-word windows at ``places``, equal windows side by side."""
    return F.array_sort(F.transform(places, lambda i: F.struct(window_hash(w, i).alias("h"), i.alias("p"))))


def repeated_places(ordered: Column) -> Column:
    """The places of windows whose hash a neighbour in ``ordered`` shares, in text order."""
    size = F.size(ordered)
    after = F.concat(F.slice(ordered, 2, size), F.slice(ordered, 1, 1))
    before = F.concat(F.slice(ordered, size, 1), F.slice(ordered, 1, size - 1))
    same_next = F.zip_with(ordered, after, lambda x, y: x["h"] == y["h"])
    same_last = F.zip_with(ordered, before, lambda x, y: F.when(x["h"] == y["h"], x["p"]))
    places = F.zip_with(F.zip_with(same_next, ordered, lambda e, x: F.when(e, x["p"])), same_last, lambda a, b: F.coalesce(a, b))
    return F.array_sort(F.filter(places, lambda p: p.isNotNull()))


def covered(places: Column) -> Column:
    """Words in the 3-word windows that start at the sorted ``places``."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))
    return F.aggregate(
        places,
        start,
        lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(3), p + 3 - acc["end"])).alias("sum"), (p + 3).alias("end")),
        lambda acc: acc["sum"],
    )


def add_features(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the struct column ``name`` of counts and shares; a null text counts as none."""
    body = F.coalesce(F.col(text), F.lit(""))
    w, counts, ordered = (free_name(df, f"{name}_{x}") for x in ("words", "counts", "windows"))
    packed, likely = free_name(df, f"{name}_packed"), free_name(df, f"{name}_likely")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    # a column of its own for each array that is read more than once: built once a row
    out = df.withColumn(w, words(F.col(text)))
    out = out.withColumn(packed, packed_windows(F.col(w)))
    out = out.withColumn(likely, likely_places(F.col(w), F.col(packed)))
    out = out.withColumn(ordered, F.when(F.size(likely) > 0, window_hashes(F.col(w), F.col(likely))))
    out = out.withColumn(
        counts,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered(repeated_places(F.col(ordered))), F.lit(0)).alias("n_repeat_words"),
        ),
    )
    c = F.col(counts)
    n, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
    return out.withColumn(
        name,
        F.struct(
            *(c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            ((c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])).alias("base_failed"),
            (c["n_symbols"] / n).alias("symbols_per_word"),
            (c["n_symbols"] / chars).alias("symbols_per_char"),
            F.abs(c["word_chars"] / n - 5.0).alias("length_off"),
            (c["n_repeat_words"] / n).alias("repeat_share"),
            (c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1))).alias("dup_line_share"),
        ),
    ).drop(w, counts, ordered, packed, likely)


def votes(features: Column, rules=RULES) -> Column:
    return F.array(*(r.vote(features).cast("int") for r in rules))


@dataclass(frozen=True)
class LabelModel:
    """Prior log-odds of good, and each rule's log-likelihood ratio for its votes -1, 0 and 1."""

    prior: float
    weights: tuple[tuple[float, float, float], ...]

    def posterior(self, vote: Column) -> Column:
        odds = F.lit(self.prior)
        for k, (bad, none, good) in enumerate(self.weights):
            odds = odds + F.when(vote[k] == 1, good).when(vote[k] == -1, bad).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over (votes, count) pairs; starts from the majority vote.

    An empty corpus gives even odds. Counts are smoothed so that no rule is ever certain.
    """
    total = sum(c for _, c in patterns)
    if not total:
        return LabelModel(0.0, ((0.0, 0.0, 0.0),) * n_rules)
    good = [0.9 if sum(v) > 0 and min(v) >= 0 else 0.5 if sum(v) > 0 else 0.1 for v, _ in patterns]
    model = LabelModel(0.0, ())
    for _ in range(rounds):
        mass = sum(g * c for g, (_, c) in zip(good, patterns))
        weights = []
        for k in range(n_rules):
            row = []
            for x in (-1, 0, 1):
                yes = sum(g * c for g, (v, c) in zip(good, patterns) if v[k] == x)
                no = sum((1 - g) * c for g, (v, c) in zip(good, patterns) if v[k] == x)
                row.append(math.log((yes + 1) / (mass + 3)) - math.log((no + 1) / (total - mass + 3)))
            weights.append(tuple(row))
        if sum(w[2] - w[0] for w in weights) < 0:  # the classes have changed places
            weights = [tuple(-x for x in w) for w in weights]
            mass = total - mass
        model = LabelModel(math.log((mass + 1) / (total - mass + 1)), tuple(weights))
        good = [1 / (1 + math.exp(-(model.prior + sum(w[x + 1] for w, x in zip(model.weights, v))))) for v, _ in patterns]
    return model


def learn(scored: DataFrame, features: str, rules=RULES) -> LabelModel:
    """The label model of all rows of ``scored`` that the base limits leave standing."""
    vote = votes(F.col(features), rules)
    failed = F.col(features)["base_failed"]  # a group, not a filter: that would count the words once more
    rows = scored.groupBy(vote.alias("v"), failed.alias("failed")).agg(F.count(F.lit(1)).alias("c")).collect()
    return fit(sorted((tuple(r["v"]), r["c"]) for r in rows if not r["failed"]), len(rules))


def judge(scored: DataFrame, features: str, model: LabelModel, name: str, rules=RULES, least: float = 0.5) -> DataFrame:
    """Adds the struct ``name`` (base_failed, posterior, kept)."""
    f, p = F.col(features), model.posterior(votes(F.col(features), rules))
    return scored.withColumn(name, F.struct(f["base_failed"].alias("base_failed"), p.alias("posterior"), (~f["base_failed"] & (p >= least)).alias("kept")))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``posterior`` and ``kept``.

    Null texts have no words and fail the base limits; repeated rows are judged one by one;
    other columns of ``docs`` are ignored, so they may have any name. Features are written
    once to the shared folder, as both the model and the verdicts read them.
    """
    scored = add_features(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "f").drop("text")
    scored = stored(scored, "quality")
    out = judge(scored, "f", learn(scored, "f"), "q")
    kept = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *(F.col("f")[c].alias(c) for c in kept), "q.base_failed", "q.kept", "q.posterior")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they had.

    Rows and features are written once to the shared folder, as both the model and the verdicts
    read them.
    """
    f, q = free_name(docs, "quality_f"), free_name(docs, "quality_q")
    scored = stored(add_features(docs, text, f), "scored")
    return judge(scored, f, learn(scored, f), q).where(F.col(q)["kept"]).select(*docs.columns)
