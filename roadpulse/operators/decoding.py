"""Viterbi's algorithm over many trips at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of candidates that are decoded together.
ROWS = 100_000
#: What is kept of a trip's candidates between two blocks, and what a decoded fix gives.
PLACE = ["TRIP_ID", "id", "timedate", "u", "v"]


class Decoder:
    """Decodes candidates that come sorted by trip, time, id, u and v, in blocks.

    A block's trips go forward together: the step to the k-th fix is one pass over the candidates of all of them. A trip
    that a block doesn't end stays open with the candidates that a path can still use; once all
    those of its last fix have one candidate in common, that and what lies before it is final and leaves. So
    a trip of any length takes the memory of a block and of its undecided fixes, and the result is the exact one.

    Candidates have TRIP_ID, id, timedate, u, v, p (log of the emission) and lists from_u, from_v and step: candidates of the
    fix before that a step leads from, and its log. A step that no list has costs ``no_route`` from the best candidate before.
    Of equal ways the candidate that comes first counts.
    """

    def __init__(self, no_route: float):
        self.no_route = no_route
        self.open: pa.Table | None = None  # undecided candidates of the open trip, its last fix's at the end
        self.back = np.empty(0, np.int64)  # the candidate before, by its place in ``open``
        self.score = np.empty(0)

    def decode(self, new: pa.Table, ended: bool) -> pa.Table:
        """The fixes that ``new``, rows of whole fixes, makes final. ``ended``: the last trip of ``new`` ends with it."""
        had = self.open if self.open is not None else new.select(PLACE).slice(0, 0)
        rows, m = pa.concat_tables([had, new.select(PLACE)]).combine_chunks(), len(had)
        if not len(rows):
            return rows
        trip, ids, u, v = (rows[c].combine_chunks() for c in ("TRIP_ID", "id", "u", "v"))
        trip = trip.dictionary_encode().indices.to_numpy()
        ids, u, v = (x.to_numpy(zero_copy_only=False) for x in (ids, u, v))
        new_trip = np.r_[True, trip[1:] != trip[:-1]]
        starts = np.flatnonzero(new_trip | np.r_[True, ids[1:] != ids[:-1]])
        fix = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
        first = new_trip[starts]  # fixes with which a trip, or what is left of it, begins
        back = np.r_[self.back, np.full(len(rows) - m, -1)]
        score = np.r_[self.score, new["p"].to_numpy()]
        self._forward(new, m, starts, fix, first, u, v, back, score)
        lasts = np.flatnonzero(np.r_[first[1:], True])
        stops = np.r_[starts[1:], len(rows)]
        done = lasts if ended else lasts[:-1]
        final = np.zeros(len(rows), bool)
        self._trace(np.array([a + score[a:b].argmax() for a, b in zip(starts[done], stops[done])], np.int64), back, final)
        self.open, self.back, self.score = None, self.back[:0], self.score[:0]
        if not ended:
            self._keep(rows, starts[-1], back, score, final)
        return rows.filter(pa.array(final))

    def _forward(self, new, m, starts, fix, first, u, v, back, score) -> None:
        """Scores and candidates before, for rows from ``m`` on."""
        lists = new["step"].combine_chunks()
        of = pc.list_parent_indices(lists).to_numpy() + m
        step, from_u, from_v = (new[c].combine_chunks().flatten().to_numpy() for c in ("step", "from_u", "from_v"))
        known_u, at_u = np.unique(np.r_[u, from_u], return_inverse=True)
        known_v, at_v = np.unique(np.r_[v, from_v], return_inverse=True)
        edge = at_u * len(known_v) + at_v
        size = len(known_u) * len(known_v)
        keys = fix * size + edge[: len(u)]
        source = np.searchsorted(keys, (fix[of] - 1) * size + edge[len(u) :], side="right") - 1
        old = fix[m - 1] + 1 if m else 0  # fixes that were scored before
        begun = np.maximum.accumulate(np.where(first, np.arange(len(starts)), 0))
        turn = np.arange(len(starts)) - np.maximum(begun, old - 1)
        turn[:old] = 0
        # fixes by their turn, and the rows and steps of each turn one after the other
        by_turn = np.argsort(turn, kind="stable")
        ends = np.r_[starts[1:], len(u)]
        bounds = np.searchsorted(turn[by_turn], np.arange(turn.max() + 2))
        step_from, step_to = np.searchsorted(of, starts), np.searchsorted(of, ends)
        for k in range(1, len(bounds) - 1):
            now = by_turn[bounds[k] : bounds[k + 1]]
            here, owner = _ranges(starts[now], ends[now])
            there, whose = _ranges(starts[now - 1], ends[now - 1])
            best = np.maximum.reduceat(score[there], np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]]))
            leader = _least(there, whose, score[there] == best[whose], len(now))
            top, frm = best[owner] + self.no_route, leader[owner]
            way, _ = _ranges(step_from[now], step_to[now])
            if len(way):
                place = np.searchsorted(here, of[way])
                if len(now) > 1:  # rows of several fixes aren't in order of their numbers when trips differ in length
                    order = np.argsort(here, kind="stable")
                    place = order[np.searchsorted(here[order], of[way])]
                total = score[source[way]] + step[way]
                reach = top.copy()
                np.maximum.at(reach, place, total)
                frm = np.where(reach > top, len(u), frm)
                equal = total == reach[place]
                np.minimum.at(frm, place[equal], source[way][equal])
                top = reach
            score[here] += top
            back[here] = frm

    @staticmethod
    def _trace(at, back, final) -> None:
        while len(at):
            final[at] = True
            at = back[at]
            at = at[at >= 0]

    def _keep(self, rows, last, back, score, final) -> None:
        """Keeps of the last trip what is undecided, and marks what is not."""
        levels, at = [np.arange(last, len(rows))], np.unique(back[last:])
        while len(at) > 1 and at[0] >= 0:
            levels.append(at)
            at = np.unique(back[at])
        self._trace(at[at >= 0], back, final)
        kept = np.sort(np.concatenate(levels))
        place = np.searchsorted(kept, back[kept])
        inside = kept[np.minimum(place, len(kept) - 1)] == back[kept]
        self.open = rows.take(pa.array(kept)).combine_chunks()
        self.back, self.score = np.where(inside, place, -1), score[kept]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start to its end, and which range each is of."""
    n = ends - starts
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - (np.cumsum(n) - n)[of] + starts[of], of


def _least(values: np.ndarray, group: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The least of the values that count, by group."""
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, group[counts], values[counts])
    return out


def decoded(no_route: float, rows: int = ROWS):
    """A function for ``mapInArrow`` that gives PLACE of the likeliest candidate of each fix; fixes may lie over several batches."""

    def run(batches):
        decoder, rest, size = Decoder(no_route), [], 0
        for batch in batches:
            rest.append(batch)
            size += len(batch)
            if size < rows:
                continue
            table = pa.Table.from_batches(rest).combine_chunks()
            other = pc.or_(pc.not_equal(table["TRIP_ID"], table["TRIP_ID"][-1]), pc.not_equal(table["id"], table["id"][-1])).to_numpy()
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # the last fix may go on
            rest, size = table.slice(cut).to_batches(), len(table) - cut
            if cut:
                yield from _ended(decoder, table.slice(0, cut), table["TRIP_ID"][cut].as_py())
        if rest:
            yield from decoder.decode(pa.Table.from_batches(rest), True).to_batches()

    return run


def _ended(decoder: Decoder, table: pa.Table, follows: str):
    """Decodes a block before the trip ``follows``."""
    return decoder.decode(table, table["TRIP_ID"][-1].as_py() != follows).to_batches()
