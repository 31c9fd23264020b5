"""Which forms share enough trigrams with what is asked, inside the arrays of a group: a batch of what is asked and a shard of forms.

A pair of similarity s has s x |A| of the asked set A in common, so one of the |A| - ceil(s |A|) + 1 trigrams of A that the
fewest forms of the shard have is in the form: the forms of these are marked in an array, no pair is a row. Trigrams stand
one behind the other in a text; three code points are one number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Pairs that are weighed at once, and the trigrams of the shortest forms: longer ones go by lengths, each twice the last.
PAIRS, SHORT = 16_384, 32
FAR = np.int32(2**30)
#: Forms are looked at that have so many of the trigrams which are looked up.
OFTEN = 3


def _numbers(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the texts one behind the other, and how many each has."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").reshape(-1, 3).astype("uint64")
    shift = np.uint64(21)
    return (points[:, 0] << shift << shift) | (points[:, 1] << shift) | points[:, 2], np.array([len(t) // 3 for t in texts], dtype="int64")


class _Shard:
    """Forms of about one length: their trigrams as rows of a matrix, and the forms of each trigram."""

    def __init__(self, rows: np.ndarray, grams: np.ndarray, lengths: np.ndarray) -> None:
        self.rows, count, width = rows, len(rows), int(lengths.max())
        self.known, ids = np.unique(grams, return_inverse=True)
        of = np.repeat(np.arange(count), lengths)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.grams = np.full((count, width), len(self.known), dtype="int32")
        self.grams[of, at] = ids
        order = np.lexsort((at, of, ids))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (ids[order][1:] == ids[order][:-1]) & (of[order][1:] == of[order][:-1])
        #: where a form has the same trigram before: -1 where it has not; behind its end FAR
        self.before = np.full((count, width), FAR, dtype="int32")
        last = np.where(same, np.append(-1, at[order][:-1]), -1)
        self.before[of[order], at[order]] = last
        self.distinct = (self.before == -1).sum(axis=1)
        once = order[~same]
        self.posted, starts = of[once], np.searchsorted(ids[once], np.arange(len(self.known) + 1))
        self.starts, self.counts, self.asked = starts, np.zeros(count, dtype="int32"), np.zeros(len(self.known) + 1, dtype=bool)

    def sharing(self, grams: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray]:
        """(forms, common): forms that have `needed` of the distinct trigrams; common: where their trigrams are of these."""
        at = np.searchsorted(self.known, grams)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == grams)]
        if len(at) < max(needed, 1):
            return at[:0], self.grams[:0] < 0
        often = min(OFTEN, needed)  # of so many more trigrams, so many are in the form
        sizes = self.starts[at + 1] - self.starts[at]
        lists = [self.posted[self.starts[g] : self.starts[g + 1]] for g in at[np.argsort(sizes, kind="stable")][: len(at) - needed + often]]
        for forms in lists:
            self.counts[forms] += 1
        forms = np.concatenate(lists)
        forms = forms[self.counts[forms] >= often]
        for some in lists:
            self.counts[some] = 0
        forms = np.unique(forms)
        self.asked[at] = True
        common = self.asked[self.grams[forms]]
        self.asked[at] = False
        enough = (common & (self.before[forms] == -1)).sum(axis=1) >= needed
        return forms[enough], common[enough]


def _extents(common: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best Jaccard similarity of a set of `size` with an extent of each row; common: which trigrams are of the set."""
    best = np.zeros(len(common))
    for i in range(common.shape[1]):
        r = np.flatnonzero(common[:, i])
        if not len(r):
            continue
        mine, fresh = common[r, i:], before[r, i:] < i
        both, more = np.cumsum(mine & fresh, axis=1, dtype="int32"), np.cumsum(fresh & ~mine, axis=1, dtype="int32")
        best[r] = np.maximum(best[r], (both / (size[r][:, None] + more)).max(axis=1))
    return best


def _weighed(asked: pa.Table, forms: pa.Table, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of asked, rows of forms, similarity) of the pairs that reach the `least` of asked; whole: of sets, not of extents."""
    grams, lengths = _numbers(forms["ordered"].to_pylist())
    sets, sizes = _numbers(asked["t"].to_pylist())
    least, begins = asked["least"].to_numpy(), np.cumsum(sizes) - sizes
    ends = np.cumsum(lengths)
    kind = np.ceil(np.log2(np.maximum(lengths, SHORT) / SHORT)).astype("int64")
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        shard = _Shard(rows, np.concatenate([grams[ends[r] - lengths[r] : ends[r]] for r in rows]) if len(rows) < len(kind) else grams, lengths[rows])
        held, pairs = [], 0
        for a in range(len(sizes)):
            found, common = shard.sharing(sets[begins[a] : begins[a] + sizes[a]], int(np.ceil(sizes[a] * least[a] - 1e-9)))
            if len(found):
                held.append((np.full(len(found), a), found, common))
                pairs += len(found)
            if held and (pairs >= PAIRS or a == len(sizes) - 1):  # the last one may have found nothing
                of, at, shared = (np.concatenate(x) for x in zip(*held, strict=True))
                held, pairs = [], 0
                if whole:
                    n = (shared & (shard.before[at] == -1)).sum(axis=1)
                    value = n / (sizes[of] + shard.distinct[at] - n)
                else:
                    value = np.concatenate([_extents(shared[i : i + PAIRS], shard.before[at[i : i + PAIRS]], sizes[of[i : i + PAIRS]]) for i in range(0, len(of), PAIRS)])
                good = value >= least[of]
                yield of[good], shard.rows[at[good]], value[good]


def _pairs(asked: pa.Table, forms: pa.Table, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = list(_weighed(asked, forms, whole)) if len(asked) and len(forms) else []
    if not found:
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _in_order(of: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, place): rows by `of` and then by the others; place: where each stands among those of its `of`."""
    order = np.lexsort((*reversed(then), of))
    of = of[order]
    begins = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, dtype="int64")
    return order, np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))


def meeting(whole: bool, most: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For groups of asked (unit, t, least) and forms (form, ordered, first): unit, form, value of the pairs that reach `least`.

    most: of each unit the best so many forms; those of one similarity (to four places) go by `first`.
    """

    def met(asked: pa.Table, forms: pa.Table) -> pa.Table:
        asked, forms = asked.combine_chunks(), forms.combine_chunks()
        if most is not None:
            forms = forms.sort_by("first")
        of, at, value = _pairs(asked, forms, whole)
        if most is not None:
            order, place = _in_order(of, -np.floor(value * 10_000 + 0.5 + 1e-9), at)
            order = order[place < most]
            of, at, value = of[order], at[order], value[order]
        return pa.table({"unit": asked["unit"].take(pa.array(of)), "form": forms["form"].take(pa.array(at)), "value": pa.array(value)})

    return met


def reaching(persons: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For groups of asked (unit, t, least) and words (form, ordered, n: persons who have it): unit and the greatest similarity
    that its best words have with `persons` persons in all; no row where they have fewer."""

    def reached(asked: pa.Table, words: pa.Table) -> pa.Table:
        asked, words = asked.combine_chunks(), words.combine_chunks()
        of, at, value = _pairs(asked, words, False)
        order, place = _in_order(of, -value)
        of, value, n = of[order], value[order], words["n"].to_numpy()[at[order]]
        total = np.cumsum(n)
        begin = np.flatnonzero(place == 0)
        upto = total - np.repeat(total[begin] - n[begin], np.diff(np.append(begin, len(of)))) if len(of) else total
        last = np.flatnonzero((upto >= persons) & (upto - n < persons))
        return pa.table({"unit": asked["unit"].take(pa.array(of[last])), "least": pa.array(value[last])})

    return reached
