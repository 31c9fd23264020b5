"""The first persons that each unnamed one may be, among mentions of one place and some days: inside a group's arrays.

A group holds unnamed ones and the mentions that share a sign with them. Mentions stand in the order in which persons are
shown and are read in stretches; an unnamed one stops reading when it has enough, so no pairs are kept, and those that ask
the same are answered once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a stretch (unnamed ones x mentions), and mentions of the first stretch; each is twice as long as the one before.
CELLS, STRETCH = 2_000_000, 512
#: Groups of so many cells are read at once, larger ones value by value.
SMALL = 500_000


def _codes(column: pa.ChunkedArray, values: pa.Array, unknown: int, other: int) -> np.ndarray:
    """Places of a column's values among `values`; unknown: for nulls; other: for values that aren't there."""
    at = pc.fill_null(pc.index_in(column, value_set=values), other)
    return np.where(pc.is_null(column).to_numpy(zero_copy_only=False), unknown, at.to_numpy(zero_copy_only=False)).astype("int64")


def _known(column: pa.ChunkedArray) -> pa.Array:
    return pc.drop_null(pc.unique(column))


def _strengths(a: dict[str, np.ndarray], t: dict[str, np.ndarray], rows: np.ndarray, cols: np.ndarray, days: int) -> np.ndarray:
    """rows x cols: 0 where a mention doesn't fit, 1 where it does, 2 where it shares the charge as well."""
    of = lambda c: a[c][rows][:, None]
    fits = (np.abs(of("day") - t["day"][cols]) <= days) & ((of("stage") == -1) | (of("stage") == t["stage"][cols]))
    sex = t["sex"][cols]
    fits &= (of("sex") == -1) | (sex == -1) | (of("sex") == sex)
    if "value" in t:
        fits &= of("value") == t["value"][cols]
    if (a["article"][rows] >= 0).any():
        fits &= of("article") != t["article"][cols]
    for slot in range(a["shown"].shape[1]):
        if (a["shown"][rows, slot] >= 0).any():
            fits &= a["shown"][rows, slot][:, None] != t["person"][cols]
    if "charges" not in t:
        return fits.astype("int8")
    shared = t["charges"][:, cols][a["charge"][rows]]  # the last line of charges is for those who have none
    return fits * (1 + shared.astype("int8"))


def _first(a: dict[str, np.ndarray], t: dict[str, np.ndarray], days: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(picks, strength), rows x most: places in t, the strongest first, then as t stands; -1 behind the last.

    A person counts once, by its strongest mention, of these the earliest.
    """
    n, m, best = len(a["day"]), len(t["day"]), 2 if "charges" in t else 1
    # mentions of persons who have several, person by person
    counts = np.bincount(t["person"])
    several = counts[t["person"]] > 1
    held = np.full((best + 1, n, most), -1, dtype="int64")
    have = np.zeros((best + 1, n), dtype="int64")
    open_, at, stretch = np.arange(n), 0, STRETCH
    while at < m and len(open_):
        cols = np.arange(at, min(at + stretch, m))
        again = np.unique(t["person"][cols][several[cols]])
        theirs = np.flatnonzero(several & np.isin(t["person"], again)) if len(again) else cols[:0]
        theirs = theirs[np.argsort(t["person"][theirs], kind="stable")]
        for part in np.array_split(open_, max(1, -(-len(open_) * (len(cols) + len(theirs)) // CELLS))):
            s = _strengths(a, t, part, cols, days)
            if len(theirs):
                own = _strengths(a, t, part, theirs, days)
                weight = np.where(own > 0, own.astype("int64") * (m + 1) - t["order"][theirs], -1)
                starts = np.flatnonzero(np.diff(t["person"][theirs], prepend=-1))
                top = np.repeat(np.maximum.reduceat(weight, starts, axis=1), np.diff(np.append(starts, len(theirs))), axis=1)
                own[weight != top] = 0
                here = (theirs >= cols[0]) & (theirs <= cols[-1])
                s[:, theirs[here] - cols[0]] = own[:, here]
            for strength in range(1, best + 1):
                r, c = np.nonzero(s == strength)
                if not len(r):
                    continue
                found = np.bincount(r, minlength=len(part))
                slot = np.arange(len(r)) - (np.cumsum(found) - found)[r] + have[strength][part[r]]
                fit = slot < most
                held[strength][part[r[fit]], slot[fit]] = cols[c[fit]]
                have[strength][part] += found
        open_ = open_[have[best][open_] < a["need"][open_]]
        at, stretch = at + len(cols), 2 * stretch
    picks, strengths = np.full((n, most), -1, dtype="int64"), np.zeros((n, most), dtype="int64")
    filled = np.zeros(n, dtype="int64")
    for strength in range(best, 0, -1):
        for slot in range(most):
            r = np.flatnonzero((held[strength][:, slot] >= 0) & (filled < a["need"]))
            picks[r, filled[r]], strengths[r, filled[r]] = held[strength][r, slot], strength
            filled[r] += 1
    return picks, strengths


def fill(asked: pa.Table, told: pa.Table, days: int, shown: int, strength: int) -> pa.Table:
    """asked with `found` carried on to `shown` persons where told has as many; the weakest of them are of `strength`.

    asked: article, day, stage, sex, charge, value, found (list of person, name, n_article, strength). told: person, name,
    n_article, n_on, n_start, day, stage, sex, value and, if a shared charge makes a mention stronger, charges (list).
    """
    asked, told = asked.combine_chunks(), told.combine_chunks()
    if not len(asked) or not len(told):
        return asked
    values = _known(asked["value"])
    told = told.filter(pc.is_in(told["value"], value_set=values))
    told = told.take(pc.sort_indices(told, sort_keys=[("name", "ascending"), ("person", "ascending")], null_placement="at_start"))
    if not len(told):
        return asked
    earlier = pc.sort_indices(told, sort_keys=[("n_on", "ascending"), ("n_article", "ascending"), ("n_start", "ascending")], null_placement="at_start").to_numpy()
    number = np.empty(len(told), dtype="int64")
    number[earlier] = np.arange(len(told))
    plain = lambda table, c: table[c].to_numpy().astype("int64")
    stages, sexes, articles, persons = _known(told["stage"]), _known(told["sex"]), _known(told["n_article"]), pc.unique(told["person"])
    in_ = lambda column, known: pc.fill_null(pc.index_in(column, value_set=known), -1).to_numpy(zero_copy_only=False).astype("int64")
    t = {
        "value": in_(told["value"], values), "day": plain(told, "day"), "stage": _codes(told["stage"], stages, -3, -3), "sex": _codes(told["sex"], sexes, -1, -3),
        "article": in_(told["n_article"], articles), "person": in_(told["person"], persons),
    }
    before = asked["found"].combine_chunks()
    kept = before.flatten()
    have = pc.list_value_length(before).to_numpy(zero_copy_only=False).astype("int64")
    owner = np.repeat(np.arange(len(asked)), have)
    place = np.arange(len(owner)) - (np.cumsum(have) - have)[owner]
    excluded = np.full((len(asked), shown), -1, dtype="int64")
    if len(owner):
        excluded[owner, place] = in_(kept.field("person"), persons)
    a = {"value": in_(asked["value"], values), "day": plain(asked, "day"), "stage": _codes(asked["stage"], stages, -1, -2), "sex": _codes(asked["sex"], sexes, -1, -2), "article": in_(asked["article"], articles), "need": shown - have}
    lines = None
    if "charges" in told.column_names:
        charges = _known(asked["charge"])
        a["charge"] = _codes(asked["charge"], charges, len(charges), len(charges))
        lists = told["charges"].combine_chunks()
        lines = np.zeros((len(charges) + 1, len(told)), dtype=bool)
        of, code = np.repeat(np.arange(len(told)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")), in_(lists.flatten(), charges)
        lines[code[code >= 0], of[code >= 0]] = True

    # those that ask the same once
    each, back = np.unique(np.column_stack([a[c] for c in sorted(a)] + [excluded]), axis=0, return_inverse=True)
    back = back.reshape(-1)
    shape = {c: each[:, i] for i, c in enumerate(sorted(a))} | {"shown": each[:, len(a) :]}
    picks, strengths = np.full((len(each), shown), -1, dtype="int64"), np.zeros((len(each), shown), dtype="int64")
    runs = [(np.arange(len(told)), np.arange(len(each)))]
    if len(told) * len(each) > SMALL:
        runs = [(np.flatnonzero(t["value"] == v), np.flatnonzero(shape["value"] == v)) for v in range(len(values))]
        del t["value"]
    for cols, rows in runs:
        if not len(cols) or not len(rows):
            continue
        mine = {c: x[cols] for c, x in t.items()}
        mine["person"] = np.unique(mine["person"], return_inverse=True)[1].reshape(-1)
        # the persons shown already, as the group numbers them here
        numbers = np.full(len(persons) + 1, -1, dtype="int64")
        numbers[t["person"][cols]] = mine["person"]
        mine["order"] = np.argsort(np.argsort(number[cols], kind="stable"), kind="stable")
        if lines is not None:
            mine["charges"] = lines[:, cols]
        theirs = {c: x[rows] for c, x in shape.items()}
        theirs["shown"] = numbers[theirs["shown"]]
        p, s = _first(theirs, mine, days, shown)
        picks[rows], strengths[rows] = np.where(p >= 0, cols[p], -1), s
    picks, strengths = picks[back], strengths[back]
    r, slot = np.nonzero(picks >= 0)
    kind = before.type.value_type
    added = told.take(pa.array(picks[r, slot]))
    parts = {"person": added["person"], "name": added["name"], "n_article": added["n_article"], "strength": pa.chunked_array([pa.array(strength - 1 + strengths[r, slot], pa.int32())])}
    fields = [kind.field(i) for i in range(kind.num_fields)]
    new = pa.StructArray.from_arrays([parts[f.name].combine_chunks().cast(f.type) for f in fields], fields=fields)
    both = pa.concat_arrays([kept, new])
    order = np.lexsort((np.concatenate([place, have[r] + slot]), np.concatenate([owner, r])))
    lengths = have + np.bincount(r, minlength=len(asked))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("int32"))
    found = pa.ListArray.from_arrays(offsets, both.take(pa.array(order)), type=before.type)
    return asked.set_column(asked.column_names.index("found"), asked.schema.field("found"), found)


def filling(days: int, shown: int, strength: int, columns: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """fill for groups of two tables; it gives `columns` of the first one."""

    def filled(asked: pa.Table, told: pa.Table) -> pa.Table:
        return fill(asked, told, days, shown, strength).select(columns)

    return filled
