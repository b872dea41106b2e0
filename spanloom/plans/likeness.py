"""Compatible variants within one session, by arrays: no table of all pairs, whatever the depth of copies.

Rows that agree in all that comparisons read are one form; forms are sorted by place, so a form's partners lie in two
windows. The conditions are those of variants.compatible.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Sequence

import numpy as np

#: Codes of the two types that can match each other; other types follow.
DUP, INS = 0, 1


def kinds(svtypes: Sequence[str]) -> list[int]:
    code = {"DUP": DUP, "INS": INS}
    return [code.setdefault(t, len(code)) for t in svtypes]


class Forms:
    """Forms as arrays: (start, end, kind, ins_seq, imprecise) of each, and what follows from them."""

    def __init__(self, forms: Sequence[tuple]):
        start, end, kind, ins, loose = zip(*forms) if forms else ((),) * 5
        self.start, self.end, self.kind = np.array(start, np.int64), np.array(end, np.int64), np.array(kind, np.int64)
        self.loose = np.array(loose, bool)
        self.open = np.array(["-" in (x or "") for x in ins], bool)
        n = np.array([len(x or "") for x in ins], np.int64)
        self.span = self.end - self.start
        self.length = np.where(self.kind == INS, n, np.maximum(self.span, n))


class Partners:
    """Finds the forms that are compatible with a form, of the same forms or others."""

    def __init__(self, forms: Forms, m, by_end: bool = True):
        """by_end: a duplication and an insertion also meet where only their ends are near."""
        self.f, self.m, self.reach = forms, m, max(m.distance)
        self.distances, self.lengths = np.array(m.distance), np.array(m.length)
        self.overlaps, self.ratios = np.array(m.overlap, float), np.array(m.ratio, float)
        self.starts, self.ends = {}, {}
        for k in np.unique(forms.kind).tolist():
            at = np.flatnonzero(forms.kind == k)
            at = at[np.argsort(forms.start[at], kind="stable")]
            self.starts[k] = (forms.start[at], at)
            if by_end and k in (DUP, INS):
                last = at[np.argsort(forms.end[at], kind="stable")]
                self.ends[k] = (forms.end[last], last)

    def window(self, table: dict, kind: int, x: int) -> np.ndarray:
        if kind not in table:
            return np.empty(0, np.int64)
        places, at = table[kind]
        return at[np.searchsorted(places, x - self.reach) : np.searchsorted(places, x + self.reach, "right")]

    def of(self, g: Forms, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The compatible forms of g's form i, their distance and difference in length."""
        f, s, e, kind = self.f, g.start[i], g.end[i], int(g.kind[i])
        j = self.window(self.starts, kind, s)
        own = len(j)
        if kind in (DUP, INS):
            more = self.window(self.ends, 1 - kind, e)
            j = np.concatenate([j, self.window(self.starts, 1 - kind, s), more[np.abs(f.start[more] - s) > self.reach]])
        ds, de = np.abs(f.start[j] - s), np.abs(f.end[j] - e)
        d = np.maximum(ds, de)
        d[own:] = np.minimum(ds[own:], de[own:])
        loose = (f.loose[j] | g.loose[i]).astype(np.int64)
        diff = np.abs(f.length[j] - g.length[i])
        small, large = np.minimum(f.length[j], g.length[i]), np.maximum(f.length[j], g.length[i])
        lengths = (diff <= self.lengths[loose]) & (small >= self.ratios[loose] * large)
        ok = (d <= self.distances[loose]) & (lengths | f.open[j] | g.open[i])
        j, d, diff, loose = j[ok], d[ok], diff[ok], loose[ok]
        least = np.minimum(f.span[j], g.span[i])
        point = (least <= 0) | ((f.kind[j] == INS) & (kind == INS))
        both = np.maximum(np.minimum(f.end[j], e) - np.maximum(f.start[j], s), 0)
        ok = point | (both / np.where(point, 1, least) >= self.overlaps[loose])
        return j[ok], d[ok], diff[ok]


def match(m, side: list, ids: list, start: list, end: list, svtype: list, ins: list, imprecise: list, known: list, missing: list, *more: list, keep: int = 64) -> list[bool]:
    """Which rows of a session are taken when pairs of the two sides are matched one to one, best first (variants.match_order).

    Rows are sorted by side and id. A form's rows are taken by rising id, as all its rows have the same pairs. A heap holds
    the best pair left of each form of the first side; one that has lost its partner meanwhile is looked up again, so at
    most ``keep`` partners (and those as good as the last) are held for each form.
    """
    n = sum(1 for x in side if not x)
    if not n or n == len(side):
        return [False] * len(side)
    rows = list(zip(start, end, kinds(svtype), ins, imprecise, known, missing, *more))
    groups: list[dict] = [{}, {}]
    for k, (form, i) in enumerate(zip(rows, ids)):
        groups[k >= n].setdefault(form, []).append(i)
    (a_forms, a_ids), (b_forms, b_ids) = (([*g], [*g.values()]) for g in groups)
    a, b = Forms([x[:5] for x in a_forms]), Forms([x[:5] for x in b_forms])
    partners = Partners(b, m)
    # Further columns count as ranks, not a number highest.
    ranks = [-np.unique(np.array([x[7 + c] for x in b_forms], float), return_inverse=True)[1] for c in range(len(more))]
    b_ins = {x: k for k, x in enumerate(dict.fromkeys(x[3] for x in b_forms))}
    b_text = np.array([b_ins[x[3]] for x in b_forms])
    a_at, b_at = [0] * len(a_ids), [0] * len(b_ids)
    left = np.ones(len(b_ids), bool)
    taken: tuple[set, set] = set(), set()

    def front(which: int, lists: list, at: list, k: int):
        """The next free row of a form, or None."""
        rest, used = lists[k], taken[which]
        while at[k] < len(rest) and rest[at[k]] in used:
            at[k] += 1
        return rest[at[k]] if at[k] < len(rest) else None

    def look(k: int) -> tuple[list, bool]:
        """Form k's free partners by groups of equal pairs, best last; and whether that is all of them."""
        j, d, diff = partners.of(a, k)
        ok = left[j]
        j, d, diff = j[ok], d[ok], diff[ok]
        form = a_forms[k]
        exact = (b.start[j] == a.start[k]) & (b.end[j] == a.end[k]) & (b.kind[j] == a.kind[k]) & (b_text[j] == b_ins.get(form[3], -1))
        first = np.where(exact, -1.0, diff + np.log(d + 1.0))
        whole = len(j) <= keep
        if not whole:
            ok = first <= np.partition(first, keep)[keep]
            whole = bool(ok.all())
            first, j, d = first[ok], j[ok], d[ok]
        same = np.array([likely(k, x) for x in j.tolist()], np.int64)
        key = [first, same, d, *[r[j] for r in ranks]]
        order = np.lexsort(key[::-1])
        return grouped(zip(zip(*[x[order].tolist() for x in key]), j[order].tolist())), whole

    def likely(k: int, j: int) -> int:
        """-1 if the genotypes of two forms allow each other, 0 if not, 1 if one is null."""
        x, y = a_forms[k], b_forms[j]
        return 1 if x[5] is None or y[5] is None else -(x[5] <= y[5] + y[6] and y[5] <= x[5] + x[6])

    def grouped(pairs) -> list:
        out: list = []
        for t, x in pairs:
            if out and out[-1][0] == t:
                out[-1][1].append(x)
            else:
                out.append((t, [x]))
        return out[::-1]

    # Exact partners come before all others, so those are looked up first and alone.
    twins: dict = {}
    for j, form in enumerate(b_forms):
        twins.setdefault(form[:4], []).append(j)
    held: list = [None] * len(a_ids)
    for k, form in enumerate(a_forms):
        if form[:4] in twins:
            held[k] = grouped(sorted(((-1.0, likely(k, j), 0, *[int(r[j]) for r in ranks]), j) for j in twins[form[:4]])), False

    def best(k: int) -> tuple | None:
        first = front(0, a_ids, a_at, k)
        while first is not None:
            if held[k] is None:
                held[k] = look(k)
            near, whole = held[k]
            while near:
                t, js = near[-1]
                free = [(x, j) for j in js if left[j] and (x := front(1, b_ids, b_at, j)) is not None]
                if free:
                    near[-1] = (t, [j for _, j in free])
                    x, j = min(free)
                    # As in match_order: exact, then missing alleles, score, genotype, distance, the call's reads, ids.
                    return (t[0] >= 0, form_missing[k], *t, first, x, k, j)
                near.pop()
            if whole:
                return None
            held[k] = None
        return None

    form_missing = [max(x[6] or 0, 0) for x in a_forms]
    heap = [x for k in range(len(a_ids)) if (x := best(k))]
    heapq.heapify(heap)
    while heap:
        top = heap[0]
        first, x, k, j = top[-4:]
        if x not in taken[1] and first not in taken[0]:
            taken[0].add(first)
            taken[1].add(x)
            left[j] = front(1, b_ids, b_at, j) is not None
        again = best(k)
        if again is None:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, again)
    return [i in taken[k >= n] for k, i in enumerate(ids)]


def _grouped(start: list, end: list, svtype: list, ins: list, imprecise: list) -> tuple[Forms, list[list[int]]]:
    """The forms of a session's rows, and each form's rows."""
    rows: dict = {}
    for k, form in enumerate(zip(start, end, kinds(svtype), ins, imprecise)):
        rows.setdefault(form, []).append(k)
    return Forms([*rows]), [*rows.values()]


def cliques(m, gap: int, start: list, end: list, svtype: list, ins: list, imprecise: list) -> list[int]:
    """Each row's clique, the same as graph.greedy_cliques gives with compatible rows at most gap apart as neighbours.

    Rows of one form have the same neighbours, so what one of them joins or moves to, the next in order does too: only the
    forms of a clique are compared, and only cliques that hold a neighbour are looked at.
    """
    if len(start) == 1:
        return [0]
    f, rows = _grouped(start, end, svtype, ins, imprecise)
    partners = Partners(f, m)
    near, degree = [], []
    count = np.array([len(x) for x in rows])
    for i in range(len(rows)):
        j = partners.of(f, i)[0]
        j = j[np.abs(f.start[j] - f.start[i]) <= gap]
        near.append(j.astype(np.int32))
        degree.append(int(count[j].sum()))
    order = sorted(((degree[i], k, i) for i, x in enumerate(rows) for k in x), reverse=True)
    members: list[dict[int, list[int]]] = []  # by clique: its forms and their rows
    first: list[int] = []  # by clique: the row that started it
    size: list[int] = []
    started = np.full(len(rows), -1)
    last = home = -1
    for _, k, i in order:
        if i != last:
            own, found = set(near[i].tolist()), started[near[i]]
            last, home = i, -1
            for c in sorted(found[found >= 0].tolist(), key=lambda c: (size[c], first[c]), reverse=True):
                if members[c].keys() <= own:
                    home = c
                    break
        if home < 0:
            home = started[i] = len(members)
            members.append({})
            first.append(k)
            size.append(0)
        members[home].setdefault(i, []).append(k)
        size[home] += 1
    place = {c: a for a, c in enumerate(sorted(range(len(members)), key=lambda c: (size[c], c)))}
    holders: list[set] = [set() for _ in rows]
    for c, x in enumerate(members):
        for i in x:
            holders[i].add(c)
    for c, a in place.items():
        for i in list(members[c]):
            own = near[i].tolist()
            larger = {h for j in own for h in holders[j] if place[h] > a}
            own = set(own)
            for h in sorted(larger, key=place.__getitem__, reverse=True):
                if members[h].keys() <= own:
                    members[h].setdefault(i, []).extend(members[c].pop(i))
                    holders[i].discard(c)
                    holders[i].add(h)
                    break
    number = [0] * len(start)
    kept = sorted((min(map(min, x.values())), c) for c, x in enumerate(members) if x)
    for n, (_, c) in enumerate(kept):
        for x in members[c].values():
            for k in x:
                number[k] = n
    return number


def beaten(m, ids: list, start: list, end: list, svtype: list, ins: list, imprecise: list, epr: list) -> list[bool]:
    """Whether a compatible row of another id is better: precise against imprecise, else a higher epr (null: neither)."""
    lost = [False] * len(ids)
    if len(ids) == 1:
        return lost
    f, rows = _grouped(start, end, svtype, ins, imprecise)
    known = [k for k, x in enumerate(epr) if x is not None]
    rank = np.full(len(ids), -1)
    rank[known] = np.unique(np.array([epr[k] for k in known], float), return_inverse=True)[1]
    top = np.array([rank[x].max() for x in rows])
    partners, copies = Partners(f, m), Counter(ids)
    for i, x in enumerate(rows):
        j = partners.of(f, i)[0]
        same = j[f.loose[j] == f.loose[i]]
        most = top[same].max() if len(same) else -1
        worse = bool(f.loose[i] and not f.loose[j].all())
        if not worse and most <= rank[x].min() and rank[x].min() >= 0:
            continue
        for k in x:
            if copies[ids[k]] > 1:
                # Rows of one id don't compete with each other.
                rivals = [r for o in j.tolist() for r in rows[o] if ids[r] != ids[k]]
                lost[k] = any((imprecise[k] and not imprecise[r]) or (imprecise[r] == imprecise[k] and 0 <= rank[k] < rank[r]) for r in rivals)
            else:
                lost[k] = worse or 0 <= rank[k] < most
    return lost
