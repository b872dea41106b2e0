"""Assembly of reads: overlap graphs, longest paths, consensus by votes, and phasing of linked sites.

Assembly runs inside one group: the reads of one locus, which the depth guard bounds before this stage.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import align
from ..operators.graph import UnionFind
from ..operators.ordered import per_group

Edge = tuple[int, int, int]  # next, score, overlap


def overlap_graph(seqs: Sequence[str], least: int, max_error: float = 0.0, quals: Sequence[Sequence[int]] | None = None) -> list[list[Edge]]:
    """Edges i -> j where a suffix of i is a prefix of j over at least ``least`` bases; j must not lie within i.

    Pairs are found through the first ``least`` bases when no error is allowed, so not all pairs are compared.
    """
    n, edges = len(seqs), [[] for _ in seqs]
    if max_error == 0:
        at = defaultdict(list)
        for j, s in enumerate(seqs):
            if len(s) >= least:
                at[s[:least]].append(j)
        for i, s in enumerate(seqs):
            seen = set()
            for k in range(1, len(s) - least + 1):
                for j in at.get(s[k : k + least], ()):
                    size = len(s) - k
                    if j != i and j not in seen and len(seqs[j]) > size and seqs[j].startswith(s[k:]):
                        seen.add(j)
                        edges[i].append((j, size, size))
    else:
        for i in range(n):
            for j in range(n):
                if i != j and (o := align.overlap(seqs[i], seqs[j], least, max_error, quals and quals[i], quals and quals[j])) and o[0] < len(seqs[j]):
                    edges[i].append((j, o[0] - 5 * o[1], o[0]))
    return edges


def break_cycles(edges: list[list[Edge]]) -> list[list[Edge]]:
    """edges without cycles: vertex by vertex, the weakest edge (overlap, then score) of a cycle through it goes."""
    out = [list(e) for e in edges]
    for root in range(len(out)):
        while cycle := _cycle(out, root):
            i, e = min(cycle, key=lambda x: (x[1][2], x[1][1]))
            out[i].remove(e)
    return out


def _cycle(edges: list[list[Edge]], root: int) -> list[tuple[int, Edge]] | None:
    path, seen, stack = [], set(), [(root, iter(edges[root]))]
    while stack:
        at, rest = stack[-1]
        e = next(rest, None)
        if e is None:
            stack.pop()
            if path:
                path.pop()
        elif e[0] == root:
            return [*path, (at, e)]
        elif e[0] not in seen:
            seen.add(e[0])
            path.append((at, e))
            stack.append((e[0], iter(edges[e[0]])))
    return None


def topological(edges: list[list[Edge]]) -> list[int] | None:
    """An order in which edges lead forward; None if there is a cycle."""
    into = [0] * len(edges)
    for e in edges:
        for j, *_ in e:
            into[j] += 1
    ready, out = [i for i, k in enumerate(into) if not k], []
    while ready:
        i = ready.pop(0)
        out.append(i)
        for j, *_ in edges[i]:
            into[j] -= 1
            if not into[j]:
                ready.append(j)
    return out if len(out) == len(edges) else None


def longest_path(edges: list[list[Edge]]) -> list[tuple[int, int]]:
    """(vertex, overlap with the one before) of the path with the highest score; the first edge wins ties."""
    order = topological(edges)
    if order is None:
        raise ValueError("HAS_CYCLE")
    best, then = [0] * len(edges), [None] * len(edges)
    for i in reversed(order):
        for e in edges[i]:
            if e[1] + best[e[0]] > best[i]:
                best[i], then[i] = e[1] + best[e[0]], e
    at = max(range(len(edges)), key=lambda i: (best[i], -i), default=None)
    path, overlap = [], 0
    while at is not None:
        path.append((at, overlap))
        e = then[at]
        at, overlap = (e[0], e[2]) if e else (None, 0)
    return path


def merged_path(seqs: Sequence[str], path: list[tuple[int, int]]) -> str:
    return "".join(seqs[i][o:] for i, o in path)


def without_contained(seqs: Sequence[str], max_error: float = 0.0) -> list[str]:
    """Different sequences that lie in no other one; the longest first."""
    out: list[str] = []
    for s in sorted(set(seqs), key=lambda x: (-len(x), x)):
        inside = any(s in t for t in out)
        if not inside and max_error:
            inside = any((p := align.best_placement(s, t)) is not None and p[1] <= max_error * len(s) for t in out)
        if not inside:
            out.append(s)
    return out


def assemble(reads: Sequence[str], least: int, max_error: float = 0.0) -> list[str]:
    """Contigs: the longest path is taken out of the graph until no read is left."""
    left, contigs = without_contained(reads), []
    while left:
        edges = overlap_graph(left, least, max_error)
        if topological(edges) is None:
            edges = overlap_graph(left, least)
        if topological(edges) is None:
            edges = break_cycles(edges)
        path = longest_path(edges)
        contigs.append(merged_path(left, path))
        used = {i for i, _ in path}
        left = [s for i, s in enumerate(left) if i not in used and s not in contigs[-1]]
    return without_contained(contigs)


def extended(seed: str, reads: Sequence[str], least: int, most: int) -> str:
    """seed and what reads add to its right end, up to ``most`` bases."""
    nodes = [seed, *(r for r in without_contained(reads) if r not in seed)]
    edges = overlap_graph(nodes, least)
    reach, todo = {0}, [0]
    while todo:
        for j, *_ in edges[todo.pop()]:
            if j not in reach:
                reach.add(j)
                todo.append(j)
    keep = sorted(reach)
    number = {v: k for k, v in enumerate(keep)}
    sub = [[(number[j], s, o) for j, s, o in edges[v] if j != 0] for v in keep]
    if topological(sub) is None:
        sub = break_cycles(sub)
    best, then = [0] * len(sub), [None] * len(sub)
    for i in reversed(topological(sub)):
        for e in sub[i]:
            if e[1] + best[e[0]] > best[i]:
                best[i], then[i] = e[1] + best[e[0]], e
    path, at, overlap = [], 0, 0
    while True:
        path.append((at, overlap))
        if not then[at]:
            break
        at, overlap = then[at][0], then[at][2]
    return merged_path([nodes[v] for v in keep], path)[: len(seed) + most]


def polished(contig: str, reads: Sequence[str], max_error: float = 0.1, least: int = 2) -> str:
    """contig with each base by the vote of reads placed without gaps; columns of fewer votes stay."""
    votes = [defaultdict(int) for _ in contig]
    for r in reads:
        p = align.best_placement(r, contig)
        if p and p[1] <= max_error * len(r):
            for k, b in enumerate(r):
                votes[p[0] + k][b] += 1
    return "".join(max(sorted(v), key=lambda b: v[b]) if sum(v.values()) >= least else c for c, v in zip(contig, votes))


def joined_flanks(left: str, right: str, least: int = 30) -> str:
    """An insertion told from both sides: one sequence where the two overlap exactly, else front, '-' and end."""
    o = align.overlap(left, right, least)
    return left + right[o[0] :] if o else f"{left}-{right}"


def phase(links: Sequence[tuple[int, int, int, int]], sites: int) -> list[tuple[int, int]]:
    """(group, parity) of each site from links (i, j, same, opposite).

    A link counts if one side is at least four times the other; the strongest first, a link that contradicts what
    stronger ones say is passed over.
    """
    usable = []
    for i, j, same, opposite in links:
        if same >= 4 * opposite and same:
            usable.append((same - opposite, same + opposite, i, j, 0))
        elif opposite >= 4 * same and opposite:
            usable.append((opposite - same, same + opposite, i, j, 1))
    sets, members = UnionFind(sites), {i: {i: 0} for i in range(sites)}
    for _, _, i, j, flip in sorted(usable, key=lambda x: (-x[0], -x[1], x[2], x[3])):
        a, b = sets.find(i), sets.find(j)
        if a == b:
            continue
        turn = members[a][i] ^ members[b][j] ^ flip
        root = sets.merge(a, b)
        other = b if root == a else a
        base = members[root]
        base |= {k: p ^ turn for k, p in members.pop(other).items()}
        members[root] = base
    return [(sets.find(i), members[sets.find(i)][i] ^ members[sets.find(i)][sets.find(i)]) for i in range(sites)]


def assembled(reads: DataFrame, locus: str, seq: str, least: int, most_reads: int) -> DataFrame:
    """locus, contig, seq, n_reads, too_deep of reads by locus; loci of more than most_reads reads are flagged, not cut."""
    from pyspark.sql import functions as F

    n = reads.groupBy(locus).agg(F.count(F.lit(1)).alias("n_reads"))
    deep = n.where(F.col("n_reads") > most_reads)
    kept = reads.select(locus, seq).join(deep.select(locus), locus, "left_anti")

    def scan(rows: list[dict]) -> list[dict]:
        found = assemble(sorted(r[seq] for r in rows if r[seq] is not None), least)
        return [{locus: rows[0][locus], "contig": k, "seq": s, "n_reads": len(rows), "too_deep": False} for k, s in enumerate(found)]

    kind = reads.schema[locus].dataType.simpleString()
    out = per_group(kept, [locus], [seq], scan, f"{locus} {kind}, contig int, seq string, n_reads long, too_deep boolean")
    none = deep.select(locus, F.lit(None).cast("int").alias("contig"), F.lit(None).cast("string").alias("seq"), "n_reads", F.lit(True).alias("too_deep"))
    return out.unionByName(none)


def guided(reads: Sequence[str], ref: str, least: int, min_score: int = 20) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Contigs of reads in the order of a reference, as (sequence, begin, end on it), and the reads that none uses.

    Reads are placed by local alignment to the reference; overlaps are looked for from each read to those that begin at or
    after it, so the graph has no cycle. Paths are taken out until no read is left. Contained contigs go, contigs that
    overlap are joined until their number stops falling, and of those that overlap on the reference the better aligned stay.
    """
    placed = []
    for s in without_contained(reads):
        a = align.with_shortcut(s, ref)
        if a is not None and a.score >= min_score:
            placed.append((a.r_start - a.q_start, s))
    placed.sort(key=lambda x: (x[0], -len(x[1]), x[1]))
    left, contigs = [s for _, s in placed], []
    while left:
        forward = [[e for e in edges if e[0] > i] for i, edges in enumerate(overlap_graph(left, least))]
        path = longest_path(forward)
        contigs.append(merged_path(left, path))
        used = {i for i, _ in path}
        left = [s for i, s in enumerate(left) if i not in used and s not in contigs[-1]]
    before = None
    while before != len(contigs):
        before = len(contigs)
        contigs = without_contained(contigs)
        edges = [[e for e in x if e[0] > i] for i, x in enumerate(overlap_graph(contigs, least))]
        if any(edges):
            path = longest_path(edges)
            contigs = [merged_path(contigs, path), *(c for i, c in enumerate(contigs) if i not in {k for k, _ in path})]
    scored = sorted(((a, c) for c in contigs if (a := align.with_shortcut(c, ref)) is not None), key=lambda x: (-x[0].score, x[0].r_start, x[1]))
    kept: list[tuple[str, int, int]] = []
    for a, c in scored:
        if all(a.r_end <= lo or a.r_start >= hi for _, lo, hi in kept):
            kept.append((c, a.r_start, a.r_end))
    kept.sort(key=lambda x: x[1])
    return kept, [s for s in reads if not any(s in c for c, *_ in kept)]


def bridged(contigs: list[tuple[str, int, int]], unused: Sequence[str], least: int) -> list[str]:
    """Guided contigs from left to right with the gaps between neighbours closed by what unused reads assemble to.

    A bridge overlaps the end of the one and the beginning of the other; of several the one with the longest overlaps is
    taken, once. The right contig's bases stand where both tell a base.
    """
    pieces = assemble(unused, least) if unused else []
    out: list[str] = []
    for c, *_ in contigs:
        if not out:
            out.append(c)
            continue
        direct = align.overlap(out[-1], c, least)
        if direct is not None:
            out[-1] = out[-1][: len(out[-1]) - direct[0]] + c
            continue
        fits = [(a[0] + b[0], p, a[0], b[0]) for p in pieces if (a := align.overlap(out[-1], p, least)) and (b := align.overlap(p, c, least))]
        if not fits:
            out.append(c)
            continue
        _, p, a, b = max(fits, key=lambda x: (x[0], x[1]))
        pieces.remove(p)
        out[-1] = out[-1] + p[a : len(p) - b] + c
    return out


def template(left: str, insert: str, right: str, least: int = 10) -> str:
    """Flanks around a predicted insertion; ends that the insertion shares with a flank stand once."""
    a = align.overlap(left, insert, least)
    joined = left + insert[a[0] if a else 0 :]
    b = align.overlap(joined, right, least)
    return joined + right[b[0] if b else 0 :]


def run_lengths(contig: str, reads: Sequence[str], least: int = 10, flank: int = 10) -> str:
    """contig with each long run of one base as long as most reads that reach over it say; without a majority it stays."""
    out, at = [], 0
    while at < len(contig):
        end = at
        while end < len(contig) and contig[end] == contig[at]:
            end += 1
        size = end - at
        if size >= least and at >= flank and len(contig) - end >= flank:
            left, right, base = contig[at - flank : at], contig[end : end + flank], contig[at]
            votes: dict[int, int] = defaultdict(int)
            for r in reads:
                k = r.find(left)
                if k >= 0:
                    stop = k + flank
                    while stop < len(r) and r[stop] == base:
                        stop += 1
                    if r.startswith(right, stop):
                        votes[stop - k - flank] += 1
            best = max(votes, key=lambda n: (votes[n], -n), default=None)
            if best is not None and 2 * votes[best] > sum(votes.values()):
                size = best
        out.append(contig[at] * size)
        at = end
    return "".join(out)


def guided_insertion(left: str, right: str, predicted: str, reads: Sequence[str], least: int = 20, anchor: int = 15) -> str | None:
    """The insertion between two flanks that reads tell when laid on a template with a predicted one; None if none is told.

    Known front and end around '-' where the contigs leave a gap.
    """
    t = template(left, predicted, right)
    contigs, unused = guided(reads, t, least)
    told = [run_lengths(c, reads) for c in bridged(contigs, unused, least)]
    if not told:
        return None
    l, r = left[-anchor:], right[:anchor]
    whole = next((c for c in told if l in c and r in c[c.find(l) + anchor :]), None)
    if whole is not None:
        a = whole.find(l) + anchor
        return whole[a : whole.find(r, a)] or None
    front = next((c[c.rfind(l) + anchor :] for c in told if l in c), "")
    back = next((c[: c.find(r)] for c in reversed(told) if r in c), "")
    return f"{front}-{back}" if front and back else None


def best_consensus(candidates: Sequence[str], reads: Sequence[tuple[str, Sequence[int]]]) -> tuple[str, float] | None:
    """The candidate that reads agree with most for its length, and its score; cut to what two reads reach at each end.

    The score is the summed quality of agreeing bases over the logarithm of the length.
    """
    import math

    best = None
    for c in sorted(set(candidates), key=lambda x: (len(x), x)):
        total, spans = 0, []
        for s, q in reads:
            p = align.best_placement(s, c)
            if p is not None:
                total += sum(x for x, a, b in zip(q, s, c[p[0] :]) if a == b)
                spans.append((p[0], p[0] + len(s)))
        if len(spans) < 2:
            continue
        score = total / math.log(max(2, len(c)))
        lo, hi = sorted(a for a, _ in spans)[1], sorted(b for _, b in spans)[-2]
        if hi > lo and (best is None or score > best[1]):
            best = c[lo:hi], score
    return best
