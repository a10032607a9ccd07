"""Plain-Python models of the operators, cell by cell and segment by segment, to hold results against."""

import heapq
import math

AROUND = {1: (-1, 0), 2: (-1, 1), 3: (0, 1), 4: (1, 1), 5: (1, 0), 6: (1, -1), 7: (0, -1), 8: (-1, -1)}


def moved(at, code):
    return at[0] + AROUND[code][0], at[1] + AROUND[code][1]


def steps(w, h):
    return {k: math.hypot(dr * h, dc * w) for k, (dr, dc) in AROUND.items()}


def natural(z, drain, w, h):
    """Code of each cell of z ({(row, col): height}); None where nothing is lower."""
    out = {}
    for at in z:
        best = None
        for k, length in steps(w, h).items():
            to = moved(at, k)
            if to in z and z[to] < z[at]:
                offer = (-(z[at] - z[to]) / length, to, k)
                best = min(best, offer) if best else offer
        out[at] = 0 if at in drain else best and best[2]
    return out


def flats(z, code):
    """Codes with flats resolved."""
    code, seen = dict(code), set()
    for start in sorted(z):
        if code[start] is not None or start in seen:
            continue
        flat = [start]
        seen.add(start)
        for at in flat:
            for k in AROUND:
                to = moved(at, k)
                if to in z and to not in seen and z[to] == z[start]:
                    seen.add(to)
                    flat.append(to)
        outlets = {at: z[start] if code[at] == 0 else z[moved(at, code[at])] for at in flat if code[at] is not None}
        line = [at for at in flat if at in outlets and (code[at] == 0 or outlets[at] == min(outlets.values()))]
        if not line:
            code[start], line = 0, [start]
        for again in (False, True):
            line = [at for at in flat if code[at] is not None] if again else line
            for at in line:
                for k in AROUND:
                    to = moved(at, k)
                    if to in flat and code[to] is None:
                        code[to] = (k + 3) % 8 + 1
                        line.append(to)
    return code


def way(code, at):
    out = [at]
    while code[out[-1]]:
        out.append(moved(out[-1], code[out[-1]]))
    return out


def edges(z, code, w, h):
    """(source, target) -> (greatest cut, sum of cuts, length, origin, destination); basins are numbered as cells meet them."""
    number, cost = {}, {}
    for at in sorted(z):
        path = way(code, at)
        end = path[-1]
        number.setdefault(end, len(number))
        cuts = [max(0.0, z[p] - z[end]) for p in path]
        cost[at] = (number[end], max(cuts), sum(reversed(cuts)), sum(reversed([steps(w, h)[code[p]] for p in path[:-1]])))
    best = {}
    for at in sorted(z):
        for k in (3, 4, 5, 6):
            to = moved(at, k)
            if to not in z or cost[to][0] == cost[at][0]:
                continue
            for a, b in ((at, to), (to, at)):
                offer = (cost[a][1], cost[a][2], cost[a][3] + steps(w, h)[k], a)
                key = cost[a][0], cost[b][0]
                if key not in best or offer < best[key][:4]:
                    best[key] = (*offer, b)
    return best, {at: c[0] for at, c in cost.items()}


def routed(z, drain, w, h):
    """Codes to drainage, or None if some cell cannot reach any."""
    code = flats(z, natural(z, drain, w, h))
    best, basin = edges(z, code, w, h)
    streams = {basin[d] for d in drain}
    known, leave, settled = {s: (0.0, 0.0, 0.0, (-1, -1), -1) for s in streams}, {}, set()
    heap = sorted((c, s) for s, c in known.items())
    while heap:
        cost, b = heapq.heappop(heap)
        if b in settled or known[b] != cost:
            continue
        settled.add(b)
        for (s, t), (cut, total, length, origin, to) in best.items():
            if t == b and s not in settled:
                offer = (max(cut, cost[0]), total + cost[1], length + cost[2], origin, b)
                if s not in known or offer < known[s]:
                    known[s], leave[s] = offer, (origin, to)
                    heapq.heappush(heap, (offer, s))
    if set(basin.values()) - settled:
        return None
    out = dict(code)
    for origin, to in leave.values():
        before = to
        for at in way(code, origin):
            out[at] = next(k for k in AROUND if moved(at, k) == before)
            before = at
    return out


def merged(ids, downs, lengths, least):
    """id -> label: as long as a short group has a neighbour, the first such by label as text joins its neighbour of least
    (length, label as text)."""
    group = {i: i for i in ids}
    while True:
        total = {g: math.fsum(lengths[i] for i in ids if group[i] == g) for g in set(group.values())}
        beside = {g: set() for g in total}
        for i in ids:
            d = downs[i]
            if d in group and group[d] != group[i]:
                beside[group[i]].add(group[d])
                beside[group[d]].add(group[i])
        short = sorted((g for g in total if total[g] < least and beside[g]), key=str)
        if not short:
            return group
        to = min(beside[short[0]], key=lambda g: (total[g], str(g)))
        group = {i: to if g == short[0] else g for i, g in group.items()}
