"""Plain statements of what the operators compute: slow, obvious, whole tables in memory."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall(small(text or ""))
    width = min(width, len(words))
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if words else frozenset()


def classes(pairs, ids) -> dict:
    """The smallest id reachable from each id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def ngram_classes(rows, width: int, num: int, den: int) -> dict:
    """Class of each id, from rows (id, text): every pair is compared."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    pairs = [
        (a, b)
        for k, (a, x) in enumerate(sets)
        for b, y in sets[k + 1 :]
        if x and y and den * len(x & y) >= num * len(x | y)
    ]
    return classes(pairs, {i for i, _ in sets})


def distance(item: str, text: str) -> int:
    """Least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        after = [k]
        for j, d in enumerate(text, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (c != d)))
        row = after
    return min(row)


def edit_distance(one: str, two: str) -> int:
    row = list(range(len(two) + 1))
    for k, c in enumerate(one, 1):
        after = [k]
        for j, d in enumerate(two, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (c != d)))
        row = after
    return row[-1]


def targets(sizes: dict, weights=(3, 1, 2), percent=150, most=2) -> dict:
    """Targets of sources, given in their order: what is above a cap is shared again, until nothing is."""
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(sizes)}
    left, open_sources, out = sum(sizes.values()) * percent / 100, set(sizes), {}
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        level = left / total
        full = {s for s in open_sources if most * sizes[s] <= weight[s] * level}
        if not full:
            return out | {s: weight[s] * level for s in open_sources}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_sources -= full
    return out


def fair_mix(rows, weights=(3, 1, 2), percent=150, most=2) -> list:
    """(id, size, target, taken) of rows (id, text, source): one queue, sorted as a whole."""
    key = lambda s: "1" if s is None else "0" + s
    sized = [(i, len(WORD.findall(t or "")), key(s)) for i, t, s in rows]
    sizes = {s: sum(n for _, n, k in sized if k == s) for s in sorted({k for _, _, k in sized})}
    goal = targets(sizes, weights, percent, most)
    place = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    order = sorted(range(len(sized)), key=lambda r: (place(sized[r][0]), -1 if sized[r][0] is None else sized[r][0], sized[r][1]))
    queue, ahead = [], dict.fromkeys(sizes, 0)
    for r in order:
        _, n, s = sized[r]
        for turn in range(most):
            start = ahead[s] + turn * sizes[s]
            if n and goal[s]:
                queue.append(((start + n) / goal[s], s, start, r))
        ahead[s] += n
    left, taken = sum(sizes.values()) * percent // 100, [0] * len(sized)
    for _, _, _, r in sorted(queue):
        take = min(left, sized[r][1])
        taken[r] += take
        left -= take
    return [(i, n, goal[s], taken[r]) for r, (i, n, s) in enumerate(sized)]
