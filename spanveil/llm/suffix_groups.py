"""Suffix arrays by linear grouping construction, on arrays.

The text holds any number of pieces, each ended by a 0. First suffixes are grouped by the
longest Lyndon word they begin with:

- At the start a group holds the suffixes of one letter. Groups are processed in
  descending order. Each suffix of a processed group is appended to its *previous smaller*
  suffix, the nearest one to the left whose group is lower; those that got the same words appended
  move to the upper end of their group, as a group of their own.
- A processed suffix is taken out of the list of neighbours, so that the left neighbour of those
  that are left is the pointer, and its right neighbour when it goes is the place where its Lyndon
  word ends.
- A run of groups of which none has a member followed by one of a higher group can't feed each
  other, and is processed at once.

Then groups are emitted in ascending order: within a group the suffix behind the Lyndon word
decides, and that is in a lower group, or in the same one, and already has its place. Nothing is
renamed and solved again.

Suffixes that are equal up to the end of their pieces come in the order of the pieces.
A text has less than 2**31 entries.
"""

from __future__ import annotations

import numpy as np

#: Entries that the first try for a run of groups takes; it adapts to what can be used.
FIRST_TRY = 1024
#: Most appended words that are compared as columns; longer runs are compared as byte strings.
COLUMNS = 6


def _appended_order(groups: np.ndarray, words: np.ndarray, at: np.ndarray, counts: np.ndarray):
    """The order of (group, appended words) and where a new one begins in it."""
    most = int(counts.max())
    if most > COLUMNS:
        big = (words + 1).astype(">u8")
        keys = [big[a : a + c].tobytes() for a, c in zip(at.tolist(), counts.tolist(), strict=True)]
        rank = {key: k for k, key in enumerate(sorted(set(keys)))}
        columns = [np.array([rank[key] for key in keys], dtype=np.int64)]
    else:
        padded = np.append(words, np.zeros(most, dtype=words.dtype))
        columns = [np.where(counts > k, padded[at + k] + 1, 0) for k in range(most)]
    if most == 1:
        # Names are less than 2**31.
        order = np.argsort(groups.astype(np.int64) << 32 | columns[0])
    else:
        order = np.lexsort((*columns[::-1], groups))
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for column in (groups, *columns):
        column = column[order]
        new[1:] |= column[1:] != column[:-1]
    return order, new


def lyndon_groups(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes by group, group of each, size of each group, next smaller suffix of each).

    A group is named by its first entry.
    """
    n = len(text)
    array = np.argsort(text, kind="stable").astype(np.int32)
    place = np.empty(n, dtype=np.int32)
    place[array] = np.arange(n, dtype=np.int32)
    ordered = text[array]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    size = np.zeros(n + 1, dtype=np.int32)
    size[begins] = np.diff(np.append(begins, n))
    group = np.full(n + 1, -1, dtype=np.int32)
    group[array] = np.repeat(begins, size[begins])
    # One entry more, lower than all, stands before the first and behind the last.
    left, right = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32)
    left[0], right[n - 1] = n, n
    smaller = np.full(n + 1, n, dtype=np.int32)
    moves = np.zeros(n + 1, dtype=bool)
    floor, end, tried = int(np.count_nonzero(text == 0)), n, FIRST_TRY
    while end > floor:
        begin = int(group[array[max(floor, end - tried)]])
        taken = array[begin:end]
        own = group[taken]
        followed = group[right[taken]] > own
        if followed.any():
            highest = int(own[followed].max())
            begin = highest + int(size[highest])
            taken = array[begin:end]
            tried = max(64, 2 * (end - begin))
        else:
            tried = 2 * (end - begin)
        end = begin
        taken = np.sort(taken)
        words = group[taken]
        smaller[taken] = right[taken]
        first = np.ones(len(taken), dtype=bool)
        first[1:] = left[taken[1:]] != taken[:-1]
        at = np.flatnonzero(first)
        counts = np.diff(np.append(at, len(taken)))
        before, behind = left[taken[at]], right[taken[at + counts - 1]]
        right[before], left[behind] = behind, before
        # The ends of pieces stay one group.
        some = group[before] > 0
        if not some.any():
            continue
        before, at, counts = before[some], at[some], counts[some]
        order, new = _appended_order(group[before], words, at, counts)
        before = before[order]
        old = group[before]
        change = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        moved = np.diff(np.append(change, len(old)))
        upper = old[change] + size[old[change]] - moved
        upper_each = np.repeat(upper, moved)
        target = upper_each + np.arange(len(old)) - np.repeat(change, moved)
        moves[before] = True
        staying = array[target]
        staying = staying[~moves[staying]]
        moves[before] = False
        vacant = place[before]
        vacant = np.sort(vacant[vacant < upper_each])
        array[vacant], place[staying] = staying, vacant
        array[target], place[before] = before, target
        size[old[change]] -= moved
        starts = target[new]
        size[starts] = np.diff(np.append(np.flatnonzero(new), len(old)))
        group[before] = starts[np.cumsum(new) - 1]
    return array, group[:n], size[:n], smaller[:n]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of the pieces of a text in order; it ends with a 0, as each piece does."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int32)
    array, group, size, smaller = lyndon_groups(text)
    begin = int(np.count_nonzero(text == 0))
    # Places are final from the lowest group on; -1 is not yet known.
    place = np.full(n, -1, dtype=np.int32)
    place[array[:begin]] = np.arange(begin, dtype=np.int32)
    tried = FIRST_TRY
    while begin < n:
        top = int(group[array[min(n, begin + tried) - 1]])
        end = top + int(size[top])
        taken = array[begin:end]
        own, behind = group[taken], smaller[taken]
        among = (group[behind] >= begin) & (group[behind] != own)
        if among.any():
            end = int(own[among].min())
            taken, own, behind = (x[: end - begin] for x in (taken, own, behind))
            tried = max(64, 2 * (end - begin))
        else:
            tried = 2 * (end - begin)
        emitted = np.zeros(end - begin, dtype=np.int32)
        ready = place[behind] >= 0
        entries = np.empty(end - begin, dtype=np.int32)
        waiting = np.flatnonzero(~ready)
        now = np.flatnonzero(ready)
        while True:
            # Places are less than 2**31.
            now = now[np.argsort(own[now].astype(np.int64) << 31 | place[behind[now]])]
            mine = own[now]
            first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            counts = np.diff(np.append(first, len(mine)))
            slot = mine + np.repeat(emitted[mine[first] - begin], counts)
            slot += np.arange(len(mine)) - np.repeat(first, counts)
            emitted[mine[first] - begin] += counts
            entries[slot - begin] = taken[now]
            place[taken[now]] = slot
            if not len(waiting):
                break
            # The same word follows: these come behind those that are followed by others.
            ready = place[behind[waiting]] >= 0
            now, waiting = waiting[ready], waiting[~ready]
        array[begin:end] = entries
        begin = end
    return array
