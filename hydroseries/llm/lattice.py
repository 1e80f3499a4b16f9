"""Least edits that bring a sequence of turns into the form s?(ua)+ or nothing,
by bidirectional Dijkstra over the edit lattice.

A node is (rows consumed, state); the state is what the initials so far allow next."""

from __future__ import annotations

import heapq

BEGIN, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NEXT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ACCEPT = (BEGIN, ASSISTANT)
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs; keeping costs 0, an undeleted truncated row TRUNCATED more


def row_edges(state: int, initial: str, fault: str | None) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that consume a row."""
    out = [("D", DELETE, state)]
    if fault in ("blank", "duplicate"):
        return out
    more = TRUNCATED if fault == "truncated" else 0
    if (state, initial) in NEXT:
        out.append(("K", more, NEXT[state, initial]))
    out += [("R", RENAME + more, NEXT[state, x]) for x in "ua" if (state, x) in NEXT]
    return out


def insert_edges(state: int) -> list[tuple[str, int, int]]:
    return [("I", INSERT, NEXT[state, x]) for x in "ua" if (state, x) in NEXT]


class _Search:
    """One direction: labels (cost, audit), least first; a heap by cost, then by rows
    passed, so that every label of a node is final when the node is settled (an edit
    of cost 0 always passes a row)."""

    def __init__(self, starts):
        self.labels = dict.fromkeys(starts, (0, ""))
        self.heap = [(0, 0, n) for n in starts]
        self.settled = set()

    def top(self):
        while self.heap and self.heap[0][2] in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None


def search(rows: list[tuple[str, str | None]], start: int = BEGIN, ends: tuple[int, ...] = ACCEPT) -> tuple[int, str] | None:
    """Least (cost, audit) from ``start`` before the rows (initial, fault) to one of ``ends`` after
    them; of equal costs the ASCII-least audit; None if there is no way.

    Two audits of one node and cost are never prefixes of each other (the longer
    one would hold more inserts and cost more), so the least one stays least
    whatever is put before or after it, and labels keep one audit only."""
    n = len(rows)
    ahead, back = _Search([(0, start)]), _Search([(n, e) for e in ends])
    # reverse edges of one row, made when the reverse search first needs them
    into: dict[int, list] = {}
    ins = [(p, q, cost, letter) for p in range(STATES) for letter, cost, q in insert_edges(p)]
    best = None

    def cross(node):
        nonlocal best
        a, b = ahead.labels.get(node), back.labels.get(node)
        if a and b:
            found = (a[0] + b[0], a[1] + b[1])
            if best is None or found < best:
                best = found

    for node in back.labels:
        cross(node)
    while True:
        fa, fb = ahead.top(), back.top()
        # a search that is exhausted has final labels wherever it reaches: the other goes on alone
        if fa is None and fb is None or best is not None and (fa or 0) + (fb or 0) > best[0]:
            return best
        forward = fb is None or fa is not None and fa <= fb
        s = ahead if forward else back
        _, _, node = heapq.heappop(s.heap)
        s.settled.add(node)
        (i, q), (cost, audit) = node, s.labels[node]
        if forward:
            moves = [((i, to), c, letter) for letter, c, to in insert_edges(q)]
            if i < n:
                moves += [((i + 1, to), c, letter) for letter, c, to in row_edges(q, *rows[i])]
        else:
            moves = [((i, p), c, letter) for p, to, c, letter in ins if to == q]
            if i:
                if i not in into:
                    into[i] = [(p, to, c, letter) for p in range(STATES) for letter, c, to in row_edges(p, *rows[i - 1])]
                moves += [((i - 1, p), c, letter) for p, to, c, letter in into[i] if to == q]
        for to, c, letter in moves:
            label = (cost + c, audit + letter if forward else letter + audit)
            if to not in s.labels or label < s.labels[to]:
                s.labels[to] = label
                heapq.heappush(s.heap, (label[0], to[0] if forward else n - to[0], to))
                cross(to)


def repaired(rows: list[tuple[str, str]], audit: str, state: int = BEGIN) -> list[str]:
    """The lines ``role:text`` after the edits; an edit's letter and the state name the new role."""
    out, at = [], iter(rows)
    role = {USER: "user", ASSISTANT: "assistant"}
    for letter in audit:
        if letter == "I":
            state = USER if (state, "u") in NEXT else ASSISTANT
            out.append(f"{role[state]}:")
            continue
        was, text = next(at)
        if letter == "K":
            state = NEXT[state, was[:1]]
            out.append(f"{was}:{text}")
        elif letter == "R":
            state = USER if (state, "u") in NEXT else ASSISTANT
            out.append(f"{role[state]}:{text}")
    return out
