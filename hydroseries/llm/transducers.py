"""Small weighted finite-state transducers over symbols, and their composition.

A machine reads a symbol, changes its state, writes a symbol and adds a weight.  Machines are
data: states, and arcs (state, symbol) -> (next state, symbol written, weight).  A symbol without an
arc is written as it is, with weight 0, and leads where the arc of ``ELSE`` leads."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

ELSE = "*"


@dataclass
class Machine:
    arcs: dict[tuple, tuple]
    start: object = 0
    weight: float = 0.0

    def step(self, state, symbol):
        """(next state, symbol written, weight)."""
        arc = self.arcs.get((state, symbol))
        if arc is None:
            nxt, _, w = self.arcs.get((state, ELSE), (state, None, 0.0))
            return nxt, symbol, w
        return arc

    def run(self, symbols: Iterable) -> tuple[list, float]:
        """Symbols written and the sum of the weights."""
        state, out, total = self.start, [], 0.0
        for s in symbols:
            state, o, w = self.step(state, s)
            out.append(o)
            total += w
        return out, total


@dataclass
class Composed:
    """First ``a``, then ``b`` on what ``a`` writes.  The product's arcs are made when a pair of states is first reached."""
    a: Machine | Composed
    b: Machine | Composed
    arcs: dict = field(default_factory=dict)

    @property
    def start(self):
        return self.a.start, self.b.start

    def step(self, state, symbol):
        arc = self.arcs.get((state, symbol))
        if arc is None:
            sa, mid, wa = self.a.step(state[0], symbol)
            sb, out, wb = self.b.step(state[1], mid)
            arc = self.arcs[state, symbol] = ((sa, sb), out, wa + wb)
        return arc

    run = Machine.run


def compose(machines: Iterable[Machine]):
    """The machines one after another, as one."""
    whole = None
    for m in machines:
        whole = m if whole is None else Composed(whole, m)
    return whole


def scope(triggers: Iterable[str], rewrite: Mapping[str, str], reach: int | None, weights: Mapping[str, float] | None = None) -> Machine:
    """A machine that, for ``reach`` symbols after a trigger (None: to the end), writes ``rewrite[s]`` for s and adds
    ``weights[s]``.  States count the symbols still in reach."""
    arcs: dict[tuple, tuple] = {}
    states = range((reach or 1) + 1)
    for left in states:
        after = left if reach is None else max(0, left - 1)
        arcs[left, ELSE] = (after, None, 0.0)
        for s, o in rewrite.items():
            arcs[left, s] = (after, o, (weights or {}).get(s, 0.0)) if left else (0, s, 0.0)
        for t in triggers:  # a trigger may itself be rewritten by the one before it
            _, o, w = arcs.get((left, t), (None, t, 0.0))
            arcs[left, t] = (reach or 1, o, w)
    return Machine(arcs)
