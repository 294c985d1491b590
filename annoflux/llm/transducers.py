"""Small weighted transducers over the tropical semiring: composition and shortest paths.

Arcs read one symbol and write one, so composing two machines pairs their states. Machines are
a handful of states each; they are compiled once in a process and run over short sequences.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterable

State = Hashable
Symbol = Hashable


class Transducer:
    """Arcs ``(state, read) -> [(write, weight, state)]`` with final weights; a state without a final weight doesn't accept."""

    def __init__(self, start: State, arcs: dict[tuple[State, Symbol], list[tuple[Symbol, float, State]]], final: dict[State, float]):
        self.start, self.arcs, self.final = start, arcs, final

    def after(self, other: Transducer, symbols: Iterable[Symbol]) -> Transducer:
        """The composition that feeds what ``other`` writes to this machine; only reachable states are made."""
        symbols = list(symbols)
        start = (other.start, self.start)
        arcs, final, todo, seen = {}, {}, [start], {start}
        while todo:
            state = todo.pop()
            theirs, mine = state
            if theirs in other.final and mine in self.final:
                final[state] = other.final[theirs] + self.final[mine]
            for symbol in symbols:
                out = [
                    (write, w1 + w2, (next1, next2))
                    for between, w1, next1 in other.arcs.get((theirs, symbol), ())
                    for write, w2, next2 in self.arcs.get((mine, between), ())
                ]
                if out:
                    arcs[state, symbol] = out
                    fresh = [to for _, _, to in out if to not in seen]
                    seen.update(fresh)
                    todo += fresh
        return Transducer(start, arcs, final)

    def numbered(self) -> Transducer:
        """The same machine with states named by numbers."""
        number: dict[State, int] = {}
        name = lambda s: number.setdefault(s, len(number))
        start = name(self.start)
        arcs = {(name(s), x): [(w, c, name(to)) for w, c, to in out] for (s, x), out in self.arcs.items()}
        return Transducer(start, arcs, {name(s): c for s, c in self.final.items()})

    def least(self, symbols: Iterable[Symbol]) -> float:
        """Weight of the shortest path that reads ``symbols``; infinite without one."""
        costs = {self.start: 0.0}
        for symbol in symbols:
            now: dict[State, float] = {}
            for state, cost in costs.items():
                for _, weight, to in self.arcs.get((state, symbol), ()):
                    if cost + weight < now.get(to, math.inf):
                        now[to] = cost + weight
            costs = now
        return min((cost + self.final[s] for s, cost in costs.items() if s in self.final), default=math.inf)
