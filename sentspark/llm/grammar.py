"""Weighted finite-state transducers over word classes.

A clause is a string of class symbols.  Each transducer reads it once and ends
with a mark; ``compose`` runs several in lock step as one automaton whose
states are the reachable combinations, so a clause costs one table lookup a
word however many transducers take part.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass

#: The alphabet.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = 6


@dataclass(frozen=True)
class Transducer:
    """``step(state, symbol) -> state`` from ``start``; ``mark(state)`` at the clause's end."""

    start: Hashable
    step: Callable[[Hashable, int], Hashable]
    mark: Callable[[Hashable], int]


def insults(most: int = 3) -> Transducer:
    """How many insults, ``most`` at most."""
    return Transducer(0, lambda s, x: min(most, s + (x == INSULT)), lambda s: s)


def threats() -> Transducer:
    """Whether a threat is aimed at somebody: a target after it or before it."""
    def step(s, x):
        seen, aimed, target = s
        target = target or x == TARGET
        seen = seen or x == THREAT
        return seen, seen and target, target
    return Transducer((False, False, False), step, lambda s: int(s[1]))


def targets(reach: int = 4) -> Transducer:
    """Whether a target stands within ``reach`` words of an insult, either way."""
    def step(s, x):
        hit, since_target, since_insult = s
        since_target = 0 if x == TARGET else min(reach + 1, since_target + 1)
        since_insult = 0 if x == INSULT else min(reach + 1, since_insult + 1)
        near = (x == TARGET and since_insult <= reach) or (x == INSULT and since_target <= reach)
        return hit or near, since_target, since_insult
    return Transducer((False, reach + 1, reach + 1), step, lambda s: int(s[0]))


def negations(reach: int = 3) -> Transducer:
    """Whether every insult or threat has a negation at most ``reach`` words before it."""
    def step(s, x):
        plain, negated, since = s
        since = 0 if x == NEGATION else min(reach + 1, since + 1)
        if x in (INSULT, THREAT):
            negated, plain = negated or since <= reach, plain or since > reach
        return plain, negated, since
    return Transducer((False, False, reach + 1), step, lambda s: int(s[1] and not s[0]))


def reports() -> Transducer:
    """Whether the insults or threats come after a verb of saying."""
    def step(s, x):
        said, inside = s
        if x in (INSULT, THREAT) and said:
            inside = True
        return said or x == REPORT, inside
    return Transducer((False, False), step, lambda s: int(s[1]))


class Automaton:
    """The composition: ``table[state][symbol]`` and ``marks[state]``."""

    def __init__(self, parts: Sequence[Transducer]) -> None:
        start = tuple(p.start for p in parts)
        number = {start: 0}
        todo = [start]
        self.table: list[list[int]] = []
        self.marks: list[tuple[int, ...]] = []
        while todo:
            state = todo.pop(0)
            self.marks.append(tuple(p.mark(s) for p, s in zip(parts, state)))
            row = []
            for x in range(SYMBOLS):
                to = tuple(p.step(s, x) for p, s in zip(parts, state))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            self.table.append(row)

    def run(self, symbols: Sequence[int]) -> tuple[int, ...]:
        state, table = 0, self.table
        for x in symbols:
            state = table[state][x]
        return self.marks[state]


def compose() -> Automaton:
    """Insults, aimed threats, targets, negation and reported speech together."""
    return Automaton([insults(), threats(), targets(), negations(), reports()])
