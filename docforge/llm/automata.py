"""Byte automata from regular expressions: position sets, subset construction, minimisation."""

from __future__ import annotations

import re._constants as codes
import re._parser as parser
from dataclasses import dataclass

ALL = frozenset(range(256))


@dataclass(frozen=True)
class Automaton:
    """``table[state * classes + class_of[byte]]`` is the next state times ``classes``; states from
    ``first_accepting`` on accept, and ``accepts`` gives the rules of a state (by position, as bits)."""

    class_of: bytes
    classes: int
    table: list[int]
    start: int
    first_accepting: int
    accepts: dict[int, int]
    dead: int


class _Builder:
    """A nondeterministic automaton with empty moves; patterns may be built backwards."""

    def __init__(self, backwards: bool):
        self.backwards = backwards
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def sequence(self, items, at: int, any_case: bool) -> int:
        for item in reversed(list(items)) if self.backwards else items:
            at = self.item(item, at, any_case)
        return at

    def item(self, item, at: int, any_case: bool) -> int:
        kind, value = item
        if kind is codes.SUBPATTERN:
            _, added, removed, inner = value
            if removed:
                raise ValueError("flags can't be removed")
            return self.sequence(inner, at, any_case or bool(added & 2))
        if kind is codes.BRANCH:
            end = self.state()
            for inner in value[1]:
                start = self.state()
                self.empty[at].append(start)
                self.empty[self.sequence(inner, start, any_case)].append(end)
            return end
        if kind is codes.MAX_REPEAT:
            least, most, inner = value
            for _ in range(least):
                at = self.sequence(inner, at, any_case)
            if most is codes.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.sequence(inner, loop, any_case)].append(loop)
                return loop
            end = self.state()
            for _ in range(most - least):
                self.empty[at].append(end)
                at = self.sequence(inner, at, any_case)
            self.empty[at].append(end)
            return end
        after = self.state()
        self.moves[at].append((_bytes_of(kind, value, any_case), after))
        return after

    def closure(self, states) -> frozenset:
        seen, open_ = set(states), list(states)
        while open_:
            for after in self.empty[open_.pop()]:
                if after not in seen:
                    seen.add(after)
                    open_.append(after)
        return frozenset(seen)


def _bytes_of(kind, value, any_case: bool) -> frozenset:
    """The bytes that one item of a pattern matches; patterns are ASCII."""
    if kind is codes.LITERAL:
        found = {value}
    elif kind is codes.IN:
        negate = value[0][0] is codes.NEGATE
        found = set()
        for inner, x in value[negate:]:
            found |= set(range(x[0], x[1] + 1)) if inner is codes.RANGE else {x} if inner is codes.LITERAL else _unknown(inner)
        if negate:
            return ALL - found
    elif kind is codes.ANY:
        return ALL - {10}
    else:
        _unknown(kind)
    if any_case:
        found |= {ord(chr(x).swapcase()) for x in found if chr(x).isascii() and chr(x).isalpha()}
    if max(found, default=0) > 127:
        raise ValueError("patterns are ASCII")
    return frozenset(found)


def _unknown(kind):
    raise ValueError(f"no automaton for {kind}")


def compile_rules(patterns: list[str], backwards: bool = False, anywhere: bool = False) -> Automaton:
    """One minimal deterministic automaton for all patterns.

    ``backwards`` reads matches from their last byte; ``anywhere`` lets a match begin at any byte, so
    that an accepting state says which rules have a match that ends here.
    """
    build = _Builder(backwards)
    start = build.state()
    ends = {}
    for position, pattern in enumerate(patterns):
        first = build.state()
        build.empty[start].append(first)
        ends[build.sequence(parser.parse(pattern), first, False)] = 1 << position
    if anywhere:
        build.moves[start].append((ALL, start))

    sets = {found for moves in build.moves for found, _ in moves}
    signature: dict[tuple, int] = {}
    class_of = bytes(signature.setdefault(tuple(byte in found for found in sets), len(signature)) for byte in range(256))
    width = len(signature)
    example = {kind: byte for byte, kind in enumerate(class_of)}

    subsets = {build.closure([start]): 0}
    order, rows = list(subsets), []
    for subset in order:
        row = []
        for kind in range(width):
            after = build.closure({to for at in subset for found, to in build.moves[at] if example[kind] in found})
            if after not in subsets:
                subsets[after] = len(order)
                order.append(after)
            row.append(subsets[after])
        rows.append(row)
    masks = [sum({ends[at] for at in subset if at in ends}) for subset in order]
    return _minimal(rows, masks, width, class_of)


def _minimal(rows, masks, width, class_of) -> Automaton:
    """Moore's refinement: states are equal while masks and successors are."""
    names: dict = {}
    block = [names.setdefault(mask, len(names)) for mask in masks]
    while True:
        names = {}
        finer = [names.setdefault((block[at], *[block[to] for to in row]), len(names)) for at, row in enumerate(rows)]
        if len(set(finer)) == len(set(block)):
            break
        block = finer
    kept = {}
    for at, name in enumerate(finer):
        kept.setdefault(name, at)
    ordered = sorted(kept, key=lambda name: (masks[kept[name]] != 0, name))
    number = {name: position for position, name in enumerate(ordered)}
    table = [number[finer[to]] * width for name in ordered for to in rows[kept[name]]]
    accepts = {number[name] * width: masks[kept[name]] for name in ordered if masks[kept[name]]}
    dead = next((number[name] * width for name in ordered if not masks[kept[name]] and all(finer[to] == name for to in rows[kept[name]])), -1)
    return Automaton(class_of, width, table, number[finer[0]] * width, min(accepts, default=len(table)), accepts, dead)
