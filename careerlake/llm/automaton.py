"""Rule regexes as one deterministic automaton over bytes.

A small regex syntax (literals, classes, groups, alternation, `?`, `*`, `+`, `{n}`, `(?i:...)`) becomes a nondeterministic automaton;
subset construction makes it deterministic, Moore's partition refinement minimises it, and what stays is a transition array over
classes of bytes that no rule tells apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class Nfa:
    """States are numbers; moves[s] has (set of bytes, target), empty[s] has targets without a byte."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


# Trees: ("set", bytes), ("cat", [..]), ("or", [..]), ("?"|"*"|"+", tree)
def parse(pattern: str) -> tuple:
    at, loose = 0, False

    def look() -> str:
        return pattern[at] if at < len(pattern) else ""

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord(c)

    def any_case(found: set[int]) -> frozenset:
        if loose:
            found |= {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
        return frozenset(found)

    def one() -> tuple:
        nonlocal at, loose
        c = look()
        if c == "(":
            at += 1
            before = loose
            if pattern.startswith("?i:", at):
                at, loose = at + 3, True
            tree = either()
            at, loose = at + 1, before
        elif c == "[":
            at += 1
            found: set[int] = set()
            while look() != "]":
                low = char()
                if look() == "-" and pattern[at + 1] != "]":
                    at += 1
                    found |= set(range(low, char() + 1))
                else:
                    found.add(low)
            at += 1
            tree = ("set", any_case(found))
        else:
            tree = ("set", any_case({char()}))
        while look() and look() in "?*+{":
            if look() == "{":
                end = pattern.index("}", at)
                tree = ("cat", [tree] * int(pattern[at + 1 : end]))
                at = end + 1
            else:
                tree = (look(), tree)
                at += 1
        return tree

    def row() -> tuple:
        parts = []
        while look() and look() not in "|)":
            parts.append(one())
        return ("cat", parts)

    def either() -> tuple:
        nonlocal at
        rows = [row()]
        while look() == "|":
            at += 1
            rows.append(row())
        return rows[0] if len(rows) == 1 else ("or", rows)

    tree = either()
    if at != len(pattern):
        raise ValueError(f"unexpected {pattern[at]!r} at {at}")
    return tree


def turned(tree: tuple) -> tuple:
    """The tree of the reversed words."""
    kind, inner = tree
    if kind == "set":
        return tree
    if kind in ("cat", "or"):
        parts = [turned(x) for x in inner]
        return kind, parts[::-1] if kind == "cat" else parts
    return kind, turned(inner)


def build(nfa: Nfa, tree: tuple, start: int) -> int:
    """Adds the tree behind start; the state where it ends."""
    kind, inner = tree
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((inner, end))
        return end
    if kind == "cat":
        for x in inner:
            start = build(nfa, x, start)
        return start
    end = nfa.state()
    if kind == "or":
        for x in inner:
            nfa.empty[build(nfa, x, start)].append(end)
        return end
    head = nfa.state()
    nfa.empty[start].append(head)
    tail = build(nfa, inner, head)
    nfa.empty[tail].append(end)
    if kind in "?*":
        nfa.empty[start].append(end)
    if kind in "*+":
        nfa.empty[tail].append(head)
    return end


@dataclass(frozen=True)
class Dfa:
    """next[state * width + class of byte]; states from `accepting` on accept, the rules of state s being rules[s - accepting].

    State 0 is the start. With an anchored automaton state 1 is dead.
    """

    classes: bytes
    width: int
    next: np.ndarray
    accepting: int
    rules: tuple[tuple[int, ...], ...]


def compiled(trees: list[tuple], anchored: bool) -> Dfa:
    """The automaton of all rules; not anchored: matches may start anywhere."""
    nfa = Nfa()
    start = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[start].append(first)
        ends[build(nfa, tree, first)] = k
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {k: i for i, k in enumerate(dict.fromkeys(signature))}
    sample = {kinds[k]: b for b, k in reversed(list(enumerate(signature)))}
    width = len(kinds)

    first = nfa.closure([start])
    number, order, table = {first: 0}, [first], []
    by_kind = [[[t for s, t in moves if sample[c] in s] for c in range(width)] for moves in nfa.moves]
    for states in order:
        row = []
        for c in range(width):
            target = {t for s in states for t in by_kind[s][c]}
            reached = nfa.closure(target | (set() if anchored else {start}))
            if reached not in number:
                number[reached] = len(order)
                order.append(reached)
            row.append(number[reached])
        table.append(row)
    accepts = [tuple(sorted(ends[s] for s in states if s in ends)) for states in order]

    step = np.array(table)
    names = {k: i for i, k in enumerate(dict.fromkeys(accepts))}
    part = np.array([names[a] for a in accepts])
    while True:  # refine until no state differs from its block in where its moves lead
        finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    blocks = sorted(range(int(part.max()) + 1), key=lambda b: (bool(accepts[int((part == b).argmax())]), b != part[0]))
    place = {b: i for i, b in enumerate(blocks)}
    member = [int((part == b).argmax()) for b in blocks]
    lines = [[place[int(part[t])] * width for t in table[m]] for m in member]
    accepting = next((i for i, m in enumerate(member) if accepts[m]), len(member))
    classes = bytes(kinds[k] for k in signature)
    return Dfa(classes, width, np.array(lines, np.int32).ravel(), accepting, tuple(accepts[m] for m in member[accepting:]))


#: With fewer texts than this left, they are scanned one by one.
LANES = 12


def scan(dfa: Dfa, texts: list[bytes], steady: frozenset[int] = frozenset()) -> list[list[tuple[int, int]]]:
    """Of each text, (end, state) wherever the automaton accepts, of those in steady the first of several in a row for the same rules; one pass over each byte.

    The texts go side by side, a byte of each at a step, longest first, so that a step is three array operations.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(t.translate(dfa.classes) for t in texts) or b"\0", np.uint8)
    first = (np.cumsum(sizes) - sizes)[order]
    longest = sizes[order]
    state = np.zeros(len(texts), np.int32)
    limit, step = dfa.accepting * dfa.width, dfa.next
    once = {s * dfa.width: dfa.rules[s - dfa.accepting] for s in steady}
    at = 0
    lanes = len(texts)
    while lanes >= LANES:
        until = int(longest[lanes - 1])
        place = first[:lanes] + at
        now = state[:lanes]
        while at < until:
            before, now = now, step[now + data[place]]
            at += 1
            place += 1
            if now.max() >= limit:
                for k in np.flatnonzero(now >= limit).tolist():
                    rules = once.get(int(now[k]))
                    if rules is None or rules != once.get(int(before[k])):
                        out[order[k]].append((at, int(now[k]) // dfa.width))
        state[:lanes] = now
        while lanes and longest[lanes - 1] <= at:
            lanes -= 1
    moves = step.tolist() if lanes else []
    for k in range(lanes):
        s, found = int(state[k]), out[order[k]]
        for i, c in enumerate(data[first[k] + at : first[k] + longest[k]].tobytes(), at + 1):
            before, s = s, moves[s + c]
            if s >= limit and (s not in once or once[s] != once.get(before)):
                found.append((i, s // dfa.width))
    return out


def dead(dfa: Dfa) -> frozenset[int]:
    """States that lead nowhere else and don't accept."""
    rows = dfa.next.reshape(-1, dfa.width)
    return frozenset(s * dfa.width for s in range(dfa.accepting) if (rows[s] == s * dfa.width).all())
