"""Regular expressions to minimal byte automata: parsing, subset construction, minimisation, transition arrays."""

from __future__ import annotations

import functools

import numpy as np


def parse(pattern: str) -> tuple:
    """Syntax tree of a pattern of literals, escapes, classes, groups, ``|`` and the quantifiers ``? * + {m} {m,} {m,n}``."""
    at = 0

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

    def members() -> frozenset:
        nonlocal at
        negate = pattern[at] == "^"
        at += negate
        out: set[int] = set()
        while pattern[at] != "]":
            low = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                out.update(range(low, char() + 1))
            else:
                out.add(low)
        at += 1
        return frozenset(range(256)) - out if negate else frozenset(out)

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = either()
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            return ("set", members())
        return ("set", frozenset([char()]))

    def repeated() -> tuple:
        nonlocal at
        node = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at:end].partition(",")
                low, high = int(low), (None if high == "" and "," in pattern[at:end] else int(high or low))
                at = end + 1
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("repeat", node, low, high)
        return node

    def row() -> tuple:
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated())
        return ("row", parts)

    def either() -> tuple:
        nonlocal at
        parts = [row()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(row())
        return ("either", parts) if len(parts) > 1 else parts[0]

    return either()


def reverse(node: tuple) -> tuple:
    if node[0] == "set":
        return node
    if node[0] == "repeat":
        return ("repeat", reverse(node[1]), *node[2:])
    return (node[0], [reverse(x) for x in (node[1][::-1] if node[0] == "row" else node[1])])


class Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def add(self, node: tuple, start: int) -> int:
        """Append the node after a state; gives the state that ends it."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.on[start].append((node[1], end))
            return end
        if kind == "row":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "either":
            end = self.state()
            for x in node[1]:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(x, own)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.add(inner, start)
            self.free[start].append(end)
        return end


class Automaton:
    """Minimal and complete. State 0 starts; accepts[s] has bit r set if pattern r ends in state s; states that accept
    come last, from ``accepting`` on. ``table`` has 256 entries a state; ``dead`` is a state that nothing leaves, or -1."""

    def __init__(self, trees: list[tuple], anywhere: bool):
        nfa = Nfa()
        root = nfa.state()
        final = {}
        for r, tree in enumerate(trees):
            own = nfa.state()
            nfa.free[root].append(own)
            final[nfa.add(tree, own)] = r
        if anywhere:
            nfa.on[root].append((frozenset(range(256)), root))

        @functools.cache
        def closure(state: int) -> frozenset:
            seen, todo = {state}, [state]
            while todo:
                for x in nfa.free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        # bytes that no set tells apart form one class
        marks: list[list[int]] = [[] for _ in range(256)]
        for k, own in enumerate({s for on in nfa.on for s, _ in on}):
            for b in own:
                marks[b].append(k)
        kinds = {m: i for i, m in enumerate(dict.fromkeys(map(tuple, marks)))}
        kind = np.array([kinds[tuple(m)] for m in marks])
        lead = [int(np.flatnonzero(kind == i)[0]) for i in range(len(kinds))]

        # subset construction
        first = closure(root)
        names, todo, rows = {first: 0}, [first], []
        while todo:
            own = todo.pop(0)
            moves: list[set[int]] = [set() for _ in lead]
            for s in own:
                for members, to in nfa.on[s]:
                    for i, b in enumerate(lead):
                        if b in members:
                            moves[i] |= closure(to)
            row = []
            for m in map(frozenset, moves):
                if m not in names:
                    names[m] = len(names)
                    todo.append(m)
                row.append(names[m])
            rows.append(row)
        step = np.array(rows)
        accept = np.array([sum(1 << r for r in {final[s] for s in own if s in final}) for own in names], np.int64)

        # minimisation: refine classes until no byte class tells two states of a class apart
        part = np.unique(accept, return_inverse=True)[1]
        while True:
            _, finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == part.max():
                break
            part = finer
        _, sample = np.unique(part, return_index=True)
        order = sorted(range(len(sample)), key=lambda c: (accept[sample[c]] != 0, c != part[0]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sample = sample[order]
        small = rank[part[step[sample]]]
        self.accepts = accept[sample]
        self.start = int(rank[part[0]])
        self.accepting = int((self.accepts == 0).sum())
        self.table = small[:, kind]
        stuck = (self.table == np.arange(len(sample))[:, None]).all(1) & (self.accepts == 0)
        self.dead = int(np.flatnonzero(stuck)[0]) if stuck.any() else -1
        self.flat = (self.table * 256).astype(np.int32).ravel()  # states times 256, so that a byte can be added
        self.rows = None

    def last(self, data: bytes, order: range) -> int:
        """Index into order after the longest match that starts at its first byte, or -1."""
        if self.rows is None:
            self.rows = self.table.tolist()
        state, found = self.start, -1
        for n, i in enumerate(order, 1):
            state = self.rows[state][data[i]]
            if state == self.dead:
                break
            if state >= self.accepting:
                found = n
        return found

    def scan(self, stream: np.ndarray, lane: int = 2048, warm: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Where the automaton accepts in one pass over the bytes, and in which states.

        The stream is cut into lanes that step side by side. A lane starts in the state that a few bytes before it lead
        to; where the lane before it ends in another state, it is run again from that one, until all agree.
        """
        n = len(stream)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = min(lane, n)
        lanes = -(-n // width)
        padded = np.full(warm + lanes * width, 255, np.uint8)
        padded[warm : warm + n] = stream
        view = np.lib.stride_tricks.as_strided(padded, (lanes, warm + width), (width, 1))
        columns = np.ascontiguousarray(view.T)
        limit = self.accepting * 256

        def run(state: np.ndarray, columns: np.ndarray, hits: list | None) -> np.ndarray:
            index = np.empty_like(state)
            for j in range(len(columns)):
                np.add(state, columns[j], out=index)
                np.take(self.flat, index, out=state, mode="clip")
                if hits is not None and state.max() >= limit:
                    at = np.flatnonzero(state >= limit)
                    hits.append((at, np.full(len(at), j), state[at] >> 8))
            return state

        begin = run(np.full(lanes, self.start * 256, np.int32), columns[:warm], None).copy()
        begin[0] = self.start * 256
        hits: list = []
        end = run(begin.copy(), columns[warm:], hits)
        found = [np.concatenate(x) for x in zip(*hits, strict=True)] if hits else [np.zeros(0, np.int64)] * 3
        while True:
            wrong = np.flatnonzero(begin[1:] != end[:-1]) + 1
            if not len(wrong):
                break
            begin[wrong] = end[wrong - 1]
            more: list = []
            end[wrong] = run(begin[wrong].copy(), np.ascontiguousarray(columns[warm:, wrong]), more)
            keep = ~np.isin(found[0], wrong)
            found = [x[keep] for x in found]
            if more:
                again = [np.concatenate(x) for x in zip(*more, strict=True)]
                found = [np.concatenate([x, y]) for x, y in zip(found, (wrong[again[0]], *again[1:]), strict=True)]
        place = found[0].astype(np.int64) * width + found[1]
        order = np.argsort(place, kind="stable")
        order = order[place[order] < n]
        return place[order], found[2][order].astype(np.int64)
