"""Regular expressions over bytes as one minimal deterministic automaton.

The accepted syntax: literals, ``\\xHH`` and escaped characters, classes ``[...]`` with ranges, groups,
``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}`` and ``{n,m}``, all over ASCII.
"""

from __future__ import annotations

import numpy as np

Node = tuple  # ("set", bytes) | ("cat", nodes) | ("or", nodes) | ("rep", node, least, most or None)


def parse(pattern: str) -> Node:
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
            c = {"n": "\n", "t": "\t", "r": "\r"}.get(c, c)
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def klass() -> Node:
        nonlocal at
        negated = pattern[at] == "^"
        at += negated
        chosen: set[int] = set()
        while pattern[at] != "]":
            lo = hi = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                hi = char()
            chosen |= set(range(lo, hi + 1))
        at += 1
        return ("set", frozenset(set(range(256)) - chosen if negated else chosen))

    def atom() -> Node:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            node = either()
            if at >= len(pattern) or pattern[at] != ")":
                raise ValueError("a group isn't closed")
            at += 1
        elif pattern[at] == "[":
            at += 1
            node = klass()
        else:
            node = ("set", frozenset([char()]))
        while at < len(pattern) and pattern[at] in "?*+{":
            if pattern[at] == "{":
                close = pattern.index("}", at)
                lo, comma, hi = pattern[at + 1 : close].partition(",")
                at = close + 1
                node = ("rep", node, int(lo), (int(hi) if hi else None) if comma else int(lo))
            else:
                node = ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]])
                at += 1
        return node

    def either() -> Node:
        nonlocal at
        options: list[Node] = []
        while True:
            parts: list[Node] = []
            while at < len(pattern) and pattern[at] not in "|)":
                parts.append(atom())
            options.append(("cat", parts))
            if at < len(pattern) and pattern[at] == "|":
                at += 1
                continue
            return options[0] if len(options) == 1 else ("or", options)

    node = either()
    if at != len(pattern):
        raise ValueError(f"left over: {pattern[at:]}")
    return node


def backwards(node: Node) -> Node:
    """The expression of the reversed strings."""
    if node[0] == "cat":
        return ("cat", [backwards(x) for x in reversed(node[1])])
    if node[0] == "or":
        return ("or", [backwards(x) for x in node[1]])
    return ("rep", backwards(node[1]), *node[2:]) if node[0] == "rep" else node


class Automaton:
    """Of several expressions; ``anywhere`` lets a match begin at each byte.

    ``table[state * width + klass[byte]]`` is the next state, state 0 the first, and bit r of
    ``accepts[state]`` says that expression r ends here. Symbol class ``width - 1`` stands between texts
    and leads back to state 0. ``dead`` is the state without any continuation, or -1.
    """

    def __init__(self, nodes: list[Node], anywhere: bool):
        self.free: list[list[int]] = []  # moves without a byte
        self.step: list[list[tuple[frozenset, int]]] = []
        begins = self._new()
        ends = {}
        for r, node in enumerate(nodes):
            first, last = self._build(node)
            self.free[begins].append(first)
            ends[last] = r
        self._classes()
        self._subsets(begins, ends, anywhere)
        self._minimise()
        del self.free, self.step

    def _new(self) -> int:
        self.free.append([])
        self.step.append([])
        return len(self.free) - 1

    def _build(self, node: Node) -> tuple[int, int]:
        first = last = self._new()
        if node[0] == "set":
            last = self._new()
            self.step[first].append((node[1], last))
        elif node[0] == "cat":
            for x in node[1]:
                a, b = self._build(x)
                self.free[last].append(a)
                last = b
        elif node[0] == "or":
            last = self._new()
            for x in node[1]:
                a, b = self._build(x)
                self.free[first].append(a)
                self.free[b].append(last)
        else:
            _, x, least, most = node
            for _ in range(least):
                a, b = self._build(x)
                self.free[last].append(a)
                last = b
            if most is None:
                a, b = self._build(x)
                self.free[last].append(a)
                self.free[b].append(a)
                end = self._new()
                self.free[last].append(end)
                self.free[b].append(end)
                last = end
            else:
                end = self._new()
                for _ in range(most - least):
                    self.free[last].append(end)
                    a, b = self._build(x)
                    self.free[last].append(a)
                    last = b
                self.free[last].append(end)
                last = end
        return first, last

    def _classes(self) -> None:
        """Bytes that no set tells apart share a class."""
        sets = list(dict.fromkeys(s for moves in self.step for s, _ in moves))
        signs = [tuple(b in s for s in sets) for b in range(256)]
        number = {sign: i for i, sign in enumerate(dict.fromkeys(signs))}
        self.klass = np.array([number[s] for s in signs], np.int32)
        self.width = len(number) + 1
        example = {number[s]: b for b, s in enumerate(signs)}
        self.example = [example[i] for i in range(len(number))]

    def _closed(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def _subsets(self, begins: int, ends: dict[int, int], anywhere: bool) -> None:
        start = self._closed({begins})
        number, todo, rows, accepts = {start: 0}, [start], [], []
        for states in todo:
            row = []
            for b in self.example:
                to = {t for s in states for chosen, t in self.step[s] if b in chosen}
                nxt = self._closed(to | ({begins} if anywhere else set()))
                if nxt not in number:
                    number[nxt] = len(todo)
                    todo.append(nxt)
                row.append(number[nxt])
            rows.append([*row, 0])
            accepts.append(sum(1 << r for s, r in ends.items() if s in states))
        self.table, self.accepts = np.array(rows, np.int32), np.array(accepts, np.int64)

    def _minimise(self) -> None:
        """Refine the states' classes, from what they accept, until no symbol tells two of a class apart."""
        _, block = np.unique(self.accepts, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([block, block[self.table]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        order = np.unique(block, return_index=True)[1]
        new = np.argsort(np.argsort(order))  # the first state's class is 0
        block = new[block]
        pick = np.sort(order)
        table = block[self.table[pick]].astype(np.int32)
        self.accepts = self.accepts[pick]
        loops = (table[:, :-1] == np.arange(len(table))[:, None]).all(axis=1) & (self.accepts == 0)
        self.dead = int(np.flatnonzero(loops)[0]) if loops.any() else -1
        self.states, self.table = len(table), table.ravel()

    def longest(self, data: bytes) -> int:
        """The end of the longest match of any expression at the beginning of ``data``, or -1."""
        end = self.run(data, 0, -1, 0)[1]
        return end if end else 0 if self.accepts[0] else -1

    def run(self, data: bytes, state: int, ends: int, marks: int) -> tuple[int, int, list[int]]:
        """From a state over some bytes: the state then, or -1 once nothing can follow; after how many bytes an
        expression of ``ends`` last ended, or 0; and after how many each of ``marks`` did."""
        table, klass, width, accepts, dead = self.rows()
        end, marked = 0, []
        for i, b in enumerate(data, 1):
            state = table[state * width + klass[b]]
            if state == dead:
                return -1, end, marked
            if accepts[state] & ends:
                end = i
            if accepts[state] & marks:
                marked.append(i)
        return state, end, marked

    def rows(self):
        if not hasattr(self, "_rows"):
            self._rows = self.table.tolist(), self.klass.tolist(), self.width, self.accepts.tolist(), self.dead
        return self._rows

    def states_after(self, symbols: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """The state after each symbol class, read from the right end to the left in one pass.

        The symbols are cut into lanes that move in step. A lane begins in state 0 and is run again, from
        its right neighbour's last state, only until it falls in with what it had.
        """
        n = len(symbols)
        long = max(1, -(-n // lanes))
        wide = -(-n // long) if n else 0
        padded = np.full(wide * long, self.width - 1, np.int32)
        padded[:n] = symbols
        by_step = np.ascontiguousarray(padded.reshape(wide, long).T)
        out = np.zeros((long, wide), np.int32)
        state = np.zeros(wide, np.int32)
        for i in range(long - 1, -1, -1):
            state = self.table[state * self.width + by_step[i]]
            out[i] = state
        begun = np.zeros(wide, np.int32)
        while wide:
            right = np.concatenate([out[0, 1:], [0]])
            todo = np.flatnonzero(right != begun)
            if not len(todo):
                break
            begun[todo] = right[todo]
            state = right[todo]
            for i in range(long - 1, -1, -1):
                state = self.table[state * self.width + by_step[i, todo]]
                apart = state != out[i, todo]
                todo, state = todo[apart], state[apart]
                if not len(todo):
                    break
                out[i, todo] = state
        return out.T.ravel()[:n]
