"""Longest-match word pieces by a trie with failure links.

The trie holds the vocabulary twice under two roots: entries that start a word, and entries that go on in one (their
``##`` taken off).  A node that is no entry knows which pieces its string breaks into when it cannot be extended, and
the node that its rest leads to, so a word is cut in time linear in its length, however long the entries are.  Where
no entry matches, one character is a piece.
"""

from __future__ import annotations

GOES_ON = "##"
_CODES = 0x110000


class PieceTrie:
    def __init__(self, tokens):
        #: (node, character) -> node, as one table; node 0 begins a word, node 1 goes on in one
        self.step: dict[int, int] = {}
        self._parent, self._letter, self._depth, entry = [-1, -1], ["", ""], [0, 0], [False, False]
        for t in tokens:
            for root, text in ((0, t), (1, t[len(GOES_ON):] if t.startswith(GOES_ON) else "")):
                if text:
                    node = self._add(root, text, entry)
                    entry[node] = True
        #: the pieces that a node's string gives when it cannot be extended (shared pairs), and the node of its rest
        self.pieces_of: list = [None] * len(entry)
        self.rest: list[int] = [1] * len(entry)
        self._link(entry)
        del self._parent, self._letter, self._depth

    def _add(self, node: int, text: str, entry: list[bool]) -> int:
        for c in text:
            key = node * _CODES + ord(c)
            nxt = self.step.get(key)
            if nxt is None:
                nxt = self.step[key] = len(entry)
                self._parent.append(node)
                self._letter.append(c)
                self._depth.append(self._depth[node] + 1)
                entry.append(False)
            node = nxt
        return node

    def _link(self, entry: list[bool]) -> None:
        """Shortest strings first: a node's pieces are those of its parent, then what the parent's rest gives up until
        it can take the node's character.  Lists are pairs (before, after), so equal beginnings are shared."""
        for v in sorted(range(2, len(entry)), key=self._depth.__getitem__):
            u, c = self._parent[v], self._letter[v]
            if entry[v] or u < 2:  # an entry, or one character: a piece of its own
                self.pieces_of[v] = self._spell(v)
                continue
            held, z = self.pieces_of[u], self.rest[u]
            while (to := self.step.get(z * _CODES + ord(c))) is None and z != 1:
                held, z = (held, self.pieces_of[z]), self.rest[z]
            self.pieces_of[v], self.rest[v] = (held, GOES_ON + c) if to is None else held, to or 1

    def _spell(self, node: int) -> str:
        out = []
        while node > 1:
            out.append(self._letter[node])
            node = self._parent[node]
        return ("" if node == 0 else GOES_ON) + "".join(reversed(out))

    @staticmethod
    def _give(held, out: list[str]) -> None:
        stack = [held]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += (x[1], x[0])

    def pieces(self, word: str) -> list[str]:
        out: list[str] = []
        node, step = 0, self.step
        for c in word:
            o = ord(c)
            while (to := step.get(node * _CODES + o)) is None and node > 1:
                self._give(self.pieces_of[node], out)
                node = self.rest[node]
            if to is None:
                out.append(c if node == 0 else GOES_ON + c)
                node = 1
            else:
                node = to
        while node > 1:
            self._give(self.pieces_of[node], out)
            node = self.rest[node]
        return out
