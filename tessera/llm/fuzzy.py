"""A lexicon trie intersected with Levenshtein automata, determinised as words are read.

A state is a set of (trie node, errors so far): every term of the lexicon runs
its own automaton, and common prefixes run once. The sets that occur are
interned and their transitions cached, so a word costs a dictionary look-up
per character, and most words die after a few. When there are ``MAX_STATES``,
all are forgotten and found anew, which bounds memory and changes no result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

#: About a kilobyte each.
MAX_STATES = 1 << 16


class _State:
    __slots__ = ("pairs", "next", "found", "stem")

    def __init__(self, pairs: bytes, found: tuple[int, str] | None, stem: str | None):
        self.pairs, self.found, self.stem = pairs, found, stem
        self.next: dict[str, _State | None] = {}


def budget(term: str) -> int:
    """Errors allowed: none in terms of up to 4 letters, one from 5, two from 9."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """The trie is lists by node number; a state's (node, errors) pairs are sorted numbers, four to a node."""

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = ()):
        self._children: list[dict[str, int]] = [{}]
        self._below, self._term, self._stem = [0], [None], [None]
        self.alphabet: set[str] = set()
        for text, is_stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            node, k = 0, 0 if is_stem else budget(text)
            self.alphabet.update(text)
            self._below[0] = max(self._below[0], k)
            for c in text:
                if c not in self._children[node]:
                    self._children[node][c] = len(self._children)
                    self._children.append({})
                    for column, empty in ((self._below, 0), (self._term, None), (self._stem, None)):
                        column.append(empty)
                node = self._children[node][c]
                self._below[node] = max(self._below[node], k)
            (self._stem if is_stem else self._term)[node] = text
        self._forget()

    def _forget(self) -> None:
        self._states: dict[bytes, _State] = {}
        self._start = self._state({0})

    def _state(self, pairs: set[int]) -> _State:
        todo = list(pairs)
        while todo:  # letters of a term that the word leaves out
            pair = todo.pop()
            e = pair & 3
            for child in self._children[pair >> 2].values():
                if e < self._below[child] and (more := child << 2 | e + 1) not in pairs:
                    pairs.add(more)
                    todo.append(more)
        key = array("i", sorted(pairs)).tobytes()
        if key not in self._states:
            ends = [(p & 3, self._term[p >> 2]) for p in pairs if self._term[p >> 2] is not None]
            stems = [self._stem[p >> 2] for p in pairs if not p & 3 and self._stem[p >> 2] is not None]
            self._states[key] = _State(key, min((x for x in ends if x[0] <= budget(x[1])), default=None), min(stems, default=None))
        return self._states[key]

    def _step(self, state: _State, c: str) -> _State | None:
        pairs = set()
        for pair in array("i", state.pairs):
            node, e = pair >> 2, pair & 3
            children = self._children[node]
            if c in children:
                pairs.add(children[c] << 2 | e)
            if e < self._below[node]:
                pairs.add(pair + 1)  # a letter too many
                for child in children.values():  # another letter
                    if e < self._below[child]:
                        pairs.add(child << 2 | e + 1)
        return self._state(pairs) if pairs else None

    def match(self, word: str) -> tuple[str, int] | None:
        """The term with fewest errors, or the stem that begins the word, and the number of errors."""
        if len(self._states) > MAX_STATES:
            self._forget()
        state, alphabet = self._start, self.alphabet
        for c in word:
            if c not in alphabet:
                c = ""
            try:
                state = state.next[c]
            except KeyError:
                state.next[c] = state = self._step(state, c)
            if state is None:
                return None
            if state.stem is not None:
                return state.stem, 0
        return (state.found[1], state.found[0]) if state.found else None
