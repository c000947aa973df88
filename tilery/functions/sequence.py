"""A sequence that is read from its start, with a look ahead."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any


class Reader:
    """Reads terms one by one. Reading or looking beyond the end raises a TypeError."""

    def __init__(self, terms: Sequence):
        self._terms, self._next = terms, 0

    def at_end(self) -> bool:
        return self._next >= len(self._terms)

    def peek(self) -> Any:
        if self.at_end():
            raise TypeError("no term after the end")
        return self._terms[self._next]

    def get(self) -> Any:
        term = self.peek()
        self._next += 1
        return term

    def next_is(self, wanted: Callable[[Any], bool]) -> bool:
        """Whether there is a next term and it is a wanted one."""
        return not self.at_end() and bool(wanted(self.peek()))

    def skip(self, wanted: Callable[[Any], bool]) -> bool:
        """Passes over the next term if it is a wanted one, and says whether it did."""
        found = self.next_is(wanted)
        self._next += found
        return found
