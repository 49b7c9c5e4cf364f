"""A bounded cache for values of words, which most texts share."""

from __future__ import annotations

from collections.abc import Callable


class Kept(dict):
    """Looks up `make(key)`; holds at most twice `room` entries, the ones used last.

    Entries live in two halves. A full half becomes the old one, and what is used from it comes back.
    """

    def __init__(self, make: Callable, room: int) -> None:
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, key):
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:  # long keys seldom come back
            self[key] = value
        return value
