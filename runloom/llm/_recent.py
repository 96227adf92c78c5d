"""A table of bounded size that remembers what was made for recent keys."""

from __future__ import annotations


class Recent(dict):
    """Makes what it lacks with make(); holds at most twice ``limit`` keys.

    When ``limit`` new keys are in, they become the old generation and the old one goes; what is asked for again comes back, so
    frequent keys stay.
    """

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def make(self, key):  # noqa: ANN001, ANN201
        raise NotImplementedError

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:  # noqa: ANN001
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
