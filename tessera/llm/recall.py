"""A bounded memory of values by key, for work that repeats words."""

from __future__ import annotations


class Recall(dict):
    """Values by key in two generations of at most `most` each.

    When the young one is full it becomes the old one; what is asked for again
    moves back, so frequent keys stay and rare ones go.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 100:
            self[key] = value

    def keep(self, found: dict) -> None:
        """Take many values at once; the young generation may outgrow `most` by these."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self.update(found)

    def work(self, key):
        raise KeyError(key)

    def lacks(self, keys: set) -> set:
        """Those of keys that are in neither generation; from here on the others are young.

        The young generation may outgrow `most` by these keys until the next call.
        """
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        new = keys.difference(self)
        again = self.old.keys() & new
        self.update({key: self.old[key] for key in again})
        return new - again
