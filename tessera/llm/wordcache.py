"""Bounded caches from a word to what a tokenizer makes of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import compress, repeat
from operator import is_


class WordCache:
    """word -> value, in two generations.

    When the young generation is half of what may be kept, it becomes the old
    one, and what was old and not asked for since is gone.  So common words are
    never learned again, rare ones leave, and memory stays bounded; what is
    returned does not depend on what is kept.
    """

    def __init__(self, encode: Callable[[list], list], most: int = 700_000, longest: int = 200):
        self.encode, self.most, self.longest = encode, most, longest
        self.young: dict = {}
        self.old: dict = {}

    def known(self, lists: Iterable[list]) -> dict:
        """The words of all lists with their values.  Words longer than longest are not kept."""
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}
        words = list(set().union(*lists))
        values = list(map(self.young.get, words))
        out = dict(zip(words, values, strict=True))
        lacking = list(compress(words, map(is_, values, repeat(None))))
        if lacking:
            new = [w for w in lacking if w not in self.old]
            found = {w: self.old[w] for w in lacking if w in self.old} if len(new) < len(lacking) else {}
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                found.update(zip(part, self.encode(part), strict=True))
            out.update(found)
            self.young.update(found if all(len(w) <= self.longest for w in new) else {w: v for w, v in found.items() if len(w) <= self.longest})
        return out
