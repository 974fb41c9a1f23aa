"""Values of words, such as their ids by a library's tokenizer, for texts that are cut where no token crosses.

Words come again and again, so the library sees those of a batch that were not seen lately, once each.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Callable

import numpy as np

#: words kept at most, and the longest that are kept (characters)
MOST, LONGEST = 400_000, 64
#: A mark after one of these letters begins a pre-token in tokenizers that tell letters from other signs.  İ is none of the
#: letters, since its lower case ends in a combining mark.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", ".,!?;:#*&%"


class Words:
    """make: values of a list of words."""

    def __init__(self, make: Callable[[list[str]], list], most: int = MOST):
        self.make, self.most, self.known = make, most, {}

    def values(self, words: list[str]) -> list:
        new = list(set(words).difference(self.known))
        if len(new) + len(self.known) > self.most:
            self.known.clear()
            new = list(set(words))
        if new:
            self.known.update(zip(new, self.make(new)))
        out = list(map(self.known.__getitem__, words))
        for word in new:
            if len(word) > LONGEST:
                del self.known[word]
        return out


class Known(dict):
    """make: the value of a word, which is made when the word is looked up and not known.

    Words are kept in two halves.  When the newer one is full it becomes the older one; of the older one before, the words
    that were not looked up since are forgotten.
    """

    def __init__(self, make: Callable[[str], bytes], most: int = 2 * MOST):
        super().__init__()
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, word: str) -> bytes:
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


def code(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def flat(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids by word)."""
    return np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), np.int64, len(codes)) // 4


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values of these sizes, empty ones too."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def tokenizer(path: str):
    """The library's tokenizer, in one thread: Spark has a task for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
