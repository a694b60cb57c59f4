"""What a worker remembers of the words it has met, bounded, and ids of new ones by a library's model."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, compress

import numpy as np

#: Letters of the words that a worker remembers at most beside those of one call; letters of a
#: word that outlasts a thinning.
MAX_LETTERS, LONG = 8_000_000, 64
#: Letters that go through a tokenizer at once; a longer text goes alone.
LETTERS_AT_ONCE = 250_000


def cuts(texts: list[str], limit: int | None = None) -> list[tuple[int, int]]:
    """Ranges of texts of about ``limit`` letters together (default: LETTERS_AT_ONCE)."""
    part = np.cumsum([len(t) for t in texts]) // (limit or LETTERS_AT_ONCE)
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if texts else []
    return list(zip([0, *ends], ends))


def _room(numbers: np.ndarray, n: int) -> np.ndarray:
    """With room for n numbers: seldom copied, as it grows by a quarter at least."""
    return numbers if n <= len(numbers) else np.concatenate([numbers, np.zeros(max(n, len(numbers) * 5 // 4) - len(numbers), numbers.dtype)])


class Lists:
    """Lists of numbers, end to end."""

    def __init__(self):
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.n = self.end = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, end = self.n + len(sizes), self.end + len(flat)
        self.flat, self.starts, self.sizes = _room(self.flat, end), _room(self.starts, n), _room(self.sizes, n)
        self.flat[self.end : end], self.sizes[self.n : n] = flat, sizes
        self.starts[self.n : n] = self.end + np.cumsum(sizes) - sizes
        self.n, self.end = n, end

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of lists, end to end, and how many each has."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(at) else 0)], sizes

    def keep(self, at: np.ndarray) -> None:
        flat, sizes = self.take(at)
        self.n = self.end = 0
        self.add(flat, sizes)


class KnownWords(dict):
    """Numbers words as they are met. ``learn`` takes the words that are new and gives, for each
    of ``lists``, numbers end to end and how many each word has. A word is a string, or a tuple
    of one where it is told apart from the string. Once there are too many, the words met most
    often stay, half of what is allowed."""

    def __init__(self, learn: Callable, lists: int):
        super().__init__()
        self.learn, self.lists = learn, [Lists() for _ in range(lists)]
        self.new: list = []
        self.letters, self.times = 0, np.zeros(0, np.int64)

    def __missing__(self, word) -> int:
        self.new.append(word)
        at = self[word] = len(self)
        return at

    def numbers(self, split: list[list], most: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, end to end, and how many each list has. They hold until the
        next call. ``most``: words that are remembered beside those of this call."""
        if len(self) > most or self.letters > MAX_LETTERS:
            self._thin(most // 2)
        n = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if self.new:
            new, self.new = self.new, []
            self.letters += _all_letters(new)
            for known, got in zip(self.lists, self.learn(new)):
                known.add(*got)
        self.times = _room(self.times, len(self))
        self.times[: len(self)] += np.bincount(at, minlength=len(self))
        return at, n

    def _thin(self, n: int) -> None:
        words = list(self)
        stay = np.sort(np.argsort(-self.times[: len(self)], kind="stable")[:n])
        stay = stay[np.array(_letters(words))[stay] <= LONG]
        for known in self.lists:
            known.keep(stay)
        self.clear()
        self.update((words[i], k) for k, i in enumerate(stay.tolist()))
        self.letters, self.times = _all_letters(list(self)), np.zeros(0, np.int64)


def _letters(words: list) -> list[int]:
    return [len(w) if type(w) is str else len(w[0]) for w in words]


def _all_letters(words: list) -> int:
    return sum(map(len, words)) + sum(len(w[0]) - 1 for w in words if type(w) is not str)


def list_sums(sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the sizes of lists of n."""
    return np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])])


class PieceEncoder:
    """Ids of pieces that the library's split leaves whole: those with nothing that ``other``
    finds go to the file's model alone, spelled in the letters of its byte level, others through
    the whole library."""

    def __init__(self, library, other: re.Pattern):
        from tokenizers.pre_tokenizers import ByteLevel

        self.library, self.other = library, other
        self.tokenize = library.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [c for c in map(chr, range(0x180)) if not other.search(c)]
        self.spelled = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in plain})

    def is_plain(self, pieces: list[str]) -> np.ndarray:
        """Few hold other characters, and one search over all is cheaper than one in each."""
        if not self.other.search("\n".join(pieces)):
            return np.ones(len(pieces), bool)
        return np.fromiter((not self.other.search(p) for p in pieces), bool, len(pieces))

    def __call__(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of all pieces end to end, and how many each has: one list for KnownWords."""
        plain = self.is_plain(pieces)
        spelled = "\0".join(compress(pieces, plain.tolist())).translate(self.spelled).split("\0") if plain.any() else []  # plain pieces hold no zero
        got = [[t.id for t in self.tokenize(p)] for p in spelled]
        if len(got) < len(pieces):
            rest = compress(pieces, (~plain).tolist())
            other = (e.ids for e in self.library.encode_batch_fast(list(rest), add_special_tokens=False))
            known = iter(got)
            got = [next(known) if p else next(other) for p in plain.tolist()]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return [(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes)]
