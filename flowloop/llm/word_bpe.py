"""Ids of a word-level BPE tokenizer file, word by word.

White space separates words and is dropped, so a text's ids are its words' ids one after the other.
Words repeat, so each worker remembers the ids of many. New words are split by the file's own rules
and merged together: every round contracts one pair of each unfinished word. Words of more than
``LONG`` characters would take as many rounds and go to the library, whose time grows with their
length alone.
"""

import json
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import regex
from tokenizers import Tokenizer

# Words and parts whose ids a worker remembers; beyond them it keeps the first KEPT, among which are
# the frequent ones. Longer words than LONG are never remembered, so this bounds the bytes as well.
REMEMBERED = 400_000
KEPT = 100_000
LONG = 256
_NONE = np.int64(1 << 40)


class WordBpe:
    """``ids(text)`` as bytes of little-endian unsigned 32-bit numbers, as the library gives them."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [t["content"] for t in spec["added_tokens"]]
        if any(token[:-1].isalpha() or token.isalpha() for token in special):
            raise ValueError("a special token is like a word")
        # Without special tokens, nothing is one.
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        signs = byte_signs()
        self.first = np.array([vocab[signs[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[signs[b] + end] for b in range(256)], dtype=np.int64)
        # Ranks of all pairs of single bytes, of which the second may end a word.
        both = np.concatenate([self.first, self.last])
        self.byte_ranks = self._ranks(self.first[:, None], both[None, :])
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def merge(self, parts: list[str]) -> list[bytes]:
        """The ids of each part: contract the leftmost pair of least rank until there is none."""
        coded = [part.encode() for part in parts]
        sizes = np.array([len(c) for c in coded])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        sym = self.first[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(parts)), sizes)
        rank = np.full(len(sym), _NONE)
        follows = raw.astype(np.int64)
        follows[ends - 1] += 256
        same = word[1:] == word[:-1]
        rank[:-1] = np.where(same, self.byte_ranks[raw[:-1], follows[1:]], _NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(sym)])
            active = np.repeat(least < _NONE, counts)
            done.append((word[~active], sym[~active]))
            sym, word, rank = sym[active], word[active], rank[active]
            if not len(sym):
                break
            low = np.repeat(least[least < _NONE], counts[least < _NONE])
            hits = np.flatnonzero(rank == low)
            hits = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]
            sym[hits] = self.merged[rank[hits]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hits + 1] = False
            hits = np.cumsum(keep)[hits] - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            for at in (hits, hits[hits > 0] - 1):
                after = np.minimum(at + 1, len(sym) - 1)
                near = (word[after] == word[at]) & (after > at)
                rank[at] = np.where(near, self._ranks(sym[at], sym[after]), _NONE)
        word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, dtype=np.int64)
        sym = np.concatenate([s for _, s in done]) if done else np.zeros(0, dtype=np.int64)
        placed = np.argsort(word, kind="stable")
        ids = sym[placed].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(word, minlength=len(parts)))).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def learn(self, words: list[str]) -> None:
        """Remember the ids of ``words`` of at most ``LONG`` characters, without white space."""
        whole, split = {}, {}
        for word in words:
            if word.isascii():
                plain = word.lower()
            elif max(word) > _SIMPLE:
                self.words[word] = self._by_library(word)
                continue
            else:
                plain = normalised(word)
            # Letters alone are one part, a mark after them another; no special token is like that.
            if plain.isalpha():
                whole[word] = plain
            elif plain[-1] in _MARKS and plain[:-1].isalpha():
                split[word] = (plain[:-1], plain[-1])
            elif self.special.search(word):
                self.words[word] = self._by_library(word)
            else:
                split[word] = self.split.findall(plain)
        fresh = set(whole.values()).union(*split.values()).difference(self.parts)
        fresh = list(fresh)
        for at in range(0, len(fresh), 100_000):
            some = fresh[at : at + 100_000]
            self.parts.update(zip(some, self.merge(some)))
        known = self.parts.__getitem__
        self.words.update(zip(whole, map(known, whole.values())))
        for word, parts in split.items():
            self.words[word] = b"".join(map(known, parts))

    def _by_library(self, word: str) -> bytes:
        ids = self.library.encode(word, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > REMEMBERED or len(self.parts) > REMEMBERED:
            self.words = dict(islice(self.words.items(), KEPT))
            self.parts = dict(islice(self.parts.items(), KEPT))
        split = [words_of(text) for text in texts]
        fresh = set().union(*split).difference(self.words) if split else set()
        long = {word for word in fresh if len(word) > LONG}
        if fresh:
            self.learn(list(fresh - long))
        if not long:
            known = self.words.__getitem__
        else:
            own = {word: self._by_library(word) for word in long}

            def known(word: str) -> bytes:
                return own[word] if word in own else self.words[word]

        return [b"".join(map(known, words)) for words in split]


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """The tokenizer of a file, once a worker."""
    return WordBpe(path)


# Words of Latin letters alone are split here. Beyond them, Unicode versions differ in what is a
# letter or composes, and the library itself encodes the word.
_SIMPLE = "\u024f"

# Marks that stand after a word and are a part of their own.
_MARKS = frozenset(".,;:!?")

# The tokenizer's white space is Unicode's; str.split() also cuts at these four controls.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACES = regex.compile(r"\s+")


def words_of(text: str) -> list[str]:
    if any(c in text for c in _NOT_SPACE):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


def normalised(word: str) -> str:
    """NFC, then lower case sign by sign: a sigma does not depend on its place."""
    if not word.isascii():
        word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
    return word.lower()


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]
