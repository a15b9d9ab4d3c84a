"""Token ids of texts by the public word-BPE vocabulary: batches are split into pieces in numpy, and each new piece is encoded once."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from .shingles import BASE, _power_tables, mix

#: Characters for which Python's lower case, white space and letters are those of the tokenizer and which are in composed form.
PLAIN = re.compile("[\t\n\r -~¡«»¿À-ÿ–—‘-”…]*")
#: The letters among them, in lower case, and the endings that the vocabulary splits off after an apostrophe.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

SPACE, LETTER, DIGIT, OTHER = range(4)
_CLASS = np.full(1 << 16, OTHER, dtype=np.uint8)
_CLASS[[9, 10, 13, 32]] = SPACE
_CLASS[[ord(c) for c in LETTERS]] = LETTER
_CLASS[48:58] = DIGIT
_VALUE = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def default_vocabulary() -> str:
    """Path of the word-BPE vocabulary on this machine; a parameter everywhere it is used."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def encoder_for(path: str) -> WordEncoder:
    """The encoder of a Python worker, kept from task to task: the tokenizer doesn't give all of its memory back when it is dropped."""
    return WordEncoder(path)


def _byte_letters() -> dict[int, str]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain and b != 32]
    shifted = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    return {b: shifted[b] for b in others}


def split_pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the pieces of lower-case 16-bit code points: letter runs, digits, runs of other characters, and endings after an apostrophe."""
    kind = _CLASS[points]
    n = len(kind)
    start = kind != SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one, two = points[quote + 1], np.append(points, 0)[quote + 2]
        size = np.zeros(len(quote), dtype=np.int64)
        for e in ENDINGS:
            hit = (one == ord(e[0])) & ((two == ord(e[1])) if len(e) == 2 else True)
            size[hit & (size == 0)] = len(e)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        after = after[after < n]
        start[after[kind[after] == LETTER]] = True
    bounds = np.append(np.flatnonzero(start | (kind == SPACE)), n)
    opens = start[bounds[:-1]]
    return bounds[:-1][opens], bounds[1:][opens]


class WordEncoder:
    """Ids of whole texts. A piece's ids don't depend on its neighbours, so each is encoded once and found again by a 64-bit hash.

    At ``most`` pieces the memory is emptied. Texts with characters outside PLAIN, or with the form of a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 1_000_000, block: int = 1 << 19):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)  # the merges alone, for words already split and in byte letters
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        self.most, self.block = most, block
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Drops the pieces learned so far."""
        self.known, self.slots = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)  # sorted hashes and the slot of each
        self.first, self.size, self.n = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32), 0
        self.pool, self.used = np.zeros(1 << 18, dtype="<u4"), 0

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Adds new pieces, given with their sorted hashes; an end-of-word token closes each."""
        groups = [" ".join(pieces[i : i + 64]).encode().decode("latin-1").translate(self.letters) for i in range(0, len(pieces), 64)]
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.words.encode_batch_fast(groups, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            raise ValueError("the vocabulary does not close each piece with an end-of-word token")
        n, at = self.n, self.used
        while n + len(pieces) > len(self.first):
            self.first, self.size = np.append(self.first, np.zeros_like(self.first)), np.append(self.size, np.zeros_like(self.size))
        while at + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[at : at + len(ids)] = ids
        starts = np.concatenate([[0], ends[:-1]])
        self.first[n : n + len(pieces)], self.size[n : n + len(pieces)] = at + starts, ends - starts
        place = np.searchsorted(self.known, hashes)
        self.known, self.slots = np.insert(self.known, place, hashes), np.insert(self.slots, place, np.arange(n, n + len(pieces), dtype=np.int32))
        self.n, self.used = n + len(pieces), at + len(ids)

    def _unknown(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(hashes), dtype=bool)
        return self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] != hashes

    def _encode_block(self, some: list[str]) -> list[np.ndarray]:
        joined = "\n".join(some).lower()
        points = np.frombuffer(joined.encode("utf-16-le"), dtype="<u2")
        first, end = split_pieces(points)
        up, down = _power_tables(len(points) + 1)
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[points] * up[: len(points)], out=sums[1:])
        hashes = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64) * BASE)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.n + len(unique) > self.most:
            self.forget()
        new = np.flatnonzero(self._unknown(unique))
        if len(new):
            at = where[new]
            self._learn(unique[new], [joined[s:e] for s, e in zip(first[at].tolist(), end[at].tolist())])
        slot = self.slots[np.searchsorted(self.known, unique)][inverse]
        size = self.size[slot].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.first[slot] - before[:-1], size) + np.arange(before[-1])]
        texts_at = np.cumsum([0] + [len(t) + 1 for t in some])
        bounds = before[np.searchsorted(first, texts_at)]
        return [ids[b:e] for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit arrays."""
        out: list = [None] * len(texts)
        block: list[int] = []
        n = 0
        for i, t in enumerate(texts):
            if "<|" in t or not PLAIN.fullmatch(t):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4")
                continue
            block.append(i)
            n += len(t)
            if n >= self.block:
                for k, ids in zip(block, self._encode_block([texts[k] for k in block])):
                    out[k] = ids
                block, n = [], 0
        if block:
            for k, ids in zip(block, self._encode_block([texts[k] for k in block])):
                out[k] = ids
        return out
