"""Token ids of whole texts: each distinct word is encoded once and looked up by its hash afterwards."""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from quire.llm import words

#: Words that a worker remembers before it starts afresh.
WORDS = 900_000
# Below U+0100 texts are in composed form already and lower case goes letter by letter, so the tokenizer's own pattern
# can be applied here: contractions, letters, single digits, other marks; a line feed stands after each word.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \t-\r\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+|\n")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def latin(word: str) -> bool:
    try:
        return word.isascii() or bool(word.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable bytes stand for themselves, others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Remembered:
    """Ids of words that were met before, by the hash of the word."""

    def clear(self) -> None:
        self.keys, self.rank = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, found: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.put(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def put(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])

    def name(self, keys: np.ndarray, at: np.ndarray) -> None:
        """New keys, in ascending order, for the ids at these places."""
        place = np.searchsorted(self.keys, keys)
        self.keys, self.rank = np.insert(self.keys, place, keys), np.insert(self.rank, place, at)

    def unmet(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys

    def look_up(self, keys: np.ndarray, learn: Callable[[np.ndarray, np.ndarray], None], most: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each); ``learn`` takes new keys and where each stands among ``keys``."""
        if not len(keys):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        order = np.argsort(keys)
        key = keys[order]
        head = np.insert(key[1:] != key[:-1], 0, True)
        key, first, which = key[head], order[head], np.empty(len(order), np.int64)
        which[order] = np.cumsum(head) - 1
        new = self.unmet(key)
        if len(self.keys) + int(new.sum()) > most:
            self.clear()
            new[:] = True
        if new.any():
            learn(key[new], first[new])
        at = self.rank[np.searchsorted(self.keys, key)][which]
        return self.flat[spread(self.starts[at], self.sizes[at])], self.sizes[at]


class WordEncoder(Remembered):
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.parts: dict[str, int] = {}

    def cut_up(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words below U+0100 with a line feed after each: the pattern runs over
        all of them at once, and each distinct part is merged once."""
        parts = _LATIN.findall(joined.lower())
        known, merge, letters = self.parts, self.merge, self.letters
        new = [part for part in set(parts) if part not in known]
        found = [[t.id for t in merge(part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(letters))] if part != "\n" else [] for part in new]
        self.add(found)
        known.update(zip(new, range(len(self.sizes) - len(new), len(self.sizes))))
        which = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)[which == known["\n"]] if parts else sizes
        return self.flat[spread(self.starts[which], sizes)], np.diff(ends, prepend=0)

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """New words, in ascending order of their hashes."""
        rare = np.concatenate(([0], np.cumsum((data >= 128) | (data == 60))))
        odd = rare[ends] > rare[starts]
        texts = [data[a:b].tobytes().decode() for a, b in zip(starts[odd].tolist(), ends[odd].tolist())]
        library = np.array([not latin(t) or "<|" in t for t in texts], bool)
        plain = ~odd
        plain[np.flatnonzero(odd)[~library]] = True
        sizes = (ends - starts + 1)[plain]
        joined = data[np.minimum(spread(starts[plain], sizes), len(data) - 1)]
        joined[np.cumsum(sizes) - 1] = 10
        self.put(*self.cut_up(joined.tobytes().decode()))
        self.add([e.ids for e in self.tokenizer.encode_batch_fast([t for t, x in zip(texts, library) if x], add_special_tokens=False)] if library.any() else [])
        at = np.empty(len(keys), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        at[order] = np.arange(len(keys)) + len(self.sizes) - len(keys)
        self.name(keys, at)

    def ids_of(self, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        return self.look_up(w.hashes, lambda keys, at: self.learn(keys, w.data, w.starts[at], w.ends[at]), WORDS)

    def encode(self, texts: pa.Array | list[str | None], end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids of some texts in a row, ids of each text); every text ends with ``end``; null is empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        held, sizes_held, next_ = [], 0, 0  # of a text that goes on in the next chunk
        for w in words.scan(column):
            ids, sizes = self.ids_of(w)
            n = np.bincount(w.text - w.first_text, sizes, w.texts).astype(np.int64)
            done = w.texts - 1 if w.unfinished else w.texts
            cut = int(n[:done].sum())
            if done:
                own = n[:done].copy()
                own[0] += sizes_held
                whole = np.concatenate([*held, ids[:cut]])
                yield next_, np.insert(whole, np.cumsum(own), end).astype(np.uint32), own + 1
                held, sizes_held, next_ = [], 0, next_ + done
            if w.unfinished:
                held.append(ids[cut:])
                sizes_held += len(ids) - cut


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One for each worker, so that later tasks know earlier words."""
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
