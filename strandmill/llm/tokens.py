"""Token ids of a byte-level BPE tokenizer over blocks of texts.

The split of a text into pre-tokens is done in numpy for a whole block; the distinct pre-tokens
of the block are looked up in a cache of the Python worker and only new ones go through the
``tokenizers`` library. A byte-level BPE encodes each pre-token on its own, so the
ids equal those of the library on the whole text. Texts for which the numpy split is not known to agree (code
points outside ``SAFE``, or a special token written out) are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pandas._libs.hashtable import Int64Factorizer
from tokenizers import Tokenizer

from strandmill.llm.arrays import mix, release

# a task is a process of its own already, and threads of the library would add memory of theirs
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Code points below this are classed by table; they have had their classes in every version of Unicode in use.
SAFE = 0x0250
#: New pre-tokens that are encoded as one text.
JOINED = 64
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
#: The contractions that the pre-token pattern of this vocabulary splits off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = np.full(SAFE, OTHER, np.uint8)
    for i in range(SAFE):
        c = chr(i)
        kinds[i] = LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else SPACE if regex.match(r"\s", c) else OTHER
    return kinds


def pretokens(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of a block of texts given as code points below ``SAFE`` and offsets."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[off] = True
    change = first[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    last = np.zeros(n, bool)
    last[:-1] = change[1:]
    last[-1] = True
    ends_text = first[1:]
    # the last white space before a word is cut off; a blank there joins the word
    tail = (kind == SPACE) & last & ~ends_text
    at = np.flatnonzero(tail)
    start[at] = True
    blank = at[points[at] == 0x20]
    start[blank + 1] = False
    # contractions: an apostrophe that is a run of its own and starts its pre-token
    quote = np.flatnonzero((points == 0x27) & change & last & start & ~ends_text)
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        second = np.zeros(len(quote), bool)
        inner = quote + 2 < n
        second[inner] = ~first[:-1][quote[inner] + 2]
        size = np.zeros(len(quote), np.int64)
        for word in reversed(CONTRACTIONS):
            hit = a == ord(word[0])
            if len(word) == 2:
                hit &= second & (b == ord(word[1]))
            size[hit] = len(word)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        inside = after < n
        start[after[inside]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes blocks of texts; keeps the ids of the pre-tokens it has met, up to a bound."""

    most = 300_000

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t["content"] for t in json.loads(definition).get("added_tokens", [])]
        self.joinable = not any(" " in t for t in self.special)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        #: Hashes of pre-tokens of up to 16 bytes, numbered as they come; ``second`` has another hash of each, ``number`` its number here.
        self.hashes = Int64Factorizer(1 << 16)
        self.second, self.number = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.size, self.place = (np.zeros(1 << 16, np.int32) for _ in range(2))
        self.flat = np.zeros(1 << 18, np.uint32)
        self.count = self.used = 0

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers of new pre-tokens, whose ids are kept from now on."""
        texts = [w.decode() for w in words]
        # a blank begins a pre-token, so such words can go through the library many at once
        joins = [len(t) > 1 and t[0] == " " and not t[1].isspace() for t in texts] if self.joinable else [False] * len(texts)
        many = [i for i, x in enumerate(joins) if x]
        rest = [i for i, x in enumerate(joins) if not x]
        groups = [many[i : i + JOINED] for i in range(0, len(many), JOINED)]
        sizes, parts, order = np.zeros(len(texts), np.int64), [], []
        for group, e in zip(groups, self.tokenizer.encode_batch(["".join(texts[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            counts = np.bincount(e.word_ids, minlength=len(group)) if e.ids else np.zeros(0)
            if len(counts) == len(group):
                sizes[group] = counts
                parts.append(e.ids)
                order += group
            else:
                rest += group
        for i, e in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            sizes[i] = len(e.ids)
            parts.append(e.ids)
        order = np.array(order + rest, np.int64)
        flat = np.fromiter(chain.from_iterable(parts), np.uint32, int(sizes.sum()))
        place = np.zeros(len(texts), np.int64)
        place[order] = self.used + np.cumsum(sizes[order]) - sizes[order]
        first = self.count
        while first + len(texts) > len(self.size):
            self.size, self.place = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.place))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.count += len(texts)
        self.size[first : self.count] = sizes
        self.place[first : self.count] = place
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return np.arange(first, self.count)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block in one array, and the offsets of each text's ids."""
        n = len(off) - 1
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        cuts = lead[off]
        odd = np.add.reduceat(np.append(points >= SAFE, False), cuts[:-1]) > 0 if n else np.zeros(0, bool)
        odd &= cuts[1:] > cuts[:-1]
        for mark in self.special:
            if (at := raw.find(mark.encode())) >= 0:
                while at >= 0:
                    odd[np.searchsorted(off, at, "right") - 1] = True
                    at = raw.find(mark.encode(), at + 1)
        if odd.any():
            ids, sizes = [], np.zeros(n, np.int64)
            plain = np.flatnonzero(~odd)
            keep = np.repeat(~odd, np.diff(off))
            own = np.concatenate([[0], np.cumsum(np.diff(off)[plain])])
            even, even_off = self.encode(data[keep], own) if len(plain) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
            found = {int(i): self._whole(raw[off[i] : off[i + 1]].decode()) for i in np.flatnonzero(odd)}
            sizes[plain] = np.diff(even_off)
            j = 0
            for i in range(n):
                if odd[i]:
                    ids.append(found[i])
                    sizes[i] = len(found[i])
                else:
                    ids.append(even[even_off[j] : even_off[j + 1]])
                    j += 1
            return np.concatenate(ids) if ids else even, np.concatenate([[0], np.cumsum(sizes)])
        starts = pretokens(points, cuts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        byte_at = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])
        begin = byte_at[starts]
        end = np.append(begin[1:], len(data))
        size = end - begin
        code = self._codes(raw, begin, size)
        many = self.size[code].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(many)])
        ids = self.flat[np.repeat(self.place[code].astype(np.int64) - total[:-1], many) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begin, off)]

    def _codes(self, raw: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number in the cache of each pre-token."""
        padded = np.frombuffer(raw + bytes(24), np.uint8)
        word = np.ndarray((len(raw) + 16,), "<u8", padded, strides=(1,))
        low, high = np.clip(size, 0, 8).astype(np.uint64), np.clip(size - 8, 0, 8).astype(np.uint64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask = lambda k: np.where(k == 0, np.uint64(0), full >> ((np.uint64(8) - k) * np.uint64(8) % np.uint64(64)))
        a, b = word[begin] & mask(low), word[np.minimum(begin + 8, len(raw))] & mask(high)
        own = np.flatnonzero(size <= 16)
        inner = mix(b + size.astype(np.uint64))
        key = mix(a * np.uint64(0x9E3779B97F4A7C15) + inner).view(np.int64)[own]
        second = ((a ^ (inner * np.uint64(0xC4CEB9FE1A85EC53))) * np.uint64(0xFF51AFD7ED558CCD))[own]
        if self.count > self.most:
            self._clear()
            release()
        before = self.hashes.get_count()
        label = self.hashes.factorize(key)
        after = self.hashes.get_count()
        words = lambda at: [raw[i:j] for i, j in zip(begin[at].tolist(), (begin[at] + size[at]).tolist(), strict=True)]
        if after > before:
            while after > len(self.second):
                self.second, self.number = (np.concatenate([x, np.zeros_like(x)]) for x in (self.second, self.number))
            new = np.flatnonzero(label >= before)
            first = new[np.unique(label[new], return_index=True)[1]]
            self.number[before:after] = self._learn(words(own[first]))
            self.second[before:after] = second[first]
        code = np.empty(len(begin), np.int64)
        code[own] = self.number[label]
        # longer ones, and such as share a hash with another, are known by their bytes
        alike = second == self.second[label]
        rest = np.concatenate([np.flatnonzero(size > 16), own[~alike]])
        if len(rest):
            others = words(rest)
            if new_words := list(dict.fromkeys(w for w in others if w not in self.known)):
                self.known.update(zip(new_words, self._learn(new_words).tolist(), strict=True))
            code[rest] = list(map(self.known.__getitem__, others))
        return code


@lru_cache(1)
def encoder(definition: str) -> Encoder:
    """The encoder of this Python worker; kept from task to task."""
    return Encoder(definition)
