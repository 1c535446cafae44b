"""Token ids of whole texts by public tokenizers, through a bounded table of pieces.

Text is first cut at places where the tokenizer's own pre-tokenizer always cuts, so the ids of a text
are the ids of its pieces one after another. Pieces repeat a lot: they are found by hash in a table of those that the
worker has seen (CACHED at most, then it starts afresh), for a whole buffer of texts at once; the rest are encoded in batches.
A piece is known by 128 bits of hash.

Where it may be cut: "words" is for tokenizers that drop white space, "spaced" for those where a word takes the one space
before it and of a longer run of white space the last character is apart. Words are cut further between letters, digits and
signs if they hold nothing else: letters are ASCII ones and the Latin ones of the next block; apostrophes (contractions) and all other
characters keep a word whole. Texts with a special token's string, and for "spaced" with white space beyond ASCII, are one piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

from .common import PART_BYTES
from .wordhash import run_hash, run_sums

#: Pieces in a worker's table at most, and places it begins with; some 60 bytes each.
CACHED, FIRST_PLACES = 1_000_000, 1 << 16
#: White space beyond ASCII, in UTF-8; next to ASCII white space it would join the same run.
WIDE_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
WIDE_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)


def _kinds() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[*range(9, 14), 32]] = BLANK
    out[[*range(65, 91), *range(97, 123)]] = LETTER
    out[48:58] = DIGIT
    for a, b in ((33, 47), (58, 64), (91, 96), (123, 126)):
        out[a : b + 1] = SIGN
    out[ord("'")] = OTHER
    return out


KINDS = _kinds()


#: One run of letters, digits or signs, with the space before it.
PRETOKEN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def byte_letters() -> dict[int, int]:
    """How byte-level models spell bytes: visible Latin-1 characters as themselves, the others from U+0100 on in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()


class Places:
    """Open addressing from pairs of 64-bit hashes to numbers, for arrays of keys."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.key, self.check, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it is new. Keys aren't zero."""
        out, todo, at = np.full(len(h), -1, np.int64), np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(todo):
            k = self.key[at]
            same = (k == h[todo]) & (self.check[at] == g[todo])
            out[todo[same]] = self.value[at[same]]
            more = ~same & (k != 0)
            todo, at = todo[more], (at[more] + 1) & int(self.mask)
        return out

    def add(self, h: np.ndarray, g: np.ndarray, numbers: np.ndarray) -> None:
        """Enters keys that are new and distinct."""
        todo, at = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(todo):
            slots, winner = np.unique(np.where(self.key[at] == 0, at, -1), return_index=True)
            winner = winner[slots >= 0]
            slots, own = at[winner], todo[winner]
            self.key[slots], self.check[slots], self.value[slots] = h[own], g[own], numbers[own]
            left = np.ones(len(todo), bool)
            left[winner] = False
            todo, at = todo[left], (at[left] + 1) & int(self.mask)


def cut_places(raw: np.ndarray, offs: np.ndarray, spaced: bool, whole: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a buffer of texts; texts in `whole` aren't cut."""
    n = len(raw)
    kind = KINDS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    kind[np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))] = OTHER
    border = np.zeros(n + 1, bool)  # a text begins or ends
    border[offs] = True
    blank = kind == BLANK
    edge = border.copy()  # a run of blanks or of others begins
    edge[1:n] |= blank[1:] != blank[:-1]
    # within words of letters, digits and signs only: where the kind changes
    others = np.concatenate([[0], np.cumsum(kind == OTHER)])
    changes = np.flatnonzero((kind[1:] != kind[:-1]) & ~edge[1:n]) + 1
    runs = np.flatnonzero(edge)
    run = np.searchsorted(runs, changes, "right")
    changes = changes[others[runs[run]] == others[runs[run - 1]]] if len(changes) else changes
    cut = edge
    if spaced:
        first = np.flatnonzero(edge[1:n] & ~blank[1:] & blank[:-1] & ~border[1:n]) + 1  # words after blanks
        cut[first - 1] = True
        cut[first[raw[first - 1] == 32]] = False
    cut[changes] = True
    for i in whole:
        cut[offs[i] + 1 : offs[i + 1]] = False
    places = np.flatnonzero(cut)
    starts, ends = places[:-1], places[1:]
    if not spaced:
        kept = ~blank[starts]
        if whole:
            kept |= np.isin(starts, offs[whole])
        starts, ends = starts[kept], ends[kept]
    return starts, ends


class Encoder:
    """Encodes many texts at once; each gets `end` appended."""

    def __init__(self, path: str, cut: str, end: int | None = 0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.end = Tokenizer.from_file(path), cut == "spaced", end
        self.model = self.tokenizer.model
        # words, numbers and signs alone are what the pre-tokenizer gives the model, unless text is normalised first
        self.direct = self.spaced and self.tokenizer.normalizer is None
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.places, self.known = Places(min(FIRST_PLACES, max(16, 2 * CACHED)).bit_length() - 1), 0
        self.ids, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def learn(self, new: list[bytes]) -> np.ndarray:
        """Numbers of new pieces; at[i] : at[i + 1] is where the ids of piece i are."""
        words = [i for i, p in enumerate(new) if PRETOKEN.fullmatch(p)] if self.direct else []
        rest = sorted(set(range(len(new))).difference(words)) if words else range(len(new))
        found: list = [None] * len(new)
        for i in words:
            found[i] = [t.id for t in self.model.tokenize(new[i].decode("latin-1").translate(BYTE_LETTERS))]
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([new[i].decode() for i in rest], add_special_tokens=False), strict=True):
            found[i] = x.ids
        numbers = np.arange(self.known, self.known + len(new))
        self.known += len(new)
        if self.known + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(self.known + len(self.at), np.int64)])
        a = self.at[numbers[0]]
        self.at[numbers + 1] = a + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        b = self.at[self.known]
        if b > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(b + len(self.ids), np.uint32)])
        self.ids[a:b] = np.fromiter(chain.from_iterable(found), np.uint32, b - a)
        return numbers

    def encode(self, raw: np.ndarray, offs: np.ndarray, most: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts raw[offs[i]:offs[i + 1]] one after another, and where each text's begin. One text of more than
        `most` bytes is encoded in parts, if it may be cut."""
        if len(offs) == 2 and len(raw) > most and not self.uncut(raw.tobytes()):
            end, self.end = self.end, None
            try:
                ids = [self._encode(part, np.array([0, len(part)]))[0] for part in self.parts(raw, most)]
            finally:
                self.end = end
            ids = np.concatenate([*ids, np.full(int(end is not None), end or 0, np.uint32)])
            return ids, np.array([0, len(ids)])
        return self._encode(raw, offs)

    def uncut(self, text: bytes) -> bool:
        return any(x in text for x in self.special) or self.spaced and bool(WIDE_BLANK.search(text))

    @staticmethod
    def parts(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """A text's parts, each but the first from a single space on: a piece begins there in any case."""
        at, most = 0, max(most, 3)
        while at < len(raw):
            to, found = at + most, None
            while found is None and to < len(raw) - 1:
                blank = KINDS[raw[to - 1 : to + most]] == BLANK
                single = np.flatnonzero((raw[to : to + len(blank) - 2] == 32) & ~blank[:-2] & ~blank[2:])
                found = to + int(single[0]) if len(single) else None
                to += most - 1
            found = len(raw) if found is None else found
            yield raw[at:found]
            at = found

    def _encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = raw.tobytes()
        whole = []
        if any(x in data for x in self.special) or self.spaced and any(x in data for x in WIDE_LEADS):
            whole = [i for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)) if self.uncut(data[a:b])]
        starts, ends = cut_places(raw, offs, self.spaced, whole) if len(raw) else (np.zeros(0, np.int64),) * 2
        values = raw.astype(np.uint64) + np.uint64(1)
        h, g = (run_hash(run_sums(values, base), starts, ends, base) | np.uint64(1) for base in (0, 2))
        if self.known > CACHED:
            self.clear()
        numbers = self.places.find(h, g)
        while len(missing := np.flatnonzero(numbers < 0)):
            first = missing[np.unique(h[missing], return_index=True)[1]]
            room = (len(self.places.key) * 3) // 4 - self.known
            if room <= 0:
                self.places = grown(self.places)
                continue
            first = first[:room]
            self.places.add(h[first], g[first], self.learn([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]))
            numbers[missing] = self.places.find(h[missing], g[missing])
        lengths = self.at[numbers + 1] - self.at[numbers]
        to = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.arange(to[-1]) + np.repeat(self.at[numbers] - to[:-1], lengths)]
        bounds = to[np.searchsorted(starts, offs)]
        if self.end is not None:
            out = np.empty(len(ids) + len(offs) - 1, np.uint32)
            ended = bounds[1:] + np.arange(len(offs) - 1)
            out[ended] = self.end
            inside = np.ones(len(out), bool)
            inside[ended] = False
            out[inside] = ids
            ids, bounds = out, bounds + np.arange(len(offs))
        return ids, bounds


def grown(places: Places) -> Places:
    """The same entries with twice the room."""
    used = np.flatnonzero(places.key)
    out = Places(len(places.key).bit_length())
    out.add(places.key[used], places.check[used], places.value[used])
    return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, cut: str, end: int | None = 0) -> Encoder:
    """This worker's encoder; kept for its later tasks."""
    if (path, cut, end) not in _encoders:
        _encoders[path, cut, end] = Encoder(path, cut, end)
    return _encoders[path, cut, end]
