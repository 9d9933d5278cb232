"""Encoding with public tokenizers of the tokenizers library, with a bounded memory of short pieces.

The vocabularies here never join what a cut separates: a word vocabulary drops white space, so a text
may be cut at any of it; a byte-level one takes one blank at most into the front of a word, so a text
may be cut where white space follows anything else; and both may be cut between a letter and a stop or
comma. Each piece is encoded by the library once and remembered; the ids of a text are those of its
pieces in turn.

Texts of plain letters, the most by far, are cut many at a time on their bytes: pieces are known by two
64-bit hashes, looked up together in one table of arrays, and their ids gathered together.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator

import numpy as np

from tilth.llm._shared import worker_table

#: White space as Unicode and the tokenizers' patterns define it.
SPACE = "\t-\r \x85\xa0  -     　"
CUTS = {"words": re.compile(f"[^{SPACE}]+"), "bytes": re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")}


LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Pieces whose normal form and pretokens plain Python gives at C speed: no marks that combine, one lower case for each letter.
EASY = {"words": re.compile(f"[!-~{LETTERS}]+"), "bytes": re.compile(f"[ \n][!-~{LETTERS}]+")}
#: The vocabularies' own patterns over those.
PRETOKENS = {
    "words": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+"),
    "bytes": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+"),
}
#: Texts of such characters only, which may be lower-cased as a whole; each is a byte of Latin-1.
EASY_TEXT = re.compile(f"[!-~{LETTERS}\\s]*", re.ASCII)
_BYTES = [chr(i) for i in range(256)]
BLANK, LETTER, STOP = (np.array([bool(re.fullmatch(p, c, re.ASCII)) for c in _BYTES]) for p in (r"\s", f"[{LETTERS}]", "[.,]"))
#: Pieces up to this long are remembered.
LONGEST = 40
_RNG = np.random.default_rng(23)
BYTE_MARKS = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_MARKS = _RNG.integers(1, 1 << 63, (2, LONGEST + 2), np.uint64) * np.uint64(2) + np.uint64(1)
#: A blank and a character that no easy piece holds; no pretoken reaches over the blank, so it is one of its own.
MARK = " \x01"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in prints else next(others)) for b in range(256)}


class Pieces:
    """Ids by two hashes of a piece: an open-addressed table of rows (hash, hash, number of the entry + 1), never more than half full."""

    def __init__(self, keep: int):
        self.keep, self.mask = keep, np.uint64((1 << (2 * keep - 1).bit_length()) - 1)
        self.reset()

    def reset(self) -> None:
        self.rows = np.zeros((int(self.mask) + 1, 3), np.uint64)
        self.n, self.used = 0, 0
        self.start, self.size = np.zeros(self.keep, np.int64), np.zeros(self.keep, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each (hash, hash), -1 where there is none."""
        out, at = np.full(len(h), -1, np.int64), h[:, 0] & self.mask
        open_ = np.arange(len(h))
        while len(open_):
            row = self.rows[at]
            hit = (row[:, 0] == h[open_, 0]) & (row[:, 1] == h[open_, 1])
            out[open_[hit]] = row[hit, 2].astype(np.int64) - 1
            on = ~hit & (row[:, 2] != 0)
            open_, at = open_[on], (at[on] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries, each hash once, with their ids one after another; their numbers. There must be room."""
        total = len(ids)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, total) + (1 << 16), np.uint32)])
        entry = np.arange(self.n, self.n + len(h))
        self.start[entry], self.size[entry] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + total] = ids
        self.n, self.used = self.n + len(h), self.used + total
        open_, at = np.arange(len(h)), h[:, 0] & self.mask
        while len(open_):
            free = np.nonzero(self.rows[at, 2] == 0)[0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.rows[at[won], 0], self.rows[at[won], 1], self.rows[at[won], 2] = h[open_[won], 0], h[open_[won], 1], (entry[open_[won]] + 1).astype(np.uint64)
            left = np.ones(len(open_), bool)
            left[won] = False
            open_, at = open_[left], (at[left] + np.uint64(1)) & self.mask
        return entry

    def gather(self, entries: np.ndarray) -> np.ndarray:
        """The ids of the entries one after another."""
        size = self.size[entries]
        ends = np.cumsum(size)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[entries] - ends + size, size)]


class Encoder:
    """cut: 'words', 'bytes', or None to hand whole texts to the library.

    Easy pieces that are not remembered go to the library's model as pretokens, past its normaliser;
    all others go through all of it. Up to `keep` pieces of easy texts and a tenth as many of others
    are remembered.
    """

    def __init__(self, path: str, cut: str | None, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cut, self.keep, self.known = cut, keep, {}
        if cut:
            self.pieces = Pieces(keep)
            self.letters = byte_letters() | {0: " "}
            (self.mark,) = self._pretokens([])

    def _pretokens(self, pieces: list[str]) -> list[str]:
        """In the model's letters, with a mark after each piece."""
        joined = (MARK + " " * (self.cut == "words")).join([*pieces, ""]) or MARK
        found = PRETOKENS[self.cut].findall(joined.lower() if self.cut == "words" else joined)
        return "\0".join(found).encode().decode("latin-1").translate(self.letters).split(" ")

    def _light(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """The ids of these easy pieces one after another, from the library's model alone, and how many each has."""
        merge, mark, ids, sizes, before = self.tokenizer.model.tokenize, self.mark, [], [], 0
        for w in self._pretokens(pieces):
            if w == mark:
                sizes.append(len(ids) - before)
                before = len(ids)
            else:
                for t in merge(w):
                    ids.append(t.id)
        return ids, sizes

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece."""
        easy = [p for p in pieces if EASY[self.cut].fullmatch(p)]
        ids, sizes = self._light(easy)
        of = dict(zip(easy, np.split(np.array(ids, np.uint32), np.cumsum(sizes)[:-1]), strict=True)) if easy else {}
        rest = [p for p in pieces if p not in of]
        of.update(zip(rest, self._plain(rest), strict=True))
        return [of[p] for p in pieces]

    def _learn(self, h: np.ndarray, pieces: list[str], easy: np.ndarray) -> np.ndarray:
        """New entries for these pieces; their numbers."""
        out = np.empty(len(pieces), np.int64)
        if easy.any():
            ids, sizes = self._light([p for p, e in zip(pieces, easy.tolist(), strict=True) if e])
            out[easy] = self.pieces.add(h[easy], np.array(ids, np.uint32), np.array(sizes, np.int64))
        if not easy.all():
            rest = self._plain([p for p, e in zip(pieces, easy.tolist(), strict=True) if not e])
            out[~easy] = self.pieces.add(h[~easy], np.concatenate(rest), np.array([len(x) for x in rest], np.int64))
        return out

    def _easy(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that EASY_TEXT matches."""
        raw = [t.encode("latin-1") for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return [np.zeros(0, np.uint32) for _ in texts]
        blank = BLANK[data]
        first = np.zeros(len(data), bool)
        first[np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]] = True
        after_letter = STOP[data]
        after_letter[1:] &= LETTER[data[:-1]]
        after_letter[0] = False
        starts_here = first | after_letter
        if self.cut == "words":
            starts_here[1:] |= blank[:-1]
            starts_here &= ~blank
        else:
            starts_here[1:] |= blank[1:] & ~blank[:-1]
        starts = np.nonzero(starts_here)[0]
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        head = int(starts[0])  # blanks before the first word
        place = np.arange(head, len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
        np.minimum(place, LONGEST + 1, out=place)
        mark = BYTE_MARKS[data[head:]]
        if self.cut == "words":
            mark[blank[head:]] = 0
        h = np.stack([np.add.reduceat(mark * PLACE_MARKS[k][place], starts - head) for k in (0, 1)], 1)
        h ^= h >> np.uint64(32)
        long = np.diff(starts, append=len(data)) > LONGEST
        if self.cut == "words" and long.any():  # it may be blanks that are long
            long[long] = [len(bytes(data[a:b]).rstrip()) > LONGEST for a, b in zip(starts[long], np.append(starts[1:], len(data))[long], strict=True)]
        entries = np.where(long, -2, 0)
        entries[~long] = self.pieces.find(h[~long])
        new = np.nonzero(entries == -1)[0]
        said, after = data.tobytes().decode("latin-1"), np.append(starts[1:], len(data))
        strip = str.rstrip if self.cut == "words" else str
        words = lambda at: [strip(said[a:b]) for a, b in zip(starts[at].tolist(), after[at].tolist(), strict=True)]
        if len(new):
            _, at, back = np.unique(h[new, 0], return_index=True, return_inverse=True)
            if (h[new[at], 1][back] != h[new, 1]).any():  # one hash is equal by chance
                _, at, back = np.unique(h[new], axis=0, return_index=True, return_inverse=True)
            some = new[at]
            if self.pieces.n + len(some) > self.pieces.keep:
                if len(some) <= self.pieces.keep // 2:  # all are dropped, and this batch begins anew
                    self.pieces.reset()
                    return self._easy(texts)
                middle = len(texts) // 2
                return self._easy(texts[:middle]) + self._easy(texts[middle:]) if middle else [np.concatenate([np.zeros(0, np.uint32), *self._ids(words(np.arange(len(starts))))])]
            easy = np.ones(len(some), bool)
            if self.cut == "bytes":  # one blank or line feed before other characters
                blanks = np.add.reduceat(blank.astype(np.int64), starts)
                easy = (blanks[some] == 1) & np.isin(data[starts[some]], (10, 32)) & (after[some] - starts[some] > 1)
            entries[new] = self._learn(h[some], words(some), easy)[back]
        size = np.zeros(len(starts), np.int64)
        size[~long] = self.pieces.size[entries[~long]]
        apart = self._ids(words(np.nonzero(long)[0]))
        size[long] = [len(x) for x in apart]
        ends_at = np.cumsum(size)
        got = np.empty(int(ends_at[-1]), np.uint32)
        got[np.repeat(~long, size)] = self.pieces.gather(entries[~long])
        for i, x in zip(np.nonzero(long)[0], apart, strict=True):
            got[ends_at[i] - size[i] : ends_at[i]] = x
        bounds = np.concatenate([[0], ends_at])[np.searchsorted(starts, np.concatenate([[0], ends]), side="left")]  # before the first piece of each text
        return [got[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _other(self, text: str) -> np.ndarray:
        """The ids of any text, piece by piece."""
        pieces = CUTS[self.cut].findall(text)
        if new := list(dict.fromkeys(p for p in pieces if p not in self.known)):
            if len(self.known) + len(new) > self.keep // 10:
                self.known.clear()
                new = list(dict.fromkeys(pieces))
            self.known.update(zip(new, self._ids(new), strict=True))
        out = np.concatenate([np.zeros(0, np.uint32), *map(self.known.__getitem__, pieces)])
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        return out

    def encode(self, texts: list[str], end: int | None = None, step: int = 1 << 20) -> list[np.ndarray]:
        """The ids of each text, with the id `end` after them. Easy texts of about `step` characters go together."""
        collects = gc.isenabled()
        gc.disable()  # nothing here goes in circles, and a collector that walks the lists of pieces is not free
        try:
            out = self._encode(texts, step)
        finally:
            if collects:
                gc.enable()
        tail = np.array([] if end is None else [end], np.uint32)
        return [np.concatenate([x, tail]).astype("<u4", copy=False) for x in out]

    def _encode(self, texts: list[str], step: int) -> list[np.ndarray]:
        if not self.cut:
            return self._plain(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        own, size = [], 0
        for i, t in enumerate(texts):
            if not EASY_TEXT.fullmatch(t):
                out[i] = self._other(t)
                continue
            own.append(i)
            size += len(t)
            if size >= step:
                self._put(out, texts, own)
                own, size = [], 0
        self._put(out, texts, own)
        return out

    def _put(self, out: list, texts: list[str], own: list[int]) -> None:
        lower = str.lower if self.cut == "words" else str
        for i, ids in zip(own, self._easy([lower(texts[i]) for i in own]), strict=True):
            out[i] = ids


@worker_table
def encoder(path: str, cut: str | None) -> Encoder:
    """One for each worker process, so its tasks share what is remembered."""
    return Encoder(path, cut)
