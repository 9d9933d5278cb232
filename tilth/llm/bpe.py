"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding. A sequence of tokens is what the merges give for its bytes if and only if every token is
what they give for its own bytes and every two neighbours are what they give for theirs. That makes
the encoder a nondeterministic transducer over bytes: it walks the trie of the tokens from its root,
may close a token at any node that ends one if it goes with the token before it, and starts again at
the root. Its states are pairs of the token closed last and the trie's node. `Transducer` determinises
it as the input asks for: a state of the machine is a list of such pairs. What all of them agree on is
emitted, so output lags by a bounded lookahead, or by the ambiguity if that lasts longer. States and
moves are kept up to a bound, beyond which the machine starts anew, within a match too.

Decoding. `Utf8` is the incremental machine that checks UTF-8 across tokens: its state is the bytes
that a character still lacks and the range of the next one.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import cache, cached_property, lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from tilth.llm import files
from tilth.llm._shared import text_of
from tilth.llm.encoding import EASY_TEXT, PRETOKENS

ROOT = 0
# Fixed value: the public pattern of byte-level vocabularies.
PUBLIC_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Ranks by bytes, the trie over them, and which tokens go together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.moves: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.depth: list[int] = [0]
        self.size = {i: len(b) for b, i in ranks.items()}
        for token in sorted(ranks):
            if self.merged(token) == (ranks[token],):
                node = ROOT
                for byte in token:
                    if byte not in self.moves[node]:
                        self.moves[node][byte] = len(self.moves)
                        self.moves.append({})
                        self.ends.append(-1)
                        self.depth.append(self.depth[node] + 1)
                    node = self.moves[node][byte]
                self.ends[node] = ranks[token]
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The merges applied to a short string: the lowest rank first, from the left."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            least, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if least == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def together(self, a: int, b: int) -> bool:
        """Whether the merges give a, b for the bytes of both."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return known


class Transducer:
    """The determinised machine: moves[state][byte] is (next state, the token that ends there or -1).

    Bytes so far have one tokenization at most, so a state's pairs are what is still open of each
    place where one ended. Those tokens wait in a list by the place of their end; what the open pairs
    have in common, walking back, is emitted.
    """

    def __init__(self, vocabulary: Vocabulary, most_states: int = 150_000, lookahead: int = 512):
        self.v, self.most, self.lookahead = vocabulary, most_states, lookahead
        self.reset()

    def reset(self, keep: tuple | None = None) -> int:
        """Forgets all states but the first and the pairs in keep; the number of those."""
        start = ((-1, ROOT),)
        self.sets = list(dict.fromkeys([start, keep or start]))
        self.numbers, self.moves = {pairs: i for i, pairs in enumerate(self.sets)}, [{} for _ in self.sets]
        return len(self.sets) - 1

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        v, found, ended = self.v, [], -1
        for last, node in self.sets[state]:
            to = v.moves[node].get(byte)
            if to is not None:
                found.append((last, to))
                token = v.ends[to]
                if token >= 0 and (last < 0 or v.together(last, token)):
                    ended = token
        if ended >= 0:
            found.append((ended, ROOT))
        key = tuple(found)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        move = self.moves[state][byte] = (number, ended)
        return move

    def _back(self, ended: list[int], place: int) -> Iterator[int]:
        """The places of ends before and at place, backwards, in the one tokenization that ends there."""
        size = self.v.size
        while place > 0:
            yield place
            place -= size[ended[place]]

    def encode(self, data: bytes) -> list[int]:
        state, out, moves, ended, most = 0, [], self.moves, [-1], self.lookahead
        for byte in data:
            move = moves[state].get(byte)
            if move is None:
                if len(self.sets) > self.most:
                    state, moves = self.reset(self.sets[state]), self.moves
                move = self._step(state, byte)
            state = move[0]
            ended.append(move[1])
            if len(ended) > most:
                ended = self._emit(state, ended, out)
                most = max(self.lookahead, 2 * len(ended))  # while nothing is agreed on, look again at twice the length only
        if len(ended) > 1:
            if ended[-1] < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out += [ended[p] for p in self._back(ended, len(ended) - 1)][::-1]
        return out

    def _emit(self, state: int, ended: list[int], out: list[int]) -> list[int]:
        """Emits up to the last place that all open pairs come through; what is left of the list."""
        at = len(ended) - 1
        common = None
        for _, node in self.sets[state]:
            places = set(self._back(ended, at - self.v.depth[node]))
            common = places if common is None else common & places
        if not common:
            return ended
        place = max(common)
        out += [ended[p] for p in self._back(ended, place)][::-1]
        return [-1, *ended[place + 1 :]]


#: (least, most) of the next byte and how many bytes a character lacks after it, by first byte. Fixed values of the UTF-8 standard.
LEADS = ((0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))


class Utf8:
    """Feeds on bytes in any cuts; whole characters come out at once. Wrong bytes raise UnicodeError."""

    CLEAN = (0, 0, 0)

    def __init__(self):
        self.state, self.rest = self.CLEAN, b""

    @staticmethod
    @lru_cache(1 << 20)
    def after(state: tuple[int, int, int], data: bytes) -> tuple[tuple[int, int, int], int]:
        """The state after data, and how many of its bytes end a whole character."""
        lacks, low, high = state
        whole = 0
        for i, byte in enumerate(data):
            if lacks:
                if not low <= byte <= high:
                    raise UnicodeError(f"byte {byte} can't continue")
                lacks, low, high = lacks - 1, 0x80, 0xBF
            else:
                for first, last, n, least, most in LEADS:
                    if first <= byte <= last:
                        lacks, low, high = n, least, most
                        break
                else:
                    raise UnicodeError(f"byte {byte} can't begin")
            if not lacks:
                whole = i + 1
        return ((lacks, low, high) if lacks else Utf8.CLEAN), whole

    def feed(self, data: bytes) -> str:
        self.state, whole = self.after(self.state, data)
        if not whole:
            self.rest += data
            return ""
        text = (self.rest + data[:whole]).decode()
        self.rest = data[whole:]
        return text

    def end(self) -> None:
        if self.rest:
            raise UnicodeError("the text ends within a character")


class Codec:
    """Encodes and decodes texts; pattern's matches are encoded separately, as the ranks' library does."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 500_000, longest: int = 48):
        self.vocabulary = Vocabulary(ranks)
        self.machine, self.pattern = Transducer(self.vocabulary), regex.compile(pattern)
        self.easy = PRETOKENS["bytes"] if pattern == PUBLIC_PATTERN else None  # says the same of easy texts, faster
        self.keep, self.longest, self.known, self.older = keep // 2, longest, {}, {}
        self.tokens = self.vocabulary.bytes_of

    def piece(self, piece: str) -> bytes:
        """The ids of one match: its own id if it is a token, else what the machine says."""
        if (ids := self.older.get(piece)) is not None:
            self.known[piece] = ids
            return ids
        data = piece.encode()
        own = self.vocabulary.ranks.get(data)
        ids = np.array([own] if own is not None else self.machine.encode(data), "<u4").tobytes()
        if len(piece) <= self.longest:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > self.keep:
            self.older, self.known = self.known, {}
        known, one = self.known, self.piece
        pieces = self.easy.findall(text) if self.easy and EASY_TEXT.fullmatch(text) else self.pattern.findall(text)
        found = list(map(known.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = known.get(pieces[i]) or one(pieces[i])
        return np.frombuffer(b"".join(found), "<u4")

    def stream(self, ids) -> Iterator[str]:
        """The text of ids, as soon as its characters are whole."""
        machine = Utf8()
        for i in ids:
            if text := machine.feed(self.tokens[int(i)]):
                yield text
        machine.end()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, checked as UTF-8 over the ends of tokens."""
        parts = list(map(self.tokens.__getitem__, ids.tolist()))
        data = b"".join(parts)
        at = 0
        for i in np.nonzero(~self._clean[ids])[0].tolist():  # from a clean state, clean tokens lead to it again
            if i < at:
                continue
            state, at = Utf8.after(Utf8.CLEAN, parts[i])[0], i + 1
            while state != Utf8.CLEAN:
                if at == len(parts):
                    raise UnicodeError("the text ends within a character")
                state, at = Utf8.after(state, parts[at])[0], at + 1
        return data

    @cached_property
    def _clean(self) -> np.ndarray:
        """By id: whether a token has whole characters only, so that it leads from a clean state to one."""
        out = np.zeros(max(self.tokens) + 1, bool)
        for i, token in self.tokens.items():
            try:
                out[i] = Utf8.after(Utf8.CLEAN, token)[0] == Utf8.CLEAN
            except UnicodeError:
                pass
        return out


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process. path: a file of base64 bytes and ranks."""
    raw = files.read(path) if "://" in path else open(path, "rb").read()
    made = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, pattern)
    gc.freeze()  # the tables hold no cycles and stay
    return made


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded, and its ids decoded again.

    Defined cases: null and empty texts have no ids; repeated rows are encoded each; a null doc_id is
    carried; an empty table gives an empty one; other columns are not looked at.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for b in batches:
            rows = []
            gc.disable()  # the machine's tables hold no cycles, and a collector that walks them takes a third of the time
            for text in b["text"]:
                ids = own.encode(text)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            gc.enable()
            yield pd.concat([b[["doc_id"]], pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=b.index)], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
