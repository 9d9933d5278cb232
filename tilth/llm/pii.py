"""Personal data: plain patterns, and a skip-chain conditional random field that adds to them.

The field labels every token of a document. Neighbours are joined in a chain; tokens that repeat, or
hold the same letters and digits, are joined to one hub however far apart, so the number of edges is
linear in the tokens. Loopy message passing over both kinds makes a token that is plainly a secret in
one place one in all places of the document: a hub hears the tokens that a telling word stands right
before or a plain pattern matches (all, where there is none such), and tells all; bare repeats are not
evidence against it, however many.

Most tokens are other whatever their neighbours say: their own score is beyond what the weights between
neighbours can turn. Messages go only through the rest, all tokens that repeat one of them, and a few
tokens about each; a hub whose tokens are all beyond that bound can't turn any of them either.

The weights are trained here on sentences that this module makes up: entities in telling contexts and
in none, and numbers of other kinds. The chain's weights maximise the conditional likelihood; the
weight of the hubs' edges is the log odds of agreement in those documents (piecewise training).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.llm._shared import lean, text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS, "secret")
# The patterns of the contract, in forms that read a text once: an address is looked for
# from its @, a dotted number from its first digit alone.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile("[0-9]")
TOKEN = re.compile(r"[^\s=:\"'`,;()<>\[\]{}|]+")
LOOK = re.compile(r"[0-9@+]")  # what a plain pattern matches has one of these in each token
ABOUT = 6
EDGE = ".,!?*_-#$%&~/\\"
CONTEXT = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "key", "phone", "tel", "call", "mobile", "fax", "mail", "email", "card", "visa", "ip", "server", "host", "version", "page", "chapter", "year", "license", "isbn", "order", "commit", "room", "section")
TELLING = frozenset(CONTEXT)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of addresses, as a leftmost search without overlaps finds them: each @ ends one run of letters that may stand before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = len(before.rstrip(LOCAL)) + free
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, by start and then as KINDS are listed."""
    found = []
    if "@" in text:
        found += [(*span, "email") for span in emails(text)]
    if DIGIT.search(text):
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        found += [(*m.span(), "card") for m in CARD.finditer(text) if 14 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
        if "+" in text:
            found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def features(token: str, before: list[str], after: str, glued: str, base: str) -> list[str]:
    """What the field sees of a token: its shape, its neighbours' words, what joins it to the one before, a plain match."""
    core = token.strip(EDGE)
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    shape = re.sub("9+", "9", re.sub("a+", "a", re.sub("A+", "A", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in core))))
    kind = "word" if not digits else "number" if not letters else "mixed"
    f = ["bias", f"kind={kind}", f"len={min(len(core), 24) // 4}", f"digits={min(digits, 20) // 3}", f"kind={kind}&len={min(len(core), 40) // 4}", f"base={base}"]
    if digits:
        f += [f"shape={shape[:8]}", f"dots={core.count('.')}", f"dashes={core.count('-')}"]
    if len(core) >= 16 and kind == "mixed":
        f.append("long-mixed")
        if core.isupper():
            f.append("long-upper-mixed")
        if re.fullmatch("[0-9a-f]+", core):
            f.append("long-hex")
    if 14 <= digits <= 19 and not letters:
        f.append(f"luhn={luhn(_digits(core))}")
    if "@" in core:
        f.append("at")
    if core.startswith("+"):
        f.append("plus")
    near = [w for w in (x.lower().strip(".") for x in before) if w in TELLING]
    f += [f"near={w}&{kind}" for w in near[-1:]]
    if before and before[-1].lower().strip(".") in TELLING:
        f.append(f"prev={before[-1].lower().strip('.')}&{kind}")
        if "=" in glued or ":" in glued:
            f += [f"set={before[-1].lower().strip('.')}&{kind}", f"set={before[-1].lower().strip('.')}&{kind}&long={len(core) >= 14}"]
    if after.lower().strip(".") in TELLING:
        f.append(f"next={after.lower().strip('.')}&{kind}")
    return f


def key_of(word: str) -> str:
    """What repeats of a token have in common; empty for short ones, which are joined to nothing."""
    key = word.lower()
    if not key.isalnum():
        key = "".join(filter(str.isalnum, key))
    return key if len(key) >= 4 else ""


class Document:
    """A text's tokens, and what the field sees of each."""

    def __init__(self, text: str, base: list[tuple[int, int, str]]):
        self.text, self.base = text, base
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.words = [text[a:b] for a, b in self.spans]
        self.starts = [s for s, _, _ in base]
        self.longest = max((e - s for s, e, _ in base), default=0)

    def base_of(self, a: int, b: int) -> str:
        if not self.base:
            return "none"
        near = range(bisect_left(self.starts, a - self.longest), bisect_left(self.starts, b))
        return next((self.base[j][2] for j in near if a < self.base[j][1]), "none")

    def seen(self, i: int) -> tuple[str, list[str], str, str, str]:
        """The arguments of `features` for token i."""
        a, b = self.spans[i]
        after = self.words[i + 1] if i + 1 < len(self.words) else ""
        glued = self.text[self.spans[i - 1][1] : a] if i else ""
        return self.words[i], self.words[max(0, i - 3) : i], after, glued, self.base_of(a, b)


def _is_context(word: str) -> bool:
    return word.lower().strip(".") in TELLING


class Field:
    """Weights by feature and label, by pairs of neighbours' labels, and for agreement over a hub."""

    def __init__(self, index: dict[str, int], unary: np.ndarray, pair: np.ndarray, agree: float):
        self.index, self.unary, self.pair, self.agree = index, unary, pair, agree
        # the most that both neighbours together can say for a label against other
        self.turn = (pair - pair[:, :1]).max(axis=0) + (pair - pair[:1]).max(axis=1)
        self.flags: dict[str, int] = {}
        self.long: dict[int, bool] = {}
        self.known: dict[tuple, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"flags": {}, "known": {}}

    def local(self, word: str, before: list[str], after: str, glued: str, base: str) -> np.ndarray:
        """A token's own score by label; remembered by all that the features take from its neighbours."""
        near = [_is_context(w) for w in before]
        last = before[len(near) - 1 - near[::-1].index(True)] if any(near) else ""
        prev = last if near and near[-1] else ""
        joined = "=" if prev and ("=" in glued or ":" in glued) else ""
        key = (word, last.lower().strip("."), bool(prev), joined, after.lower().strip(".") if _is_context(after) else "", base)
        if key not in self.known:
            if len(self.known) >= 50_000:
                self.known.clear()
            f = features(word, before, after, glued, base)
            score = self.unary[[self.index[x] for x in f if x in self.index]].sum(axis=0)
            if len(word) > 200:
                return score
            self.known[key] = score
        return self.known[key]

    def may_turn(self, local: np.ndarray) -> bool:
        """Whether neighbours could make the token anything but other."""
        return bool((local + self.turn - local[0])[1:].max() > 0)

    def may_turn_between(self, before: np.ndarray, local: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The same for many tokens, with the most that the neighbours with these scores (against other) can say."""
        forward, backward = (self.pair - self.pair[:, :1]).max(axis=0), (self.pair - self.pair[:1]).max(axis=1)
        left = _through(before + forward * (np.arange(len(LABELS)) > 0), self.pair) - self.pair[0, 0]
        right = _through(after + backward * (np.arange(len(LABELS)) > 0), self.pair.T) - self.pair[0, 0]
        most = local + np.minimum(left, forward) + np.minimum(right, backward)
        return most[:, 1:].max(axis=1) > 0

    def _flag(self, word: str) -> int:
        """1: the word may turn by its own looks; 2: it is one of CONTEXT; 4: it may turn between two words that can't."""
        core = word.strip(EDGE)
        if LOOK.search(word):
            return 5
        if not core.isalpha():
            own = self.local(word, [], "", "", "none")
            return 5 * self.may_turn(own) + 2 * _is_context(word)
        n = min(len(core), 40)  # only its length counts then
        if n not in self.long:
            own = self.local("a" * n, [], "", "", "none")
            may = self.may_turn(own)
            if may:
                plain = [self.local("a" * k, [], "", "", "none") for k in range(1, n)]
                beside = np.max([x - x[0] for x in plain if not self.may_turn(x)], axis=0)[None]
                may += 4 * bool(self.may_turn_between(beside, (own - own[0])[None], beside)[0])
            self.long[n] = int(may)
        return self.long[n] + 2 * _is_context(word)

    def look(self, words: list[str]) -> np.ndarray:
        """Which tokens may turn by their own looks, by a word of CONTEXT near them, or by a plain match; all others can't.

        Where the only ones are words that would turn beside each other alone, and all stand apart, none can.
        """
        if len(self.flags) > 100_000:
            self.flags.clear()
        known, flag, long = self.flags, self._flag, []
        found = list(map(known.get, words))
        if None in found:
            for i, f in enumerate(found):
                if f is None:
                    w = words[i]
                    found[i] = known[w] = flag(w)
                    if len(w) > 200:
                        long.append(w)
        flags = np.frombuffer(bytes(found), np.uint8)
        for w in long:
            known.pop(w, None)
        look, context = (flags & 1).astype(bool), (flags & 2).astype(bool)
        if context.any():
            look[:-1] |= context[1:]
            for k in (1, 2, 3):
                look[k:] |= context[:-k]
        elif not (flags & 4).any() and not (look[1:] & look[:-1]).any():
            look[:] = False
        return look

    def marginals(self, local: np.ndarray, chain: np.ndarray, groups: list[list[int]], heard: list[list[int]], damp: float = 0.3) -> np.ndarray:
        """Beliefs by loopy sum-product over the chain and a hub for each group, until messages settle.

        chain: places whose next neighbour follows them. A place is in one group at most. A hub hears those
        of its group in `heard`. From the 200th sweep on steps shrink, so that messages which go round in a
        circle end too. Memory: four messages of a number a label for each token, and one block of edges.
        """
        left, right = chain, chain + 1
        member = np.array([i for g in groups for i in g], np.int64)
        hub = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        first = np.nonzero(np.diff(hub, prepend=-1))[0]
        mute = np.array([i not in h for g, h in zip(groups, map(set, heard), strict=True) for i in g], bool)
        ahead, behind = np.zeros((len(left), len(LABELS))), np.zeros((len(left), len(LABELS)))
        up, down = np.zeros((len(member), len(LABELS))), np.zeros((len(member), len(LABELS)))
        gain = np.expm1(self.agree)

        def belief() -> np.ndarray:
            b = local.copy()
            b[right] += ahead
            b[left] += behind
            b[member] += down
            return b

        def over_hub(given: np.ndarray) -> np.ndarray:
            e = np.exp(given - given.max(axis=1, keepdims=True))
            return np.log(e.sum(axis=1, keepdims=True) + gain * e)

        step, sweep, moved = 1 - damp, 0, 1.0
        while moved >= 1e-4 and (len(left) or len(member)):
            b = belief()
            at_hub = np.add.reduceat(up, first)[hub] if len(member) else up
            fresh = [_through(b[left] - behind, self.pair), _through(b[right] - ahead, self.pair.T), over_hub(b[member] - down), over_hub(at_hub - up)]
            fresh[2][mute] = 0
            moved = 0.0
            for message, new in zip((ahead, behind, up, down), fresh, strict=True):
                if len(new):
                    new -= new.max(axis=1, keepdims=True)
                    moved = max(moved, step * float(np.abs(new - message).max()))
                    message += step * (new - message)
            sweep += 1
            if sweep >= 200:
                step *= 0.97
        return _softmax(belief())


def _through(given: np.ndarray, pair: np.ndarray, block: int = 4096) -> np.ndarray:
    """Messages over edges with the weights pair, a block of edges at a time."""
    out = np.empty_like(given)
    for i in range(0, len(given), block):
        out[i : i + block] = _logsumexp(given[i : i + block, :, None] + pair[None], 1)
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def made_up(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Documents of invented words with entities, and the entities' spans."""
    r = random.Random(seed)
    syllables = ["ta", "ner", "lo", "mi", "ve", "sur", "an", "dol", "ik", "é", "ung", "ras", "pe", "cio"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    num = lambda k: "".join(r.choices("0123456789", k=k))
    some = lambda letters, k: "".join(r.choices(letters, k=k))

    def card() -> str:
        d = num(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def no_card() -> str:
        return next(d for _ in range(99) if not luhn(d := num(r.randint(14, 19))))

    def secret() -> tuple[str, str, str]:
        value = r.choice([lambda: "AK" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 18), lambda: some("0123456789abcdef", r.choice([18, 20, 32, 40])), lambda: some("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", r.randint(16, 40)), lambda: some(r.choice(["abcdefghijklmnopqrstuvwxyz", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"]), r.randint(16, 32))])()
        name = r.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "key"])
        return r.choice([(f"{name}=", value, ""), (f"{name} = \"", value, '"'), (f"{name}: ", value, "")] + [("", value, "")] * value.startswith("AK") + [(f"{name} is ", value, "")] * bool(DIGIT.search(value)))

    def entity() -> tuple[str, str, str, str]:
        kind = r.choice(["email", "ip", "card", "phone", "phone", "secret", "secret", "secret"])
        if kind == "secret":
            return (*secret(), kind)
        if kind == "phone" and r.random() < 0.3:  # no plain match: the word before it tells
            return r.choice(["phone ", "tel ", "call ", "mobile ", "fax ", "phone: "]), r.choice([f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", num(10)]), "", kind
        lead = r.choice(["", "", {"email": "mail ", "ip": "server ", "card": "card ", "phone": "phone "}[kind]])
        value = {"email": lambda: f"{word()}.{num(2)}@{word()}{num(1)}.example.org", "ip": lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)), "card": card, "phone": lambda: r.choice([f"+{r.randint(1, 98)} ({num(3)}) 555-{num(4)}", f"+{r.randint(1, 98)} {num(3)} {num(3)} {num(4)}"])}[kind]()
        return lead, value, "", kind

    def long() -> str:
        one = "".join(r.choices(syllables, k=r.randint(5, 14)))
        return r.choice([one, one, one.capitalize(), one.upper()]) + r.choice(["", "", "!!"])

    def plain() -> str:
        return r.choice([lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: str(r.randint(1900, 2035)), lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)}", lambda: f"${num(2)}.{num(2)}", lambda: f"page {num(3)}", lambda: num(r.randint(1, 9)), lambda: f"room {word()}{num(2)}", lambda: f"{word()}={num(2)}", lambda: f"order {num(r.randint(6, 12))}", lambda: f"commit {num(10)}", lambda: f"page {num(3)}-{num(3)}", lambda: f"{num(2)}%", no_card, lambda: f"{num(1)}:{num(2)}", lambda: f"{word()}-{num(1)}", lambda: f"isbn {num(13)}", lambda: f"x{num(1)} = y{num(1)}", lambda: f"{word()}@{word()}", lambda: f"BY-NC {num(1)}.0.", lambda: f"{r.choice(CONTEXT)}{r.choice([' ', ': ', ' = '])}{word()}", long, long, lambda: " ".join([long()] * r.randint(2, 6))])()

    out = []
    for _ in range(n):
        text, spans, kept = "", [], []
        for _ in range(r.randint(2, 6)):
            text += " ".join(word() for _ in range(r.randint(3, 9))) + " "
            for _ in range(r.randint(0, 3)):
                text += plain() + " " + word() + " "
            if r.random() < 0.6:
                if kept and r.random() < 0.35:
                    (_, value, _, kind), lead, tail = r.choice(kept), "", ""
                else:
                    lead, value, tail, kind = one = entity()
                    kept.append(one)
                text += lead
                spans.append((len(text), len(text) + len(value), kind))
                text += value + tail + r.choice([" ", ". ", ", "])
        out.append((text, spans))
    return out


@cache
def trained(documents: int = 1200, rounds: int = 12, together: int = 8, seed: int = 11) -> Field:
    """The field, trained on `documents` made-up ones, `together` at a time; by the driver, in seconds, which sends it along."""
    index: dict[str, int] = {}
    rows = []
    same = pairs = 0
    for text, spans in made_up(documents, seed):
        doc = Document(text, base_spans(text))
        if not doc.words:
            continue
        feats = [[index.setdefault(x, len(index)) for x in features(*doc.seen(i))] for i in range(len(doc.words))]
        gold = np.array([next((LABELS.index(k) for s, e, k in spans if s < b and a < e), 0) for a, b in doc.spans])
        rows.append((np.array([x for f in feats for x in f]), np.cumsum([0, *map(len, feats)])[:-1], gold))
        last: dict[str, int] = {}
        for i, key in enumerate(map(key_of, doc.words)):
            if key in last:
                pairs += 1
                same += bool(gold[last[key]] == gold[i])
            if DIGIT.search(key):
                last[key] = i
    unary, pair = np.zeros((len(index), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    step_u, step_p = np.full_like(unary, 1e-6), np.full_like(pair, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), together):
            some = [rows[i] for i in order[k : k + together]]
            sizes = [len(gold) for _, _, gold in some]
            local = np.zeros((len(some), max(sizes), len(LABELS)))
            for d, (feats, starts, gold) in enumerate(some):
                local[d, : len(gold)] = np.add.reduceat(unary[feats], starts)
            one, two = _chain_marginals(local, np.array(sizes), pair)
            grad_u, grad_p = 1e-3 * unary, 1e-3 * pair + two
            for d, (feats, starts, gold) in enumerate(some):
                off = one[d, : len(gold)]
                off[np.arange(len(gold)), gold] -= 1
                each = np.repeat(off, np.diff([*starts, len(feats)]), axis=0)
                for label in range(len(LABELS)):
                    grad_u[:, label] += np.bincount(feats, each[:, label], len(unary))
                np.add.at(grad_p, (gold[:-1], gold[1:]), -1)
            step_u += grad_u**2
            step_p += grad_p**2
            unary -= 0.3 * grad_u / np.sqrt(step_u)
            pair -= 0.3 * grad_p / np.sqrt(step_p)
    agree = float(np.log((same + 1) / (pairs - same + 1) * (len(LABELS) - 1)))
    return Field(index, unary, pair, min(agree, 6.0))


def _chain_marginals(local: np.ndarray, sizes: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals of chains, one a row of local and `sizes` long: by token, and summed over all joined pairs."""
    m, n = local.shape[:2]
    own, step = np.exp(local - local.max(axis=2, keepdims=True)), np.exp(pair - pair.max())
    ahead, behind = own.copy(), np.ones_like(own)  # each token's are scaled to a sum of one
    ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, n):
        ahead[:, i] *= ahead[:, i - 1] @ step
        ahead[:, i] /= ahead[:, i].sum(axis=1, keepdims=True)
    inside = np.arange(n)[None] < sizes[:, None]
    for i in range(n - 2, -1, -1):
        b = (own[:, i + 1] * behind[:, i + 1]) @ step.T
        behind[:, i] = np.where(inside[:, i + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    one = ahead * behind
    two = ahead[:, :-1, :, None] * step * (own[:, 1:] * behind[:, 1:])[:, :, None]
    two *= (inside[:, 1:] / two.sum(axis=(2, 3)))[:, :, None, None]
    return one / one.sum(axis=2, keepdims=True), two.sum(axis=(0, 1))


def _turning(doc: Document, field: Field, maybe: list[int]) -> tuple[list[int], set[str]]:
    """Those of the tokens that their own neighbours may turn, and their keys; a neighbour that has one of the keys may itself be turned by its hub."""
    n, words = len(doc.words), doc.words
    at = sorted({j for i in maybe for j in (i - 1, i, i + 1) if 0 <= j < n})
    place = {j: k for k, j in enumerate(at)}
    own = np.array([field.local(*doc.seen(j)) for j in at] + [np.where(np.arange(len(LABELS)) > 0, -np.inf, 0)])  # the last: no neighbour
    own -= own[:, :1]
    key = [key_of(words[j]) for j in at]
    three = np.array([[place.get(i + d, len(at)) for d in (-1, 0, 1)] for i in maybe])
    keys: set[str] = set()
    while True:
        hub = np.array([k in keys for k in key] + [False])[:, None] * (np.arange(len(LABELS)) > 0) * field.agree
        most = own + hub
        turns = field.may_turn_between(most[three[:, 0]], own[three[:, 1]], most[three[:, 2]])
        turning = [i for i, t in zip(maybe, turns, strict=True) if t]
        more = {k for i in turning if (k := key_of(words[i]))}
        if more <= keys:
            return turning, keys
        keys |= more


def beliefs(doc: Document, field: Field, look: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
    """Tokens that messages go through, and what is believed of them; all other tokens are other. Without `look`, all tokens."""
    words, n = doc.words, len(doc.words)
    if look is None:
        found, keys, at = {}, {key for w in words if (key := key_of(w))}, list(range(n))
    else:
        found = {int(i): field.local(*doc.seen(i)) for i in np.nonzero(look)[0]}
        maybe = [i for i, score in found.items() if field.may_turn(score)]
        turning, keys = _turning(doc, field, maybe) if maybe else ([], set())
    same = {w: key for w in set(words) if (key := key_of(w)) in keys} if keys else {}
    groups: dict[str, list[int]] = {}
    for i, w in enumerate(words) if same else ():
        if w in same:
            groups.setdefault(same[w], []).append(i)
    if look is not None:
        near = np.zeros(n + 1, np.int64)
        for i in {*turning, *(i for g in groups.values() for i in g)}:
            near[max(0, i - ABOUT)] += 1
            near[min(n, i + ABOUT + 1)] -= 1
        at = np.nonzero(np.cumsum(near[:-1]))[0].tolist()
    if not at:
        return [], np.zeros((0, len(LABELS)))
    local = np.array([found[i] if i in found else field.local(*doc.seen(i)) for i in at])
    place = {i: k for k, i in enumerate(at)}
    chain = np.nonzero(np.diff(at) == 1)[0]
    for k, i in enumerate(at):  # tokens beyond a stretch are other
        if i and i - 1 not in place:
            local[k] += field.pair[0]
        if i + 1 < n and i + 1 not in place:
            local[k] += field.pair[:, 0]
    joined = [g for g in groups.values() if len(g) > 1]
    telling = [[i for i in g if (i and _is_context(words[i - 1])) or doc.base_of(*doc.spans[i]) != "none"] or g for g in joined]
    return at, field.marginals(local, chain, *([[place[i] for i in g] for g in gs] for gs in (joined, telling)))


def added_spans(text: str, base: list[tuple[int, int, str]], field: Field, least: float = 0.9) -> list[tuple[int, int, str]]:
    """What the field finds beside the plain spans: runs of tokens with one label, each believed by `least` or more, or most likely and so believed of the same token elsewhere."""
    look = field.look(TOKEN.findall(text))
    if not look.any():
        return []
    doc = Document(text, base)
    at, belief = beliefs(doc, field, look)
    if not at:
        return []
    label, sure = belief.argmax(axis=1), belief.max(axis=1) >= least
    plain = {(key_of(doc.words[i]), k) for i, k, s in zip(at, label, sure, strict=True) if s and k}
    label = [k if k and (s or (key := key_of(doc.words[i])) and (key, k) in plain) else 0 for i, k, s in zip(at, label, sure, strict=True)]
    runs: list[list] = []
    for i, k in zip(at, label, strict=True):
        a, b = doc.spans[i]
        while b > a and text[b - 1] in ".,!?*":
            b -= 1
        if not k or doc.base_of(a, b) != "none":
            continue
        if runs and runs[-1][3] == i - 1 and runs[-1][2] == k and LABELS[k] == "phone":
            runs[-1][1], runs[-1][3] = b, i
        elif b > a:
            runs.append([a, b, k, i])
    return [(a, b, LABELS[k]) for a, b, k, _ in runs]


def _said(spans: list[tuple[int, int, str]]) -> str:
    order = {k: i for i, k in enumerate(LABELS[1:])}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the plain spans), base_sha256, spans (all).

    Defined cases: null and empty texts have no spans; repeated rows are read each; a null doc_id is
    carried; an empty table gives an empty one; other columns are not looked at.
    """

    field = trained()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                base = base_spans(text)
                rows.append((*(sum(k == kind for _, _, k in base) for kind in KINDS), hashlib.sha256(_said(base).encode()).hexdigest(), _said([*base, *added_spans(text, base, field)])))
            yield pd.concat([b[["doc_id"]], pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"], index=b.index)], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(lean(work), f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redacted(text: str, field: Field) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one, named after the first."""
    base = base_spans(text)
    spans = sorted([*base, *added_spans(text, base, field)])
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans in `text` replaced by their kinds, all other columns as they are. A null text stays null."""

    field = trained()

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else redacted(t, field))

    return docs.withColumn(text, F.pandas_udf(lean(work), "string")(F.col(text)))
