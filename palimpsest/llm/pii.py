"""Personal data: base patterns, and a semi-Markov conditional random field that adds what they miss.

The field works on regions: runs of tokens around digits, "@" and bracketed "at". A candidate is any span of up to MAX_TOKENS tokens
that has such an anchor, enough of it to be an entity at all, and no white space at its ends; its score is a weight vector of the type times features of the
whole span (its characters and digit groups, checksums, the kinds' usual forms, the characters beside it, the words before
it). Tokens outside spans score 0, and each entity adds a weight for its type after the type of the entity before it in the region. One dynamic programme
over token ends with a bounded span length chooses boundaries and types together. The weights are fitted by the exact
likelihood (forward and backward sums over the same segments) on generated texts: personal data in many forms, and numbers that are none.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "iban", "secret"]
MAX_TOKENS = 24
MAX_CHARS = 80

# Base patterns of the contract. Digits runs are taken whole: no match can begin inside one.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the base patterns, leftmost and non-overlapping for each kind, by start and then kind."""
    out = []
    at = text.find("@")
    taken = 0
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            taken = m.end()
        at = text.find("@", max(at + 1, taken))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.DOTALL)
_ANCHOR = re.compile(r"[0-9@]|[(\[](?i:at)[)\]]")
_FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?)[A-Za-z0-9-]+)+", re.IGNORECASE),
    "ip": re.compile(r"(?:[0-9]{1,3}\s?\.\s?){3}[0-9]{1,3}|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"),
    "card": re.compile(r"[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{2,7}"),
    "phone": re.compile(r"(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "secret": re.compile(r"(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,80}"),
}
_CUES = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "mastercard", "credit", "amex"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "contact"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "bank"},
    "secret": {"token", "key", "secret", "password", "apikey", "api", "passwd", "bearer"},
}
FEATURES = [
    "bias", "tokens", "digits", *(f"form_{k}" for k in KINDS), *(f"cue_{k}" for k in KINDS), "luhn", "mod97", "hex", "mixed", "joined_left", "joined_right",
    "octets", "digits_9_15", "digits_14_19", "plus", "bracket", "goes_on_left", "goes_on_right", "free_words", "one_word", "number_signs", "pairs", "groups_3_2_4",
    "hex_colons", "at", "key_signs", "spaces", "odd_end", "bare_number",
]
_NUMBER_SIGNS = frozenset("0123456789 +().-/")
_HEX_COLONS = re.compile(r"(?=.*::|(?:[0-9a-fA-F]+:){7})[0-9a-fA-F:]{6,39}")
_KEY_SIGNS = re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]{16,80}")
_AT = re.compile(r"@|[(\[]at[)\]]", re.IGNORECASE)
#: A word of three letters or more with white space on both sides.
_FREE_WORD = re.compile(r"(?<!\S)[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*(?!\S)")
_GROUP = re.compile(r"[0-9]+")


def _mod97(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return len(s) >= 15 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, end: int, cue: set[str]) -> list[float]:
    """Features of the whole span; cue: the lower-cased words shortly before it."""
    span = text[start:end]
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    left, right = text[start - 1 : start], text[end : end + 1]
    octets = span.split(".")
    forms = [f.fullmatch(span) is not None for f in _FORMS.values()]
    numeric = not set(span) - _NUMBER_SIGNS
    return [
        1.0, (end - start) / 20, len(digits) / 10, *map(float, forms),
        *(float(not words.isdisjoint(cue)) for words in _CUES.values()),
        float(numeric and len(digits) >= 13 and luhn(digits)), float(forms[5] and _mod97(span)),
        float(len(span) >= 24 and not set(span) - set("0123456789abcdefABCDEF")),
        float(len(span) >= 20 and bool(digits) and any(c.islower() for c in span) and " " not in span),
        float(left.isalnum() or left != "" and left in "._-+@/=:"), float(right.isalnum() or right != "" and right in "_-@/=+"),
        float(len(octets) == 4 and all(o.strip().isdecimal() and len(o.strip()) <= 3 and int(o) <= 255 for o in octets)),
        float(9 <= len(digits) <= 15), float(14 <= len(digits) <= 19), float(span[:1] == "+"), float("(" in span or "[" in span),
        # A digit group or part of a word that stands behind one sign belongs to the same thing.
        float(left != "" and left in " .-/" and text[start - 2 : start - 1].isdigit() and span[:1].isdigit()), float(right != "" and right in " .-/" and text[end + 1 : end + 2].isdigit() and span[-1:].isdigit()),
        float(len(_FREE_WORD.findall(span))), float(span.isalnum()), float(numeric), float(len(groups) >= 4 and numeric and all(len(g) == 2 for g in groups)),
        float(numeric and [len(g) for g in groups] == [3, 2, 4]), float(_HEX_COLONS.fullmatch(span) is not None), float(_AT.search(span) is not None),
        float(_KEY_SIGNS.fullmatch(span) is not None), float(span.count(" ")) / 4, float(not span[:1].isalnum() and span[:1] not in "+(:" or not span[-1:].isalnum() and span[-1:] not in ":="),
        float(span.isdigit()),
    ]


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans around each anchor: up to 40 characters on each side, within a line; near regions are one."""
    begin = end = -1
    for m in _ANCHOR.finditer(text):
        if begin >= 0 and m.start() <= end + 80:
            end = m.end()
            continue
        if begin >= 0:
            yield from _tokens(text, begin, end)
        begin, end = m.start(), m.end()
    if begin >= 0:
        yield from _tokens(text, begin, end)


def _tokens(text: str, begin: int, end: int) -> Iterator[list[tuple[int, int]]]:
    low, high = max(0, begin - 40, text.rfind("\n", max(0, begin - 40), begin) + 1), min(len(text), end + 40)
    stop = text.find("\n", end, high)
    high = stop if stop >= 0 else high
    for _ in range(MAX_CHARS):  # whole words at the ends
        low -= low > 0 and text[low - 1].isalnum()
        high += high < len(text) and text[high].isalnum()
    # One programme runs over the whole region: spans are bounded, so its time is linear.
    yield [m.span() for m in _TOKEN.finditer(text, low, high)]


#: What the characters of a span leave it to be: a number of any kind, hexadecimal groups, a key, an account, an address.
_NUM, _HEX, _KEY, _IBAN, _MAIL = 1, 2, 4, 8, 16
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MADE_OF = {
    _NUM: _NUMBER_SIGNS, _HEX: frozenset("0123456789abcdefABCDEF:"), _KEY: frozenset("0123456789_-+/=" + _LETTERS), _IBAN: frozenset("0123456789 " + _LETTERS.upper()),
    _MAIL: frozenset("0123456789._%+-@()[] " + _LETTERS),
}


#: Signs of which one may stand between two groups of a number.
_BETWEEN = (" ", ".", "-", "/")
_ALL_CUES = frozenset().union(*_CUES.values())


@lru_cache(maxsize=1 << 14)
def _may_be(part: str) -> int:
    return sum(bit for bit, signs in _MADE_OF.items() if signs.issuperset(part))


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, list[float]]]:
    """(first token, end token, features) of the spans that may be an entity.

    These have no white space at their ends, and an "at" with a word on both sides, or three digits and no free word between them. Their characters
    must leave them to be something: a number of 9 to 19 digits (beyond 15 with a card's checksum) or of four groups, hexadecimal
    groups, a key of 16 characters, an account that begins with two letters and two digits, an address. A span that can be nothing can't be longer either.
    A number amid other numbers on both sides, without a word near it that names a kind, is a row's.
    """
    n = len(tokens)
    parts = [text[a:b] for a, b in tokens]
    may = [_may_be(p) for p in parts]
    blank = [p.isspace() for p in parts]
    digits = [sum(c.isdigit() and c.isascii() for c in p) for p in parts]
    free = [len(p) > 2 and p.isalpha() and not p.isupper() and (k == 0 or blank[k - 1]) and (k + 1 == n or blank[k + 1]) for k, p in enumerate(parts)]
    at = [p == "@" or p.lower() == "at" and 0 < k < n - 1 and parts[k - 1] in "([" and parts[k + 1] in ")]" for k, p in enumerate(parts)]
    next_at = [n] * (n + 1)
    for k in range(n - 1, -1, -1):
        next_at[k] = k if at[k] else next_at[k + 1]
    out = []
    for i, (start, _) in enumerate(tokens):
        bits = may[i]
        if blank[i] or not bits:
            continue
        if next_at[i + 1] >= i + MAX_TOKENS:
            bits &= ~_MAIL
        if not (len(parts[i]) >= 4 and parts[i][:2].isalpha() and parts[i][2:4].isdigit()):
            bits &= ~_IBAN
        before: set[str] | None = None
        n_digits, n_free, n_dots, n_colons, has_at = 0, 0, 0, 0, False
        for j in range(i, min(n, i + MAX_TOKENS)):
            bits &= may[j]
            end = tokens[j][1]
            n_digits, n_free, has_at = n_digits + digits[j], n_free + free[j], has_at or at[j] and j > i
            if n_digits > 19:
                bits &= ~_NUM
            if not bits or end - start > MAX_CHARS:
                break
            n_dots, n_colons = n_dots + (parts[j] == "."), n_colons + (parts[j] == ":")
            if blank[j]:
                continue
            if not (bits & _MAIL and has_at and not at[j]):
                if n_digits < 3 or n_free:
                    continue
                number = bits & _NUM and (9 <= n_digits or n_dots == 3) and (n_digits <= 15 or luhn("".join(filter(str.isdigit, text[start:end]))))
                if not (number or bits & _HEX and n_colons >= 2 or bits & _KEY and end - start >= 16 or bits & _IBAN and end - start >= 15):
                    continue
            if before is None:
                before = {w.lower() for w in re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start])}
                follows = before.isdisjoint(_ALL_CUES) and text[start].isdigit() and text[start - 1 : start] in _BETWEEN and text[start - 2 : start - 1].isdigit()
            if follows and bits == _NUM and text[end - 1].isdigit() and text[end : end + 1] in _BETWEEN and text[end + 1 : end + 2].isdigit():
                continue
            out.append((i, j + 1, features(text, start, end, before)))
    return out


_F = {name: k for k, name in enumerate(FEATURES)}


def scored(x: np.ndarray, weights: Weights) -> np.ndarray:
    """Scores of candidates by type. No account is a number alone. No card fails its checksum. Without a word that names them cards have a card's groups,
    and cards and social security numbers no further digits beside them.
    """
    scores = x @ weights.spans.T
    scores[x[:, _F["number_signs"]] > 0, KINDS.index("iban")] = -np.inf
    goes_on = (x[:, _F["goes_on_left"]] > 0) | (x[:, _F["goes_on_right"]] > 0)
    card = (x[:, _F["luhn"]] > 0) & ((x[:, _F["form_card"]] > 0) & ~goes_on | (x[:, _F["cue_card"]] > 0))
    scores[~card, KINDS.index("card")] = -np.inf
    scores[goes_on & (x[:, _F["cue_ssn"]] == 0), KINDS.index("ssn")] = -np.inf
    return scores


def viterbi(n: int, spans: list[tuple[int, int]], scores: np.ndarray, moves: np.ndarray) -> list[tuple[int, int]]:
    """(candidate, type) of the best labelling of n tokens; tokens outside score 0. moves: weights by the type of the entity before (none last) and the type."""
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j) in enumerate(spans):
        ends[j].append(k)
    kinds = moves.shape[1]
    # By token and the last entity's type: the best score, and the candidate that ended there with the type before it.
    best = np.full((n + 1, kinds + 1), -np.inf)
    best[0, kinds] = 0
    reach: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ends[j]:
            i = spans[k][0]
            if i not in reach:
                through = best[i][:, None] + moves
                last = through.argmax(axis=0)
                reach[i] = through[last, np.arange(kinds)], last
            came, last = reach[i]
            value = came + scores[k]
            for t in np.flatnonzero(value > best[j, :kinds]).tolist():
                best[j, t] = value[t]
                back[j, t] = k, int(last[t])
    out: list[tuple[int, int]] = []
    j, t = n, int(best[n].argmax())
    while j > 0:
        if (step := back.get((j, t))) is None:
            j -= 1
        else:
            out.append((step[0], t))
            j, t = spans[step[0]][0], step[1]
    return out[::-1]


class Lattice:
    """The candidates of many regions, in arrays by their ends and starts, for sums over all labellings at once."""

    def __init__(self, regions: list[list[tuple[int, int]]]) -> None:
        self.regions = len(regions)
        self.region = np.repeat(np.arange(len(regions)), [len(r) for r in regions])
        flat = np.array([s for r in regions for s in r], np.int64).reshape(-1, 2)
        self.start, self.end = flat[:, 0], flat[:, 1]
        self.length = int(self.end.max(initial=0))
        self.by_end, self.by_start = ([np.flatnonzero(x == k) for k in range(self.length + 1)] for x in (self.end, self.start))

    def _sum(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Log of the sums of exp(values) by region; at is ascending, and so are its regions."""
        region = self.region[at]
        first = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        most = np.maximum.reduceat(values, first, axis=0)
        out = np.full((self.regions, values.shape[1]), -np.inf)
        size = np.diff(np.append(first, len(at)))
        out[region[first]] = np.log(np.add.reduceat(np.exp(values - np.repeat(most, size, axis=0)), first, axis=0)) + most
        return out

    def marginals(self, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each candidate with each type, and the expected number of each move."""
        kinds = moves.shape[1]
        factor = np.exp(moves)

        def moved(x: np.ndarray, by: np.ndarray) -> np.ndarray:
            most = x.max(axis=1, keepdims=True)
            return np.log(np.exp(x - most) @ by) + most

        alpha = np.full((self.length + 1, self.regions, kinds + 1), -np.inf)
        alpha[0, :, kinds] = 0
        came = np.empty((self.length + 1, self.regions, kinds))
        beta = np.zeros((self.length + 1, self.regions, kinds + 1))
        came[0] = moved(alpha[0], factor)
        for j in range(1, self.length + 1):
            alpha[j] = alpha[j - 1]
            at = self.by_end[j]
            if len(at):
                alpha[j, :, :kinds] = np.logaddexp(alpha[j, :, :kinds], self._sum(at, came[self.start[at], self.region[at]] + scores[at]))
            came[j] = moved(alpha[j], factor)
        for i in range(self.length - 1, -1, -1):
            beta[i] = beta[i + 1]
            at = self.by_start[i]
            if len(at):
                beta[i] = np.logaddexp(beta[i], self._sum(at, moved(scores[at] + beta[self.end[at], self.region[at], :kinds], factor.T)))
        whole = moved(alpha[self.length], np.ones((kinds + 1, 1)))
        rest = scores + beta[self.end, self.region, :kinds] - whole[self.region]
        share = np.exp(came[self.start, self.region] + rest)
        before = alpha[self.start, self.region]
        # Each candidate's share, split by the type before it.
        ratio = share / np.exp(came[self.start, self.region] - before.max(axis=1, keepdims=True))
        return share, (np.exp(before - before.max(axis=1, keepdims=True)).T @ ratio) * factor


def examples(count: int = 900, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated lines with their spans: each kind in its forms, with and without cue words, and numbers that are no personal data."""
    rng = random.Random(seed)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghiklmnorstuvwy") for _ in range(rng.randint(2, 8)))
    pick = rng.choice

    def card() -> str:
        d = pick("3456") + n(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        s = pick(["", " ", "-", "."])
        return s.join(d[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        body, land = n(18), pick(["DE", "FR", "ES", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    octet = lambda: str(rng.randint(0, 255))
    forms = {
        "email": lambda: f"{word()}{pick(['', '.' + word(), '.' + n(2)])}{pick(['@', '@', '(at)', ' (at) ', ' [at] '])}{word()}{pick(['.', '.', ' (dot) ', '[dot]'])}{pick(['com', 'org', 'net'])}",
        "ip": lambda: pick([lambda: ".".join(octet() for _ in range(4)), lambda: ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8)), lambda: f"{rng.choice(['2001', 'fe80', 'fd' + n(2)])}:{rng.randrange(16, 1 << 16):x}::{rng.randrange(16, 1 << 16):x}", lambda: f"2001:db8::{rng.randrange(1, 1 << 16):x}"])(),
        "card": card,
        "phone": lambda: pick([f"+1 ({n(3)}) {n(3)}-{n(4)}", f"+{n(2)} {n(3)} {n(3)} {n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"00{n(2)} {n(3)} {n(3)} {n(3)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"{n(3)}.{n(3)}.{n(4)}", f"0{n(4)} {n(6)}", f"0{n(3)}/{n(7)}"]),
        "ssn": lambda: pick([f"{n(3)}-{n(2)}-{n(4)}", f"{n(3)} {n(2)} {n(4)}"]),
        "iban": iban,
        "secret": lambda: pick(["".join(rng.choice("0123456789abcdef") for _ in range(pick([32, 40, 64]))), "sk_" + "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJK0123456789") for _ in range(28)), "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJK0123456789+/") for _ in range(pick([24, 30, 38]))) + pick(["", "=", "=="])]),
    }
    cues = {k: sorted(v) for k, v in _CUES.items()}
    needs_cue = {"ssn": 0.7, "secret": 0.8, "phone": 0.6}
    none = [
        lambda: f"version {n(1)}.{n(1)}", lambda: f"{n(4)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"{n(2)}:{n(2)}", lambda: f"{n(3)}", lambda: f"{n(1)},{n(3)},{n(3)}",
        lambda: f"{n(4)} {n(4)}", lambda: n(16), lambda: n(10), lambda: n(13), lambda: f"{rng.randint(300, 999)}.{n(3)}.{n(3)}.{n(3)}", lambda: f"{n(1)}.{n(2)} {n(3)}", lambda: f"page {n(3)} of {n(3)}",
        lambda: f"{n(2)}-{n(2)}-{n(2)}", lambda: f"isbn {n(3)}-{n(1)}-{n(5)}-{n(3)}-{n(1)}", lambda: f"{word()}@{word()}", lambda: f"{n(4)}-{n(4)}", lambda: f"order{n(12)}", lambda: f"{n(2)} {n(2)} {n(2)}", lambda: f"{n(3)} {n(2)}", lambda: f"{n(1)}:{n(2)}:{n(2)}", lambda: f"{n(5)} {word()}",
        lambda: word() * 4 + n(3),
    ]
    out = []
    for _ in range(count):
        text, spans = f"{word()} {word()} ", []
        for _ in range(pick([1, 2, 2, 3])):
            if rng.random() < 0.55:
                kind = pick(KINDS)
                if rng.random() < needs_cue.get(kind, 0.3):
                    text += pick(cues[kind]) + pick([" ", ": ", ' = "', " is "])
                value = forms[kind]()
                spans.append((len(text), len(text) + len(value), kind))
                text += value
            else:
                text += pick(none)()
            text += pick([" ", ", ", ". ", '" ', "### "]) + f"{word()} {word()} "
        out.append((text, spans))
    return out


class Weights(NamedTuple):
    """Weights of types by features, and of types after types (none last)."""

    spans: np.ndarray
    moves: np.ndarray


@lru_cache(maxsize=1)
def trained(steps: int = 120, rate: float = 0.4, decay: float = 5e-4) -> Weights:
    """Likelihood ascent with AdaGrad steps over all generated lines. The same numbers in every run."""
    kinds = len(KINDS)
    spans, xs, gold_at, gold_kind = [], [], [], []
    moved = np.zeros((kinds + 1, kinds))
    for text, gold in examples():
        for tokens in regions(text):
            found = candidates(text, tokens)
            if not found:
                continue
            places = {(tokens[i][0], tokens[j - 1][1]): len(xs) + k for k, (i, j, _) in enumerate(found)}
            last = kinds
            for a, b, kind in gold:
                if (a, b) in places:
                    t = KINDS.index(kind)
                    gold_at.append(places[a, b])
                    gold_kind.append(t)
                    moved[last, t] += 1
                    last = t
            spans.append([(i, j) for i, j, _ in found])
            xs += [f for *_, f in found]
    lattice, x = Lattice(spans), np.array(xs)
    seen = np.zeros((kinds, x.shape[1]))
    np.add.at(seen, gold_kind, x[gold_at])
    weights = Weights(np.zeros((kinds, x.shape[1])), np.zeros((kinds + 1, kinds)))
    squares = [np.full_like(w, 1e-6) for w in weights]
    for _ in range(steps):
        share, moves = lattice.marginals(x @ weights.spans.T, weights.moves)
        for w, observed, expected, square in zip(weights, (seen, moved), (share.T @ x, moves), squares, strict=True):
            grad = (observed - expected) / len(spans) - decay * w
            square += grad * grad
            w += rate * grad / np.sqrt(square)
    return weights


def field_spans(text: str, weights: Weights) -> list[tuple[int, int, str]]:
    out = []
    for tokens in regions(text):
        found = candidates(text, tokens)
        if found:
            spans = [(i, j) for i, j, _ in found]
            for k, t in viterbi(len(tokens), spans, scored(np.array([f for *_, f in found]), weights), weights.moves):
                out.append((tokens[spans[k][0]][0], tokens[spans[k][1] - 1][1], KINDS[t]))
    return out


def find(text: str, weights: Weights) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those with the field's spans that overlap none of them."""
    base = base_spans(text)
    # Base spans of several kinds may overlap; joined they are apart, so one search by start finds what a span meets.
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    added = []
    for a, b, kind in field_spans(text, weights):
        k = bisect_left(starts, b)
        if not k or ends[k - 1] <= a:
            added.append((a, b, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_spans, and with_text: redacted_text.

    Spans are kind:start:end in code points, by start and then kind. A null text is empty and its redacted text null. Redaction puts
    <KIND> for each span; of overlapping ones the first. Repeated rows are read one by one; null ids stay; an empty table gives no rows.
    """
    weights = docs.sparkSession.sparkContext.broadcast(trained())
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = read.schema["_id"].dataType.simpleString()
    anchors = np.zeros(256, bool)
    anchors[[*range(0x30, 0x3A), 0x40, 0x28, 0x5B]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for texts in W.slices(batch.column(1)):
                n = texts.last - texts.first
                seen = np.concatenate([[0], np.cumsum(anchors[texts.data])])[texts.offsets]
                counts, sha, joined, size = np.zeros((len(BASE), n), np.int64), [nothing] * n, [""] * n, [0] * n
                column = batch.column(1).slice(texts.first, n)
                clean = column.to_pylist() if with_text else []
                for i in np.flatnonzero(np.diff(seen)):
                    text = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode()
                    base, spans = find(text, weights.value)
                    for _, _, k in base:
                        counts[BASE.index(k), i] += 1
                    sha[i], joined[i], size[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans)
                    if with_text and spans:
                        parts, at = [], 0
                        for a, b, k in spans:
                            if a >= at:
                                parts += [text[at:a], f"<{k.upper()}>"]
                                at = b
                        clean[i] = "".join([*parts, text[at:]])
                columns = [batch.column(0).slice(texts.first, n), *(pa.array(c) for c in counts), pa.array(sha, pa.string()), pa.array(joined, pa.string()), pa.array(size, pa.int64())]
                names = ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"]
                if with_text:
                    columns.append(pa.array(clean, pa.string()))
                    names.append("redacted_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string, n_spans bigint" + ", redacted_text string" * with_text
    return read.mapInArrow(run, fields)
