"""Personal data: candidates of many generators, judged by boosted trees.

Base spans follow fixed grammars and always stay. Further generators, chosen for recall, propose
spans that may overlap; gradient-boosted trees look at each candidate's format and at the words
before it; their margins are calibrated to probabilities, and a threshold for each kind, chosen on
held-out candidates, selects what is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "iban")
BASE = KINDS[:4]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    r"""Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`, in time linear in the text.

    A match has one @; its start is as far left as the characters allow, but not before the end of
    the last match.
    """
    out, done, mark = [], 0, 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        low = max(done, text.rfind("@", mark, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        mark = at
        if start < at:
            out.append((start, m.end()))
            done = m.end()
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end (code points) by the fixed grammars, by kind and then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *s) for s in ips(text)]
        out += [("card", *s) for s in cards(text)]
        if "+" in text:
            out += [("phone", *s) for s in phones(text)]
    return out


# Generators: what might be personal data. Nothing bounds the length of an address or a secret.
_LOOSE = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,}+)+"), re.compile(r"@|\(at\)|\[at\]")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}(?![0-9])"), _DIGIT),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::|:?[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:])"), re.compile(":[0-9A-Fa-f]{0,4}:")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]?[0-9]{2,6}){2,4}(?![0-9])"), _DIGIT),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,8}){1,5}(?![0-9])"), _DIGIT),
    ("secret", re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{4,}+){1,5}"), _DIGIT),
    ("secret", re.compile(r"(?<![A-Za-z0-9_])(?:[A-Za-z_]{2,20} ?[=:] ?)?[\"']?[A-Za-z0-9+/_-]{16,}+=*[\"']?"), _DIGIT),
    ("secret", re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)[\"']? ?[=:] ?[\"']?[^\s\"',;]{4,}+[\"']?"), re.compile("[=:]")),
    # A key with its end, whatever lies between; or one that breaks off: its headers, and lines as keys have them.
    ("secret", re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,24}PRIVATE KEY-----"), re.compile("-----BEGIN")),
    ("secret", re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:\s+[A-Za-z0-9-]{1,32}: ?[^\n]*+)*+(?:\s+[A-Za-z0-9+/]{16,}+={0,2})*+(?:\s+[A-Za-z0-9+/]{1,15}={1,2})?+"), re.compile("-----BEGIN")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _DIGIT),
]
_CONTEXT = re.compile(r"\w+")
_NAMED = re.compile(r"(?i)[\"']?(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)[\"']? ?[=:]")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][01][0-9][-./][0-3][0-9].*")
FEATURES = 34

# Words that tend to stand before each kind.
CUES = {
    "email": {"mail", "email", "e", "contact", "write", "to", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "addr", "from", "login"},
    "card": {"card", "credit", "visa", "mastercard", "pan", "karte", "tarjeta", "carte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "fon"},
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "api", "apikey", "auth", "bearer"},
    "iban": {"iban", "account", "konto", "cuenta", "compte", "bank"},
}


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of all generators, overlapping ones too, by kind and start."""
    out = set()
    for kind, pattern, sign in _LOOSE:
        if sign.search(text):
            out.update((kind, *m.span()) for m in pattern.finditer(text) if sign is not _DIGIT or _DIGIT.search(text, *m.span()))
    return sorted(out, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return KINDS.index(span[0]), span[1], span[2]


def iban_valid(text: str) -> bool:
    """Whether the check digits are right."""
    t = text.replace(" ", "")
    return t.isascii() and t.isalnum() and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def features(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Format and context of each span, a row each."""
    rows = []
    for kind, s, e in spans:
        body, before = text[s:e], text[max(0, s - 40) : s].lower()
        digits = [c for c in body if c.isdigit()]
        letters = sum(c.isalpha() for c in body)
        words = set(_CONTEXT.findall(before)[-4:]) | set(_CONTEXT.findall(body.lower())[:1])
        runs = [len(r) for r in re.findall(r"[0-9]+", body)]
        classes = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in body]
        turns = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
        distinct = len(set(body)) / len(body)
        after = text[e : e + 1]
        rows.append([
            KINDS.index(kind), len(body), len(digits), letters, len(body) - len(digits) - letters, len(digits) / len(body), turns / len(body), distinct, max(runs, default=0), len(runs),
            float(kind == "card" and 13 <= len(digits) <= 19 and all(c.isascii() for c in digits) and luhn("".join(digits))), float("@" in body), float("=" in body or ":" in body), float(bool(words & CUES[kind])), float(before[-1:].isalnum()), float(after.isalnum()),
            sum("a" <= c <= "f" for c in body.lower()) / max(1, letters), float(any(r > 3 for r in runs)), float(len(runs) == 4 and all(int(r) <= 255 for r in re.findall(r"[0-9]{1,3}", body)[:4])),
            float(kind == "iban" and iban_valid(body)), float(body.startswith("-----BEGIN")), float(bool(_NAMED.match(body))), body.count(":"), float(bool(_DATE.fullmatch(body))),
            *(runs + [0] * 4)[:4], *(body.count(c) for c in ".- /("), float(body.lstrip("(")[:1] == "0"),
        ])
    return np.array(rows, np.float64).reshape(-1, FEATURES)


class Trees:
    """Gradient-boosted regression trees on the logistic loss, calibrated on held-out rows."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, precision: float = 0.98) -> Trees:
        """Trees on half of the rows; on a quarter their margins become probabilities (a slope and an intercept);
        on the last, each kind (the first feature) gets the least threshold from which on its precision is reached."""
        part = np.arange(len(y)) % 4
        xt, yt = x[part < 2], y[part < 2]
        self.base = float(np.log((yt.mean() + 1e-3) / (1 - yt.mean() + 1e-3)))
        self.trees, self.slope, self.intercept, f = [], 1.0, 0.0, np.full(len(yt), self.base)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in xt.T]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(xt, yt - p, p * (1 - p) + 1e-6, cuts, np.arange(len(yt)), self.depth)
            self.trees.append(tree)
            f += self.rate * self._walk(tree, xt)
        self._calibrate(x[part == 2], y[part == 2])
        held, own = x[part == 3], y[part == 3]
        score = self.score(held)
        self.thresholds = {}
        for kind in range(len(KINDS)):
            mine = held[:, 0] == kind
            order = np.argsort(-score[mine], kind="stable")
            ranked = score[mine][order]
            hits = np.cumsum(own[mine][order]) / np.arange(1, mine.sum() + 1)
            whole = np.append(ranked[1:] != ranked[:-1], True) if len(ranked) else np.zeros(0, bool)  # not in the midst of equal scores
            good = np.flatnonzero((hits >= precision) & whole)
            self.thresholds[kind] = float(ranked[good[-1]]) if len(good) else 1.0
        return self

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and intercept of the margin by Newton's method on the logistic loss."""
        f, w = self.margin(x), np.array([1.0, 0.0])
        design = np.column_stack((f, np.ones(len(f))))
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
            w = w - np.linalg.solve(hessian, design.T @ (p - y) + 1e-3 * (w - [1, 0]))
        self.slope, self.intercept = float(max(w[0], 1e-3)), float(w[1])

    def selected(self, x: np.ndarray) -> np.ndarray:
        """Whether each row's probability reaches its kind's threshold."""
        return self.score(x) >= np.array([self.thresholds[int(k)] for k in x[:, 0]])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def _grow(self, x, g, h, cuts, rows, depth):
        leaf = g[rows].sum() / (h[rows].sum() + 1.0)
        if not depth or len(rows) < 8:
            return leaf
        best, whole = (1e-6, None, None), g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for k, cut in enumerate(cuts):
            if not len(cut):
                continue
            b = np.searchsorted(cut, x[rows, k], side="left")
            gs, hs = np.cumsum(np.bincount(b, g[rows], len(cut) + 1))[:-1], np.cumsum(np.bincount(b, h[rows], len(cut) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], k, cut[i])
        if best[1] is None:
            return leaf
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, cuts, rows[left], depth - 1), self._grow(x, g, h, cuts, rows[~left], depth - 1)

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        return np.where(left, self._walk(tree[2], x), self._walk(tree[3], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.intercept, -40, 40)))


SAMPLES, SEED = 8000, 17


def drawn(n: int = SAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Candidates from drawn sentences, labelled by how they were made: personal data, or lookalikes.

    No corpus has such labels, so the trees learn from n sentences that this function makes up;
    n is the bound on what they are fitted on.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(3, 9))))

    def card() -> str:
        body = pick("3456") + num(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def other_digits(k: int) -> str:
        """Digits that are no card's."""
        return next(d for d in iter(lambda: num(k), None) if not luhn(d))

    def split(text: str, *sizes: int, by: str) -> str:
        at = np.cumsum([0, *sizes])
        return by.join(text[i:j] for i, j in zip(at, at[1:], strict=False))

    def national() -> str:
        """A number as people write it at home: it begins with 0."""
        area, by = "0" + pick("123456789") + num(int(rng.integers(1, 4))), pick([" ", "/", "-", " / "])
        rest = num(int(rng.integers(6, 9)))
        return area + by + pick([rest, split(rest, 3, len(rest) - 3, by=" "), split(rest, len(rest) - 4, 4, by=pick(" -")), split(rest, 2, 2, len(rest) - 4, by=" ")])

    hexa = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
    mixed = lambda k: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"), k))
    shout = lambda k: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), k))

    def iban() -> str:
        country, body = pick(["DE", "FR", "ES", "GB", "NL"]), num(int(rng.integers(14, 21)))
        return next(t for k in range(2, 99) if iban_valid(t := f"{country}{k:02}{body}"))

    yes = {
        "email": [lambda: f"{word()}.{word()}{pick(['@', '(at)', ' [at] ', ' (at) '])}{word()}{pick(['.', ' (dot) ', '[dot]'])}{pick(['com', 'org', 'net', 'example'])}"],
        "ip": [lambda: ".".join(str(int(v)) for v in rng.integers(1, 256, 4)), lambda: "[.]".join(str(int(v)) for v in rng.integers(1, 256, 4)), lambda: ":".join(hexa(4) for _ in range(8)), lambda: f"{hexa(4)}:{hexa(3)}::{hexa(int(rng.integers(1, 5)))}", lambda: f"fe80::{hexa(4)}:{hexa(4)}:{hexa(3)}"],
        "card": [lambda: split(card(), 4, 4, 4, 4, by=pick("./"))],
        "phone": [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{pick('23456789')}{num(2)}{(by := pick('-.'))}{num(3)}{by}{num(4)}", national, national, lambda: f"00{pick('123456789')}{num(1)} {pick('123456789')}{num(2)} {num(3)} {num(4)}"],
        "secret": [lambda: f'{pick(["token", "key", "secret", "password", "api_key"])} = "{hexa(int(pick([32, 40, 64])))}"', lambda: f"{pick(['token', 'key'])}: {mixed(int(rng.integers(24, 48)))}", lambda: mixed(int(rng.integers(32, 64))), lambda: f"AKIA{num(2)}{shout(14)}", lambda: f'{pick(["token", "key", "secret"])} = "{hexa(12)}{num(int(rng.integers(4, 20)))}{hexa(12)}"', lambda: f'{pick(["password", "passwd", "pwd", "secret"])}{pick([" = ", "=", ": "])}{pick(["", chr(34)])}{word()}{num(int(rng.integers(1, 5)))}{pick(["", "!", "#"])}', lambda: f"{pick(['token', 'api_key'])}: {mixed(int(rng.integers(8, 400)))}", lambda: f"-----BEGIN {pick(['', 'RSA ', 'EC '])}PRIVATE KEY-----\n{pick(['', 'Proc-Type: 4,ENCRYPTED' + chr(10) + 'DEK-Info: AES-128-CBC,' + shout(16) + chr(10) * 2])}{mixed(64)}\n{mixed(40)}={pick(['', chr(10) + '-----END PRIVATE KEY-----'])}", lambda: ".".join(("ey" if i < 2 else "") + mixed(int(rng.integers(18, 60))) for i in range(3))],
        "iban": [iban, lambda: (c := iban()) and " ".join(c[i : i + 4] for i in range(0, len(c), 4))],
    }
    no = {
        "email": [lambda: f"{word()} @ {word()} {word()}", lambda: f"{word()} @ {word()}. {word().title()}", lambda: f"{word()}@{word()} . {word()}", lambda: f"{word()}@{num(2)}.{word()}"],
        "ip": [lambda: f"{num(3)}.{pick('3456789')}{num(2)}.{num(3)}.{pick('456789')}{num(2)}", lambda: f"version {pick('123')}.{num(1)}.{num(1)}.{num(1)}", lambda: f"{pick('012')}{num(1)}:{pick('012345')}{num(1)}:{pick('012345')}{num(1)}", lambda: f"{num(1)}:{num(2)}:{num(2)}"],
        "card": [lambda: other_digits(16), lambda: split(other_digits(16), 4, 4, 4, 4, by=pick(" ./-")), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"19{num(2)} 20{num(2)} 20{num(2)}"],
        "phone": [lambda: f"{pick('123456789')}{num(1)}.{num(3)}.{num(3)}", lambda: f"{pick('123456789')}{num(3)} {num(3)} {num(3)}", lambda: f"{pick('12')}{num(3)}-{pick('12')}{num(3)}", lambda: f"{pick(['19', '20'])}{num(2)}{(by := pick('-./'))}{pick('01')}{num(1)}{by}{pick('0123')}{num(1)}", lambda: f"{pick('0123')}{num(1)}{(by := pick('-./'))}{pick('01')}{num(1)}{by}{pick(['19', '20'])}{num(2)}", lambda: f"{pick('123456789')}{num(1)} {num(3)}", lambda: f"{pick('123456789')}{num(2)}/{num(2)}", lambda: " ".join(pick("123456789") + num(2) for _ in range(4)), lambda: split(other_digits(16), 4, 4, 4, 4, by=" ")],
        "secret": [lambda: f"{word()}{num(1)}.{word()}.{pick(['com', 'html', 'json'])}", lambda: f"{word()}{word()}{word()}.{word()}{num(2)}.{word()}", lambda: f"{word()}{word()}{word()}{num(1)}", lambda: f"{word()}_{word()}_{word()}_{num(2)}", lambda: num(20), lambda: f"{word()}/{word()}/{word()}{num(2)}/{word()}", lambda: f"{pick(['password', 'secret', 'token', 'passwd'])}: {word()}", lambda: f"{pick(['Password', 'token', 'secret'])} = {word()}", lambda: f"20{num(2)}-0{num(1)}-1{num(1)}T{num(2)}-{num(2)}-{num(2)}", lambda: f"{word()}-{word()}-20{num(2)}-0{num(1)}", lambda: f"{word()}_{num(4)}_{word()}_{word()}"],
        "iban": [lambda: f"{shout(2)}{num(2)} {num(4)} {num(4)}", lambda: f"{shout(2)}{num(12)}", lambda: f"{shout(2)}{num(2)}{shout(12)}"],
    }
    x, y = [], []
    for _ in range(n):
        kind, label = pick(KINDS), bool(rng.integers(2))
        body = pick((yes if label else no)[kind])()
        cue = pick(sorted(CUES[kind])) if rng.random() < (0.5 if label else 0.1) else word()
        text = f"{word()} {word()} {cue} {body} {word()} {word()}"
        at, base = text.index(body), _Kept(base_spans(text))
        for c in candidates(text):
            if c[1] >= at and c[2] <= at + len(body) and not base.takes(c):  # a base span needs no judgement
                x.append(features(text, [c])[0])
                y.append(float(label and c[0] == kind))
    return np.array(x), np.array(y)


@lru_cache(maxsize=1)
def model() -> Trees:
    """Trees that depend on the parameters alone; fitted once, on the driver."""
    return Trees().fit(*drawn())


class _Kept:
    """Spans of each kind, none of which overlaps another of its kind, in order of their starts."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: dict[str, list[int]] = {}
        self.ends: dict[str, list[int]] = {}
        for s in spans:
            self.add(s)

    def add(self, span: tuple[str, int, int]) -> None:
        starts, ends = self.starts.setdefault(span[0], []), self.ends.setdefault(span[0], [])
        i = bisect(starts, span[1])
        starts.insert(i, span[1])
        ends.insert(i, span[2])

    def takes(self, span: tuple[str, int, int]) -> bool:
        """Whether span overlaps one of its kind, or lies in one of any kind."""
        kind, s, e = span
        for k, starts in self.starts.items():
            i = bisect(starts, s) - 1
            if i >= 0 and (self.ends[k][i] > s if k == kind else self.ends[k][i] >= e):
                return True
            if k == kind and i + 1 < len(starts) and starts[i + 1] < e:
                return True
        return False


def spans(text: str | None, trees: Trees | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind and start; an added span overlaps no other of its kind, and lies in none of another."""
    text = text or ""
    base = base_spans(text)
    kept = _Kept(base)
    free = [c for c in candidates(text) if not kept.takes(c)]
    added: list[tuple[str, int, int]] = []
    if free:
        trees = trees or model()
        x = features(text, free)
        good, score = trees.selected(x), trees.score(x)
        for i in np.lexsort((np.arange(len(free)), -score, [s - e for _, s, e in free])):  # the longest first: they leave least behind
            if good[i] and not kept.takes(free[i]):
                kept.add(free[i])
                added.append(free[i])
    return base, sorted(base + added, key=_order)


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with a mark like [EMAIL] in place of each span; overlapping ones become one mark, the first's."""
    out, at = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _line(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (kind:start:end, by kind and start) for every row.

    Null and empty texts have no spans (base_sha256 of nothing); null ids stay; repeated rows each
    have theirs; offsets are code points. Other columns are not read. Very long texts, and texts with
    very many spans, take time about linear in both.
    """
    names, trees = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"], model()

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                got, rows = batch.slice(at, 1024), []
                for text in got.column(1).to_pylist():
                    base, every = spans(text, trees)
                    rows.append((*(sum(b[0] == k for b in base) for k in BASE), hashlib.sha256(_line(base).encode()).hexdigest(), _line(every)))
                yield pa.RecordBatch.from_arrays([got.column(0), *(pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(zip(*rows, strict=True)))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span in the text replaced; all columns stay, nulls too."""

    trees = model()

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if not t else redact(t, spans(t, trees)[1]))

    return docs.withColumn(text_col, clean(F.col(text_col)))
