"""Whole texts split into pre-tokens and encoded by the tokenizers library, many texts at a time.

Texts are laid end to end as code points; class changes give the pre-tokens, a hash names each of
them, and the library encodes each distinct pre-token once per worker. A hash only finds a word:
its characters are compared too. Texts with code points that this Python does not know, or with
added tokens where these count, go to the library whole, and so do those with two words of one hash.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE, UNKNOWN, END = range(6)

# The code points with Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

CHUNK = 400_000
_MARK = "\U0010ffff"


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(i))) in ("Cn", "Cs") else kinds.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    table[ord(_MARK)] = END
    return table


def mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the characters of all spans, span after span; and where each span's begin among them."""
    total = int(n.sum())
    kind = np.int32 if total < 1 << 30 and (not len(start) or start.max() < 1 << 30) else np.int64
    first = (np.cumsum(n) - n).astype(kind)
    return np.repeat(start.astype(kind) - first, n) + np.arange(total, dtype=kind), first


def _spelled(cp: np.ndarray, start: np.ndarray, n: np.ndarray, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of spans, their characters one after another, and where each span's begin."""
    at, first = _letters(start, n)
    chars = cp[at]
    at -= np.repeat(start.astype(at.dtype), n)
    v = at.astype(np.uint64)
    v <<= np.uint64(21)
    v |= chars
    seed = np.uint64((0x632BE59BD9B4E019 + key * 0x9E3779B97F4A7C15) % (1 << 64))
    v += seed
    return mix(np.add.reduceat(mix(v), first) + n.astype(np.uint64) * seed), chars, first


def span_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of the code points in each span, the same wherever the span lies.

    The sum of a mixed value of each character and its place in the span: nothing of a word's
    structure cancels out. key: another hash for each.
    """
    return _spelled(cp, start, end - start, key)[0] if len(start) else np.zeros(0, np.uint64)


def spelled_alike(a: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, first: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the n characters of a from each at on are the m of b from each first on."""
    out = n == m
    to = np.flatnonzero(out)
    to = to[n[to] > 0]
    x, begins = _letters(at[to], n[to])
    y, _ = _letters(first[to], n[to])
    differ = a[x] != b[y]
    if differ.any():
        out[to[np.add.reduceat(differ, begins, dtype=np.int64) > 0]] = False
    return out


class Memory:
    """Words with a list of ids each, found by hash and compared character by character."""

    def __init__(self):
        self.size = 0
        self.keys, self.slots = np.zeros(1024, np.uint64), np.full(4096, -1, np.int32)
        #: of each word: where its characters and its ids begin, and how many there are
        self.spans = np.zeros((4, 1024), np.int64)
        self.chars, self.ids, self.n_chars, self.n_ids = np.zeros(4096, np.uint32), np.zeros(4096, np.uint32), 0, 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of the word with each hash, or -1."""
        mask, out = len(self.slots) - 1, np.full(len(hashes), -1, np.int64)
        left, slot = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
        while len(left):
            got = self.slots[slot]
            hit = (got >= 0) & (self.keys[got] == hashes[left])
            out[left[hit]] = got[hit]
            go = (got >= 0) & ~hit
            left, slot = left[go], (slot[go] + 1) & mask
        return out

    def add(self, hashes: np.ndarray, chars: np.ndarray, n: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        """New words, whose hashes differ and are not there yet."""
        old, new = self.size, self.size + len(hashes)
        self.keys, self.spans = _room(self.keys, new), _room(self.spans, new)
        self.chars, self.ids = _room(self.chars, self.n_chars + len(chars)), _room(self.ids, self.n_ids + len(ids))
        self.keys[old:new] = hashes
        self.spans[:, old:new] = self.n_chars + np.cumsum(n) - n, n, self.n_ids + np.cumsum(n_ids) - n_ids, n_ids
        self.chars[self.n_chars : self.n_chars + len(chars)] = chars
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.size, self.n_chars, self.n_ids = new, self.n_chars + len(chars), self.n_ids + len(ids)
        if 2 * new > len(self.slots):
            self.slots, old = np.full(4 << new.bit_length(), -1, np.int32), 0
        mask, left = len(self.slots) - 1, np.arange(old, new)
        slot = (self.keys[left] & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            go = self.slots[slot] != left
            left, slot = left[go], (slot[go] + 1) & mask

    def same(self, i: np.ndarray, chars: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the words at places i are spelled like these spans, whose n characters begin at first."""
        at, own = self.spans[0, i], self.spans[1, i]
        return spelled_alike(self.chars, at, own, chars, first, n)

    def gather(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at places i, one after another; and how many each has."""
        _, _, at, n = self.spans[:, i]
        place, _ = _letters(at, n)
        return self.ids[place], n


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if a.shape[-1] >= n:
        return a
    out = np.zeros((*a.shape[:-1], 1 << n.bit_length()), a.dtype)
    out[..., : a.shape[-1]] = a
    return out


def pretokens(cp: np.ndarray, style: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens in texts that each end with the end mark.

    style "byte": the public byte-level pattern (a space joins what follows it); "word": runs of
    letters, single numbers, runs of the rest, no white space. Both: 's 't 're 've 'm 'll 'd.
    """
    cls = classes()[cp]
    new = np.empty(len(cp), bool)
    new[0] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    new |= cls == END
    if style == "word":
        new |= cls == NUMBER
    first = np.flatnonzero(new)
    kind, last = cls[first], np.append(first[1:], len(cp))
    mark = np.zeros(len(cp) + 3, bool)
    if style == "word":
        mark[first] = True
    else:
        mark[first[kind != SPACE]] = True
        space = kind == SPACE
        followed = space & (np.append(kind[1:], END) != END)
        whole = (last - first > 1) | ~followed
        mark[first[space & whole]] = True
        mark[last[followed] - 1] = True
        joins = last[followed & (cp[last - 1] == 32)]
        mark[joins] = False
    quote = first[(kind == OTHER) & (last - first == 1) & (cp[first] == 39) & (np.append(kind[1:], END) == LETTER)]
    quote = quote[mark[quote]]
    if len(quote):
        more = np.append(cp, [0, 0, 0])
        a, b = more[quote + 1], more[quote + 2]
        is_ = lambda v, s: np.isin(v, [ord(c) for c in s])
        n = np.where(is_(a, "stmd"), 1, np.where((is_(a, "rv") & is_(b, "e")) | (is_(a, "l") & is_(b, "l")), 2, 0))
        quote, n = quote[n > 0], n[n > 0]
        mark[quote + 1] = False
        mark[quote + 1 + n] = True
    start = np.flatnonzero(mark[: len(cp)])
    end = np.append(start[1:], len(cp))
    held = cls[start]
    keep = held != END if style == "byte" else (held != END) & (held != SPACE)
    return start[keep], end[keep]


def cuts(text: str, size: int = CHUNK):
    """text in parts of about size, cut only at a space between two characters that are not white space."""
    at, n = 0, len(text)
    while n - at > size:
        i = text.find(" ", at + size)
        while 0 < i < n - 1 and (text[i - 1].isspace() or text[i + 1].isspace()):
            i = text.find(" ", i + 1)
        if i <= 0 or i >= n - 1:
            break
        yield text[at:i]
        at = i
    yield text[at:]


def spelled(parts: list[str], style: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The pre-tokens of parts as codes, where each part's begin (and the last ends), and the distinct pre-tokens."""
    big = _MARK.join(parts) + _MARK
    cp = points(big)
    start, end = pretokens(cp, style)
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))))
    code, distinct = spans_coded(cp, start, end)
    firsts = _firsts(code, distinct)
    return code, bounds, [big[s:e] for s, e in zip(start[firsts].tolist(), end[firsts].tolist(), strict=True)]


def spans_coded(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each span, equal where its characters are, in the order of first places; and how many numbers there are."""
    if not len(start):
        return np.zeros(0, np.int64), 0
    n = end - start
    hashes, chars, first = _spelled(cp, start, n)
    code, distinct = pd.factorize(hashes)
    if not _alike(code, _firsts(code, len(distinct)), chars, first, n):
        code, distinct = pd.factorize(np.array([cp[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)], object))
    return code, len(distinct)


def _firsts(code: np.ndarray, n: int) -> np.ndarray:
    """Where each code comes first."""
    out = np.empty(n, np.int64)
    out[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return out


def _alike(code: np.ndarray, firsts: np.ndarray, chars: np.ndarray, first: np.ndarray, n: np.ndarray) -> bool:
    """Whether words of one code are spelled alike."""
    again = np.flatnonzero(firsts[code] != np.arange(len(code)))
    like = firsts[code[again]]
    return bool(spelled_alike(chars, first[like], n[like], chars, first[again], n[again]).all())


class Encoder:
    """Ids of whole texts, equal to those of the library's encode(text, add_special_tokens=False).

    added: whether added tokens that stand in a text, such as <|endoftext|>, become their own ids,
    as the library has it unless encode_special_tokens is set; else they are text like any other.
    """

    LIMIT = 1_200_000  #: distinct pre-tokens that a worker remembers
    SEPARATOR = {"byte": "\n", "word": " 0 "}  #: a pre-token of its own wherever it stands, and one id

    def __init__(self, path: str, style: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.style = Tokenizer.from_file(path), style
        self.library.encode_special_tokens = not added
        self.added = sorted({t.content.lower() for t in self.library.get_added_tokens_decoder().values()}) if added else []
        self.mark = self._whole(self.SEPARATOR[style])
        self.memory = Memory()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def normal(self, text: str) -> str | None:
        """text as the library's own normaliser leaves it; None: leave all of it to the library."""
        if self.style == "byte" or text.isascii():
            return text if self.style == "byte" else text.lower()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text if unicodedata.is_normalized("NFC", text) else None

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word by the library, one after another; and how many each has."""
        ids = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _learn(self, hashes: np.ndarray, big: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Remember the words at these spans: all in one call of the library where separators can stand between them."""
        words = [big[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        kind = classes()[cp[end - 1]]
        plain = kind != (SPACE if self.style == "byte" else NUMBER)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        one, n_one = self._ids([words[k] for k in order[plain.sum() :]])
        held = [words[k] for k in order[: plain.sum()]]
        flat = np.array(self.library.encode_batch_fast([self.SEPARATOR[self.style].join(held)], add_special_tokens=False)[0].ids, np.uint32)
        gaps = np.flatnonzero(flat == self.mark[0])
        if held and len(self.mark) == 1 and len(gaps) == len(held) - 1:
            n = np.diff(np.concatenate(([-1], gaps, [len(flat)]))) - 1
            flat = np.delete(flat, gaps)
        else:
            flat, n = self._ids(held)
        place, _ = _letters(start[order], (end - start)[order])
        self.memory.add(hashes[order], cp[place], (end - start)[order], np.concatenate((flat, one)), np.concatenate((n, n_one)))

    def _batch(self, parts: list[str]) -> list[np.ndarray]:
        big = _MARK.join(parts) + _MARK
        cp = points(big)
        start, end = pretokens(cp, self.style)
        n = end - start
        hashes, chars, first = _spelled(cp, start, n)
        code, distinct = pd.factorize(hashes)
        firsts = _firsts(code, len(distinct))
        at = self.memory.find(distinct)
        if (at < 0).any():
            if self.memory.size + int((at < 0).sum()) > self.LIMIT:
                self.memory, at = Memory(), np.full(len(distinct), -1)
            lost = firsts[at < 0]
            self._learn(distinct[at < 0], big, cp, start[lost], end[lost])
            at = self.memory.find(distinct)
        if not self.memory.same(at, chars, first[firsts], n[firsts]).all() or not _alike(code, firsts, chars, first, n):
            return [self._whole(p) for p in parts]  # two words with one hash
        at = at[code]
        ids, n = self.memory.gather(at)
        total = np.concatenate(([0], np.cumsum(n)))
        text_end = np.cumsum([len(p) + 1 for p in parts])
        return np.split(ids, total[np.searchsorted(start, text_end)][:-1])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; null counts as empty."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, owner, size = [], [], 0

        def flush():
            nonlocal held, owner, size
            if held:
                for k, ids in zip(owner, self._batch(held), strict=True):
                    out[k].append(ids)
            held, owner, size = [], [], 0

        for k, text in enumerate(texts):
            if not text:
                continue
            low = text.lower() if self.added else ""
            clean = None if any(a in low for a in self.added) or not text.isascii() and (classes()[points(text)] >= UNKNOWN).any() else self.normal(text)
            if clean is None:
                out[k].append(self._whole(text))
                continue
            for part in cuts(clean) if len(clean) > CHUNK else (clean,):
                if size + len(part) > CHUNK:
                    flush()
                held.append(part)
                owner.append(k)
                size += len(part) + 1
        flush()
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.uint32) for x in out]


@lru_cache(maxsize=2)
def encoder(path: str, style: str, added: bool = False) -> Encoder:
    """One for each worker."""
    return Encoder(path, style, added)
