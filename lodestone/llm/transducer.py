"""Byte-level byte-pair encoding as a stream: a transducer with bounded lookahead, and its inverse.

The merge list alone says how far behind the end of what has been read a token can still change.
Compare a text with the same text cut off: up to some place, the frontier, both have the same
tokens. A merge (u, v) moves the frontier to the left only if u ends there and v begins there in one
of the two, by the length of u; after it one side has uv there and the other u, so the next merge
that moves it, of a higher rank, has a right part that begins with u. So the longest such chain of
merges bounds the lookahead, whatever the text. Tokens that end further back than that are final and
leave the machine, which holds no more than a window of bytes. Decoding keeps at most three bytes
of an unfinished character.

Pre-tokens begin anew, so each distinct one goes through the machine once for each worker.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import Encoder, Memory, _letters

BATCH = 512  #: rows that are encoded together


def alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 ones stand for themselves, the others take the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before the end of what was read in which tokens may still change; those that end before these are final.

    merges in rank order. Each part must be a byte or an earlier merge's result, and each result have one merge.
    """
    made = {bytes([b]) for b in range(256)}
    for u, v in merges:
        if u not in made or v not in made or u + v in made:
            raise ValueError(f"not a merge list that a stream can follow: {u!r} + {v!r}")
        made.add(u + v)
    longest: dict[bytes, int] = {}  #: of the chains whose first merge has a right part that begins so
    most = 0
    for u, v in reversed(merges):
        chain = len(u) + longest.get(u, 0)
        most = max(most, chain)
        for i in range(1, len(v) + 1):
            if longest.get(v[:i], 0) < chain:
                longest[v[:i]] = chain
    return most


class Machine:
    """A vocabulary's merges, their lookahead, and the pieces of its ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told["pre_tokenizer"]
        if model["type"] != "BPE" or told["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("not a plain byte-level vocabulary")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError("an option of the vocabulary has no stream")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"]):
            raise ValueError("an added token that takes more than its own characters")
        letters = alphabet()
        self.letters = letters
        spell = lambda token: bytes(letters[c] for c in token)
        ids, names = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = sufficient_lookahead([(spell(a), spell(b)) for a, b in names])
        self.window = 2 * self.lookahead + 256
        self.width = max(ids.values()) + 1
        self.ranks = {ids[a] * self.width + ids[b]: k for k, (a, b) in enumerate(names)}
        self.merged = [ids[a + b] for a, b in names]
        self.first = [ids[c] for c in sorted(letters, key=letters.get)]
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        pieces = {i: spell(t) for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.sizes = [len(p) for p in self.pieces]

    def fold(self, data: bytes) -> list[int]:
        """Ids of these bytes, as if nothing followed: the merge of least rank, the leftmost of these, again and again."""
        first, width, ranks, none = self.first, self.width, self.ranks.get, len(self.merged)
        ids = [first[b] for b in data]
        if len(ids) < 2:
            return ids
        pair = [ranks(a * width + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while pair and (least := min(pair)) < none:
            i = pair.index(least)
            ids[i : i + 2] = [self.merged[least]]
            del pair[i]
            if i:
                pair[i - 1] = ranks(ids[i - 1] * width + ids[i], none)
            if i < len(pair):
                pair[i] = ranks(ids[i] * width + ids[i + 1], none)
        return ids


class Transducer:
    """Encodes one pre-token, whose bytes come in parts of any size; holds at most a window of them."""

    def __init__(self, machine: Machine):
        self.machine, self.held = machine, b""

    def feed(self, data: bytes) -> list[int]:
        """Take more bytes; the ids that are now final."""
        out, m = [], self.machine
        for at in range(0, len(data), m.window):
            self.held += data[at : at + m.window]
            if len(self.held) >= m.window:
                final, end = len(self.held) - m.lookahead, 0
                for i in m.fold(self.held):
                    if end + m.sizes[i] > final:
                        break
                    out.append(i)
                    end += m.sizes[i]
                self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        """The rest, as nothing follows; ready for the next pre-token."""
        out, self.held = self.machine.fold(self.held), b""
        return out


class TextDecoder:
    """Text of ids that come in parts; what is not UTF-8 reads as U+FFFD, and unknown ids as nothing."""

    def __init__(self, machine: Machine):
        self.machine, self.state = machine, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        pieces, n = self.machine.pieces, len(self.machine.pieces)
        return self.state.decode(b"".join([pieces[i] for i in ids if 0 <= i < n]))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


class StreamEncoder(Encoder):
    """Ids of whole texts, equal to the library's encode(text, add_special_tokens=False).

    Texts are split as words.Encoder does it; what is a word goes through the transducer. For texts
    with code points that this Python does not know, the library says where pre-tokens end.
    """

    def __init__(self, path: str):
        self.machine, self.style, self.path, self.added, self.library = machine(path), "byte", path, [], None
        self.memory, self.stream = Memory(), Transducer(self.machine)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.machine.added, key=len, reverse=True))) + ")") if self.machine.added else None

    def word(self, data: bytes) -> list[int]:
        return self.machine.fold(data) if len(data) < self.machine.window else [*self.stream.feed(data), *self.stream.finish()]

    def _learn(self, hashes, big, cp, start, end) -> None:
        ids = [self.word(big[s:e].encode()) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        place, _ = _letters(start, end - start)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.memory.add(hashes, cp[place], end - start, np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum())), n)

    def _whole(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        letters = self.machine.letters
        return np.array([i for piece, _ in self.library.pre_tokenize_str(text) for i in self.word(bytes(map(letters.__getitem__, piece)))], np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.marks is None:
            return super().encode(texts)
        parts = [self.marks.split(t) if t else [""] for t in texts]  # plain texts and added tokens by turns
        plain = iter(super().encode([p for x in parts for p in x[::2]]))
        out = []
        for x in parts:
            ids = [next(plain) if k % 2 == 0 else np.array([self.machine.added[p]], np.uint32) for k, p in enumerate(x)]
            out.append(ids[0] if len(ids) == 1 else np.concatenate(ids))
        return out


@lru_cache(maxsize=2)
def machine(path: str) -> Machine:
    return Machine(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> StreamEncoder:
    """One for each worker."""
    return StreamEncoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of every row of docs, in one pass without a shuffle.

    Null and empty texts have no ids (empty binary). Null ids and repeated rows are rows like any
    other; an empty table gives no rows; other columns are not read. Added tokens in a text are
    their own ids, as in the library. A word of any length takes a window's memory in the machine;
    a row's text and ids are in memory whole.
    """

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                got = batch.slice(at, BATCH)
                ids = [x.astype("<u4").tobytes() for x in enc.encode(got.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([got.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


STEP = 1 << 14  #: ids that are decoded at once


def _texts(ids: np.ndarray, decoder: TextDecoder):
    for at in range(0, len(ids), STEP):
        yield decoder.feed(ids[at : at + STEP].tolist())
    yield decoder.finish()


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows doc_id, ids as encode() gives them; null ids give a null text. Special tokens are not skipped."""

    def run(batches):
        decoder = TextDecoder(machine(path))
        for batch in batches:
            texts = [None if raw is None else "".join(_texts(np.frombuffer(raw, "<u4"), decoder)) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded text), digested as they stream by."""

    def run(batches):
        m = machine(path)
        decoder, names = TextDecoder(m), [str(i) for i in range(len(m.pieces))]
        for batch in batches:
            out = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, lines, text = np.frombuffer(raw, "<u4"), hashlib.sha256(), hashlib.sha256()
                for at in range(0, len(ids), STEP):
                    lines.update((("," if at else "") + ",".join([names[i] for i in ids[at : at + STEP].tolist()])).encode())
                for part in _texts(ids, decoder):
                    text.update(part.encode())
                out.append((doc, len(ids), lines.hexdigest(), text.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
