"""Encoding a corpus with a public byte-level BPE tokenizer by a bounded-lookahead streaming transducer.

A rank file (token bytes in base 64, rank) gives the merges: the pair whose joined bytes have the lowest rank merges first. Text is cut
into pieces by the tokenizer's pattern, and merges never cross pieces.

Two facts carry the transducer. The tokens of a prefix that ends at a token boundary of the whole are the tokens of that prefix on its
own; and two tokens stand side by side in a result exactly if their joined bytes encode to these two. So one pass can keep, for every
position, the last token of the prefix that ends there. Whatever follows, the final tokens pass through one of the last ``longest token``
positions; once the paths back from all of them share a boundary, everything before it is stable and is emitted, and the pass goes on from
there. ``lookahead`` is the merge list's bound on how far that boundary can lag behind: a boundary that many bytes back is stable anyway.

Text comes in chunks. An ``Encoder`` holds back the last piece of a chunk, which may go on; a piece that goes on for long is handed to the
transducer as it comes. So memory is constant in the length of the text: a chunk, the lookahead, and the cache of pieces.
"""

from __future__ import annotations

import base64
import codecs
import os
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

#: Cuts text into pieces (fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARIES = "/opt/tokenizers"
#: Pieces of up to so many bytes, all far below the lookahead, settle nothing before their end: they are merged at once. It decides on speed alone.
SHORT = 24
CACHED_PIECES = 500_000
#: Characters of a text that are looked at together, and those of one piece from which on it isn't kept whole.
CHUNK, LONG = 1 << 16, 1 << 13
NEVER = 1 << 60


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("SPARKSEEK_TOKENIZERS", VOCABULARIES), name)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.pieces = regex.compile(pattern)
        self._lookahead: int | None = None
        self._cache: dict[str, tuple[int, ...]] = {}
        self._beside: dict[tuple[bytes, bytes], bool] = {}

    def lookahead(self) -> int:
        """Bytes after which a token boundary can no longer change.

        What follows can undo a token only through a merge of lower rank that takes its end, that token's absence only frees merges of
        higher rank to its left, and so on: from right to left, ranks rise and neighbours overlap. The bound is the longest such chain.
        """
        if self._lookahead is not None:
            return self._lookahead
        reach: dict[bytes, int] = {}
        most = 0
        for token in sorted(self.ranks, key=self.ranks.__getitem__):
            size = len(token) + max((reach.get(token[i:], 0) for i in range(1, len(token))), default=0)
            most = max(most, size)
            for i in range(1, len(token) + 1):
                if reach.get(token[:i], 0) < size:
                    reach[token[:i]] = size
        self._lookahead = most
        return most

    def merge(self, piece: bytes) -> list[bytes]:
        """Tokens of a short piece, lowest rank first, leftmost among equals."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], NEVER)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, a: bytes, b: bytes) -> bool:
        """Whether these two tokens can stand side by side; with an empty first, whether the second is its own encoding."""
        known = self._beside.get((a, b))
        if known is None:
            if len(self._beside) > 4 * CACHED_PIECES:
                self._beside.clear()
            known = self._beside[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[bytes]:
        """Tokens of one piece that comes in chunks, each as soon as it is stable."""
        piece = PieceStream(self)
        for chunk in chunks:
            yield from piece.feed(chunk)
        yield from piece.end()

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece. A piece shorter than the lookahead settles nothing before its end, so it is merged at once."""
        known = self._cache.get(text)
        if known is not None:
            return known
        data = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            ids = (whole,)
        else:
            tokens = self.merge(data) if len(data) <= SHORT else self.stream(data[i : i + 4096] for i in range(0, len(data), 4096))
            ids = tuple(self.ranks[t] for t in tokens)
        if len(data) <= 64:
            if len(self._cache) >= CACHED_PIECES:
                self._cache.clear()
            self._cache[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; strings that look like one are plain text. Null and empty text: no ids."""
        return list(self.ids(text))

    def ids(self, text: str | None) -> Iterator[int]:
        """The ids of a text one after another."""
        if not text:
            return
        if len(text) <= CHUNK:
            for p in self.pieces.findall(text):
                yield from self.piece(p)
            return
        yield from self.ids_of_chunks(text[i : i + CHUNK] for i in range(0, len(text), CHUNK))

    def ids_of_chunks(self, chunks: Iterable[str]) -> Iterator[int]:
        """The ids of a text that comes in chunks, in memory that doesn't depend on its length."""
        e = Encoder(self)
        for chunk in chunks:
            yield from e.feed(chunk)
        yield from e.end()


class PieceStream:
    """The transducer's state within one piece."""

    def __init__(self, t: Transducer):
        self.t = t
        self.window = b""  # what isn't emitted yet
        self.last = [0]  # last[i]: length of the last token of window[:i]
        self.check = 2 * t.longest

    def feed(self, chunk: bytes) -> Iterator[bytes]:
        """Tokens that are stable by now."""
        ranks, longest, beside = self.t.ranks, self.t.longest, self.t.beside
        for start in range(0, len(chunk), 4096):
            self.window += chunk[start : start + 4096]
            window, last = self.window, self.last
            while len(last) <= len(window):
                i = len(last)
                for size in range(min(i, longest), 0, -1):
                    token = window[i - size : i]
                    if token in ranks and beside(window[i - size - last[i - size] : i - size], token):
                        last.append(size)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                if i >= self.check:
                    cut = self._stable(i)
                    if cut:
                        yield from self._path(cut)
                        window = self.window = window[cut:]
                        last = self.last = [0]  # the rest encodes on its own
                    self.check = len(last) - 1 + (2 * longest if cut else longest)

    def end(self) -> list[bytes]:
        """What is left; the piece is over."""
        return self._path(len(self.window))

    def _stable(self, end: int) -> int:
        """The furthest boundary that no continuation can change: the paths back from all of the last ``longest`` positions share it, or
        it lies the lookahead back; 0 if there is none."""
        heads = set(range(max(end - self.t.longest + 1, 0), end + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(top - self.last[top])
        shared = heads.pop()
        if not shared and end > self.t.lookahead() + self.t.longest:
            shared = end
            while end - shared < self.t.lookahead():
                shared -= self.last[shared]
        return shared

    def _path(self, end: int) -> list[bytes]:
        out = []
        while end:
            out.append(self.window[end - self.last[end] : end])
            end -= self.last[end]
        return out[::-1]


_RUNS = {k: regex.compile(p) for k, p in (("letters", r"\p{L}+"), ("numbers", r"\p{N}+"), ("spaces", r"\s+"), ("others", r"[^\s\p{L}\p{N}]+"))}


class Encoder:
    """Ids of a text that comes in chunks: what may still be part of a longer piece waits for the next chunk."""

    def __init__(self, t: Transducer):
        self.t = t
        self.waiting = ""
        self.open: tuple[str, PieceStream] | None = None  # a long piece: what runs on in it, and its transducer

    def feed(self, text: str) -> Iterator[int]:
        self.waiting += text
        yield from self._run(False)

    def end(self) -> Iterator[int]:
        yield from self._run(True)
        self.waiting = ""

    def _run(self, over: bool) -> Iterator[int]:
        at = 0
        if self.open is not None:
            kind, stream = self.open
            m = _RUNS[kind].match(self.waiting)
            at = m.end() if m else 0
            closed = over or at < len(self.waiting)
            if kind == "spaces" and not (over and at == len(self.waiting)):
                at -= 1  # the last blank belongs to what follows
            yield from map(self.t.ranks.__getitem__, stream.feed(self.waiting[:at].encode("utf-8", "surrogatepass")))
            if closed:
                yield from map(self.t.ranks.__getitem__, stream.end())
                self.open = None
            else:
                self.waiting = self.waiting[at:]
                return
        text, size = self.waiting, len(self.waiting)
        for m in self.t.pieces.finditer(text, at):
            if not over and (m.end() == size or m.start() + 3 > size):  # more letters, or the rest of 're, may follow
                break
            yield from self.t.piece(m.group())
            at = m.end()
        self.waiting = text[at:]
        if not over and len(self.waiting) > LONG:
            first = self.waiting[0] if self.waiting[0] != " " or self.waiting[1].isspace() else self.waiting[1]
            kind = next(k for k, p in _RUNS.items() if p.match(first))
            keep = 1 if kind == "spaces" else 0
            stream = PieceStream(self.t)
            sure, self.waiting = self.waiting[: len(self.waiting) - keep], self.waiting[len(self.waiting) - keep :]
            self.open = kind, stream
            yield from map(self.t.ranks.__getitem__, stream.feed(sure.encode("utf-8", "surrogatepass")))


class Decoder:
    """Ids back to text, piecewise: bytes of a character that isn't complete yet stay in the state."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield state.decode(self.tokens[i])
        yield state.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


_built: dict[int, tuple[Transducer, Decoder]] = {}


def _of(shared) -> tuple[Transducer, Decoder]:
    """The process's transducer of a broadcast rank file."""
    data = shared.value
    key = hash(data)
    if key not in _built:
        ranks = read_ranks(data)
        _built[key] = Transducer(ranks), Decoder(ranks)
    return _built[key]


class Tokenizer:
    """Column functions for one vocabulary; its file (under 1 MB) is read on the driver and broadcast."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        with open(path or vocabulary_path(), "rb") as f:
            self._shared = spark.sparkContext.broadcast(f.read())

    def encode(self, text: Column) -> Column:
        """array<int> of ids; an empty array for empty and for null text."""
        shared = self._shared

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ids = _of(shared)[0].ids
            for batch in batches:
                flat = array("i")
                ends = [0]
                for text in batch.to_pylist():
                    flat.extend(ids(text))
                    ends.append(len(flat))
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

        return arrow_udf(run, "array<int>")(text)

    def count(self, text: Column) -> Column:
        """Number of ids; 0 for empty and for null text."""
        shared = self._shared

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ids = _of(shared)[0].ids
            for batch in batches:
                yield pa.array([sum(1 for _ in ids(t)) for t in batch.to_pylist()], pa.int32())

        return arrow_udf(run, "int")(text)

    def decode(self, ids: Column) -> Column:
        """Text of ids; empty for an empty or null array."""
        shared = self._shared

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            decode = _of(shared)[1].decode
            for batch in batches:
                yield pa.array([decode(x or ()) for x in batch.to_pylist()], pa.string())

        return arrow_udf(run, "string")(ids)
