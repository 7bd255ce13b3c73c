"""Encoding of a corpus with a public byte-level BPE tokenizer, by monoid tree reduction.

A text is halved down to leaves of bounded size. An element of the monoid is the ids between a stretch's first and
last sure boundary; the text outside them waits for its neighbour. A boundary is sure where no match of the
splitting pattern can hold both characters, which the two characters alone decide: it holds whatever stands around them.
Joining neighbours encodes only the text between the last sure boundary of the left, the seam and the first one of the
right.

A stretch without sure boundaries that is longer than a leaf (a run of letters, of dashes, of blanks) is a tree of its
own, over bytes: neighbours' ids are welded by encoding a window around the seam that doubles until its outer tokens
and those next to it are each other's encoding. Ids whose neighbours are all so are the encoding of the whole,
so tokens outside the window are final. So no call encodes more than a leaf or a window.

Null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
#: Characters a leaf of the tree, and bytes a leaf within one long piece.
LEAF = 1 << 10
#: The splitting pattern of the vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACE = "\\t-\\r \x85\xa0  -     　"
_MARK, _BLANK = r"\p{P}\p{S}\p{M}", r" \n\t\r"
#: Letter, digit, other mark: no alternative of the pattern spans two of them, but for an apostrophe and letters.
_CHANGES = rf"(?<=\p{{L}})(?=[\p{{N}}{_MARK}{_BLANK}])|(?<=\p{{N}})(?=[\p{{L}}{_MARK}{_BLANK}])|(?<=[{_MARK}])(?=[\p{{N}}{_BLANK}])|(?<=[{_MARK}])(?<!')(?=\p{{L}})"
_FIRST, _LAST = regex.compile(_CHANGES), regex.compile(f"(?r){_CHANGES}")
_PIECES = regex.compile(PATTERN.replace(r"\S", f"[^{_SPACE}]").replace(r"[^\s", f"[^{_SPACE}").replace(r"\s+", f"[{_SPACE}]+"))


class Bpe:
    """A vocabulary of ranks. text() and piece() are the only calls that encode."""

    def __init__(self, lines: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self._encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: t for t, i in ranks.items()}
        self._fits: dict[tuple[int, int], bool] = {}

    def text(self, text: str) -> np.ndarray:
        return np.frombuffer(self._encoding._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)

    def piece(self, piece: bytes) -> list[int]:
        """The ids of bytes that no boundary of the pattern cuts."""
        return self._encoding._encode_single_piece(piece)

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(self._bytes[i] for i in ids)

    def fits(self, a: int, b: int) -> bool:
        """Whether two ids side by side are the encoding of their bytes."""
        out = self._fits.get((a, b))
        if out is None:
            out = self.piece(self._bytes[a] + self._bytes[b]) == [a, b]
            if len(self._fits) < 1 << 18:
                self._fits[a, b] = out
        return out


_loaded: dict[str, Bpe] = {}


def load_bpe(path: str, lines: bytes | None = None) -> Bpe:
    """The vocabulary of a file of ranks, or of its content where a task got that from the driver; loaded once a process."""
    if path not in _loaded:
        if lines is None:
            with open(path, "rb") as f:
                lines = f.read()
        _loaded[path] = Bpe(lines)
    return _loaded[path]


def _middle(size: int, leaf: int) -> int:
    """About half, in whole leaves."""
    return leaf * ((size - 1) // leaf + 1 >> 1)


# ---- ids within one piece of the pattern


def weld(x: list[int], y: list[int], bpe: Bpe) -> list[int]:
    """The ids of the joined bytes of two neighbours within a piece."""
    if not x or not y:
        return x or y
    if bpe.fits(x[-1], y[0]):
        return x + y
    k = 1
    while True:
        i, j = max(0, len(x) - k), min(len(y), k)
        window = bpe.piece(bpe.spell(x[i:] + y[:j]))
        if (i == 0 or bpe.fits(x[i - 1], window[0])) and (j == len(y) or bpe.fits(window[-1], y[j])):
            return x[:i] + window + y[j:]
        k *= 2


def encode_piece(piece: bytes, bpe: Bpe, leaf: int = LEAF) -> list[int]:
    """The ids of one piece of any length: a tree of welds."""
    if len(piece) <= leaf:
        return bpe.piece(piece)
    middle = _middle(len(piece), leaf)
    return weld(encode_piece(piece[:middle], bpe, leaf), encode_piece(piece[middle:], bpe, leaf), bpe)


def encode_stretch(text: str, bpe: Bpe, leaf: int = LEAF) -> np.ndarray:
    """The ids of a text between two sure boundaries."""
    if len(text) <= leaf:
        return bpe.text(text)
    return np.array([i for m in _PIECES.finditer(text) for i in encode_piece(m.group().encode(), bpe, leaf)], np.uint32)


# ---- the tree over a text


class Part:
    """An element of the monoid: text[start:end], its first and last sure boundary (-1 without one) and the ids between them."""

    __slots__ = ("start", "first", "last", "end", "ids")

    def __init__(self, start: int, first: int, last: int, end: int, ids: list[np.ndarray]):
        self.start, self.first, self.last, self.end, self.ids = start, first, last, end, ids


def leaf_part(text: str, start: int, end: int, bpe: Bpe) -> Part:
    own = text[start:end]
    m = _FIRST.search(own)
    if m is None:
        return Part(start, -1, -1, end, [])
    first, last = m.start(), _LAST.search(own).start()
    return Part(start, start + first, start + last, end, [bpe.text(own[first:last])] if last > first else [])


def join(text: str, x: Part, y: Part, bpe: Bpe, leaf: int = LEAF) -> Part:
    """The neighbours x and y of one text as one element; associative."""
    cuts = [x.last] if x.first >= 0 else []
    if x.end > x.start and y.end > y.start and _FIRST.search(text[x.end - 1 : x.end + 1]):
        cuts.append(x.end)
    if y.first >= 0:
        cuts.append(y.first)
    if not cuts:
        return Part(x.start, -1, -1, y.end, [])
    between = [encode_stretch(text[a:b], bpe, leaf) for a, b in zip(cuts, cuts[1:]) if b > a]
    x.ids.extend(between)
    x.ids.extend(y.ids)
    return Part(x.start, x.first if x.first >= 0 else cuts[0], y.last if y.first >= 0 else cuts[-1], y.end, x.ids)


def encode_tree(text: str | None, bpe: Bpe, leaf: int = LEAF) -> np.ndarray:
    """The ids of a text of any length, those of bpe.text(text); every text goes through the tree."""

    def reduce(a: int, b: int) -> Part:
        if b - a <= leaf:
            return leaf_part(text, a, b, bpe)
        middle = a + _middle(b - a, leaf)
        return join(text, reduce(a, middle), reduce(middle, b), bpe, leaf)

    if not text:
        return np.zeros(0, np.uint32)
    p = reduce(0, len(text))
    if p.first < 0:
        return encode_stretch(text, bpe, leaf)
    parts = [encode_stretch(text[: p.first], bpe, leaf), *p.ids]
    if p.last < p.end:
        parts.append(encode_stretch(text[p.last :], bpe, leaf))
    return np.concatenate(parts)


# ---- tables


def _vocabulary(df: DataFrame, path: str):
    """The file's content, sent to the executors once: they need no copy of it."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_ids(df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", leaf_chars: int = LEAF) -> DataFrame:
    """(key, ids array<int>) of each row, without special tokens; their strings in a text are ordinary text.

    Narrow: no shuffle. Repeated rows give repeated results; rows are never dropped.
    """
    lines = _vocabulary(df, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(vocabulary, lines.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                ids = [encode_tree(t, bpe, leaf_chars) for t in some.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    schema = df.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))
    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", leaf_chars: int = LEAF) -> DataFrame:
    """The columns keep and n_tokens of each row; 0 for null and empty texts."""
    lines = _vocabulary(df, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(vocabulary, lines.value)
        for b in batches:
            sizes = [len(encode_tree(t, bpe, leaf_chars)) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    schema = df.select(*keep).schema.add("n_tokens", T.LongType())
    return df.select(*keep, text).mapInArrow(run, schema)


def decode_ids(ids: list[int], vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> str:
    """The text of a list of ids: decoding is concatenation."""
    return load_bpe(vocabulary).spell([int(i) for i in ids]).decode()
