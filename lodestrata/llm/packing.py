"""Harmonic packing of documents into sequences of fixed capacity.

Lengths fall into reciprocal classes: a piece of class ``k`` has a length in ``(C/(k+1), C/k]`` and every bin of
that class takes exactly ``k`` pieces. Documents are cut so that all but their last piece are as long as their
class allows, ``C // k``; only the last, short piece leaves a gap. Each worker fills its own bins and holds no
more than the pieces of its open ones; at its end the pieces of unfinished bins share sequences, longest first.

Tokens come from a public tokenizer file. Tokenization never crosses white space, so the ids of white-space
separated chunks are kept in a bounded table and looked up; ids equal the tokenizer's own on the whole text.

Defined results: null text is empty and has only the end token; null ids are kept; every row is packed by itself,
repeated rows and equal ids too; bins take pieces of equal length in the order of the rows; an empty table gives an
empty result; other columns are ignored; ids must be whole numbers or texts of such. A worker's bins depend on its rows
and their order alone, so a task that runs again gives the same sequences."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
END = 2
#: Sequences of one worker are numbered from its partition's number times this.
STRIDE = 1 << 32
#: Bytes of the table of known chunks, and of that of pieces, before they are emptied; an entry's own cost; the longest chunk kept.
KNOWN_BYTES = 64 << 20
ENTRY = 200
LONGEST = 64

#: The tokenizer's own split rule for lower-cased Latin-1 letters, digits and ASCII punctuation.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
PLAIN = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ÿ!-/:-@\[-`{-~]+").fullmatch
#: str.split() also splits at these, the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]").search


assert sys.byteorder == "little" and array("I").itemsize == 4


class Ids:
    """Token ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.known_bytes = self.piece_bytes = 0
        self.byte_level: dict[int, str] | None = None
        self._load(path)

    def _load(self, path: str) -> None:
        """If the file is a byte-level BPE with word ends, the characters that its model takes for bytes; else every chunk goes through the whole tokenizer."""
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>":
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
            hidden = [b for b in range(256) if b not in set(shown)]
            self.byte_level = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.byte_level)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self.byte_level is None or "<|" in chunk or len(chunk) > 200 or not PLAIN(chunk):
            return self._whole(chunk)
        out = []
        for piece in PIECES.findall(chunk.lower()):
            got = self.pieces.get(piece)
            if got is None:
                got = self._piece(piece)
                if len(piece) <= LONGEST:
                    if self.piece_bytes > KNOWN_BYTES:
                        self.pieces.clear()
                        self.piece_bytes = 0
                    self.pieces[piece] = got
                    self.piece_bytes += ENTRY + 2 * len(piece) + len(got)
            out.append(got)
        return b"".join(out)

    def of(self, text: str) -> bytes:
        if SEPARATORS(text):
            return self._whole(text)
        known, chunks = self.known, text.split()
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            out = []
            for c in chunks:
                got = known.get(c)
                if got is None:
                    got = self._chunk(c)
                    if len(c) <= LONGEST:  # longer ones hardly come again
                        known[c] = got
                        self.known_bytes += ENTRY + 4 * len(c) + len(got)
                out.append(got)
                if self.known_bytes > KNOWN_BYTES:
                    known.clear()
                    self.known_bytes = 0
            return b"".join(out)


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """Kept by the worker from one task to the next."""
    return Ids(path)


def cuts(n: int, capacity: int = CAPACITY, least: int = CAPACITY // 64) -> list[int]:
    """Piece lengths of a document of n tokens: each but the last is the largest ``capacity // k`` that fits."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > least:
        k = -(-capacity // n)
        out.append(capacity // k)
        n -= capacity // k
    return out + [n] * (n > 0)


class Bins:
    """Open bins of one worker, by class; whole sequences are given out as lists of pieces."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next, self.open = capacity, first, {}

    def _out(self, pieces: list[tuple]) -> list[tuple]:
        at, sequence, out = 0, self.next, []
        self.next += 1
        for p in pieces:
            out.append((*p, sequence, at))
            at += p[2]
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """piece: (document, start, length, ...)."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self._out(self.open.pop(k)) if len(held) == k else []

    def rest(self) -> Iterator[list[tuple]]:
        """Pieces of unfinished bins, longest first, each into the first shared sequence with room."""
        shared: list[tuple[int, list]] = []
        for p in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2]):
            for i, (room, held) in enumerate(shared):
                if room >= p[2]:
                    held.append(p)
                    shared[i] = (room - p[2], held)
                    break
            else:
                shared.append((self.capacity - p[2], [p]))
        self.open = {}
        for _, held in shared:
            yield self._out(held)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, key: Column, text: Column, tokenizer: str | Callable[[], str], capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece; ``with_ids`` adds the piece's token ids as bytes.

    ``tokenizer``: path of the tokenizer file, or a function that gives it on the worker."""
    tail = array("I", [end]).tobytes()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        ids = columns.pop(5)
        arrays = [pa.array(c, pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer if isinstance(tokenizer, str) else tokenizer())
        bins, out = Bins(capacity, TaskContext.get().partitionId() * STRIDE), []
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                for doc, body in zip(batch.column(0).slice(i, 128).to_pylist(), batch.column(1).slice(i, 128).to_pylist(), strict=True):
                    tokens = memoryview(ids.of(body or "") + tail)
                    n, start = len(tokens) // 4, 0
                    for length in cuts(n, capacity):
                        part = tokens[4 * start : 4 * (start + length)]
                        out += bins.add((doc, start, length, zlib.crc32(part), n, bytes(part) if with_ids else b""))
                        start += length
                if len(out) > 4000:
                    yield rows(out)
                    out = []
        for more in bins.rest():
            out += more
        if out:
            yield rows(out)

    chosen = docs.select(key.cast("long").alias("key"), text.cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def public_tokenizer() -> str:
    """The public vocabulary of the packing query, found on the worker that reads it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
