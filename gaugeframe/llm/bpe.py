"""Byte-level BPE encoding and decoding over Arrow batches.

The `tokenizers` library turns pieces of text into ids; this module cuts whole texts into the pieces the vocabulary's
pattern defines, asks the library once for each distinct piece and joins the answers. A cut is only made before a space
that a non-space character follows, or before a single line end between visible characters. There the pattern always ends
one match and begins the next, so the ids are those of the whole text. Decoding maps ids to their bytes through the reversed byte table; characters that are split between
tokens come out whole because bytes, not characters, are joined.
"""

from __future__ import annotations

import codecs
import contextlib
import ctypes
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm._shared import batched

#: Bounds on what a worker remembers between batches: entries of a generation (some 200 bytes each), the worker's memory
#: above which a generation ends early, entries that it has then at least, and bytes of a chunk that is remembered.
MAX_CHUNKS, MAX_PIECES, WORKER_MB, MIN_ENTRIES, LONG_CHUNK = 600_000, 500_000, 450, 80_000, 64
#: Pieces that the library gets in one string.
JOINED = 2000
#: Rows of a batch that are handled at once.
SLICE = 256

#: A space that white space or the end follows, in UTF-8: U+0009 to 000D, 001C to 0020, 0085, 00A0, 1680, 2000 to 200A,
#: 2028, 2029, 202F, 205F, 3000.
_ODD_SPACE = re.compile(rb" (?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z)")
_SPACE = re.compile(r"\s")
#: Marks at a word's end that the pattern matches by themselves.
MARKS = ".,;:!?"
_CUT = re.compile(r" (?=\S)")
#: A line end between two visible ASCII characters: the pattern matches it by itself.
_LINE = re.compile(rb"\n(?<=[!-~]\n)(?=[!-~])")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def resident_mb() -> float:
    """This process's resident memory; 0 where the system doesn't say."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    except OSError:
        return 0.0


def trimmed() -> None:
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def full(cache: dict, most: int) -> bool:
    return len(cache) > most or len(cache) > MIN_ENTRIES and resident_mb() > WORKER_MB


class ByteBpe:
    """A vocabulary file of the `tokenizers` library with bounded caches of what it has answered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.matches = regex.compile(public_tokenizers.PATTERN).findall
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["id"]: x["content"].encode() for x in spec.get("added_tokens", ())}
        vocab = spec["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *added]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = added[i] if i in added else bytes(to_byte[c] for c in token)
        for i, content in added.items():
            self.bytes_of[i] = content
        self.lengths = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.chunks, self.chunks_before = {}, {}
        self.pieces, self.pieces_before = {}, {}
        self.marks = {m.encode(): array("I", self.tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in MARKS}

    def _joined(self, pieces: list[str], mark: str) -> dict[str, bytes]:
        """Ids of pieces that the pattern keeps apart when they follow each other, with the mark between."""
        ids = np.array(self.tokenizer.encode_batch_fast([mark.join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        sizes = np.array([len(p.encode()) for p in pieces]) + len(mark)
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes) - len(mark)) + 1
        raw, begin, gap = ids.tobytes(), 0, 4 * len(mark)
        out = {}
        for p, end in zip(pieces, (4 * ends).tolist(), strict=True):
            out[p] = raw[begin:end]
            begin = end + gap
        return out

    def _pieces(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of each match of the pattern, from the caches or the library."""
        if full(self.pieces, MAX_PIECES):
            self.pieces, self.pieces_before = {}, self.pieces
        known, before = self.pieces, self.pieces_before
        new = []
        for p in wanted.difference(known):
            if (ids := before.get(p)) is None:
                new.append(p)
            else:
                known[p] = ids
        spaced = [p for p in new if p[0] == " " and not p[1:2].isspace() and len(p) > 1]
        bare = [p for p in new if not _SPACE.search(p)]
        for many, mark in ((spaced, ""), (bare, "\n")):
            for at in range(0, len(many), JOINED):
                known.update(self._joined(many[at : at + JOINED], mark))
        for p in set(new).difference(known):
            known[p] = array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes()
        return known

    def _resolve(self, chunks: dict[bytes, str]) -> dict[bytes, bytes]:
        """Ids of each chunk (given with its text)."""
        cut = {c: self.matches(text) for c, text in chunks.items()}
        known = self._pieces(set(chain.from_iterable(cut.values())))
        return {c: b"".join([known[p] for p in found]) for c, found in cut.items()}

    def _recall(self, wanted: set[bytes]) -> list[bytes]:
        """Those of the chunks that neither generation has; what the older one has moves to the younger."""
        known, before, new = self.chunks, self.chunks_before, []
        for c in wanted.difference(known):
            if (ids := before.get(c)) is None:
                new.append(c)
            else:
                known[c] = ids
        return new

    def encode(self, texts: Iterable[bytes | None]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers; a null has none.

        Chunks are remembered without the space before them; the first chunk of a text, which has none, is not. A chunk also
        begins at a single line end, which it keeps.
        """
        cuts = []
        for t in texts:
            if not t or not _ODD_SPACE.search(t):
                cuts.append(_LINE.sub(rb" \n", t or b"").split(b" "))
            else:
                cuts.append([c.encode() for c in _CUT.split(t.decode())])
        heads = {c[0] for c in cuts}
        heads = self._resolve({c: c.decode() for c in heads})
        if full(self.chunks, MAX_CHUNKS):
            self.chunks, self.chunks_before = {}, self.chunks
        known = self.chunks
        new = self._recall(set(chain.from_iterable(cuts)))
        words, marked, odd = [], [], {}
        for c in new:
            text = c.decode()
            if text[:1] == "\n":
                odd[c] = text
            elif text.isalpha():  # the pattern matches it whole with its space, or all but a mark at its end
                words.append(c)
            elif c[-1:] in self.marks and text[:-1].isalpha():
                marked.append(c)
            else:
                odd[c] = " " + text
        words += self._recall({c[:-1] for c in marked}.difference(words))
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            known.update(zip(some, self._joined([" " + c.decode() for c in some], "").values(), strict=True))
        for c in marked:
            known[c] = known[c[:-1]] + self.marks[c[-1:]]
        known.update(self._resolve(odd))
        out = [heads[c[0]] + b"".join([known[x] for x in c[1:]]) for c in cuts]
        for c in new:
            if len(c) > LONG_CHUNK:
                del known[c]
        return out

    def rest(self) -> None:
        """At the end of a task: the older generations go, and freed memory back to the system."""
        self.chunks_before, self.pieces_before = {}, {}
        trimmed()

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text id by id; a character split between tokens comes with the token that completes it."""
        partial = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield partial.decode(self.bytes_of[i])
        yield partial.decode(b"", True)

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Characters [start, end) that each token touches; tokens that share a split character both have it."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return (char_of[starts], char_of[ends - 1] + 1) if len(ends) else (ends, ends)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    """The vocabulary of this worker; memory that earlier tasks have freed goes back to the system first."""
    trimmed()
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, offsets: bool = False) -> DataFrame:
    """Whole texts to ids: the kept columns and `ids` (binary, little-endian u32); with offsets also `starts` and `ends`.

    Null and empty texts have no ids. Rows keep their number and may repeat; no shuffle.
    """
    path = path or default_path()
    kept = df.select(*[F.col(c) for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", ids binary"
    schema += ", starts array<bigint>, ends array<bigint>" if offsets else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                texts = rows.column(len(keep)).to_pylist()
                ids = bpe.encode(texts)
                columns = [*[rows.column(i) for i in range(len(keep))], pa.array(ids, pa.binary())]
                names = [*keep, "ids"]
                if offsets:
                    both = [bpe.offsets((t or b"").decode(), x) for t, x in zip(texts, ids, strict=True)]
                    columns += [pa.array([x[k] for x in both], pa.list_(pa.int64())) for k in (0, 1)]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names)
        bpe.rest()

    return df.select(*[F.col(c) for c in keep], F.col(text).cast("string").cast("binary").alias("__text")).transform(batched, run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds `decoded` (binary): the bytes of each row's ids. Null ids decode to nothing."""
    path = path or default_path()
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", decoded binary"
    at_ids = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                out = pa.array([bpe.decode(x) for x in rows.column(at_ids).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, out], [*names, "decoded"])

    return df.transform(batched, run, schema)


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: n_tokens, and SHA-256 of its ids and of the bytes they decode to."""
    both = decode(encode(df, path=path), path=path)
    sha = lambda c: F.sha2(F.col(c), 256)
    n: Column = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))
