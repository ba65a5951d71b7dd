"""Token ids and counts of whole texts with a tokenizer file of the tokenizers library.

Two exact shortcuts keep the library's work small. PieceEncoder cuts a text where the tokenizer can
carry nothing across the cut, and gives the library each distinct piece once; a piece that is one word goes
straight to the library's model. count_tokens() encodes a huge text in overlapping chunks and splices them
where both chunks provably agree.
"""

from __future__ import annotations

import codecs
import functools
import gc
import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, picked, small_batches

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 32_768, 256
#: Distinct pieces that a worker keeps at most; then those of more than SHORT characters go.
PIECES, SHORT = 1_000_000, 8
#: The letters of words that go straight to the model (Latin ones; the second kind in lower case only), and the signs that may follow.
LETTERS, SMALL, SIGNS = "a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\u024f", "a-z\xdf-\xf6\xf8-\xff", r"!-&(-/:-@\[-`{-~"


@functools.cache
def load(path: str, keeps: bool = True):
    """The library's tokenizer. keeps: with its own cache of words, which only costs where no word comes twice."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    if not keeps and hasattr(made.model, "_resize_cache"):
        made.model._resize_cache(0)
    return made


@functools.cache
def byte_letters() -> str:
    """The character by which byte-level models write each byte: itself if it shows, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
    return "".join(chr(hidden.get(b, b)) for b in range(256))


@functools.cache
def _spec(path: str) -> dict:
    with open(path) as f:
        x = json.load(f)
    x["model"].pop("vocab", None)
    x["model"].pop("merges", None)
    return x


def _plain_specials(spec: dict) -> bool:
    return not any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])


def _is_byte_level(spec: dict) -> bool:
    """Byte-level BPE without a normalizer, by the usual pattern: ` ?letters| ?digits| ?others|\\s+(?!\\S)|\\s+`."""
    p = spec["pre_tokenizer"] or {}
    return spec["normalizer"] is None and p.get("type") == "ByteLevel" and p["use_regex"] and not p["add_prefix_space"] and _plain_specials(spec)


def _drops_spaces(spec: dict) -> bool:
    """White space is folded and left out by the pattern, so that no token holds any."""
    p = spec["pre_tokenizer"] or {}
    first = (p.get("pretokenizers") or [{}])[0]
    folds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    return folds == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "") and _plain_specials(spec)


class Pieces(dict):
    """Piece -> its ids, made when they are first asked for.

    `simple` matches pieces of a line feed, a word and signs, all optional but the word, between which the tokenizer's
    pattern always cuts. The word is then one pre-token, so the model alone gives its ids; other pieces go through
    the whole tokenizer.
    """

    def __init__(self, tokenizer, simple: re.Pattern):
        self.tokenizer, self.simple, self.cut = tokenizer, simple.fullmatch, tokenizer.model.tokenize
        self.raw = [struct.pack("<I", k) for k in range(tokenizer.get_vocab_size())]
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> bytes:
        m = self.simple(piece)
        if m is None:
            ids = _packed(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0])
        elif m[1] or m[3]:
            ids = (self[m[1]] if m[1] else b"") + self[m[2]] + (self[m[3]] if m[3] else b"")
        else:
            raw = self.raw
            ids = b"".join([raw[t.id] for t in self.cut(codecs.charmap_decode(piece.encode(), "strict", self.letters)[0])])
        self[piece] = ids
        return ids


class PieceEncoder:
    """The library's ids of whole texts, as little-endian unsigned 32-bit integers.

    Cuts are made before a space or line feed between two characters that are not white space. There the
    byte-level pattern ends a token and starts afresh, and the other kind drops the white space. A text with
    other runs of white space is cut only where such a run starts. Other tokenizers get whole texts.
    """

    def __init__(self, path: str, most: int | None = None):
        self.most, spec = most or PIECES, _spec(path)
        self.byte_level, self.dropping = _is_byte_level(spec), _drops_spaces(spec)
        self.cuts = self.byte_level or self.dropping
        self.tokenizer = load(path, keeps=not self.cuts)
        word = f"( ?[{LETTERS}]+)" if self.byte_level else f"([{SMALL}]+)"
        self.known = Pieces(self.tokenizer, re.compile(f"(\n?){word}([{SIGNS}]*)"))
        self.piece, self.marks = re.compile(r"\s*\S+|\s+"), re.compile("[\u0130\u0300-\U0010ffff]")

    def pieces(self, text: str) -> list[str]:
        if self.dropping:
            if self.marks.search(text) is None and "<|" not in text:  # lower case of these letters is letter by letter
                text = text.lower()
            return text.replace("\n", " ").split(" ")
        lines = text.split("\n")
        if not all(map(self.even, lines)):
            return self.piece.findall(text)
        lines = [x.replace(" ", "\0 ") for x in lines]
        return "\0\n".join(lines).split("\0")

    @staticmethod
    def even(line: str) -> bool:
        """Whether the only white space is single spaces between other characters (and there is no other control character)."""
        return line.isprintable() and line != "" and "  " not in line and line[0] != " " != line[-1]

    def __call__(self, text: str) -> bytes:
        if not self.cuts:
            return _packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])
        on = gc.isenabled()
        gc.disable()  # strings and bytes make no cycles, and there are millions
        try:
            return b"".join(map(self.known.__getitem__, self.pieces(text)))
        finally:
            if on:
                gc.enable()
            if len(self.known) > self.most:
                self._forget()

    def _forget(self) -> None:
        short = {k: v for k, v in self.known.items() if len(k) <= SHORT}
        self.known.clear()
        if len(short) <= self.most // 2:
            self.known.update(short)


def _packed(encoding) -> bytes:
    ids = encoding.ids
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def encoder(path: str, most: int | None = None) -> PieceEncoder:
    return PieceEncoder(path, most)


def _words(encoding) -> tuple[list[int], list[int]]:
    """Where each pre-token starts (in characters), and the number of tokens before it."""
    w = np.array([-1 if x is None else x for x in encoding.word_ids], np.int64)
    first = np.ones(len(w), bool)
    first[1:] = (w[1:] != w[:-1]) | (w[1:] < 0)
    at = np.flatnonzero(first)
    offsets = encoding.offsets
    return [offsets[k][0] for k in at.tolist()], at.tolist()


def count_by_chunks(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = 32) -> int:
    """Number of tokens of a long text, from overlapping chunks.

    The tokenizer reads pre-tokens from left to right, each from its own start with a bounded look ahead (a
    special token, a contraction). A start of a pre-token that both chunks show, at `margin` characters or
    more before the first one's end, is therefore a start in the whole text, and what follows depends on
    nothing before it: the first chunk counts up to there, the second from there. If the overlap shows no such
    start, it is doubled; when it has reached the chunk's start, the chunk is made longer.
    """
    n, total, start, skip = len(text), 0, 0, 0
    size = chunk
    encoding = tokenizer.encode(text[:size], add_special_tokens=False)
    while start + size < n:
        end, back = start + size, overlap
        places, before = _words(encoding)
        known = {start + p: k for p, k in zip(places, before) if start + p <= end - margin and k > skip}
        while True:
            back = min(back, end - start)
            begin = end - back
            if back == end - start:  # no common start: a longer chunk
                size *= 2
                encoding = tokenizer.encode(text[start : start + size], add_special_tokens=False)
                break
            after = tokenizer.encode(text[begin : begin + chunk], add_special_tokens=False)
            p2, b2 = _words(after)
            common = next(((known[begin + p], k) for p, k in zip(p2, b2) if k and begin + p in known), None)
            if common:
                total += common[0] - skip
                start, size, skip, encoding = begin, chunk, common[1], after
                break
            back *= 2
    return total + len(encoding.ids) - skip


def _count_batches(path: str, chunk: int, overlap: int):
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        encode, whole, splices = encoder(path), load(path), _is_byte_level(_spec(path))
        for b in batches:
            texts = b.column(1).fill_null("").to_pylist()
            n = [count_by_chunks(whole, x, chunk, overlap) if splices and len(x) > chunk else len(encode(x)) // 4 for x in texts]
            yield batch(schema, b.column(0), [len(x.encode()) for x in texts], n)

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit of each row; a null or empty text has none.

    Special strings inside texts count as the library takes them by default. Repeated rows and rows with a null
    id each give a row; nothing is shuffled. Tokenizers other than byte-level BPE take huge texts whole.
    """
    small_batches(docs.sparkSession)
    made = picked(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    made = made.mapInArrow(_count_batches(path, chunk, overlap), "id long, n_bytes long, n_tokens long")
    return made.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
