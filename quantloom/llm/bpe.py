"""Byte-level BPE of whole texts: by the tokenizers library, and by a sentencepiece model serialised from a vocabulary of ranks.

Both split a text by the pre-token pattern first. A BPE merges within a pre-token
only, so each distinct pre-token is encoded once per worker and its ids are kept
in a table of bounded size; a text's ids are gathered from that table in numpy.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, tidily, utf8
from .pretokens import PATTERN, PretokenEncoder

MAX_WORDS = 700_000  # pre-tokens kept per worker; beyond it the table starts anew
CHUNK = 1 << 20  # text bytes of one pass
LONG_WORD = 200  # longer pre-tokens are not kept


def ragged_take(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``which`` of ``flat``, one after the other, and their lengths."""
    n = length[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(start[which] - (ends - n), n)
    return flat[at], n


def slices(parts: list) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.cumsum(length) - length, length


class _Index(dict):
    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """``encode_words(list of distinct pre-tokens) -> list of id lists``, applied through a table of pre-tokens."""

    def __init__(self, pattern: str, encode_words: Callable[[list[str]], list[list[int]]]):
        self.find, self.encode_words = regex.compile(pattern).findall, encode_words
        self.clear()

    def clear(self) -> None:
        self.index, self.flat, self.used, self.start, self.length = _Index(), np.zeros(1 << 16, np.int32), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        if len(self.index) > MAX_WORDS:
            self.clear()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.find(text)
            counts[i] = len(found)
            words += found
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            ids = self.encode_words(self.index.new)
            start, length = slices(ids)
            more = int(length.sum())
            if self.used + more > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(more, self.used), np.int32)])
            self.flat[self.used : self.used + more] = np.fromiter((x for y in ids for x in y), np.int32, more)
            self.start, self.length = np.concatenate([self.start, start + self.used]), np.concatenate([self.length, length])
            self.used += more
            if any(len(w) > LONG_WORD for w in self.index.new):
                self.index.new = []
                out = self._out(which, counts)
                self.clear()
                return out
            self.index.new = []
        return self._out(which, counts)

    def _out(self, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, n = ragged_take(self.flat, self.start, self.length, which)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)


@lru_cache(2)
def library_encoder(path: str, pattern: str) -> WordEncoder:
    """By the tokenizers library; special tokens in a text are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode = lambda words: [e.ids for e in t.encode_batch(words, add_special_tokens=False)]
    if type(t.pre_tokenizer).__name__ == "ByteLevel" and not t.pre_tokenizer.add_prefix_space and t.normalizer is None:
        # all that is left to do for a pre-token is the model's merging of its mapped bytes
        model, mapped = t.model, dict(enumerate(byte_chars()))
        encode = lambda words: [[x.id for x in model.tokenize(w.encode().decode("latin-1").translate(mapped))] for w in words]
    return word_encoder(pattern, encode)


def word_encoder(pattern: str, encode_words: Callable[[list[str]], list[list[int]]]):
    """In numpy for the pattern it knows, else by the regex engine."""
    return PretokenEncoder(encode_words) if pattern == PATTERN else WordEncoder(pattern, encode_words)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a .tiktoken file by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[k] for k in range(len(ranks))]


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model (protobuf wire format) whose piece ids are the ranks.

    Pieces are the tokens with bytes mapped to characters, scored by negative
    rank; one unknown piece follows. The normaliser is the identity: no prefix
    space, no joining of spaces, no escaping.
    """

    def number(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        return bytes(out)

    def field(k: int, value: bytes | int | float) -> bytes:
        if isinstance(value, bytes):
            return number(k << 3 | 2) + number(len(value)) + value
        if isinstance(value, float):
            return number(k << 3 | 5) + struct.pack("<f", value)
        return number(k << 3) + number(value)

    chars = byte_chars()
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += field(1, field(1, "".join(chars[b] for b in token).encode()) + field(2, float(-rank)) + field(3, 1))
    out += field(1, field(1, b"<unk>") + field(2, float(-len(tokens))) + field(3, 2))
    out += field(2, field(3, 2) + field(4, len(tokens) + 1) + field(40, len(tokens)) + field(41, (1 << 64) - 1) + field(42, (1 << 64) - 1) + field(43, (1 << 64) - 1))
    out += field(3, field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0))
    return bytes(out)


class PieceCodec:
    """Encode by the sentencepiece model, decode by the inverse of the byte mapping."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(read_ranks(path)))
        chars = byte_chars()
        mapped = {b: c for b, c in enumerate(chars)}
        self.encoder = word_encoder(pattern, lambda words: self.model.encode([w.encode().decode("latin-1").translate(mapped) for w in words], num_threads=1))
        back = {c: b for b, c in enumerate(chars)}
        size = self.model.get_piece_size() - 1
        pieces = [bytes(back[c] for c in self.model.id_to_piece(k)) for k in range(size)]
        self.bytes_start, self.bytes_length = slices(pieces)
        self.bytes_flat = np.frombuffer(b"".join(pieces), np.uint8)
        decimals = [b"%d " % k for k in range(size)]
        self.text_start, self.text_length = slices(decimals)
        self.text_flat = np.frombuffer(b"".join(decimals), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder(texts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        flat, n = ragged_take(self.bytes_flat, self.bytes_start, self.bytes_length, ids)
        return _cut(flat, n, counts)

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        flat, n = ragged_take(self.text_flat, self.text_start, self.text_length, ids)
        return [x[:-1] for x in _cut(flat, n, counts)]


def _cut(flat: np.ndarray, n: np.ndarray, counts: np.ndarray) -> list[bytes]:
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
    data = flat.tobytes()
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(2)
def piece_codec(path: str, pattern: str) -> PieceCodec:
    return PieceCodec(path, pattern)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, work: Callable) -> Iterator[pa.RecordBatch]:
    """``work(rows, ids, counts)`` over pieces of the batches, ids by the tokenizers library. Column ``text``; null is empty."""
    encoder = library_encoder(path, pattern)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        _, off = utf8(column)
        for i, j in chunks(off, CHUNK):
            ids, counts = encoder([x or "" for x in column.slice(i, j - i).to_pylist()])
            yield work(batch.slice(i, j - i), ids, counts)


def bpe_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every text by the serialised sentencepiece model, decode the ids, and digest both.

    Returns ``key``, n_tokens, ids_sha256 (decimal ids joined by one space) and
    decoded_sha256. A null text is empty (no ids); rows may repeat, each gives a
    row; a null key stays null; other columns are not read. No shuffle.
    """

    def run(batches):
        codec = piece_codec(path, pattern)
        for batch in batches:
            _, off = utf8(batch.column(1))
            for i, j in chunks(off, CHUNK):
                ids, counts = codec.encode([x or "" for x in batch.column(1).slice(i, j - i).to_pylist()])
                shown = [hashlib.sha256(x).hexdigest() for x in codec.decimals(ids, counts)]
                back = [hashlib.sha256(x).hexdigest() for x in codec.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts), pa.array(shown, pa.string()), pa.array(back, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(tidily(run), f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
