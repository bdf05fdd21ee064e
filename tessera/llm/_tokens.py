"""Byte-level BPE ids of whole texts, made by the ``tokenizers`` library with a memo of chunks.

The library splits a text into pre-tokens with

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and merges inside each pre-token alone. A pre-token holds white space only as one leading space or as nothing else,
so it always ends before a space that a non-space follows, on both sides of a line feed that a non-space follows, and
between a letter or digit and a full stop, comma, colon, semicolon, question or exclamation mark. Texts are cut there; each distinct chunk goes through the library once and its ids are repeated where it recurs.
The concatenation equals what the library gives for the whole text. Chunks of up to 16 bytes are compared in full, as
two machine words, and longer ones as byte strings, so no hash decides equality.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa

from ._common import text_buffer

SHORT = 16
#: Chunks that a worker remembers before it starts anew.
MEMO_CHUNKS = 600_000

_definite = np.zeros(256, dtype=bool)  # bytes that surely start a character that is neither white space nor an added token
_definite[0x21:0x7F] = True
_definite[0xC3:0xE1] = True
_definite[0xE4:0xF5] = True
_definite[0x3C] = False
_closing = np.zeros(256, dtype=bool)
_closing[np.frombuffer(b".,:;?!", dtype=np.uint8)] = True
_wordly = np.zeros(256, dtype=bool)  # ASCII letters and digits
_wordly[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", dtype=np.uint8)] = True
_mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start positions of chunks in a padded buffer of texts, the starts of non-empty texts included."""
    n = int(offsets[-1])
    if not n:
        return np.zeros(0, dtype=np.int64)
    own = data[:n]
    before_solid = _definite[data[1 : n + 1]]
    before_solid[offsets[1:][offsets[1:] > 0] - 1] = False  # nothing follows the end of a text
    mark = (own == 32) & before_solid  # cut before a space that a non-space follows
    line = np.flatnonzero((own == 10) & before_solid)
    mark[line] = True  # cut on both sides of such a line feed
    mark[line[line + 1 < n] + 1] = True
    close = np.flatnonzero(_closing[own])
    close = close[close > 0]
    last, lead = own[close - 1], own[close - 2]  # of the character before; C3 leads U+00C0 to U+00FF
    mark[close[_wordly[last] | ((lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (close > 1))]] = True
    mark[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(mark)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand
    for themselves, the others are numbered from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ChunkMemo:
    """Ids of chunks seen so far by this worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.encoder.get_vocab_size() <= 1 << 16 else np.uint32
        for token in self.encoder.get_added_tokens_decoder().values():
            if not token.content.startswith("<") or set(token.content) & set(" \n.,:;?!") or token.lstrip or token.rstrip:
                raise ValueError(f"texts can't be cut around the added token {token.content!r}")
        self.table = dict(enumerate(byte_alphabet()))
        self.clear()

    def clear(self) -> None:
        self.long: dict[bytes, int] = {}
        self.keys = pd.Index(np.zeros(0, dtype=np.uint64))
        self.low = self.high = np.zeros(0, dtype=np.uint64)
        self.size = np.zeros(0, dtype=np.int64)
        self.slot = np.zeros(0, dtype=np.int64)  # of a short key: its place in first/count
        self.first, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=self.dtype)

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Encode new chunks; their places."""
        lists, other, model = [], [], self.encoder.model
        for k, chunk in enumerate(chunks):
            if chunk.removeprefix(b" ").decode("utf-8").isalpha():  # one pre-token: straight to the library's merges
                lists.append([t.id for t in model.tokenize(chunk.decode("latin-1").translate(self.table))])
            else:
                lists.append([])
                other.append(k)
        for k, e in zip(other, self.encoder.encode_batch_fast([chunks[k].decode("utf-8") for k in other], add_special_tokens=False), strict=True):
            lists[k] = e.ids
        count = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter((i for x in lists for i in x), dtype=self.dtype, count=int(count.sum()))
        at = len(self.first) + np.arange(len(lists))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, flat])
        return at

    def _short(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        words = np.ndarray(shape=(len(data) - 8,), dtype="<u8", buffer=data.data, strides=(1,))
        low = words[start] & _mask[np.minimum(size, 8)]
        high = words[start + 8] & _mask[np.maximum(size - 8, 0)]
        with np.errstate(over="ignore"):
            key = low * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            key = (key + high) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
            key = (key + size.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
        codes, unique = pd.factorize(key)
        head = np.empty(len(unique), dtype=np.int64)
        head[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        known = self.keys.get_indexer(unique)
        new = np.flatnonzero(known < 0)
        if len(new):
            at, raw = head[new], data.tobytes()
            place = self._learn([raw[s : s + n] for s, n in zip(start[at].tolist(), size[at].tolist(), strict=True)])
            known[new] = len(self.keys) + np.arange(len(new))
            self.keys = pd.Index(np.concatenate([self.keys.to_numpy(), unique[new]]))
            self.low, self.high = np.concatenate([self.low, low[at]]), np.concatenate([self.high, high[at]])
            self.size, self.slot = np.concatenate([self.size, size[at]]), np.concatenate([self.slot, place])
        entry = known[codes]
        place = self.slot[entry]
        odd = np.flatnonzero((self.low[entry] != low) | (self.high[entry] != high) | (self.size[entry] != size))
        if len(odd):  # two chunks with one key: the later one is remembered by its bytes
            place[odd] = self._long(data, start[odd], size[odd])
        return place

    def _long(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        view = memoryview(data)
        chunks = [bytes(view[s : s + n]) for s, n in zip(start.tolist(), size.tolist(), strict=True)]
        new = [c for c in dict.fromkeys(chunks) if c not in self.long]
        if new:
            self.long.update(zip(new, self._learn(new).tolist(), strict=True))
        return np.fromiter((self.long[c] for c in chunks), dtype=np.int64, count=len(chunks))

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, one text after the other, and the n + 1 offsets of the texts.
        ``end_id`` is appended to each text, empty and null ones included."""
        if len(self.first) > MEMO_CHUNKS:
            self.clear()
        data, offsets = text_buffer(column)
        start = cuts(data, offsets)
        size = np.diff(np.append(start, offsets[-1]))
        place = np.empty(len(start), dtype=np.int64)
        short = size <= SHORT
        if short.any():
            place[short] = self._short(data, start[short], size[short])
        if not short.all():
            place[~short] = self._long(data, start[~short], size[~short])
        count = self.count[place]
        ends = np.concatenate([[0], np.cumsum(count)])
        own = ends[np.searchsorted(start, offsets)]  # ids before each text
        total, docs = int(ends[-1]), len(offsets) - 1
        source = np.repeat(self.first[place] - ends[:-1], count)
        source += np.arange(total)
        flat = self.ids[source]
        if end_id is None:
            return flat, own
        out = np.empty(total + docs, dtype=self.dtype)
        bounds = own + np.arange(docs + 1)
        keep = np.ones(total + docs, dtype=bool)
        keep[bounds[1:] - 1] = False
        out[keep], out[bounds[1:] - 1] = flat, end_id
        return out, bounds


_memos: dict[str, ChunkMemo] = {}


def memo(path: str) -> ChunkMemo:
    if path not in _memos:
        _memos[path] = ChunkMemo(path)
    return _memos[path]
