"""SentencePiece encoding and decoding in batched numpy.

Words of one length advance together, one position at a step. At each position every piece that ends there is a
candidate (substring hashes, from prefix hashes, probe the sorted keys of the pieces), the best candidate is taken over
all words at once, and its length is stored as the backpointer; walking the backpointers from the end gives the pieces.

What "best" means depends on the model. For a unigram model it is the largest sum of scores (Viterbi). A byte-pair
model doesn't define its segmentation by a sum, so its scores can't be added up. There, the segmentation of a prefix
ends with the one piece that is *compatible* with the last piece of the segmentation before it: the pair, merged by
the model's rules, stays that pair. So a candidate's value is whether it is compatible; the rest is the same pass. Words
of any length go through it: they are first cut where no piece has the two characters beside each other, since no piece
can span such a place, and a text without spaces falls into short parts there.

Only runs of spaces have no order of pieces: all pieces of several spaces have one score, below all others. What follows a
run goes through the pass with its last space, and the spaces left are merged by the rules, once for each length of run.

Text is taken as it is (identity normalisation), with a space put before it, and spaces become U+2581. Characters
outside the pieces become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, slices

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Words a worker remembers before it starts anew.
MEMO_WORDS = 500_000
#: Text bytes that are taken at once: the more new words of one length, the fewer passes.
SLICE_BYTES = 4 << 20
#: Positions for which candidates are looked up at once, over all words that advance together.
POSITIONS = 1 << 18
#: Places of the table that remembers which pairs of pieces are compatible.
PAIRS = 1 << 21
_NONE = np.iinfo(np.int64).max
_word = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 2: None, 5: 4}[key & 7]
        if size is None:
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


class Vocabulary:
    """Pieces, scores and settings of a model file."""

    #: Values of a piece's type field in the file format.
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str, kind: int | None = None):
        self.pieces, self.scores, self.types, self.kind, self.normalizer = [], [], [], UNIGRAM, b"identity"
        self.prefix, self.trim = True, True
        with open(path, "rb") as file:
            data = file.read()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, self.NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                settings = dict(_fields(value))
                self.normalizer, self.prefix, self.trim = settings.get(1, b""), bool(settings.get(3, 1)), bool(settings.get(4, 1))
        self.kind = kind or self.kind
        if self.normalizer != b"identity" or self.trim or not self.prefix or self.USER in self.types or self.kind not in (UNIGRAM, BPE):
            raise ValueError("the model's normalisation, piece types or algorithm aren't supported")
        self.byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == self.BYTE}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces")


class Coder:
    def __init__(self, path: str, kind: int | None = None):
        self.vocabulary = v = Vocabulary(path, kind)
        normal = [i for i, t in enumerate(v.types) if t == v.NORMAL]
        # Ranks: characters first, then pieces by descending score. A rank is a piece's number within this class.
        order = sorted(normal, key=lambda i: (len(v.pieces[i]) > 1, -v.scores[i], i))
        self.id = np.array(order, dtype=np.int64)
        self.text = [v.pieces[i] for i in order]
        self.rank = {p: k for k, p in enumerate(self.text)}
        self.score = np.array([v.scores[i] for i in order])
        self.size = np.array([len(p) for p in self.text])
        self.longest = int(self.size.max())
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.array([1] + [0x9E3779B97F4A7C15] * 64, dtype=np.uint64), dtype=np.uint64)
        keys = np.zeros(len(order), dtype=np.uint64)
        for n in np.unique(self.size).tolist():
            of = np.flatnonzero(self.size == n)
            chars = np.array([[ord(c) for c in self.text[k]] for k in of], dtype=np.uint64)
            keys[of] = self._keys(self._prefix_hashes(chars), n)[:, 0]
        self.key_order = np.argsort(keys)
        self.keys = keys[self.key_order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.begins = np.zeros(1 << 20, dtype=bool)  # the first bits of all keys: most substrings needn't be searched
        self.begins[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.chars = np.zeros((len(order), self.longest), dtype=np.uint32)
        for k, p in enumerate(self.text):
            self.chars[k, : len(p)] = [ord(c) for c in p]
        self._learn_borders()
        if v.kind == BPE:
            self._learn_merges()
            self._check_spaces()
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.runs: dict[int, np.ndarray] = {}
        self.asked, self.asked_ok = np.full(PAIRS, -1, dtype=np.int64), np.zeros(PAIRS, dtype=bool)

    # Substring hashes

    def _prefix_hashes(self, chars: np.ndarray) -> np.ndarray:
        out = np.zeros((len(chars), chars.shape[1] + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(chars.shape[1]):
                out[:, j + 1] = out[:, j] * self.power[1] + chars[:, j] + np.uint64(1)
        return out

    def _keys(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """Keys of all substrings of n characters, by their start."""
        with np.errstate(over="ignore"):
            key = prefix[:, n:] - prefix[:, : prefix.shape[1] - n] * self.power[n]
            key ^= key >> np.uint64(29)
            return key * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)

    def _probe(self, key: np.ndarray, chars: np.ndarray, n: int) -> np.ndarray:
        """Ranks of the pieces of n characters among all substrings of that size, or -1. A key finds a candidate; its
        size and characters decide."""
        out = np.full(key.shape, -1, dtype=np.int64)
        row, i = np.nonzero(self.begins[(key >> np.uint64(44)).astype(np.int64)])
        wanted = key[row, i]
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == wanted
        row, i = row[hit], i[hit]
        out[row, i] = self.key_order[at[hit]]
        found = out[row, i]
        same = self.size[found] == n
        for k in range(n):
            same &= self.chars[found, k] == chars[row, i + k]
        out[row[~same], i[~same]] = -1
        return out

    # Places that no piece spans

    def _learn_borders(self) -> None:
        """``letter``: the number of each character of the pieces; ``beside``: whether a piece has two of them in turn."""
        own = np.unique(self.chars[self.chars > 0])
        self.letter = np.full(0x110000, len(own), dtype=np.int32)
        self.letter[own] = np.arange(len(own))
        self.beside = np.zeros((len(own) + 1, len(own) + 1), dtype=bool)
        both = (self.chars[:, 1:] > 0).nonzero()
        self.beside[self.letter[self.chars[both]], self.letter[self.chars[both[0], both[1] + 1]]] = True

    def parts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Words cut where no piece can lie across, all parts in turn, and how many each word has."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        text = "".join(words)
        own = self.letter[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
        cut = np.ones(len(own), dtype=bool)
        cut[1:] = ~self.beside[own[:-1], own[1:]]
        cut[np.cumsum(size) - size] = True
        first = np.flatnonzero(cut).tolist()
        return [text[a:b] for a, b in zip(first, [*first[1:], len(text)], strict=True)], np.add.reduceat(cut, np.cumsum(size) - size, dtype=np.int64)

    # Byte-pair rules

    def _learn_merges(self) -> None:
        """``pair``: all (left, right) whose concatenation is a piece; ``left``/``right``: the merge that makes a piece
        (its own rank for characters); ``made``: whether the rules ever make it."""
        pairs, merged = [], []
        for k, p in enumerate(self.text):
            for cut in range(1, len(p)):
                a, b = self.rank.get(p[:cut]), self.rank.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append(a * len(self.text) + b)
                    merged.append(k)
        by = np.argsort(np.array(pairs, dtype=np.int64))
        self.pair, self.pair_rank = np.array(pairs, dtype=np.int64)[by], np.array(merged, dtype=np.int64)[by]
        self.left = np.arange(len(self.text))
        self.right = self.left.copy()
        self.made = self.size == 1
        for n in range(2, self.longest + 1):
            of = [k for k in np.flatnonzero(self.size == n).tolist() if set(self.text[k]) != {SPACE}]
            for cut in range(1, n):
                rows = [(k, self.rank[self.text[k][:cut]], self.rank[self.text[k][cut:]]) for k in of if not self.made[k] and self.text[k][:cut] in self.rank and self.text[k][cut:] in self.rank]
                if not rows:
                    continue
                k, a, b = np.array(rows).T
                ok = self.made[a] & self.made[b] & (a < k) & (b < k)
                ok[ok] = self.compatible(a[ok], b[ok], k[ok])
                self.left[k[ok]], self.right[k[ok]], self.made[k[ok]] = a[ok], b[ok], True

    def _check_spaces(self) -> None:
        """What the treatment of runs of spaces rests on."""
        runs = {p for p in self.text if len(p) > 1 and set(p) == {SPACE}}
        others = [k for k, p in enumerate(self.text) if len(p) > 1 and p not in runs]
        if any(SPACE in self.text[k][1:] for k in others):
            raise ValueError("a piece has a space behind its first character")
        if runs and others and max(self.score[self.rank[p]] for p in runs) >= self.score[others].min():
            raise ValueError("pieces of several spaces aren't the last merges")

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.text) + b
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where(self.pair[at] == key, self.pair_rank[at], _NONE)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of all pairs, with a table of pairs asked for before."""
        key = a * len(self.text) + b
        place = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        out, new = self.asked_ok[place], np.flatnonzero(self.asked[place] != key)
        if len(new):
            out[new] = self.compatible(a[new], b[new])
            self.asked[place[new]], self.asked_ok[place[new]] = key[new], out[new]
            # Of two new pairs with one place the later key stays, and its own answer with it.
            self.asked_ok[place[new]] = np.where(self.asked[place[new]] == key[new], out[new], self.asked_ok[place[new]])
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int = _NONE) -> np.ndarray:
        """Whether the merges inside each of two adjacent pieces all happen before any merge across their border. The
        pieces are undone merge by merge, the later merge first; a merge across that comes before the merge just undone
        (or is the same piece further left) parts them. Only merges before ``limit`` count."""
        out = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.broadcast_to(np.asarray(limit, dtype=np.int64), a.shape).copy()
        while len(live):
            broken = self._merged(a, b) < limit
            out[live[broken]] = False
            one, two = self.left[a] != a, self.left[b] != b  # can be undone
            undo_a = one & ((a > b) | ~two)
            undo_b = two & ~undo_a
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            keep = ~broken & (undo_a | undo_b)
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return out

    def merge_one_by_one(self, word: str) -> list[int]:
        """Ranks (or minus one minus the code point of an unknown character) of a word, by the rules themselves."""
        parts: list[str | None] = list(word)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else len(parts)
            if j < len(parts) and (r := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.score[r], i, j, parts[i] + parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, j, text = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != text:
                continue
            parts[i], parts[j] = text, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [self.rank.get(p, -1 - ord(p[0])) for p in parts if p is not None]

    # The pass over positions

    def segment(self, words: list[str]) -> np.ndarray:
        """Ranks (negative: unknown characters) of words of one length, a row a word, the rest of a row ``_NONE``."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1)
        n, length = chars.shape
        prefix = self._prefix_hashes(chars.astype(np.uint64))
        bpe = self.vocabulary.kind == BPE
        last = np.full((n, length + 1), _NONE, dtype=np.int64)  # rank of the last piece of each prefix
        back = np.ones((n, length + 1), dtype=np.uint8)
        best = np.full((n, length + 1), -np.inf, dtype=np.float32 if bpe else np.float64)
        best[:, 0] = 0
        penalty = self.score.min() - 10  # of an unknown character in a unigram model
        window, known, first, stop = max(1, POSITIONS // n), {}, 0, 0
        for j in range(1, length + 1):
            if j > stop:  # candidates that end in the next window of positions
                first, stop = max(0, j - self.longest), min(length, j + window - 1)
                known = {}
                for size in range(1, min(stop - first, self.longest) + 1):
                    ranks = self._probe(self._keys(prefix[:, first : stop + 1], size), chars[:, first:stop], size)
                    known[size] = ranks, (ranks >= 0).any(axis=0)
            for size in range(min(j, self.longest), 0, -1):
                i = j - size
                ranks, some = known[size]
                if not some[i - first] and (bpe or size > 1):
                    continue
                piece = ranks[:, i - first]
                if bpe:
                    rows = np.flatnonzero((piece >= 0) & (best[:, j] == -np.inf))
                    rows = rows[self.made[piece[rows]]]
                    before = last[rows, i]
                    ok = np.ones(len(rows), dtype=bool)
                    if i:
                        inner = np.flatnonzero(before >= 0)
                        ok[inner] = self.joined(before[inner], piece[rows[inner]])
                    rows = rows[ok]
                    best[rows, j], last[rows, j], back[rows, j] = 0, piece[rows], size
                else:
                    value = best[:, i] + np.where(piece >= 0, self.score[piece], -np.inf)
                    if size == 1:
                        value = np.where(piece >= 0, value, best[:, i] + penalty)
                    rows = np.flatnonzero(value > best[:, j])
                    best[rows, j], last[rows, j], back[rows, j] = value[rows], piece[rows], size
            lost = np.flatnonzero((last[:, j] == _NONE) | (last[:, j] < 0))
            if len(lost):
                last[lost, j], back[lost, j], best[lost, j] = -1 - chars[lost, j - 1].astype(np.int64), 1, np.where(best[lost, j] == -np.inf, 0, best[lost, j])
        at, rows, steps = np.full(n, length), np.arange(n), []
        while len(rows):
            step = np.full(n, _NONE, dtype=np.int64)
            step[rows] = last[rows, at[rows]]
            steps.append(step)
            at[rows] -= back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return np.array(steps[::-1]).T if steps else np.zeros((n, 0), dtype=np.int64)

    def _coded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct parts without runs of spaces: ids of all, and where each part's begin and how many they are."""
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        order = np.argsort(sizes, kind="stable")
        flat, counts, start = [], [], 0
        while start < len(order):
            size = int(sizes[order[start]])
            stop = min(int(np.searchsorted(sizes[order], size, side="right")), start + max(1, 50_000 // size))
            table = self.segment([parts[k] for k in order[start:stop].tolist()])
            own = table != _NONE
            flat.append(table[own])
            counts.append(own.sum(axis=1))
            start = stop
        ranks = np.concatenate(flat)
        first, count = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
        count[order] = np.concatenate(counts)
        first[order] = np.cumsum(count[order]) - count[order]
        ids = self.id[np.maximum(ranks, 0)]
        unknown = np.flatnonzero(ranks < 0)  # such a character is a part of its own
        more, end = [], len(ids)
        for k, rank in zip(order[np.searchsorted(first[order], unknown, side="right") - 1].tolist(), ranks[unknown].tolist(), strict=True):
            own = [self.vocabulary.byte[b] for b in chr(-1 - rank).encode()]
            more += own
            first[k], count[k], end = end, len(own), end + len(own)
        return np.concatenate([ids, np.array(more, dtype=np.int64)]), first, count

    def _spaces(self, n: int) -> np.ndarray:
        """Ids of a run of spaces alone."""
        if n not in self.runs:
            self.runs[n] = self.id[self.merge_one_by_one(SPACE * n)] if n else np.zeros(0, dtype=np.int64)
        return self.runs[n]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words."""
        runs = [k for k, w in enumerate(words) if w.startswith(SPACE * 2)] if self.vocabulary.kind == BPE else []
        lead = {k: len(words[k]) - len(words[k].lstrip(SPACE)) - 1 for k in runs}
        bare = list(words)
        for k, n in lead.items():
            bare[k] = words[k][n:]
        parts, per = self.parts(bare)
        number = dict(zip(dict.fromkeys(parts), range(len(parts)), strict=False))
        ids, first, count = self._coded(list(number))
        code = np.fromiter(map(number.__getitem__, parts), dtype=np.int64, count=len(parts))
        own, head = count[code], np.cumsum(per) - per
        total = np.add.reduceat(own, head)
        flat = ids[np.repeat(first[code] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        begin, more = np.cumsum(total) - total, []
        space, end = self.id[self.rank[SPACE]] if SPACE in self.rank else -1, len(flat)
        for k, n in lead.items():
            mine = flat[begin[k] : begin[k] + total[k]]
            alone = int(mine[0] == space)  # the run's last space stays with the others
            mine = np.concatenate([self._spaces(n + alone), mine[alone:]])
            more.append(mine)
            begin[k], total[k], end = end, len(mine), end + len(mine)
        self.place.update(zip(words, range(len(self.first), len(self.first) + len(words)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + begin])
        self.count = np.concatenate([self.count, total])
        self.ids = np.concatenate([self.ids, flat, *more]).astype(np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn and the n + 1 offsets; null and empty texts have none."""
        if len(self.place) > MEMO_WORDS:
            self.clear()
        split = [_word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        per = np.array([len(x) for x in split], dtype=np.int64)
        words = list(chain.from_iterable(split))
        place = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(place < 0).tolist()
        if new:
            unseen = [words[k] for k in new]
            self._learn(list(dict.fromkeys(unseen)))
            place[new] = np.fromiter(map(self.place.__getitem__, unseen), dtype=np.int64, count=len(new))
        count = self.count[place]
        ends = np.concatenate([[0], np.cumsum(count)])
        source = np.repeat(self.first[place] - ends[:-1], count) + np.arange(int(ends[-1]))
        return self.ids[source], ends[np.concatenate([[0], np.cumsum(per)])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, U+2581 as space, byte pieces as UTF-8 (what isn't valid as U+FFFD), without
        the space put before; control pieces have no text."""
        if not hasattr(self, "raw"):
            v = self.vocabulary
            self.raw = [b"" if t == v.CONTROL else bytes([int(p[3:5], 16)]) if t == v.BYTE else b" \xe2\x81\x87 " if t == v.UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(v.pieces, v.types, strict=True)]
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


_coders: dict[tuple, Coder] = {}


def coder(path: str, kind: int | None = None) -> Coder:
    if (path, kind) not in _coders:
        _coders[path, kind] = Coder(path, kind)
    return _coders[path, kind]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of each row of ``docs`` (``doc_id, text``; other columns are ignored). Null and empty texts have
    no ids. Texts and words of any length are taken whole. Repeated rows are returned repeatedly, null ids are kept, an
    empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, bounds = own.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``. Null and empty lists give an empty text, null doc_ids and repeated rows are
    kept, ids of any number are taken whole, other columns are ignored, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in batches:
            lists = batch.column("ids")
            texts = [own.decode(np.asarray(x.values)) if x.is_valid else "" for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, decoded_sha256``: ids as little-endian unsigned 32-bit integers, and the text that
    they decode to. Nulls, repeated rows and empty tables as in ``encode_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in batches:
            lists = [np.asarray(x.values) for x in batch.column("ids")]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in lists]
            sha = [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in lists], pa.int64()), pa.array(crc, pa.int64()), pa.array(sha)], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return encode_documents(docs, model).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
