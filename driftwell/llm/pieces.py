"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by the score of the
piece that they merge to, leftmost first among equals, until no pair is a piece;
symbols that aren't pieces fall back to bytes.  As no piece of the vocabulary
holds a word mark after another character (checked on loading), merges never
cross the start of a run of word marks, so a text is encoded by its segments and
each distinct segment is encoded once for each memory of a worker.

Short segments run their agendas in lockstep as numpy arrays: every round pops the
best pair of each.  Long segments run one heap.  All new segments of an Arrow
batch are encoded and decoded again by the sentencepiece library, which must
agree; a difference ends the job.

Defined results: null counts as empty; an empty text has no ids and decodes to
an empty text.  Texts of any length are encoded whole.  Of pairs of equal score the
leftmost merges first, as in the library.  Repeated rows are encoded each by itself,
alike; an empty table gives an empty result.  Other columns are passed over, whatever
their names.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, tokenizer_path

MARK = "▁"
#: Characters of segments whose agendas run in lockstep; a place takes _BITS bits.
LOCKSTEP = 30
_BITS = 5
#: Segments in a worker's newer memory; the older one has as many at most.
MEMORY = 200_000
_NONE = np.uint32(2**32 - 1)
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(MARK in self.text[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a word mark after another character")
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.bytes = frozenset(self.byte_of)
        self.unknown = sp.unk_id()
        self.symbol = {self.text[i]: i for i in plain}
        for c in sorted({c for i in plain for c in self.text[i]} - set(self.symbol)):
            self.symbol[c] = n + len(self.symbol)  # merges only; no piece of its own
        self.pieces = n
        self.extra = {i: c for c, i in self.symbol.items() if i >= n}
        order = sorted((i for i in plain if len(self.text[i]) > 1), key=lambda i: -sp.get_score(i))
        rank, last, at = {}, None, -1
        for i in order:
            if sp.get_score(i) != last:
                at, last = at + 1, sp.get_score(i)
            rank[i] = at
        self.pair: dict[int, tuple[int, int]] = {}  # left symbol << 32 | right symbol to rank and piece
        for i in order:
            t = self.text[i]
            for k in range(1, len(t)):
                a, b = self.symbol.get(t[:k]), self.symbol.get(t[k:])
                if a is not None and b is not None:
                    self.pair[a << 32 | b] = (rank[i], i)
        self._tables()
        self.new: dict[str, str] = {}  # segments to ids joined by commas
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # decoded texts of segments that don't decode to themselves
        self.old_odd: dict[str, str] = {}

    def _tables(self) -> None:
        self.of_char = np.arange(-2, -2 - 0x110000, -1, dtype=np.int32)
        for t, i in self.symbol.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        self.name = [str(i) for i in range(self.pieces)]
        bits = 2 + max(8, len(self.pair).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, _NONE, dtype=np.uint32)
        self.merged = np.zeros(1 << bits, dtype=np.int32)
        for key, (rank, i) in self.pair.items():
            at = ((key * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> int(self.shift)
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at], self.merged[at] = key, rank, i

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; _NONE where it is no piece. Negative symbols pair with nothing."""
        key = (a.astype(np.int64) << np.int64(32)) | b
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)
        held = self.keys[at]
        missed = np.flatnonzero((held != key) & (held != -1))
        while len(missed):
            at[missed] = (at[missed] + 1) & self.mask
            held = self.keys[at[missed]]
            missed = missed[(held != key[missed]) & (held != -1)]
        rank = self.ranks[at]
        rank[(self.keys[at] != key) | (a < 0) | (b < 0)] = _NONE
        return rank, self.merged[at]

    def _lockstep(self, segments: list[str]) -> list[list[int]]:
        """Symbols of the segments (LOCKSTEP characters at most) after all merges.

        A column is a segment, a row a place in it; places are linked to those that are left
        before and after them.  The agenda is one number for each place, the rank of its pair
        and then the place, so that the least of a column is the pair to merge next.
        """
        n, width = len(segments), max(map(len, segments))
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=n)
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        end, before_all = width, width + 1  # rows of no symbol
        sym = np.full((width + 2, n), -1, dtype=np.int32)
        sym[place, np.repeat(np.arange(n), sizes)] = self.of_char[codes]
        agenda = np.full((width + 2, n), _NONE, dtype=np.uint32)
        to = np.zeros((width + 2, n), dtype=np.int32)
        for i in range(width - 1):
            rank, to[i] = self._ranks(sym[i], sym[i + 1])
            agenda[i] = np.where(rank == _NONE, _NONE, (rank << _BITS) | np.uint32(i))
        rows = np.arange(width + 2, dtype=np.int64)[:, None]
        after = np.repeat(rows + 1, n, axis=1)
        before = np.repeat(np.where(rows == 0, before_all, rows - 1), n, axis=1)
        out = np.empty((end, n), dtype=np.int32)
        column = np.arange(n)
        while True:
            best = agenda.min(axis=0)
            busy = np.flatnonzero(best != _NONE)
            if len(busy) < 0.6 * len(column):  # what is done goes
                out[:, column] = sym[:end]
                column, best = column[busy], best[busy]
                sym, agenda, to, after, before = (np.ascontiguousarray(x[:, busy]) for x in (sym, agenda, to, after, before))
                busy = np.arange(len(busy))
            if not len(busy):
                break
            width = len(column)
            flat_sym, flat_agenda, flat_to, flat_after, flat_before = (x.reshape(-1) for x in (sym, agenda, to, after, before))
            i = (best[busy] & np.uint32((1 << _BITS) - 1)).astype(np.int64)
            at = i * width + busy
            gone = flat_after[at] * width + busy
            k, h = flat_after[gone], flat_before[at]
            right, left = k * width + busy, h * width + busy
            piece = flat_to[at]
            flat_sym[at], flat_sym[gone], flat_agenda[gone] = piece, -1, _NONE
            flat_after[at], flat_before[right] = k, i
            rank, made = self._ranks(np.concatenate([piece, flat_sym[left]]), np.concatenate([flat_sym[right], piece]))
            spot = np.concatenate([at, left])
            flat_agenda[spot] = np.where(rank == _NONE, _NONE, (rank << _BITS) | np.concatenate([i, h]).astype(np.uint32))
            flat_to[spot] = made
        by_segment = out.T
        kept = by_segment != -1
        symbols, bounds = by_segment[kept].tolist(), [0, *np.cumsum(kept.sum(axis=1)).tolist()]
        return [symbols[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _heap(self, segment: str) -> list[int]:
        sym = [self.symbol.get(c, -2 - ord(c)) for c in segment]
        n = len(sym)
        before, after, agenda = list(range(-1, n - 1)), list(range(1, n + 1)), []

        def push(i: int) -> None:
            j = after[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (found := self.pair.get(sym[i] << 32 | sym[j])):
                heapq.heappush(agenda, (found[0], i, sym[i], j, sym[j], found[1]))

        for i in range(n - 1):
            push(i)
        while agenda:
            _, i, a, j, b, to = heapq.heappop(agenda)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j] = to, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [x for x in sym if x is not None]

    def _ids(self, symbols: list[int]) -> list[int]:
        if all(0 <= x < self.pieces for x in symbols):
            return symbols
        out: list[int] = []
        for x in symbols:
            if 0 <= x < self.pieces:
                out.append(x)
            elif self.byte:
                out += [self.byte[b] for b in (self.extra[x] if x >= 0 else chr(-2 - x)).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def _decoded(self, ids: list[int]) -> str:
        if not any(i in self.byte_of for i in ids):
            return "".join([self.text[i] for i in ids]).replace(MARK, " ")
        return b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].replace(MARK, " ").encode() for i in ids).decode("utf-8", "replace")

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment; symbols that are no pieces as bytes."""
        by = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        out: list[list[int]] = [[]] * len(segments)
        short = bisect.bisect_right(by, LOCKSTEP, key=lambda i: len(segments[i]))
        for at in range(0, short, 8192):
            group = by[at : min(at + 8192, short)]
            for i, found in zip(group, self._lockstep([segments[i] for i in group]), strict=True):
                out[i] = found
        for i in by[short:]:
            out[i] = self._heap(segments[i])
        return [x if min(x) >= 0 and max(x) < self.pieces else self._ids(x) for x in out]

    def learn(self, segments: list[str]) -> None:
        """Encodes and decodes new segments, and holds both against the library."""
        ids = self.encode_segments(segments)
        plain = [s.replace(MARK, " ") for s in segments]
        # Merges don't change the text, so ids without bytes decode to the segment itself.
        texts = [p if self.bytes.isdisjoint(x) and self.unknown not in x else self._decoded(x) for p, x in zip(plain, ids, strict=True)]
        alone = [i for i, p in enumerate(plain) if len(p) > 1]  # the library gives an empty text no ids
        checked = self.library.encode([plain[i][1:] for i in alone], num_threads=1)
        for i, c in zip(alone, checked, strict=True):
            if c != ids[i]:
                raise ValueError(f"the library encodes {segments[i][:80]!r} otherwise: {c[:20]} instead of {ids[i][:20]}")
        if self.library.decode([i for x in ids for i in x]) != "".join(texts)[1:]:
            raise ValueError("the library decodes these segments otherwise")
        name = self.name
        for s, x, p, t in zip(segments, ids, plain, texts, strict=True):
            self.new[s] = ",".join([name[i] for i in x])
            if t != p:
                self.odd[s] = t

    def forget(self) -> None:
        """Lets go of the older memory."""
        self.old, self.old_odd = {}, {}

    def _know(self, segments: set[str]) -> None:
        """Sees to it that the newer memory has all ``segments``."""
        if len(self.new) > MEMORY:
            self.old, self.new, self.old_odd, self.odd = self.new, {}, self.odd, {}
        missing = segments.difference(self.new)
        for s in self.old.keys() & missing:
            self.new[s] = self.old[s]
            if s in self.old_odd:
                self.odd[s] = self.old_odd[s]
        missing.difference_update(self.old)
        if missing:
            self.learn(list(missing))

    def encode_batch(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """(ids joined by commas, decoded text) of every text."""
        split = [_SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        out, at = [], 0
        while at < len(split):
            upto, size = at, 0
            while upto < len(split) and (upto == at or size + len(split[upto]) <= MEMORY):
                size += len(split[upto])
                upto += 1
            self._know(set().union(*split[at:upto]))
            known, odd = self.new, self.odd
            for text, segments in zip(texts[at:upto], split[at:upto], strict=True):
                if odd.keys().isdisjoint(segments):
                    decoded = (text or "").replace(MARK, " ")
                else:
                    decoded = "".join([odd[s] if s in odd else s.replace(MARK, " ") for s in segments])[1:]
                out.append((",".join([known[s] for s in segments]), decoded))
            at = upto
        return out


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encode_decode(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row of ``docs``.

    ``model`` names a file of the public tokenizers; each executor finds it by its own path.
    """
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def rows(texts: list[str | None]) -> list[list]:
        done = codec(tokenizer_path(model)).encode_batch(texts)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        out = [[x.count(",") + 1 if x else 0 for x, _ in done], [sha(x) for x, _ in done], [sha(t) for _, t in done]]
        if with_ids:
            out += [[[int(i) for i in x.split(",")] if x else [] for x, _ in done], [t for _, t in done]]
        return out

    return added(docs, [F.col(id_col).alias("id")], text_col, made, rows, end=lambda: codec(tokenizer_path(model)).forget())
