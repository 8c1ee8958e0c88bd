"""SentencePiece encoding and decoding with seeded merge-dropout.

A text becomes one blank more in front, blanks become the vocabulary's space mark, and it is cut where
a mark follows another character; the vocabulary is checked to have no piece across such a cut, so
segments merge on their own. In each segment an agenda of adjacent pairs is worked off by piece score,
leftmost first; each candidate merge, as it arises, is skipped where a keyed hash of (seed, key, its
place and both its symbols) is below the dropout rate. With rate 0 ids equal the library's. The key is
a hash of the seed, the row's id and the segment's number: each occurrence has draws of its own. Of each
segment the candidates that arise without skips are remembered; where an occurrence's draws skip none
of them, its ids are the remembered ones, and all others are cut on their own. Runs are reproducible.

What has no piece is spelled in byte pieces, also a literal space mark of the text, so any ids decode
to exactly the text. Null and empty texts have no ids and decode to an empty text. Segments of many
characters go through a heap, so very long texts without blanks take n log n steps. Only the id and
the text are read; repeated ids with equal texts have equal ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbgrid.llm.common import only, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20
#: Segments of more characters go through a heap; segments that a task remembers; segments cut at once.
LONG, REMEMBERED, SEGMENTS_AT_ONCE = 64, 100_000, 32_768
MARK = "▁"
_SEGMENTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: No text has this segment: a mark after another character starts a new one.
_LITERAL = f"literal{MARK}"
_NONE = np.int64(1) << 40
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x):
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Vocabulary:
    """Pieces with scores, byte pieces, and the pairs of symbols that merge. Symbols from len(pieces)
    on are characters that occur in pieces only."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]
    byte_ids: list[int]
    symbols: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        own = {p: i for i, p in enumerate(self.pieces) if self.plain[i]}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in own):
            raise ValueError("a piece runs across a blank")
        self.symbols = dict(own)
        for c in sorted({c for p in own for c in p} - own.keys()):
            self.symbols[c] = len(self.pieces) + len(self.symbols) - len(own)
        rank = np.unique(-np.array(self.scores), return_inverse=True)[1]
        pairs = {}
        for p, i in own.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (int(rank[i]), i)
        self.bits = 64 - max(16, (4 * len(pairs)).bit_length())
        size = 1 << (64 - self.bits)
        self.keys, self.rank, self.merged = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64), np.zeros(size, np.int64)
        for key, (r, i) in pairs.items():
            at = (key * int(_A) & 0xFFFFFFFFFFFFFFFF) >> self.bits
            while self.keys[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.rank[at], self.merged[at] = key, r, i
        self.characters = {c: i for c, i in self.symbols.items() if len(c) == 1}
        self.written = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.written[i] = bytes([b])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE: no merge) and merged piece of each pair."""
        key = left << 32 | right
        key[(left < 0) | (right < 0)] = -2
        at = (key.astype(np.uint64) * _A >> np.uint64(self.bits)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            open_ = open_[(self.keys[at[open_]] != key[open_]) & (self.keys[at[open_]] >= 0)]
        return np.where(self.keys[at] == key, self.rank[at], _NONE), self.merged[at]


def vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    pieces = [m.id_to_piece(i) for i in ids]
    byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(m.is_byte(i) for i in byte_ids):
        raise ValueError("the vocabulary has no byte pieces: it cannot spell every text")
    return Vocabulary(pieces, [m.get_score(i) for i in ids], [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in ids], byte_ids)


@dataclass
class Encoder:
    words: Vocabulary
    dropout: float = DROPOUT
    seed: int = SEED

    def __post_init__(self) -> None:
        self.keys = mixed(np.arange(1, 5, dtype=np.uint64) * _B + np.uint64(self.seed))
        self.literal = np.array([self.words.byte_ids[b] for b in MARK.encode()], np.int32).tobytes()
        self.arisen: list[tuple[np.ndarray, np.ndarray]] | None = None
        self.forget()

    def forget(self) -> None:
        """Remembered segments: their number, ids, and where their candidates start in one array."""
        self.number, self.ids, self.starts, self.drawn = {_LITERAL: 0}, [self.literal], np.zeros(2, np.int64), np.zeros(0, np.uint64)

    def skipped(self, key, drawn):
        """Whether candidate merges are skipped: keys and what is drawn for, in arrays."""
        return (mixed(key ^ drawn) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < self.dropout

    def candidates(self, key, left, right, at):
        rank, to = self.words.look_up(left, right)
        if self.dropout or self.arisen is not None:
            some = np.flatnonzero(rank < _NONE)
            drawn = left[some].astype(np.uint64) * _A + right[some].astype(np.uint64) * _B + at[some].astype(np.uint64) * _C
            if self.arisen is not None:
                self.arisen.append((key[some], drawn))
            else:
                rank[some[self.skipped(key[some], drawn)]] = _NONE
        return rank, to

    def remember(self, new: list[str]) -> None:
        """Cuts segments without skips, and keeps their ids and all candidates that arose."""
        self.arisen = []
        ids = self.cut_many(new, np.arange(len(new), dtype=np.uint64))
        owner, drawn = (np.concatenate(x) for x in zip(*self.arisen))
        self.arisen = None
        owner = owner.astype(np.int64)
        self.drawn = np.concatenate([self.drawn, drawn[np.argsort(owner, kind="stable")]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(owner, minlength=len(new)))])
        self.number.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
        self.ids += ids

    def cut(self, segments: list[str], keys: np.ndarray) -> list[bytes]:
        """The ids of each occurrence of a segment. Segments that are new and stand here once are not
        remembered, but cut with their draws at once."""
        number = np.array(list(map(self.number.get, segments, repeat(-1))), np.int64)
        open_ = np.flatnonzero(number < 0).tolist()
        new = [s for s, n in Counter([segments[i] for i in open_]).items() if n > 1 and len(s) <= LONG]
        if len(self.number) + len(new) > REMEMBERED and len(self.number) > 1:
            self.forget()
            return self.cut(segments, keys)
        for k in range(0, len(new), SEGMENTS_AT_ONCE):
            self.remember(new[k : k + SEGMENTS_AT_ONCE])
        number[open_] = [self.number.get(segments[i], -1) for i in open_]
        short = np.flatnonzero(number >= 0)
        parts = [short[k : k + SEGMENTS_AT_ONCE] for k in range(0, len(short), SEGMENTS_AT_ONCE)] if self.dropout else []
        apart = np.concatenate([short[:0], *[self.hit(x, number[x], keys) for x in parts]])
        ids = self.ids
        out = [ids[n] if n >= 0 else b"" for n in number.tolist()]
        alone = np.flatnonzero(number < 0)
        long = np.array([len(segments[i]) > LONG for i in alone.tolist()], bool)
        apart = np.concatenate([apart, alone[~long]])
        for k in range(0, len(apart), SEGMENTS_AT_ONCE):
            some = apart[k : k + SEGMENTS_AT_ONCE]
            for i, x in zip(some.tolist(), self.cut_many([segments[i] for i in some.tolist()], keys[some])):
                out[i] = x
        for i in alone[long].tolist():
            out[i] = self.cut_long(segments[i], keys[i])
        return out

    def hit(self, some: np.ndarray, number: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Those of some occurrences, of remembered segments, whose draws skip a candidate."""
        size = self.starts[number + 1] - self.starts[number]
        owner = np.repeat(some, size)
        place = np.arange(len(owner)) + np.repeat(self.starts[number] - (np.cumsum(size) - size), size)
        return np.unique(owner[self.skipped(keys[owner], self.drawn[place])])

    def cut_many(self, segments: list[str], keys: np.ndarray) -> list[bytes]:
        """The ids of each segment, as bytes of 32-bit numbers (which the garbage collector needn't visit); each round takes the best candidate of every segment."""
        look = self.words.characters.get
        flat = "".join(segments)
        unique = sorted(set(flat))
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.array([look(c, -1) for c in unique], np.int64)
        # characters without a symbol are kept apart as -2 - place, and spelled in the end
        sym = table[np.searchsorted(np.array([ord(c) for c in unique], np.uint32), codes)]
        sym = np.where(sym < 0, -2 - np.arange(len(sym)), sym)
        lengths = np.array([len(s) for s in segments])
        seg = np.repeat(np.arange(len(segments)), lengths)
        at = np.arange(len(sym)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rank, to = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inner], to[inner] = self.candidates(keys[seg[inner]], sym[inner], sym[inner + 1], at[inner])
        done_sym, done_seg = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            # places fit 22 bits: at most SEGMENTS_AT_ONCE segments of LONG characters
            best = np.minimum.reduceat(rank << 22 | np.arange(len(sym)), starts)
            live = best < _NONE << 22
            over = np.repeat(~live, np.diff(np.append(starts, len(sym))))
            done_sym.append(sym[over])
            done_seg.append(seg[over])
            i = best[live] & ((1 << 22) - 1)
            sym[i] = to[i]
            keep = ~over
            keep[i + 1] = False
            place = np.cumsum(keep) - 1
            sym, seg, at, rank, to, i = sym[keep], seg[keep], at[keep], rank[keep], to[keep], place[i]
            rank[i] = _NONE
            for j in (i[(i + 1 < len(sym))], i[i > 0] - 1):
                j = j[seg[j] == seg[j + 1]] if len(j) else j
                rank[j], to[j] = self.candidates(keys[seg[j]], sym[j], sym[j + 1], at[j])
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        sym = sym[np.argsort(seg, kind="stable")]
        ends = np.cumsum(np.bincount(seg, minlength=len(segments)))
        odd = set(np.searchsorted(ends, np.flatnonzero((sym < 0) | (sym >= len(self.words.pieces))), "right").tolist())
        raw, cuts = sym.astype(np.int32).tobytes(), [0, *(4 * ends).tolist()]
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in odd:
            out[k] = self.spelled(sym[cuts[k] // 4 : cuts[k + 1] // 4].tolist(), flat)
        return out

    def cut_long(self, segment: str, key: np.uint64) -> bytes:
        """As cut_many for one segment, by a heap."""
        sym = [self.words.characters.get(c, -2 - k) for k, c in enumerate(segment)]
        before, after = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(some: list[int]) -> None:
            a = np.array(some, np.int64)
            left, right = np.array([sym[k] for k in some], np.int64), np.array([sym[after[k]] for k in some], np.int64)
            rank, to = self.candidates(np.full(len(a), key), left, right, a)
            for k, r, t in zip(some, rank.tolist(), to.tolist()):
                if r < _NONE:
                    heapq.heappush(heap, (r, k, sym[k], sym[after[k]], t))

        offer([k for k in range(len(sym)) if after[k] >= 0])
        while heap:
            _, k, left, right, t = heapq.heappop(heap)
            n = after[k]
            if n < 0 or sym[k] != left or sym[n] != right:
                continue
            sym[k], sym[n], after[k] = t, -1, after[n]
            if after[k] >= 0:
                before[after[k]] = k
            new = [x for x in (k, before[k]) if x >= 0 and after[x] >= 0]
            if new:
                offer(new)
        return self.spelled([s for s in sym if s != -1], segment)

    def spelled(self, symbols: list[int], flat: str) -> bytes:
        """Symbols as ids; characters without a piece as byte pieces."""
        n = len(self.words.pieces)
        own = {i: c for c, i in self.words.characters.items() if i >= n} if max(symbols) >= n else {}
        out: list[int] = []
        for s in symbols:
            if 0 <= s < n:
                out.append(s)
            else:
                c = flat[-2 - s] if s < 0 else own[s]
                out += [self.words.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32).tobytes()

    def segments(self, text: str) -> list[str]:
        """A text's segments; a literal space mark, which is spelled in bytes, is the segment _LITERAL."""
        if MARK not in text:
            return _SEGMENTS.findall(MARK + text.replace(" ", MARK))
        out: list[str] = []
        for k, part in enumerate(text.split(MARK)):
            out += [_LITERAL] * (k > 0) + _SEGMENTS.findall((MARK if k == 0 else "") + part.replace(" ", MARK))
        return out

    def encode(self, rows: list[tuple[int | None, str | None]]) -> list[np.ndarray]:
        """The ids of each (id, text)."""
        parts = [self.segments(text) if text else [] for _, text in rows]
        salts = mixed(np.array([(doc or 0) & 0xFFFFFFFFFFFFFFFF for doc, _ in rows], np.uint64) * _C + np.uint64(self.seed))
        keys = [mixed(np.arange(len(p), dtype=np.uint64) * _A + salt) for p, salt in zip(parts, salts)]
        cut = self.cut([s for p in parts for s in p], np.concatenate(keys)) if rows else []
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        return [np.frombuffer(b"".join(cut[a:b]), np.int32) for a, b in zip(ends, ends[1:])]


def decode(ids: list[int], words: Vocabulary) -> str:
    data = b"".join(map(words.written.__getitem__, ids))
    return (data[1:] if ids and words.pieces[ids[0]].startswith(MARK) else data).decode("utf-8", "surrogatepass")


def _shared(spark: SparkSession, words: Vocabulary | str):
    return spark.sparkContext.broadcast(vocabulary(words) if isinstance(words, str) else words)


def encoded(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, text_sha256 (of the text) and ids."""
    words = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(words.value, dropout, seed)
        for whole in batches:
            for part in slices(whole):
                texts = part.column(1).to_pylist()
                ids = encoder.encode(list(zip(part.column(0).to_pylist(), texts)))
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "n_bytes", "text_sha256", "ids"]
                )

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_bytes long, text_sha256 string, ids array<int>")


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded() rows with the text that their ids spell."""
    words = _shared(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                texts = [decode(x.values.to_numpy().tolist(), words.value) for x in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_bytes", "text_sha256", "ids", "text"])

    return rows.select("doc_id", "n_bytes", "text_sha256", "ids").mapInArrow(run, "doc_id long, n_bytes long, text_sha256 string, ids array<int>, text string")


def round_trips(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, ids and decoded_sha256 of the text that the ids spell, and whether it is the
    text itself: encoded() and decoded() in one pass, so a task has one Python worker, not two."""
    words = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(words.value, dropout, seed)
        for whole in batches:
            for part in slices(whole):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = encoder.encode(list(zip(part.column(0).to_pylist(), texts)))
                again = [decode(x.tolist(), words.value) for x in ids]
                ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                columns = [
                    part.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in again]), pa.array([x == y for x, y in zip(texts, again)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "ids", "decoded_sha256", "lossless"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_bytes long, ids array<int>, decoded_sha256 string, lossless boolean")


def piece_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_hash, decoded_sha256, lossless."""
    return round_trips(docs).select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_tokens"), F.lower(F.hex(F.xxhash64("ids"))).alias("ids_hash"), "decoded_sha256", "lossless")
