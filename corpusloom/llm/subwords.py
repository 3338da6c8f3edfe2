"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Merging works on an agenda: of all neighbouring symbols whose union is a piece, the best-scored (then the
leftmost) is merged next. With dropout, each candidate is skipped when the keyed hash of (seed, document, copy of it,
place of the word, place in the word, both symbols) falls below the rate. A skipped candidate comes back only as part of
another one, so every seed gives segmentations of the same text that all decode to it. Rate 0 gives the library's own
result.

No piece has a space mark after another character, so merges stay within a run of marks and the characters
after it. Of each word the result without dropout and its candidates are remembered. A use of the word that skips none
of them has this result; every other use runs the agenda with its own key. Short words advance together as arrays, one
merge each per round; long ones get a heap of their own.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import documents_of, mix64, slices_of

MARK = "▁"
MODEL = "piece_bpe_32k.model"
LONG = 48
BLOCK = 1 << 16
WORDS = 120_000
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NONE = np.int32(1 << 22)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOADED: dict[str, Pieces] = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A model's pieces and, for every pair of symbols, the piece they merge to and its rank."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        self.ids = {t: i for i, t in enumerate(self.text) if plain[i]}
        self.byte = {i: bytes([int(self.text[i][3:5], 16)]) for i in range(n) if model.is_byte(i)}
        self.of_byte = {b[0]: i for i, b in self.byte.items()}
        self.raw = [self.byte.get(i, t.replace(MARK, " ").encode() if plain[i] else b"") for i, t in enumerate(self.text)]
        scores = sorted({model.get_score(i) for i in self.ids.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = (rank[model.get_score(i)], i)
        self.pairs = pairs
        self.of_char = np.arange(0x110000, dtype=np.int64) + n
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self._table()

    def _table(self) -> None:
        """The pairs in a table with open addresses: a look-up costs one or two reads instead of a binary search."""
        self.shift = np.uint64(64 - (4 * len(self.pairs)).bit_length())
        size = 1 << (64 - int(self.shift))
        self.keys, self.ranks, self.joined = np.full(size, -1), np.full(size, _NONE), np.zeros(size, np.int32)
        for key, place in zip(self.pairs, self._places(np.array(list(self.pairs), np.int64)).tolist(), strict=True):
            while self.keys[place] >= 0:
                place = (place + 1) % size
            self.keys[place] = key
            self.ranks[place], self.joined[place] = self.pairs[key]

    def _places(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * _GOLD) >> self.shift).astype(np.int64)

    def found(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``pair`` are known, their places in ``ranks`` and ``joined``)."""
        place = self._places(pair)
        held = self.keys[place]
        open_ = np.flatnonzero((held != pair) & (held >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) % len(self.keys)
            held[open_] = self.keys[place[open_]]
            open_ = open_[(held[open_] != pair[open_]) & (held[open_] >= 0)]
        known = np.flatnonzero(held == pair)
        return known, place[known]

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def symbols(self, text: str) -> np.ndarray:
        """A number per character: its piece, or past the pieces for a character without one."""
        return self.of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def written(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final ids of words of symbols: a character without a piece becomes its bytes."""
        strange = np.flatnonzero(symbols >= self.size)
        if not len(strange):
            return symbols, sizes
        long = np.ones(len(symbols), np.int64)
        spelled = [[self.of_byte[b] for b in chr(c).encode("utf-8", "replace")] for c in (symbols[strange] - self.size).tolist()]
        long[strange] = [len(x) for x in spelled]
        out = np.repeat(symbols, long)
        starts = np.cumsum(long) - long
        for at, ids in zip(starts[strange].tolist(), spelled, strict=True):
            out[at : at + len(ids)] = ids
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return out, np.bincount(owner, long, len(sizes)).astype(np.int64)


def _chance(key: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keyed hash of a candidate."""
    return mix64(mix64(key + place.astype(np.uint64) * _GOLD) ^ _pair(left, right))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(((left.astype(np.uint64) << np.uint64(22)) ^ right.astype(np.uint64)) + _GOLD)


def _limit(rate: float) -> np.uint64:
    return np.uint64(min(int(rate * 2.0**64), (1 << 64) - 1))


def agenda(pieces: Pieces, symbols: list[int], key: int, rate: float) -> list[int]:
    """Segment one use of a word with a heap; ``key`` is the unsigned hash of the use."""
    n, limit = len(symbols), _limit(rate)
    ids, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    size = [1] * n
    heap: list[tuple[int, int, int, int, int]] = []
    base = np.array([key], np.uint64)

    def offer(a: int) -> None:
        b = after[a]
        if b < 0 or ids[a] >= pieces.size or ids[b] >= pieces.size:
            return
        found = pieces.pairs.get(ids[a] * pieces.size + ids[b])
        if found is None:
            return
        if rate and _chance(base, np.array([a]), np.array([ids[a]]), np.array([ids[b]]))[0] < limit:
            return
        heapq.heappush(heap, (found[0], a, found[1], size[a], size[b]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, a, whole, na, nb = heapq.heappop(heap)
        b = after[a] if size[a] == na else -1
        if b < 0 or size[b] != nb:
            continue
        ids[a], size[a], size[b] = whole, na + nb, 0
        after[a] = after[b]
        if after[a] >= 0:
            before[after[a]] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    out, i = [], 0
    while 0 <= i < n:
        out.append(ids[i])
        i = after[i]
    return out


def segment(
    pieces: Pieces, flat: np.ndarray, sizes: np.ndarray, keys: np.ndarray, rate: float, seen: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Segment many uses of words, given as symbols in a row; ``keys`` are the hashes of the uses.

    Returns the symbols of all words in a row, and how many each word has. ``seen`` collects the candidates of words up
    to ``LONG`` symbols: word, place, left and right symbol.
    """
    words = len(sizes)
    # Short rows of numbers: ranks and places fit, and the cores share the memory's bandwidth.
    flat, owner = flat.astype(np.int32), np.repeat(np.arange(words, dtype=np.int32), sizes)
    place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    big = np.flatnonzero(sizes > LONG)
    if len(big):
        starts = np.cumsum(sizes) - sizes
        for i in big.tolist():
            found = agenda(pieces, flat[starts[i] : starts[i] + sizes[i]].tolist(), int(keys[i]), rate)
            done.append((np.full(len(found), i), np.arange(len(found)), np.array(found, np.int64)))
        small = (sizes <= LONG)[owner]
        flat, owner, place = flat[small], owner[small], place[small]
    n, limit = pieces.size, _limit(rate)

    def ranked(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and union of the candidates that start at the positions ``a`` (the right one is next)."""
        rank, whole = np.full(len(a), _NONE), np.zeros(len(a), np.int32)
        right = np.minimum(a + 1, len(flat) - 1)
        u = np.flatnonzero((right > a) & (owner[right] == owner[a]) & (flat[a] < n) & (flat[right] < n))
        at, right = a[u], right[u]
        known, spot = pieces.found(flat[at].astype(np.int64) * n + flat[right])
        if seen is not None:
            seen.append((owner[at[known]], place[at[known]], flat[at[known]], flat[right[known]]))
        if rate:
            at, right = at[known], right[known]
            stays = _chance(keys[owner[at]], place[at], flat[at], flat[right]) >= limit
            known, spot = known[stays], spot[stays]
        u = u[known]
        rank[u], whole[u] = pieces.ranks[spot], pieces.joined[spot]
        return rank, whole

    rank, whole = ranked(np.arange(len(flat)))
    while len(flat):
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        cost = (rank << np.int32(8)) + place
        best = np.minimum.reduceat(cost, starts)
        best = np.repeat(best, np.diff(np.append(starts, len(flat))))
        busy = best < (_NONE << np.int32(8))
        if not busy.all():
            rest = ~busy
            done.append((owner[rest], place[rest], flat[rest]))
        chosen = (cost == best) & busy
        at = np.flatnonzero(chosen)
        flat[at] = whole[at]
        busy[at + 1] = False
        redo = chosen
        redo[np.maximum(at - 1, 0)] = True
        flat, owner, place, rank, whole, redo = (x[busy] for x in (flat, owner, place, rank, whole, redo))
        new = np.flatnonzero(redo)
        if len(new):
            rank[new], whole[new] = ranked(new)
    if not done:
        return flat, np.zeros(words, np.int64)
    owner, place, flat = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.lexsort((place, owner))
    return flat[order], np.bincount(owner, minlength=words)


def _words(text: str) -> list[str]:
    marked = MARK + text.replace(" ", MARK)
    if text.startswith((" ", MARK)) or text.endswith((" ", MARK)) or f"{MARK}{MARK}" in marked:
        return _RUN.findall(marked)
    return [MARK + w for w in marked.split(MARK)[1:]]


class Encoder:
    """Encodes texts slice by slice and remembers the words of the slices before, up to ``WORDS``."""

    def __init__(self, pieces: Pieces, rate: float) -> None:
        self.pieces, self.rate = pieces, rate
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict = defaultdict(count().__next__)
        self.names: list[str] = []
        self.ids, self.filled = np.zeros(1 << 16, np.int32), 0
        # By word: where its undropped ids start and how many there are; the same for its candidates (place, pair).
        self.start, self.long = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.places, self.pairs = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _keep(self, flat: np.ndarray) -> int:
        """Add ids behind the others; the place where they start."""
        start, end = self.filled, self.filled + len(flat)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(flat), np.int32)])
        self.ids[start:end] = flat
        self.filled = end
        return start

    def _segments(self, words: list[str], keys: np.ndarray, rate: float, seen: list | None = None):
        """Blocks of uses: (from, ids in a row, how many each use has)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends, at = np.cumsum(sizes), 0
        while at < len(words):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
            symbols, found = self.pieces.symbols("".join(words[at:stop])), None if seen is None else []
            flat, long = self.pieces.written(*segment(self.pieces, symbols, sizes[at:stop], keys[at:stop], rate, found))
            if seen is not None:
                seen += [(owner + at, *rest) for owner, *rest in found]
            yield at, flat, long
            at = stop

    def _learn(self) -> None:
        new = list(islice(self.number, len(self.names), None))
        if not new:
            return
        seen = [] if self.rate else None
        starts, longs = [self.start], [self.long]
        for _, flat, long in self._segments(new, np.zeros(len(new), np.uint64), 0.0, seen):
            starts.append(self._keep(flat) + np.cumsum(long) - long)
            longs.append(long)
        self.start, self.long = np.concatenate(starts), np.concatenate(longs)
        self.names += new
        if self.rate:
            owner, place, left, right = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.argsort(owner, kind="stable")
            many = np.bincount(owner, minlength=len(new))
            self.first = np.concatenate([self.first, len(self.places) + np.cumsum(many) - many])
            # Long words have no list of candidates: every use of them runs.
            self.many = np.concatenate([self.many, np.where([len(w) > LONG for w in new], -1, many)])
            self.places = np.concatenate([self.places, place[order].astype(np.uint64) * _GOLD])
            self.pairs = np.concatenate([self.pairs, _pair(left[order], right[order])])

    def _dropping(self, unit: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The uses (of words ``unit``) that skip a candidate of the result without dropout."""
        many = self.many[unit]
        drops = many < 0
        many = np.maximum(many, 0)
        ends = np.cumsum(many)
        for a in range(0, len(unit), BLOCK):
            part = slice(a, a + BLOCK)
            owner = np.repeat(np.arange(a, min(a + BLOCK, len(unit))), many[part])
            base = ends[a] - many[a]
            at = np.repeat(self.first[unit[part]] - (ends[part] - many[part] - base), many[part]) + np.arange(len(owner))
            chance = mix64(mix64(keys[owner] + self.places[at]) ^ self.pairs[at])
            drops[owner[chance < _limit(self.rate)]] = True
        return np.flatnonzero(drops)

    def encode(self, texts: list[str], uses: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; ``uses`` is an unsigned hash per document that keys the uses of its words."""
        if len(self.number) > WORDS:
            self._forget()
        number = self.number
        lists = [np.array([number[w] for w in _words(t)] if t else [], np.int32) for t in texts]
        self._learn()
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        unit = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        start, long, filled = self.start[unit], self.long[unit], self.filled
        if self.rate:
            nth = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys = mix64(np.repeat(uses, sizes) + nth.astype(np.uint64) * _GOLD)
            drops = self._dropping(unit, keys)
            for at, flat, many in self._segments([self.names[u] for u in unit[drops].tolist()], keys[drops], self.rate):
                mine = drops[at : at + len(many)]
                start[mine], long[mine] = self._keep(flat) + np.cumsum(many) - many, many
        ends = np.cumsum(long)
        ids = self.ids[np.repeat(start - (ends - long), long) + np.arange(int(long.sum()))]
        self.filled = filled
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _turns(ids: list, marks: list, last: list) -> np.ndarray:
    """For each row how many rows just before it have its id and mark; ``last`` carries the state between batches."""
    out = np.zeros(len(ids), np.uint64)
    for i, row in enumerate(zip(ids, marks, strict=True)):
        last[:] = [row, last[1] + 1 if row == last[0] else 0]
        out[i] = last[1]
    return out


def encoded(
    docs: DataFrame, rate: float = 0.1, seed: int = 1, path: str | None = None, copies: bool = False, verify: bool = False
) -> DataFrame:
    """(doc_id, mark, ids array<int>): the pieces of every whole text; mark is the hash of what they decode to.

    With ``verify`` each text is decoded again where it was encoded, and ``lossless`` tells whether that gives it back.

    A null or empty text has no ids. A null doc_id is a key like any other; repeated rows get equal results. With
    ``copies``, rows that lie next to each other and repeat id and text (as ``mixing.repeated`` writes them) are
    numbered, and each is encoded in its own way. An empty table gives no row.
    """
    path = path or public_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        encoder, last = Encoder(pieces, rate), [None, 0]
        for batch in slices_of(batches, chars=1_000_000):
            uses = batch.column("use").to_numpy(False).view(np.uint64)
            if copies:
                uses = mix64(uses ^ _turns(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), last))
            texts = batch.column("text").to_pylist()
            found = encoder.encode(texts, uses)
            ends = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32))
            ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), pa.int32()))
            columns = [batch.column("doc_id"), batch.column("mark"), ids]
            if verify:
                same = [decoded(pieces.raw, x) == t.replace(MARK, " ") for x, t in zip(found, texts, strict=True)]
                columns.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "ids", "lossless"][: len(columns)])

    rows = documents_of(docs).withColumns(
        {"use": F.xxhash64(F.lit(seed), "doc_id"), "mark": F.xxhash64(read_back(F.col("text")))}
    )
    return rows.mapInArrow(run, "doc_id long, mark long, ids array<int>" + ", lossless boolean" * verify)


def decoder(path: str | None = None):
    """A column function: ids -> text. Bytes are put together; the mark added in front is taken off.

    Ids outside the model are left out; a null list gives a null text."""
    path = path or public_path(MODEL)

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        raw = Pieces.of(path).raw
        for lists in parts:
            yield lists.map(lambda x: None if x is None else decoded(raw, x))

    return decode


def decoded(raw: list[bytes], ids) -> str:
    joined = b"".join(map(raw.__getitem__, ids[(ids >= 0) & (ids < len(raw))].tolist()))
    return joined[1:].decode("utf-8", "replace") if joined.startswith(b" ") else joined.decode("utf-8", "replace")


def read_back(text: Column) -> Column:
    """What a text decodes to: the model writes its space mark for a space, so both read as a space."""
    return F.translate(text, MARK, " ")


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_pieces, ids_hash, lossless (the ids decode to the text) for every row."""
    ids = [F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash")]
    return encoded(docs, verify=True, **options).select("doc_id", *ids, "lossless")
