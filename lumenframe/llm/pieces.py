"""Encoding to pieces and decoding, by vectorised merge rounds over flat arrays.

A model of the byte-pair kind merges, over and over, the neighbouring symbols whose union has the best score, the leftmost first.
Here the words of many texts are merged at once:

1. A text is normalised (a space in front, spaces to U+2581) and cut into words where no piece of the vocabulary can reach across.
2. The characters of all new words lie in one flat array of symbols. A round looks up the rank of every neighbouring pair, takes the
   minimum per word (``reduceat``), merges all its places at once, the leftmost where places overlap, and compacts the array. Words
   without any pair leave it; rounds go on until none is left.
3. Ids of a word are remembered by the worker, within a bound.

Merging all places of a rank at once equals merging them one by one, unless a union of this rank may be part of a pair that ranks no
later. The vocabulary tells which ranks those are; a word with several places of such a rank merges the first of them in a round, and a
long one is finished one merge at a time with a heap, so that a long run of spaces doesn't need as many rounds as it has spaces.
"""

from __future__ import annotations

import heapq
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import worker_cache

SPACE = "▁"
#: Words that a worker remembers with their ids, and characters from which on a word is not remembered.
REMEMBERED, LONG_WORD = 400_000, 40
#: Characters of text handled at once; a longer text is handled alone.
GROUP_CHARS = 1 << 21
#: Symbols from which on a part of a word that needs single merges is finished with a heap.
LONG_PART = 64
#: Rank of a pair that is no piece.
NONE = np.iinfo(np.int32).max
# Kinds of pieces, fixed values of the model file's format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message: integers, or bytes for all other kinds."""
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
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
        yield tag >> 3, data[at : at + size]
        at += size


class Vocabulary(NamedTuple):
    """What a model file says. Symbols are numbered: pieces by id, then single characters that only occur inside pieces."""

    pieces: list[str]
    kinds: list[int]
    scores: np.ndarray
    unknown: int
    byte_fallback: bool
    dummy_prefix: bool


def read_model(path: str) -> Vocabulary:
    """Pieces and settings of a model file. A model of another kind, or with a table of normalisation rules, is an error."""
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    pieces, kinds, scores = [], [], []
    for number, value in parts:
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(np.frombuffer(own.get(2, b"\0\0\0\0"), dtype="<f4")[0])
            kinds.append(own.get(3, NORMAL))
    trainer = dict(f for n, v in parts if n == 2 for f in _fields(v))
    rules = dict(f for n, v in parts if n == 3 for f in _fields(v))
    if trainer.get(3, 1) != 2:
        raise ValueError("not a byte-pair model")
    if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model rewrites texts beyond spaces, which is not supported")
    if UNUSED in kinds or USER_DEFINED in kinds:
        raise ValueError("unused or user-defined pieces are not supported")
    return Vocabulary(pieces, kinds, np.array(scores, dtype=np.float32), kinds.index(UNKNOWN), bool(trainer.get(35, 0)), bool(rules.get(3, 1)))


class Merger:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        mergeable = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == NORMAL}
        symbols = dict(mergeable)
        for p in mergeable:
            for c in p:
                symbols.setdefault(c, len(v.pieces) + len(symbols) - len(mergeable))
        self.symbols = symbols
        self.size = len(v.pieces) + len(symbols) - len(mergeable)
        # Rank of a piece: pieces of equal score share one, the best score has 0.
        _, rank = np.unique(-v.scores.astype(np.float64), return_inverse=True)
        pairs = {}
        for p, i in mergeable.items():
            for cut in range(1, len(p)):
                left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_merged = np.array([pairs[k] for k in keys.tolist()] + [0], dtype=np.int32)
        self.pair_rank = np.append(rank[self.pair_merged[:-1]], NONE).astype(np.int32)
        # The same pairs by a hash of their key, the next free slot where two share one; NONE's place is an empty slot's pair.
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.slots = np.full((1 << int(64 - int(self.shift))) + len(keys) + 1, -1, dtype=np.int64)
        slot, pending = self._slot(keys), np.arange(len(keys))
        while len(pending):
            own = pending[self.slots[slot[pending]] < 0]
            self.slots[slot[own]] = own
            pending = pending[self.slots[slot[pending]] != pending]
            slot[pending] += 1
        self.slots = np.where(self.slots < 0, len(keys), self.slots).astype(np.int32)
        self.slot_keys = self.pair_keys[self.slots]
        # Ranks whose unions can be part of a pair that ranks no later.
        careful = np.zeros(int(rank.max(initial=0)) + 2, dtype=bool)
        made = np.zeros(self.size, dtype=bool)
        made[self.pair_merged[:-1]] = True
        for part in (keys // self.size, keys % self.size):
            union = made[part]
            part_rank = np.where(union, rank[np.minimum(part, len(rank) - 1)], -1)
            careful[part_rank[union & (self.pair_rank[:-1] <= part_rank)]] = True
        self.careful = careful
        # Pairs of characters inside pieces: words can be cut between any others.
        inside = {a + b for p in mergeable for a, b in zip(p, p[1:])}
        self.inside = np.array(sorted((ord(x[0]) << 21) | ord(x[1]) for x in inside), dtype=np.int64)
        self.cut_at_space = not any(x[1] == SPACE and x[0] != SPACE for x in inside)
        # A line end belongs to no piece, so that what follows it is a word of its own.
        self.cut_at_line = v.byte_fallback and not any("\n" in x for x in inside)
        points = sorted((ord(c), i) for c, i in symbols.items() if len(c) == 1)
        self.points = np.array([p for p, _ in points] or [-1], dtype=np.int64)
        self.point_symbol = np.array([i for _, i in points] or [0], dtype=np.int64)
        # What a symbol becomes in the end: its id, the ids of its bytes, or the unknown id.
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == BYTE}
        self.extra = {i: c for c, i in symbols.items() if i >= len(v.pieces)}
        self.surface = [self._surface(i) for i in range(len(v.pieces))]
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else s for p, k, s in zip(v.pieces, v.kinds, self.surface)]
        self.raw, self.kinds = pa.array(raw, pa.binary()), np.array(v.kinds)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _surface(self, i: int) -> bytes | None:
        """Bytes of a piece when decoded; None for a byte piece."""
        kind = self.vocabulary.kinds[i]
        if kind == BYTE:
            return None
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else self.vocabulary.pieces[i].replace(SPACE, " ").encode()

    # --- encoding ---

    def words(self, text: str) -> list[str]:
        """The normalised text in parts that no merge crosses."""
        if not text:
            return []
        text = (SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE)
        if not self.cut_at_space:
            return [text]
        parts = text.split(SPACE)
        if "" not in parts[1:]:
            return [*([parts[0]] if parts[0] else []), *[SPACE + p for p in parts[1:]]]
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; none for null."""
        split = [self.words(t or "") for t in texts]
        distinct = list(dict.fromkeys(w for words in split for w in words))
        now = dict(zip(distinct, self._look_up(distinct)))
        return [b"".join(map(now.__getitem__, words)) for words in split]

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Ids of different words, remembered or merged now."""
        out = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i in missing:
            out[i] = self.older.get(words[i])
        fresh = [i for i in missing if out[i] is None]
        for i, ids in zip(fresh, self.merge([words[i] for i in fresh])):
            out[i] = ids
        # Two generations: words in use stay when the older one goes.
        self.known.update((words[i], out[i]) for i in missing if len(words[i]) < LONG_WORD)
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        return out

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """As ``encode``; texts without runs of spaces are cut, and their different words found, by Arrow."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")))
        odd = odd.to_numpy(zero_copy_only=False) | (not (self.cut_at_space and self.vocabulary.dummy_prefix))
        out: list[bytes] = [b""] * len(texts)
        apart = np.flatnonzero(odd)
        for i, ids in zip(apart.tolist(), self.encode(texts.take(pa.array(apart)).to_pylist())):
            out[i] = ids
        whole = np.flatnonzero(~odd)
        if len(whole):
            own = texts.take(pa.array(whole))
            # What begins with a line end has no space in front, all other words have one.
            parts = pc.split_pattern(pc.replace_substring(own, "\n", " \n") if self.cut_at_line else own, " ")
            coded = parts.flatten().dictionary_encode()
            words = [w if self.cut_at_line and w[:1] == "\n" else SPACE + w for w in coded.dictionary.to_pylist()]
            data, limits = _joined(pa.array(self._look_up(words), pa.binary()), coded.indices, parts.offsets.to_numpy())
            for i, a, b in zip(whole.tolist(), limits, limits[1:]):
                out[i] = data[a:b]
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks(self, symbols: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and union of each symbol with its right neighbour; ``inner`` is False at the end of a word."""
        left, right = symbols[:-1], symbols[1:]
        usable = np.flatnonzero(inner[:-1] & (left < self.size) & (right < self.size))
        keys = left[usable] * self.size + right[usable]
        slot = self._slot(keys)
        there = self.slot_keys[slot]
        todo = np.flatnonzero((there != keys) & (there != self.pair_keys[-1]))
        while len(todo):
            slot[todo] += 1
            there = self.slot_keys[slot[todo]]
            todo = todo[(there != keys[todo]) & (there != self.pair_keys[-1])]
        hit, at = self.slot_keys[slot] == keys, self.slots[slot]
        rank, merged = np.full(len(symbols), NONE, dtype=np.int32), np.zeros(len(symbols), dtype=np.int32)
        rank[usable[hit]], merged[usable[hit]] = self.pair_rank[at[hit]], self.pair_merged[at[hit]]
        return rank, merged

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word, merged in rounds side by side."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        if not len(points):
            return [b""] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = np.searchsorted(self.points, points).clip(max=len(self.points) - 1)
        symbols = np.where(self.points[at] == points, self.point_symbol[at], self.size + points)
        # Parts of words that no piece connects are merged apart.
        first = np.zeros(len(points), dtype=bool)
        first[np.cumsum(lengths)[:-1][lengths[1:] > 0]] = True
        pairs = (points[:-1] << 21) | points[1:]
        spot = np.searchsorted(self.inside, pairs).clip(max=max(0, len(self.inside) - 1))
        first[1:] |= (self.inside[spot] != pairs) if len(self.inside) else True
        first[0] = True
        place = np.arange(len(points))  # where in the flat text a symbol starts
        done_place, done_symbol = [], []
        while len(symbols):
            starts = np.flatnonzero(first)
            inner = np.append(~first[1:], False)
            rank, merged = self._ranks(symbols, inner)
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            # Leftmost of overlapping places: every other one of a run of neighbouring places.
            chosen = (rank == np.repeat(least, sizes)) & (rank < NONE)
            index = np.arange(len(symbols))
            run = np.where(chosen & ~np.append(False, chosen[:-1]), index, 0)
            chosen &= (index - np.maximum.accumulate(run)) % 2 == 0
            # Where a union may bring up an earlier pair, a word merges only its first place, or goes its own way if it is long.
            upto = np.cumsum(chosen)
            nth = upto - np.repeat(upto[starts] - chosen[starts], sizes)
            odd = self.careful[np.minimum(least, len(self.careful) - 1)] & (least < NONE) & (nth[starts + sizes - 1] > 1)
            long = odd & (sizes > LONG_PART)
            for i in np.flatnonzero(long).tolist():
                own = slice(int(starts[i]), int(starts[i] + sizes[i]))
                kept, ids = self._one_by_one(symbols[own])
                done_place.append(place[own][kept])
                done_symbol.append(ids)
            chosen &= (nth == 1) | ~np.repeat(odd, sizes)
            finished = least == NONE
            leaving = np.repeat(finished | long, sizes)
            ended = np.repeat(finished, sizes)
            done_place.append(place[ended])
            done_symbol.append(symbols[ended])
            chosen &= ~leaving
            symbols = np.where(chosen, merged, symbols)
            stay = ~leaving & ~np.append(False, chosen[:-1])
            symbols, place, first = symbols[stay], place[stay], first[stay]
        places, found = np.concatenate(done_place), np.concatenate(done_symbol)
        order = np.argsort(places, kind="stable")
        return self._ids(found[order], places[order], np.cumsum(lengths))

    def _one_by_one(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges of one word in order of rank, then from the left: places that stay, and their symbols."""
        n, own = len(symbols), symbols.tolist()
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if i < 0 or j < 0 or own[i] >= self.size or own[j] >= self.size:
                return
            key = own[i] * self.size + own[j]
            at = int(np.searchsorted(self.pair_keys, key))
            if self.pair_keys[at] == key:
                heapq.heappush(heap, (int(self.pair_rank[at]), i, j, key, int(self.pair_merged[at])))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, j, key, union = heapq.heappop(heap)
            if not (alive[i] and alive[j] and after[i] == j and own[i] * self.size + own[j] == key):
                continue
            own[i], alive[j], after[i] = union, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        kept = np.flatnonzero(alive)
        return kept, np.array(own, dtype=np.int64)[kept]

    def _ids(self, symbols: np.ndarray, places: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids word by word. Symbols that are no piece become the ids of their bytes, or the unknown id once for each run."""
        v = self.vocabulary
        limits = np.searchsorted(places, ends)
        odd = symbols >= len(v.pieces)
        if odd.any():
            chars, which = np.unique(symbols[odd], return_inverse=True)
            texts = [self.extra[c] if c < self.size else chr(c - self.size) for c in chars.tolist()]
            ids = [[self.byte_ids[b] for b in t.encode("utf-8", "surrogatepass")] if v.byte_fallback else [v.unknown] for t in texts]
            sizes = np.ones(len(symbols), dtype=np.int64)
            sizes[odd] = np.array([len(x) for x in ids])[which]
            if not v.byte_fallback:
                word = np.searchsorted(ends, places, side="right")
                sizes[1:][odd[1:] & odd[:-1] & (word[1:] == word[:-1])] = 0
            begin = np.cumsum(sizes) - sizes
            table = np.array([x + [0] * (4 - len(x)) for x in ids])
            symbols = np.repeat(symbols, sizes)
            for k in range(4):
                there = sizes[odd] > k
                symbols[begin[odd][there] + k] = table[which[there], k]
            limits = np.append(begin, len(symbols))[limits]
        data, limits = symbols.astype("<i4").tobytes(), (4 * limits).tolist()
        return [data[a:b] for a, b in zip([0, *limits[:-1]], limits)]

    # --- decoding ---

    def decode_column(self, ids: pa.ListArray) -> list[str]:
        """As ``decode``, for all rows; null has no ids. The bytes of all pieces are laid out by Arrow.

        Bytes that make up a valid text are valid run by run, as all other pieces are whole characters; other rows, and those with control
        pieces, which may stand between bytes, are decoded one by one.
        """
        flat = ids.flatten()
        limits = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()])
        numbers = flat.to_numpy()
        data, ends = _joined(self.raw, flat, limits)
        kinds = self.kinds[numbers]
        control = np.append(0, np.cumsum(kinds == CONTROL))[limits]
        out = []
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            try:
                text = None if control[i] < control[i + 1] else data[a:b].decode()
            except UnicodeDecodeError:
                text = None
            if text is None:
                text = self.decode(numbers[limits[i] : limits[i + 1]].tolist())
            elif text.startswith(" ") and self.vocabulary.dummy_prefix and kinds[limits[i]] == NORMAL:
                text = text[1:]
            out.append(text)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces for U+2581, without the space in front; bytes that are no character become U+FFFD, each by itself."""
        surface, strip = self.surface, self.vocabulary.dummy_prefix
        if ids and self.vocabulary.kinds[ids[0]] == NORMAL:
            parts = [surface[i] for i in ids]
            if None not in parts:
                text = b"".join(parts).decode()
                return text[1:] if strip and text.startswith(" ") else text
        out: list[bytes] = []
        begun = False  # something was decoded, or the space in front taken off
        held = bytearray()
        for i in ids:
            own = surface[i]
            if own is None:
                held.append(int(self.vocabulary.pieces[i][3:5], 16))
                continue
            if held:
                out.append(_characters(bytes(held)))
                held.clear()
                begun = True
            if not begun and own:
                if strip and own.startswith(b" ") and self.vocabulary.kinds[i] == NORMAL:
                    own = own[1:]
                begun = True
            out.append(own)
        if held:
            out.append(_characters(bytes(held)))
        return b"".join(out).decode()


def _characters(data: bytes) -> bytes:
    """UTF-8 with every byte that belongs to no character replaced."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        try:
            out.append(data[at : at + size].decode().encode())
            at += size
        except UnicodeDecodeError:
            out.append("�".encode())
            at += 1
    return b"".join(out)


def _joined(values: pa.Array, numbers: pa.Array, limits: np.ndarray) -> tuple[bytes, list[int]]:
    """The numbered binary values one after another, and the bytes that lie before each of ``limits`` numbers."""
    taken = values.take(numbers)
    offsets, data = taken.buffers()[1:]
    ends = np.frombuffer(offsets, dtype="<i4", count=len(taken) + 1) if len(taken) else np.zeros(1, dtype="<i4")
    return (data.to_pybytes() if data else b""), ends[limits].tolist()


def _merger(path: str) -> Merger:
    """The worker's own, made once."""
    cache = worker_cache()
    if ("merger", path) not in cache:
        cache["merger", path] = Merger(read_model(path))
    return cache["merger", path]


def _groups(sizes: list[int], limit: int):
    """(first, end) of consecutive rows of about ``limit`` together."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > limit:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def encode(docs: DataFrame, model: str, text: str = "text", to: str = "ids") -> DataFrame:
    """The other columns of ``docs``, and the piece ids of the whole ``text`` as an array ``to``, without begin or end ids.

    A null or empty text has no ids. A column named ``to`` is replaced; repeated rows are handled alike; an empty table gives an empty result. ``model`` is the path of the model file on the workers.
    """
    kept = [c for c in docs.columns if c not in (text, to, "__text")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema], f"`{to}` array<int>"])

    def run(batches):
        merger = _merger(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__text"))
            sizes = [s or 0 for s in pc.binary_length(column).to_pylist()]
            for a, b in _groups(sizes, GROUP_CHARS):
                ids = merger.encode_column(column.slice(a, b - a))
                limits = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
                rows = batch.slice(a, b - a).select(kept)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(limits), values)], names=[*kept, to])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(docs: DataFrame, model: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text ``to`` that the array of piece ids stands for; null ids give an empty text.

    Other columns pass through, the ids too; one named ``to`` is replaced; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in (to, "__ids")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema], f"`{to}` string"])

    def run(batches):
        merger = _merger(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__ids"))
            sizes = [s or 0 for s in pc.list_value_length(column).to_pylist()]
            for a, b in _groups(sizes, GROUP_CHARS // 4):
                texts = merger.decode_column(column.slice(a, b - a))
                rows = batch.slice(a, b - a).select(kept)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*kept, to])

    return docs.select(*kept, F.col(ids).alias("__ids")).mapInArrow(run, schema)
