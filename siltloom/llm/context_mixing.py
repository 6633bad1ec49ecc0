"""Language-model scores by logistic mixing of hashed-context bit predictors: counted contexts, gated weights learned online, an adaptive probability map."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltloom.llm.common import _bounded_batches, map_rows, saved, slices

#: Slots of a predictor's table that travel together.
BLOCK = 1 << 13
#: Short words without a code whose scores a task keeps.
MOST_KEPT = 600_000
#: Words that a task counts before it sends them on.
MOST_COUNTED = 400_000
#: Tokens, or spelled bytes, whose bits are handled at once.
TOGETHER = 12_000
CLIP = 12.0
#: Texts, and words, from which one task learns weights.
TEXTS, WORDS = 2_000, 80_000
#: Bits after which weights move.
STEP = 2048
BUCKETS = 33


@dataclass(frozen=True)
class Mixing:
    """``words``: the most frequent training words that get a code of their own, of ``word_bytes`` at most; ``word_slots`` and ``char_slots``: logarithms of the
    number of slots of a predictor's table; one in ``share`` training documents (and of rare words) teaches weights and map: all of them, unless told otherwise; ``rate``: step of the weights."""

    words: int = 65_534
    word_bytes: int = 64
    word_slots: int = 22
    char_slots: int = 20
    share: int = 1
    rate: float = 0.03


# A slot's state: how often 0 and 1 were seen, each in one of 16 levels, exact up to 4.

_BOUNDS = np.array([0, 1, 2, 3, 4, *(int(5 * 1.75**i) for i in range(11))])
_MEAN = np.r_[_BOUNDS[:5], np.sqrt(_BOUNDS[5:] * np.r_[_BOUNDS[6:], _BOUNDS[-1] * 2])]


#: A count is held within 16 bits.
MOST_COUNT = (1 << 16) - 1
_LEVEL = (np.searchsorted(_BOUNDS, np.arange(MOST_COUNT + 1), "right") - 1).astype(np.uint8)


def states_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _LEVEL[n0] * np.uint8(16) + _LEVEL[n1]


def states_apart(n: np.ndarray) -> np.ndarray:
    """States of slots [slot, bit] as each event sees them that is itself taken out, at 2 * slot + bit."""
    out = np.empty(n.size, np.uint8)
    out[0::2] = states_of(np.maximum(n[:, 0], 1) - 1, n[:, 1])
    out[1::2] = states_of(n[:, 0], np.maximum(n[:, 1], 1) - 1)
    return out


def worth_of(total: np.ndarray) -> np.ndarray:
    """How often each state, at 2 * state + bit, was met by events that are taken out: the whole corpus's sums of slots by their counts."""
    at = states_apart(np.minimum(total, MOST_COUNT).astype(np.uint16).reshape(-1, 2)).astype(np.intp) * 2
    at[1::2] += 1
    return np.bincount(at, total, 512)


_N0, _N1 = _MEAN[np.arange(256) // 16], _MEAN[np.arange(256) % 16]
#: 0 for an unseen context, 1 for one event, 2 for up to four, 3 for more.
CONFIDENCE = np.searchsorted([0.5, 1.5, 4.5], _N0 + _N1).astype(np.uint8)
_GATE16, _GATE4 = CONFIDENCE.astype(np.intp) * 16, CONFIDENCE.astype(np.intp) * 4
PRIOR = (_N1 + 0.4) / (_N0 + _N1 + 0.8)


@dataclass
class Bits:
    """Binary decisions: slots [predictor, decision], the bit, a first guess (stretched), what chooses weights besides confidence (0-3), what chooses the map's row, and each decision's item."""

    slots: np.ndarray
    bit: np.ndarray
    guess: np.ndarray
    place: np.ndarray
    row: np.ndarray
    starts: np.ndarray


@dataclass
class Mixer:
    """Counts of all slots, and what turns them into one probability: a learned stretch for each predictor and state, weights for each gate, the adaptive map."""

    counts: np.ndarray | None  # predictor x slot x bit
    rows: int
    tables: np.ndarray | None = field(init=False)  # states, predictor x slot
    apart: np.ndarray | None = field(init=False)  # states without the own event, predictor x (slot, bit), for learning
    stretch: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    map: np.ndarray = field(init=False)

    def __post_init__(self):
        k = len(self.counts)
        self.tables = np.stack([states_of(n[:, 0], n[:, 1]) for n in self.counts])
        self.apart = np.stack([states_apart(n) for n in self.counts])
        self.counts = None
        self.stretch = np.tile(np.log(PRIOR / (1 - PRIOR)).astype(np.float32), (k, 1))
        self.weights = np.full((64, k + 1), 0.3, np.float32)
        self.map = np.tile(np.linspace(-8, 8, BUCKETS).astype(np.float32), (self.rows, 1))

    def __getstate__(self):
        """Travels compressed: for learning the states without the own event, else those with all."""
        press = zstandard.ZstdCompressor(level=1)
        name = "tables" if self.apart is None else "apart"
        return self.__dict__ | {"tables": None, "apart": None, "sent": (name, len(getattr(self, name)), press.compress(getattr(self, name).tobytes()))}

    def __setstate__(self, state):
        name, k, packed = state.pop("sent")
        self.__dict__ |= state | {name: np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(k, -1)}

    def inputs(self, b: Bits, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States, inputs of the mix [predictor + 1, decision] and gates; ``apart``: without the decision's own event."""
        if apart:
            states = np.stack([t.take(s * np.uint32(2) + b.bit, mode="clip") for t, s in zip(self.apart, b.slots)])
        else:
            states = np.stack([t.take(s, mode="clip") for t, s in zip(self.tables, b.slots)])
        states = states.astype(np.intp)  # gathers by other integers are slower
        x = np.empty((len(states) + 1, len(b.bit)), np.float32)
        for k, s in enumerate(states):
            x[k] = self.stretch[k].take(s)
        x[-1] = b.guess
        gate = _GATE16.take(states[-1])
        gate += _GATE4.take(states[-2])
        gate += b.place
        return states, x, gate

    def scored(self, b: Bits) -> np.ndarray:
        """The weighted sum of ``inputs``: a predictor's weight times its stretch is one entry of a table by gate and state, so that each decision gathers once a predictor."""
        states = [t.take(s, mode="clip").astype(np.intp) for t, s in zip(self.tables, b.slots)]
        gate = _GATE16.take(states[-1])
        gate += _GATE4.take(states[-2])
        gate += b.place
        y = np.zeros(len(gate), np.float32)
        high = gate * 256
        for w, v, s in zip(self.weights.T, self.stretch, states):
            s += high
            y += (w[:, None] * v).ravel().take(s)
        y += self.weights[:, -1].take(gate) * b.guess
        return np.clip(y, -CLIP, CLIP, out=y)

    def refined(self, y: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The mean of the mixed stretch and its entry in the map, between two neighbouring buckets."""
        at = np.clip((y + np.float32(8)) * np.float32(2), np.float32(0), np.float32(BUCKETS - 1.001))
        low = at.astype(np.int32)
        at -= low
        where = (row * np.int32(BUCKETS) + low).astype(np.intp, copy=False)
        flat = self.map.ravel()
        out = flat.take(where)
        out += y
        at *= np.diff(flat, append=np.float32(0)).take(where)
        out += at
        out *= np.float32(0.5)
        return out

    def log2(self, b: Bits) -> np.ndarray:
        """Minus the bits of each item."""
        y = self.refined(self.scored(b), b.row)
        y *= np.float32(1) - np.float32(2) * b.bit
        cost = np.log(np.float32(1) + np.exp(y))
        return -np.add.reduceat(cost, b.starts, dtype=np.float64) / math.log(2)


# Words with a code: the path in a Huffman tree; contexts are the words before.


class Paths:
    """Huffman paths of items 0, 1, ... by weight. Three levels of the tree share eight neighbouring slots, so that a path meets few places of memory: ``groups`` has
    the node that leads the three levels, ``local`` the place (1 to 7) below it."""

    def __init__(self, weight: list[int]):
        n = len(weight)
        heap = [(max(1, c), i) for i, c in enumerate(weight)]
        heapq.heapify(heap)
        parent, side, total = {}, {}, {}
        for node in range(n - 1):  # inner nodes are made in order, the root last
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y], side[x], side[y] = node, node, 0, 1
            total[node] = (a, b)
            heapq.heappush(heap, (a + b, -1 - node))
        nodes, bits, groups, local, self.length = [], [], [], [], np.zeros(n, np.int64)
        for i in range(n):
            path, at = [], i
            while at in parent:
                path.append((parent[at], side[at]))
                at = -1 - parent[at]
            path.reverse()
            self.length[i] = len(path)
            for depth, (node, bit) in enumerate(path):
                if depth % 3 == 0:
                    lead, place = node, 1
                nodes.append(node)
                bits.append(bit)
                groups.append(lead)
                local.append(place)
                place = 2 * place + bit
        self.start = np.cumsum(self.length) - self.length
        self.bits = np.array(bits, np.uint8)
        self.groups, self.local = np.array(groups, np.uint32) * np.uint32(0xC2B2AE35), np.array(local, np.uint32)
        self.guess = np.array([math.log(total[i][1] / total[i][0]) for i in range(n - 1)], np.float32)[nodes] if n > 1 else np.zeros(0, np.float32)

    def bits_of(self, items: np.ndarray, contexts: list[np.ndarray], slot_bits: int) -> tuple[Bits, np.ndarray]:
        """The decisions of items, each with its own hash for each predictor, and their depths; ``starts`` are those of items."""
        length = self.length.take(items)
        starts = np.cumsum(length) - length
        place = np.arange(int(length.sum()))
        depth = place - np.repeat(starts, length)
        at = place + np.repeat(self.start.take(items) - starts, length)
        groups, local, shift = self.groups.take(at), self.local.take(at), np.uint32(35 - slot_bits)
        slots = np.empty((len(contexts), len(at)), np.uint32)
        for k, c in enumerate(contexts):
            h = np.repeat(c, length)
            h ^= groups
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x297A2D39)
            h >>= shift
            h <<= np.uint32(3)
            h |= local
            slots[k] = h
        return Bits(slots, self.bits.take(at), self.guess.take(at), np.empty(0, np.uint8), np.empty(0, np.int32), starts), depth


class WordCode:
    """Words by number; the number after the last is the way out to spelling, then the end of a text. Bytes of spelled words have paths by the bytes of the words with a code."""

    def __init__(self, words: list[bytes], counts: list[int], rare: int, ends: int):
        self.words, n = words, len(words)
        self.out, self.end = n, n + 1
        self.paths = Paths([*counts, rare, ends])
        self.bytes = Paths((np.bincount(np.frombuffer(b" ".join(words), np.uint8), minlength=256) + 1).tolist())
        self.known = pa.array(words, pa.binary())

    def bits_of(self, ids: np.ndarray, before: np.ndarray, before2: np.ndarray, slot_bits: int) -> Bits:
        """Contexts are the word before the last, the last, and both."""
        one = (before.astype(np.uint32) + np.uint32(7)) * np.uint32(0x9E3779B1)
        two = before2.astype(np.uint32) * np.uint32(0x85EBCA6B) + np.uint32(0x165667B1)
        out, depth = self.paths.bits_of(ids, [two ^ (two >> np.uint32(13)), one ^ (one >> np.uint32(15)), (one * np.uint32(0x27D4EB2F)) ^ two ^ (two >> np.uint32(15))], slot_bits)
        out.place, out.row = np.minimum(depth >> 2, 3), np.minimum(depth, WORD_ROWS - 1)
        return out


WORD_PREDICTORS, WORD_ROWS = 3, 32
CHAR_PREDICTORS, CHAR_ROWS = 4, 32


def spelled_bits(words: list[bytes], paths: Paths, slot_bits: int) -> Bits:
    """The bits of words and of the blank that ends each; contexts are the one, two and three bytes before, and all bytes of the word so far."""
    own = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    b = own.astype(np.uint32)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(b)) - np.repeat(first, sizes)
    back = [np.where(place >= i, np.r_[np.zeros(i, np.uint32), b[:-i]][: len(b)] + np.uint32(1), np.uint32(0)) for i in (1, 2, 3)]
    run = np.cumsum((b + np.uint32(1)) * ((place.astype(np.uint32) * np.uint32(2) + np.uint32(3)) * np.uint32(0x9E3779B1)), dtype=np.uint32)
    whole = np.r_[np.uint32(0), run[:-1]] - np.repeat(np.r_[np.uint32(0), run[:-1]][first], sizes)
    one = back[0] * np.uint32(0x9E3779B1) + np.uint32(1)
    two = one ^ (back[1] * np.uint32(0x85EBCA6B) + np.uint32(0x68E31DA4))
    three = two * np.uint32(5) ^ (back[2] * np.uint32(0x27D4EB2F))
    whole = (whole + place.astype(np.uint32)) * np.uint32(0x27D4EB2F) + np.uint32(9)
    out, depth = paths.bits_of(own, [c ^ (c >> np.uint32(15)) for c in (one, two, three, whole)], slot_bits)
    out.starts = out.starts[first]
    out.guess[:] = 1
    out.place, out.row = np.minimum(depth >> 1, 3), np.minimum(depth, CHAR_ROWS - 1)
    return out


def spelled_parts(words: list[bytes], paths: Paths, slot_bits: int) -> Iterator[Bits]:
    held, size = [], 0
    for w in words:
        held.append(w)
        size += len(w) + 1
        if size >= TOGETHER:
            yield spelled_bits(held, paths, slot_bits)
            held, size = [], 0
    if held:
        yield spelled_bits(held, paths, slot_bits)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of binary texts, whatever bytes they hold, and which text each is from. Kernels for ASCII look at bytes, so that taking bytes for text is safe."""
    whole = texts if texts.null_count == 0 else pc.fill_null(texts, b"")
    kind = pa.large_string() if pa.types.is_large_binary(whole.type) else pa.string()
    low = pc.ascii_lower(pa.Array.from_buffers(kind, len(whole), [None, *whole.buffers()[1:]], 0, whole.offset))
    split = pc.ascii_split_whitespace(low)
    words = split.flatten()
    of = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some).cast(pa.binary()), of[some.to_numpy(zero_copy_only=False)]


def numbered(texts: pa.Array, code: WordCode) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Numbers of all tokens of binary texts, those of the two tokens before (0 at the start, else number + 1), each text's first token and number of tokens,
    and of the words without a code which text they are from and the words."""
    words, of = tokens_of(texts)
    own = pc.fill_null(pc.index_in(words, value_set=code.known), code.out).to_numpy()
    size = np.bincount(of, minlength=len(texts)) + 1
    first = np.cumsum(size) - size
    n = np.full(len(own) + len(texts), code.end, np.int64)
    n[np.arange(len(own)) + of] = own
    before = np.r_[0, n[:-1] + 1]
    before[first] = 0
    before2 = np.r_[0, before[:-1]]
    before2[first] = 0
    out = own == code.out
    return n, before, before2, first, size, of[out], words.filter(pa.array(out))


def word_parts(n: np.ndarray, before: np.ndarray, before2: np.ndarray, code: WordCode, slot_bits: int) -> Iterator[Bits]:
    for i in range(0, len(n), TOGETHER):
        yield code.bits_of(n[i : i + TOGETHER], before[i : i + TOGETHER], before2[i : i + TOGETHER], slot_bits)


# Learning: counts of contexts and what states are worth, then weights and the map, all over the whole corpus.

Parts = Callable[[pa.RecordBatch], Iterator[Bits]]


def count_contexts(df: DataFrame, column: str, parts: Parts, predictors: int, slot_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """[predictor, slot, bit]: how often each bit came at each slot, over the bits of all rows; [predictor, state, bit]: how often at each state, the own event taken out. A task counts in arrays of fixed size and sends blocks that hold anything, compressed;
    they are added up by block, one block in memory at a time. The driver gets four bytes a slot, a fixed size whatever the corpus."""
    slots = 1 << slot_bits
    _bounded_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((predictors, 2 * slots), np.int32)
        met = False
        for batch in batches:
            for part in slices([batch], column):
                for b in parts(part):
                    met = True
                    for own, at in zip(n, b.slots):
                        np.add.at(own, (at * np.uint32(2) + b.bit).astype(np.intp), np.int32(1))
        press = zstandard.ZstdCompressor(level=1)
        for k in range(predictors if met else 0):
            rows = n[k].reshape(-1, 2 * BLOCK)
            some = np.flatnonzero(rows.any(1))
            for i in range(0, len(some), 64):
                own = some[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int32()), pa.array(own, pa.int32()), pa.array([press.compress(rows[j].tobytes()) for j in own], pa.binary())], ["k", "block", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        at, total = None, None

        def told():
            sums = np.minimum(total, MOST_COUNT).astype(np.uint16)
            packed = [pa.array([press.compress(x.tobytes())], pa.binary()) for x in (sums, worth_of(total))]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), *packed], ["k", "block", "n", "worth"])

        for batch in batches:
            for k, block, n in zip(batch.column("k").to_pylist(), batch.column("block").to_pylist(), batch.column("n").to_pylist()):
                if (k, block) != at:
                    if at is not None:
                        yield told()
                    at, total = (k, block), np.zeros(2 * BLOCK, np.int64)
                total += np.frombuffer(expand.decompress(n), np.int32)
        if at is not None:
            yield told()

    schema = "k int, block int, n binary"
    counted = df.mapInArrow(count, schema).repartition("k", "block").sortWithinPartitions("k", "block").mapInArrow(added, f"{schema}, worth binary")
    out, worth = np.zeros((predictors, slots, 2), np.uint16), np.zeros((predictors, 512))
    expand = zstandard.ZstdDecompressor()
    for r in saved(counted).toLocalIterator():
        out[r["k"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(expand.decompress(r["n"]), np.uint16).reshape(-1, 2)
        worth[r["k"]] += np.frombuffer(expand.decompress(r["worth"]), np.float64)
    return out, worth.reshape(predictors, 256, 2)


def _gathered(df: DataFrame, column: str, fn: Callable[[Iterator[pa.RecordBatch]], dict[int, float]]) -> dict[int, float]:
    """Sums over tasks of what ``fn`` returns for each; keys are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = fn(part for batch in batches for part in slices([batch], column))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.float64())], ["i", "s"])

    return {r["i"]: r["s"] for r in df.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}


def _dense(found: dict[int, float], shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)))
    out[list(found)] = list(found.values())
    return out.reshape(shape)


def learn(mixer: Mixer, worth: np.ndarray, df: DataFrame, column: str, parts: Parts, rate: float, rows: int) -> Mixer:
    """What each state of each predictor is worth, from the sums over the whole corpus; weights and map from the bits of ``df``, each seen with its own event taken out of the counts.

    Rows are dealt by their hash (copies of a text with their ids, so that they part) to tasks of about ``rows`` rows and put in order, so that the result doesn't hang on how the table is stored. Each task learns weights
    online over its rows, from the same start; they are averaged by the number of bits that each task saw at a gate.
    """
    spark, k = df.sparkSession, len(worth)
    p = (worth[:, :, 1] + 2 * PRIOR) / (worth.sum(2) + 2)
    mixer.stretch = np.clip(np.log(p / (1 - p)), -CLIP, CLIP).astype(np.float32)
    held = spark.sparkContext.broadcast(mixer)
    shape = (64, k + 2)

    def weigh(batches: Iterator[pa.RecordBatch]) -> dict[int, float]:
        m = held.value
        w, seen, squares = m.weights.T.astype(np.float64), np.zeros(64), np.full((k + 1, 64), 1.0)
        hits = np.zeros((m.rows * BUCKETS, 2))
        for batch in batches:
            for b in parts(batch):
                _, x, gate = m.inputs(b, True)
                y = np.empty(len(gate))
                for i in range(0, len(gate), STEP):
                    g, own, at = gate[i : i + STEP], x[:, i : i + STEP], y[i : i + STEP]
                    np.clip(sum(v.take(g) * z for v, z in zip(w, own)), -CLIP, CLIP, out=at)
                    miss = b.bit[i : i + STEP] - 1 / (1 + np.exp(-at))
                    push = np.stack([np.bincount(g, miss * v, 64) for v in own])
                    squares += push * push
                    w += rate * push / np.sqrt(squares)
                seen += np.bincount(gate, minlength=64)
                near = np.rint(np.clip((y + 8) * 2, 0, BUCKETS - 1)).astype(np.intp) + b.row.astype(np.intp) * BUCKETS
                hits += np.bincount(near * 2 + b.bit, minlength=hits.size).reshape(-1, 2)
        out = np.concatenate([np.c_[w.T * seen[:, None], seen].ravel(), hits.ravel()])
        return {int(i): float(out[i]) for i in np.flatnonzero(out)}

    hashed = F.xxhash64(*df.columns)
    dealt = df.repartition(max(1, -(-df.count() // rows)), hashed).sortWithinPartitions(hashed, *df.columns)
    found = _dense(_gathered(dealt, column, weigh), (64 * (k + 2) + mixer.rows * BUCKETS * 2,))
    w = found[: 64 * (k + 2)].reshape(shape)
    some = w[:, -1] > 0
    mixer.weights[some] = (w[some, :-1] / w[some, -1:]).astype(np.float32)
    hits = found[64 * (k + 2) :].reshape(mixer.rows, BUCKETS, 2)
    start = 1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))
    p = (hits[:, :, 1] + 16 * start) / (hits.sum(2) + 16)
    mixer.map = np.log(p / (1 - p)).astype(np.float32)
    mixer.apart = None
    held.destroy()
    return mixer


@dataclass
class Model:
    how: Mixing
    code: WordCode
    words: Mixer
    chars: Mixer
    base: np.ndarray  # log10 of the base model for each number; 0 for the way out
    known: np.ndarray
    tokens: int
    kinds: int

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """Scores of words without a code; those of short words are kept for the next slice, until there are too many."""
        kept = self.__dict__.setdefault("_kept", {})
        if len(kept) > MOST_KEPT:
            kept.clear()
        new = sorted(w for w in words if w not in kept)
        scores = dict(zip(new, (x for b in spelled_parts(new, self.code.bytes, self.how.char_slots) for x in self.chars.log2(b).tolist())))
        kept.update((w, x) for w, x in scores.items() if len(w) <= 64)
        return np.array([kept[w] if w in kept else scores[w] for w in words], np.float64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of a table with binary ``text``: tasks count before the shuffle."""
    _bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for batch in batches:
            for part in slices([batch], "text"):
                found = pc.value_counts(tokens_of(part.column("text"))[0])
                held.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
                size += len(found)
                if size > 2 * MOST_COUNTED:
                    held[:] = [added()]
                    size = len(held[0])
                    if size > MOST_COUNTED:
                        yield from held.pop().combine_chunks().to_batches(max_chunksize=100_000)
                        size = 0
        if held:
            yield from added().combine_chunks().to_batches(max_chunksize=100_000)

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train(texts: DataFrame, vocabulary: DataFrame, how: Mixing) -> Model:
    """The model of a table with binary ``text`` and its saved word counts. What the driver holds is bounded by ``how``."""
    spark = texts.sparkSession
    n, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = texts.count()
    coded = vocabulary.where(F.octet_length("word") <= how.word_bytes)
    top = [(bytes(r["word"]), r["c"]) for r in coded.orderBy(F.desc("c"), "word").limit(how.words).collect()]
    inside = sum(c for _, c in top)
    code = WordCode([w for w, _ in top], [c for _, c in top], n - inside, ends)
    all_tokens, all_kinds = n + ends, kinds + (ends > 0)
    count = np.array([*(c for _, c in top), 0, ends], np.float64)
    base = np.log10((count + 1) / (all_tokens + all_kinds + 1))
    base[code.out] = 0
    sent = spark.sparkContext.broadcast(code)

    def of_texts(batch: pa.RecordBatch) -> Iterator[Bits]:
        return word_parts(*numbered(batch.column("text"), sent.value)[:3], sent.value, how.word_slots)

    def of_words(batch: pa.RecordBatch) -> Iterator[Bits]:
        return spelled_parts(batch.column("word").to_pylist(), sent.value.bytes, how.char_slots)

    taught = lambda df, column: df if how.share == 1 else df.where(F.pmod(F.xxhash64(F.lit("weights"), column), F.lit(how.share)) == 0)
    counts, worth = count_contexts(texts.select("text"), "text", of_texts, WORD_PREDICTORS, how.word_slots)
    words = learn(Mixer(counts, WORD_ROWS), worth, taught(texts.select("doc_id", "text"), "text"), "text", of_texts, how.rate, TEXTS)
    least, last = (top[-1][1], top[-1][0]) if len(top) == how.words else (0, b"")
    rare = vocabulary.where((F.octet_length("word") > how.word_bytes) | (F.col("c") < least) | ((F.col("c") == least) & (F.col("word") > F.lit(bytearray(last))))) if len(top) == how.words else vocabulary
    rare = rare.select("word")
    counts, worth = count_contexts(rare, "word", of_words, CHAR_PREDICTORS, how.char_slots)
    chars = learn(Mixer(counts, CHAR_ROWS), worth, taught(rare, "word"), "word", of_words, how.rate, WORDS)
    sent.destroy()
    return Model(how, code, words, chars, base, count > 0, all_tokens, all_kinds)


def score_texts(docs: DataFrame, how: Mixing = Mixing()) -> DataFrame:
    """(doc_id, text) to (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row a row.

    Training documents are those whose crc32 of the id as text isn't 2 modulo 7. The model codes a text as its lower-cased words and an end. A word among the
    ``how.words`` most frequent ones is a path in a Huffman tree, whose bits are predicted from the tree node with the word before, the word before that, and both;
    any other word is a way out and then its bytes, predicted from the one, two and three bytes before and the word so far. Contexts are hashed into tables of fixed size;
    counts come from all training documents. Stretched predictions are added by weights that the predictors' confidence and the depth choose, learned online; an adaptive map
    of what the mix has said and what came then refines it. The finished model is the same for all documents, so that a score depends on nothing but the text.

    The texts are read four times: where they lie, but for the training texts, which are dealt out once to learn weights. What is shuffled besides are word counts, blocks of counts, and the words without
    a code of each text, which meet their exact counts by a join. No training words leave out: base_score uses counts of all words.

    A null text is empty: one token, the end. A null doc_id counts as an empty text under crc32, which is training. Repeated rows each count and each get a row. Without training
    documents N and V are 0. Further columns are left out; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    rest = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    training = rows.where(rest != 2)
    vocabulary = saved(word_counts(training))
    model = train(training, vocabulary, how)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        m = held.value
        ids, before, before2, first, sizes, of, rare = numbered(batch.column("text"), m.code)
        own = np.concatenate([m.words.log2(b) for b in word_parts(ids, before, before2, m.code, m.how.word_slots)])
        # words without a code: each once a text, with how often it stands there
        kinds = rare.dictionary_encode()
        names = kinds.dictionary.to_pylist()
        pair, times = np.unique(of * len(names) + kinds.indices.to_numpy(), return_counts=True)
        text, word = np.divmod(pair, max(1, len(names)))
        spelled = np.bincount(text, m.spelled(names)[word] * times, len(sizes))
        lists = pa.ListArray.from_arrays(np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32), pa.StructArray.from_arrays([kinds.dictionary.take(pa.array(word)), pa.array(times.astype(np.int64))], ["word", "n"]))
        return {
            "doc_id": batch.column("doc_id"), "k1": batch.column("k1"), "k2": batch.column("k2"), "held_out": batch.column("held_out"), "size": batch.column("size"), "n_tokens": sizes,
            "known": np.add.reduceat(m.known[ids].astype(np.int64), first), "base": np.add.reduceat(m.base[ids], first), "score": (np.add.reduceat(own, first) + spelled) * math.log10(2), "rare": lists,
        }

    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType), *T.StructType.fromDDL("k1 long, k2 long, held_out boolean, size long, n_tokens long, known long, base double, score double, rare array<struct<word:binary,n:long>>")]
    keyed = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"), (rest == 2).alias("held_out"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    done = saved(map_rows(keyed, "text", T.StructType(fields), run))
    counts = vocabulary.select("word", "c")
    met = done.select("k1", "k2", F.posexplode("rare").alias("i", "w")).select("k1", "k2", (F.col("i") == 0).cast("long").alias("rows"), "w.word", "w.n")
    level = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(model.tokens + model.kinds + 1)))
    found = met.join(counts, "word", "left").groupBy("k1", "k2").agg(F.sum("rows").alias("m"), F.sum(F.col("n") * level).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    out = done.drop("rare").join(found, ["k1", "k2"], "left")  # of m rows alike each has the m-th part
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce((F.col("more_known") / F.col("m")).cast("long"), F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more") / F.col("m"), F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("size")).alias("bits_per_byte"),
    )


def op11_context_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the six sevenths that are training documents."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
