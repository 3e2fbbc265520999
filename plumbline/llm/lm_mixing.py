"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is lower-cased (A-Z) and read as its words, each followed by one blank, and an end symbol. Each symbol is a few
binary decisions along a Huffman code of the training symbols. Every decision is predicted from the counts of zeros and ones under
several contexts: the last 1, 2, 3 and 5 bytes and all that is seen of the word. The predictions
(log odds) are mixed by weights that a gate picks by how much the longer contexts have been seen; the mix is refined by an
adaptive probability map. The first two symbols of a word see up to four bytes of the words before; later ones see their word from its
blank on, so that each distinct beginning and each distinct word of the corpus is evaluated once, whatever the number of times.

The counts are kept for every context of the corpus, without a bound, and exactly. The distinct beginnings and words of each group of texts
meet in hashed buckets, which add up how often each occurs in training documents. A bucket's distinct pairs of context and symbol meet in
buckets by the 64-bit hash of the context, and all symbols of a context that several buckets have go back to them, with how often each follows it. In the
order of the symbols' codes the symbols below a node of the code are neighbours: the zeros and ones of every node are sums over neighbours. What is gathered at
the driver and broadcast are the weights and the map, whose size does not depend on the corpus.

Learning is online: a task reads its distinct beginnings and words block by block. Each decision is predicted by the counts of the
whole corpus without one occurrence of its own, before it is learned from; then the weights and the map take a step by the error, every
occurrence weighing alike. Tasks run side by side; their weights are averaged by what they have seen.

A further predictor looks further back: at anchors (about every eighth word, by the hash of three words) it predicts the whole
phrase up to the next anchor, as training texts went on most often. One decision, with the odds of the counts under that
context (a training document's own occurrence taken out), tells whether the phrase comes true; if not, its words are coded as above.
It makes copied passages cheap. These contexts meet in buckets, too, and return what changes for the documents that have them.

The unigram base counts every token of all training documents exactly, by 64-bit hashes: the words' buckets have their counts
already, and return them with the words' costs. Nothing is dealt by token to documents, so no frequent token makes a large task.

Ids are integers. Null texts count as empty: one end token. Rows with a null id are scored but never learned from. Rows with equal id and text get
equal results. Very long texts are read whole. An empty table gives an empty result; with no training tokens the base has N = V = 0.
Only the named columns are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import LOWER, SPACE, clean, discard, discard_part, expand, mix, powers, prefix_hash, slices, span_hash, spans, stored, tidy, training_row, utf8

MODULUS, HELD = 7, 2
#: Lengths of the contexts in bytes; the last one stands for the whole word.
ORDERS = (1, 2, 3, 5, 24)
#: Bytes of the words before that a word's first two symbols see.
TAIL = 4
#: Bytes of text whose distinct words are evaluated together, and symbols of a training block.
GROUP_BYTES, BLOCK = 6_000_000, 8_000
#: Pairs whose nodes are counted together.
STEP = 32_768
#: Buckets at most: a group of texts has some 150,000 distinct beginnings and words, and sends a row to each bucket.
BUCKETS = 4_096
#: Mean words between anchors of phrases.
APART = 8
#: Size of a weight's first step.
RATE = 0.02
END, BLANK = 256, 32
_LOG = np.log(np.arange(65_536) + 0.4).astype(np.float32)
_LEVEL = np.minimum(np.log2(np.arange(65_536) + 1).astype(np.int64), 6)
_CELLS = 25  # of the probability map, for each node
_GATES = 3 * 28
_K = len(ORDERS)


# --- words and symbols -----------------------------------------------------------------------------------------------


class Words:
    """The words of some texts: ``row``, ``token`` (hash), ``head`` (code of tail and first two symbols), and their bytes."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.flat = flat = LOWER[flat]
        self.starts, self.ends, self.first = spans(flat, offsets)
        n = len(offsets) - 1
        self.row = np.repeat(np.arange(n), np.diff(self.first))
        self.token = span_hash(prefix_hash(flat), self.starts, self.ends)
        sizes = self.ends - self.starts
        begin = np.cumsum(sizes + 1) - (sizes + 1)  # of each word, in the words with one blank behind each
        line = np.full(int((sizes + 1).sum()), BLANK, np.uint8)
        line[expand(begin, sizes)] = flat[expand(self.starts, sizes)]
        low = np.append(begin, len(line))[self.first[:-1]]  # where each row begins there
        s0, s1 = (line[begin + k].astype(np.int64) for k in (0, 1))
        self.head = (_tail(line, begin, low[self.row]) * 512 + s0) * 256 + s1
        self.end_head = (_tail(line, np.append(begin, len(line))[self.first[1:]], low) * 512 + END) * 256
        self._phrases(n)

    def _phrases(self, n: int) -> None:
        """Anchors are words whose hash with the two before is a multiple of ``APART``; the phrase runs on to the next anchor, or past the end."""
        t = self.token
        context = np.zeros(len(t), np.uint64)
        if len(t) > 2:
            context[2:] = mix(t[2:] ^ mix(t[1:-1] ^ mix(t[:-2])))
        inside = np.arange(len(t)) - self.first[self.row] >= 2
        self.anchor = np.flatnonzero(inside & (context % np.uint64(APART) == 0))
        self.context, row = context[self.anchor], self.row[self.anchor]
        following = np.append(self.anchor[1:], 0)
        same = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
        self.upto = np.where(same, following + 1, self.first[row + 1])  # one past the phrase's last word
        self.to_end = ~same
        hashes = np.zeros(len(t) + 1, np.uint64)
        np.cumsum(t * powers(len(t)), out=hashes[1:])
        self.phrase = mix(span_hash(hashes, self.anchor + 1, self.upto) + self.to_end.astype(np.uint64)) if len(row) else np.zeros(0, np.uint64)


def _tail(line: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The ``TAIL`` bytes before the blank before each place, as a number; 0 for bytes before the row's beginning."""
    out = np.zeros(len(at), np.int64)
    for j in range(TAIL + 1, 1, -1):
        out = out * 256 + (np.where(at - j >= low, line[np.maximum(at - j, 0)], 0) if len(line) else 0)
    return out


def symbol_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(257, np.int64)
    for batch in batches:
        for part, flat, offsets in slices(batch):
            counts = np.bincount(LOWER[flat], minlength=256)
            counts[SPACE] = 0  # no part of a word
            total[:256] += counts
            total[BLANK] += len(spans(flat, offsets)[0])
            total[END] += len(part)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(257)), pa.array(total)], ["symbol", "n"])


class Code:
    """A Huffman code of the 257 symbols, each counted once more than it occurs: per symbol its nodes and bits."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        children, made = {}, 257
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            children[made] = (x, y)
            heapq.heappush(heap, (a + b, made, made))
            made += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
        while todo:
            node, path = todo.pop()
            if node < 257:
                paths[node] = path
            else:
                for bit, child in enumerate(children[node]):
                    todo.append((child, [*path, (node - 257, bit)]))
        self.size = np.array([len(paths[s]) for s in range(257)])
        self.start = np.cumsum(self.size) - self.size
        self.node = np.array([x[0] for s in range(257) for x in paths[s]])
        self.bit = np.array([x[1] for s in range(257) for x in paths[s]], bool)
        spelled = ["".join(str(x[1]) for x in paths[s]) for s in range(257)]
        self.leaf = np.empty(257, np.int64)  # the place of each symbol among all, in the order of their codes
        self.leaf[sorted(range(257), key=spelled.__getitem__)] = np.arange(257)
        self.symbol_at = np.argsort(self.leaf)


class Units:
    """Symbols to be coded: heads (two symbols after the tail of the words before) and bodies (the rest of a word), each once."""

    def __init__(self, heads: np.ndarray, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n, wide = len(heads), TAIL + 3
        seq = np.empty((n, wide), np.uint8)
        tail, s0, s1 = heads >> 17, heads >> 8 & 511, heads & 255
        for j in range(TAIL):
            seq[:, j] = tail >> 8 * (TAIL - 1 - j) & 255
        seq[:, TAIL], seq[:, TAIL + 1], seq[:, TAIL + 2] = BLANK, s0 & 255, s1
        two = s0 != END
        sizes = ends - starts + 2
        begin = wide * n + np.cumsum(sizes) - sizes
        text = np.full(int(sizes.sum()), BLANK, np.uint8)
        text[expand(begin - wide * n + 1, ends - starts)] = flat[expand(starts, ends - starts)]
        self.flat = np.concatenate((seq.ravel(), text))
        counts = np.concatenate((1 + two, np.maximum(sizes - 3, 0)))
        self.begin = np.concatenate((np.arange(n) * wide, begin))
        self.unit = np.repeat(np.arange(n + len(starts)), counts)
        self.at = expand(self.begin + np.where(np.arange(len(self.begin)) < n, TAIL + 1, 3), counts)
        self.symbol = self.flat[self.at].astype(np.int64)
        self.symbol[np.repeat(np.concatenate((~two, np.zeros(len(starts), bool))), counts)] = END
        self.kind = np.minimum(self.at - self.begin[self.unit] - np.where(self.unit < n, TAIL + 1, 1), 2)  # first symbol of a word, second, later
        self.n = n + len(starts)
        self.prefix = prefix_hash(self.flat)

    def contexts(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the contexts of the symbols a .. b - 1, one row for each order; and whether a context is longer than that of the order before."""
        at, begin = self.at[a:b], self.begin[self.unit[a:b]]
        starts = np.stack([np.maximum(at - k, begin) for k in ORDERS])
        longer = np.ones(starts.shape, bool)
        longer[1:] = starts[1:] < starts[:-1]
        return np.stack([span_hash(self.prefix, x, at) for x in starts]), longer


# --- the model -------------------------------------------------------------------------------------------------------


class Pairs:
    """The distinct pairs of a context and the symbol that follows it, in the order of the contexts' hashes and the symbols' codes.

    ``context`` and ``symbol`` of each pair; ``of`` is the pair of each of the units' symbols under each order. Contexts that are clipped at the
    beginning of the unit are the same under several orders.
    """

    def __init__(self, units: Units, code: Code):
        n = len(units.at)
        self.of, self.longer = np.zeros((_K, n), np.int32), np.zeros((_K, n), bool)
        self.context, self.symbol = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if not n:
            return
        hashes, place, step = [], [], 16 * BLOCK
        for a in range(0, n, step):
            b = min(a + step, n)
            contexts, longer = units.contexts(a, b)
            self.longer[:, a:b] = longer
            hashes.append(contexts[longer])
            place += [(np.flatnonzero(x) + a).astype(np.int32) for x in longer]
        hashes, place = np.concatenate(hashes), np.concatenate(place)
        keys = mix(np.arange(1, 258, dtype=np.uint64))[units.symbol[place]]
        keys ^= hashes
        keys *= np.uint64(0xD6E8FEB86659FD93)
        codes, names = pd.factorize(keys)
        del keys
        codes, first = codes.astype(np.int32), np.empty(len(names), np.int32)
        first[codes[::-1]] = np.arange(len(codes), dtype=np.int32)[::-1]
        context, symbol = hashes[first], units.symbol[place[first]]
        del hashes, place, names
        order = np.lexsort((code.leaf[symbol].astype(np.int16), context))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.context, self.symbol, codes, at = context[order], symbol[order], rank[codes], 0
        for a in range(0, n, step):
            b = min(a + step, n)
            for k in range(_K):
                here = np.flatnonzero(self.longer[k, a:b])
                if k:
                    self.of[k, a:b] = self.of[k - 1, a:b]
                self.of[k, a + here] = codes[at : at + len(here)]
                at += len(here)

    def times(self, units: Units, times: np.ndarray) -> np.ndarray:
        """How often each pair occurs in training texts."""
        out, often = np.zeros(len(self.symbol)), times[units.unit].astype(np.float64)
        for k in range(_K if len(out) else 0):
            out += np.bincount(self.of[k][self.longer[k]], often[self.longer[k]], len(out))
        return out.astype(np.int64)


def node_counts(code: Code, context: np.ndarray, symbol: np.ndarray, times: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each node on the way to the symbols of the wanted pairs, one after the other, given all distinct pairs in the order of context and ``Code.leaf``.

    Counts go into 16 bits; larger ones keep their ratio. Contexts are taken in steps of about ``STEP`` pairs, whose arrays stay in a processor's cache.
    """
    below = np.concatenate(([0], np.cumsum(code.size[symbol] * wanted)))
    zeros, ones = np.zeros(int(below[-1]), np.uint16), np.zeros(int(below[-1]), np.uint16)
    a = 0
    while a < len(symbol):
        b = min(a + STEP, len(symbol))
        while b < len(symbol) and context[b] == context[b - 1]:
            b += 1
        cells = slice(below[a], below[b])
        _count_nodes(code, context[a:b], symbol[a:b], times[a:b], wanted[a:b], zeros[cells], ones[cells])
        a = b
    return zeros, ones


def _count_nodes(code: Code, context: np.ndarray, symbol: np.ndarray, times: np.ndarray, wanted: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
    """Fills in the zeros and ones of some contexts."""
    size = code.size[symbol]
    start = np.cumsum(size * wanted) - size * wanted
    same = np.zeros(len(symbol), bool)  # whether the code so far is that of the pair before
    same[1:] = context[1:] == context[:-1]
    live, first, many = np.arange(len(symbol), dtype=np.int32), code.start[symbol], times
    depth = 0
    while len(live):
        alone = ~same  # a pair that shares its code with none any more: all further nodes have its own count on its own side
        alone[:-1] &= ~same[1:]
        if alone.any():
            at = np.flatnonzero(alone & wanted[live])
            rest = size[live[at]] - depth
            bit, cells = code.bit[expand(first[at] + depth, rest)], expand(start[live[at]] + depth, rest)
            count = np.repeat((many[at] / np.maximum(1, many[at] / 65_535)).astype(np.uint16), rest)
            ones[cells], zeros[cells] = count * bit, count * ~bit
            go = ~alone
            live, same, first, many = live[go], same[go], first[go], many[go]
            if not len(live):
                break
        heads = np.flatnonzero(~same)
        bit = code.bit[first + depth]
        one, every = np.add.reduceat(many * bit, heads), np.add.reduceat(many, heads)
        zero = every - one
        most = np.maximum(zero, one)
        if most.max() > 65_535:
            scale = np.maximum(1, most / 65_535)
            zero, one = (zero / scale).astype(np.int64), (one / scale).astype(np.int64)
        run, shown = np.cumsum(~same) - 1, wanted[live]
        run, at = run[shown], start[live[shown]] + depth
        ones[at], zeros[at] = one[run], zero[run]
        same[1:] &= bit[1:] == bit[:-1]
        depth += 1
        go = size[live] > depth
        live, same, first, many = live[go], same[go], first[go], many[go]  # what ends here shares its code with none
        if len(same):
            same[0] = False


class Mixer:
    """Gated weights and the probability map, over the counts of pairs that ``take`` is given."""

    def __init__(self, code: Code):
        self.code = code
        self.weights = np.full((_K + 1, _GATES), 0.25, np.float32)
        self.weights[-1] = 0
        self.slopes = np.full((_K + 1, _GATES), 1e-4, np.float32)
        self.map = np.zeros(2 * 256 * _CELLS)
        self.seen = np.zeros(_GATES)

    def take(self, symbols: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        """Takes the counts of the nodes on the way to each pair's symbol, and turns them into log odds."""
        size = self.code.size[symbols]
        self.start = (np.cumsum(size) - size).astype(np.int32)
        self.zeros, self.ones = zeros, ones
        self.odds = _LOG[ones] - _LOG[zeros]
        self.level = _LEVEL[np.minimum(zeros.astype(np.int32) + ones, 65_535)].astype(np.uint8)

    def locate(self, symbols: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """The decisions of some symbols: symbol, node and bit of each, and where its counts stand under each context."""
        code, size = self.code, self.code.size[symbols]
        owner = np.repeat(np.arange(len(symbols)), size)
        path = expand(code.start[symbols], size)
        step = path - code.start[symbols][owner]
        return owner, code.node[path], code.bit[path], [self.start[pairs[k]][owner] + step for k in range(_K)]

    def inputs(self, y: np.ndarray, kind: np.ndarray, cells: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The log odds of the counts under each context, each without what the decision itself has added; and the gates."""
        x, gate = [], 28 * kind
        for k in range(_K):
            one = np.maximum(np.take(self.ones, cells[k]).astype(np.int64) - y, 0)
            zero = np.maximum(np.take(self.zeros, cells[k]).astype(np.int64) - ~y, 0)
            x.append(np.take(_LOG, one) - np.take(_LOG, zero))
            if k in (_K - 3, _K - 1):
                level = np.take(_LEVEL, np.minimum(zero + one, 65_535))
                gate = gate + (4 * level if k == _K - 1 else np.minimum(level // 2, 3))
        return x, gate

    def frozen_inputs(self, kind: np.ndarray, cells: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        gate = 28 * kind + np.minimum(np.take(self.level, cells[_K - 3]) // 2, 3) + 4 * np.take(self.level, cells[_K - 1])
        return [np.take(self.odds, cells[k]) for k in range(_K)], gate

    def predict(self, node: np.ndarray, y: np.ndarray, x: list[np.ndarray], gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mixed probability, place in the map, and the log probability of each decision after refinement."""
        z = np.take(self.weights[_K], gate) * np.float32(0.5)
        for k in range(_K):
            z += np.take(self.weights[k], gate) * x[k]
        np.clip(z, -11, 11, out=z)
        p = 1 / (1 + np.exp(-z))
        spot = 2 * (node * _CELLS + np.rint(z * (12 / 11) + 12).astype(np.int64))
        zero, one = np.take(self.map, spot), np.take(self.map, spot + 1)
        final = np.clip((p + (one + 16 * p) / (zero + one + 16)) / 2, 1e-6, 1 - 1e-6)
        return p, spot, np.log(np.where(y, final, 1 - final))

    def _blocks(self, units: Units, pairs: Pairs) -> Iterator[tuple]:
        for a in range(0, len(units.at), BLOCK):
            b = min(a + BLOCK, len(units.at))
            owner, node, y, cells = self.locate(units.symbol[a:b], pairs.of[:, a:b])
            yield units.unit[a:b][owner], units.kind[a:b][owner], node, y, cells

    def learn(self, units: Units, times: np.ndarray, pairs: Pairs) -> float:
        """Block by block: predict every decision by the counts without itself, and step against the cost.

        ``times`` says how often each unit occurs in training texts; every occurrence weighs alike. Returns the cost in nats.
        """
        cost = 0.0
        for unit, kind, node, y, cells in self._blocks(units, pairs):
            often = times[unit].astype(np.float64)
            used = np.flatnonzero(often)
            often, kind, node, y, cells = often[used], kind[used], node[used], y[used], [x[used] for x in cells]
            x, gate = self.inputs(y, kind, cells)
            p, spot, log = self.predict(node, y, x, gate)
            cost -= float((log * often).sum())
            error = (y - p) * often
            n = np.bincount(gate, often, _GATES)
            for k in range(_K + 1):
                slope = np.bincount(gate, error * x[k] if k < _K else error * 0.5, _GATES) / np.maximum(n, 1)
                self.slopes[k] += slope**2
                self.weights[k] += RATE * slope / np.sqrt(self.slopes[k])
            self.seen += n
            self.map += np.bincount(spot + y, often, len(self.map))
        return cost

    def costs(self, units: Units, pairs: Pairs) -> np.ndarray:
        """log10 probability of each unit."""
        out = np.zeros(units.n)
        for unit, kind, node, y, cells in self._blocks(units, pairs):
            log = self.predict(node, y, *self.frozen_inputs(kind, cells))[-1]
            low = int(unit[0])
            part = np.bincount(unit - low, weights=log)
            out[low : low + len(part)] += part
        return out / np.log(10)


class Parts(NamedTuple):
    """What the words of a group consist of: see ``Group.units``. Heads of words come before those of ends."""

    head_row: np.ndarray
    head_codes: np.ndarray
    body_codes: np.ndarray
    heads: np.ndarray
    head_edges: np.ndarray
    head_times: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    body_edges: np.ndarray
    body_times: np.ndarray


def edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends among hashes in order: buckets are equal ranges of their upper halves."""
    return np.searchsorted((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1).astype(np.uint64))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    codes, names = pd.factorize(values)
    order = np.argsort(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return names[order], rank[codes]


def _packed(*batches: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Group:
    """The words of several slices, gathered until their distinct ones are worth evaluating together."""

    def __init__(self):
        self.words: list[Words] = []
        self.rows: list[pa.RecordBatch] = []
        self.bytes = 0

    def add(self, rows: pa.RecordBatch, flat: np.ndarray, offsets: np.ndarray) -> None:
        words = Words(flat, offsets)
        words.flat = words.flat.copy() if words.flat.base is not None else words.flat
        self.words.append(words)
        self.rows.append(rows)
        self.bytes += len(flat)

    def units(self, buckets: int) -> Parts:
        """The distinct heads and bodies in the order of their buckets, and how often each occurs in training rows."""
        begins = np.cumsum([0, *(len(r) for r in self.rows)])
        shift = np.cumsum([0, *(len(w.flat) for w in self.words)])
        row = np.concatenate([w.row + b for w, b in zip(self.words, begins)])
        head, token = np.concatenate([w.head for w in self.words]), np.concatenate([w.token for w in self.words])
        starts, ends = (np.concatenate([getattr(w, x) + s for w, s in zip(self.words, shift)]) for x in ("starts", "ends"))
        head_row = np.concatenate((row, np.arange(begins[-1])))
        train = self.column("train").astype(bool)
        every = np.concatenate((head, *(w.end_head for w in self.words)))
        heads, head_codes = distinct(mix(every.astype(np.uint64)))
        names = np.empty(len(heads), np.int64)
        names[head_codes] = every
        bodies, body_codes = distinct(token)
        first = np.empty(len(bodies), np.int64)
        first[body_codes] = np.arange(len(body_codes))
        return Parts(
            head_row, head_codes, body_codes, names, edges(heads, buckets), np.bincount(head_codes, train[head_row], len(heads)).astype(np.int64),
            bodies, starts[first], ends[first], edges(bodies, buckets), np.bincount(body_codes, train[row], len(bodies)).astype(np.int64),
        )

    def column(self, name: str) -> np.ndarray:
        return np.concatenate([r.column(name).to_numpy(zero_copy_only=False) for r in self.rows])

    def packed(self) -> bytes:
        """The rows with their texts, as they are read again by ``unpacked``."""
        return _packed(*self.rows)

    @classmethod
    def unpacked(cls, data: bytes) -> Group:
        group = cls()
        for rows in pa.ipc.open_stream(data):
            group.add(rows, *utf8(rows.column("text")))
        return group

    def phrases(self) -> tuple[np.ndarray, ...]:
        """Row, context, phrase, first word, one past the last word, whether it runs past the end; words counted over the group."""
        begins, words = np.cumsum([0, *(len(r) for r in self.rows)]), np.cumsum([0, *(len(w.token) for w in self.words)])
        gather = lambda f: np.concatenate([f(w, b, k) for w, b, k in zip(self.words, begins, words)])
        return (
            gather(lambda w, b, k: w.row[w.anchor] + b), gather(lambda w, b, k: w.context), gather(lambda w, b, k: w.phrase),
            gather(lambda w, b, k: w.anchor + 1 + k), gather(lambda w, b, k: w.upto + k), gather(lambda w, b, k: w.to_end),
        )


def _groups(batches: Iterator[pa.RecordBatch], most: int = GROUP_BYTES) -> Iterator[Group]:
    group = Group()
    for batch in batches:
        for part, flat, offsets in slices(batch):
            group.add(part, flat, offsets)
            if group.bytes >= most:
                yield group
                group = Group()
    if group.rows:
        yield group


# --- learning: tokens to buckets, model to chunks ---------------------------------------------------------------------

_LEARNED = "kind int, part long, a binary, b binary, c binary, d binary"
UNITS, TEXTS = 1, 2


def _blob(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _map_learn(buckets: int):
    def rows_of(group: Group, name: bytes) -> Iterator[tuple]:
        """The texts of the group, and per bucket its distinct heads and bodies with how often they occur in training rows."""
        packed = group.packed()
        mark = hashlib.blake2b(packed + name, digest_size=16).digest()
        yield TEXTS, 0, packed, b"", b"", mark
        flat, own = np.concatenate([w.flat for w in group.words]), group.units(buckets)
        for b in range(buckets):
            heads, bodies = (slice(x[b], x[b + 1]) for x in (own.head_edges, own.body_edges))
            starts, sizes = own.starts[bodies], (own.ends - own.starts)[bodies]
            if heads.start < heads.stop or bodies.start < bodies.stop:
                spelled = zlib.compress(flat[expand(starts, sizes)].tobytes(), 1)
                yield UNITS, b, _blob(own.heads[heads], own.head_times[heads]), own.tokens[bodies].tobytes(), _blob(own.body_times[bodies], sizes) + spelled, mark + len(spelled).to_bytes(8, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        for k, group in enumerate(_groups(batches)):
            rows = list(rows_of(group, f"{context.partitionId() if context else 0} {k}".encode()))
            for a in range(0, len(rows), 16):
                yield _learned(rows[a : a + 16])

    return run


def _learned(rows: list[tuple]) -> pa.RecordBatch:
    kind, part, *blobs = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["kind", "part", "a", "b", "c", "d"])


def _unite(part: int, rows: list[tuple]) -> Iterator[tuple]:
    """A bucket's distinct heads and bodies with how often they occur, and which of them each slice has."""
    heads, times, tokens, own_times, sizes, spelled = [], [], [], [], [], []
    for a, b, c, d in rows:
        own = np.frombuffer(zlib.decompress(a), np.int64).reshape(2, -1)
        n = int.from_bytes(d[16:], "little")
        body = np.frombuffer(zlib.decompress(c[: len(c) - n]), np.int64).reshape(2, -1)
        for held, x in zip((heads, times, tokens, own_times, sizes, spelled), (own[0], own[1], np.frombuffer(b, np.uint64), body[0], body[1], np.frombuffer(zlib.decompress(c[len(c) - n :]), np.uint8))):
            held.append(x)
    codes, names = pd.factorize(np.concatenate(heads))
    head_times = np.bincount(codes, np.concatenate(times), len(names)).astype(np.int64)
    body_codes, kinds = pd.factorize(np.concatenate(tokens))
    body_times = np.bincount(body_codes, np.concatenate(own_times), len(kinds)).astype(np.int64)
    size, first = np.concatenate(sizes), np.empty(len(kinds), np.int64)
    first[body_codes[::-1]] = np.arange(len(body_codes))[::-1]
    text = np.concatenate(spelled)[expand((np.cumsum(size) - size)[first], size[first])]
    yield TOTALS, part, np.array([body_times.sum(), (body_times > 0).sum()], np.int64).tobytes(), b"", b""
    yield UNIQUE, part, _blob(names, head_times), _blob(size[first], body_times), zlib.compress(text.tobytes(), 1)
    at = below = 0
    for (_, _, _, d), x, y in zip(rows, heads, tokens):
        yield LINKS, part, d[:16], _blob(codes[at : at + len(x)].astype(np.int32)), _blob(body_codes[below : below + len(y)].astype(np.int32))
        at, below = at + len(x), below + len(y)


def _units(a: bytes, b: bytes, c: bytes) -> tuple[Units, np.ndarray, int]:
    """A bucket's units, how often each occurs in training texts, and the number of heads."""
    heads, head_times = np.frombuffer(zlib.decompress(a), np.int64).reshape(2, -1)
    sizes, body_times = np.frombuffer(zlib.decompress(b), np.int64).reshape(2, -1)
    ends = np.cumsum(sizes)
    return Units(heads, np.frombuffer(zlib.decompress(c), np.uint8), ends - sizes, ends), np.concatenate((head_times, body_times)), len(heads)


_MERGED = "kind int, part long, a binary, b binary, c binary"
TOTALS, UNIQUE, LINKS = 1, 2, 3


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for part, *blobs in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b", "c", "d"))):
            held.setdefault(part, []).append(tuple(blobs))
    for part in list(held):
        out = list(_unite(part, held.pop(part)))
        for a in range(0, len(out), 64):
            kinds, parts, *blobs = zip(*out[a : a + 64])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(parts, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["kind", "part", "a", "b", "c"])


# --- counts of contexts: out to buckets, back to the units, and into weights ----------------------------------------------

_COUNTED = "part long, source long, a binary, b binary, c binary"
ODDS, WEIGHTS, MAP = 0, 1, 2


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    part, source, *blobs = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(source, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["part", "source", "a", "b", "c"])


def _send(code: Code, buckets: int):
    """For each bucket of contexts: those of a bucket of units, with the symbols that follow them and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, *blobs in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b", "c"))):
                units, times, _ = _units(*blobs)
                pairs = Pairs(units, code)
                often = pairs.times(units, times)
                cut = edges(pairs.context, buckets)
                for q in range(buckets):
                    lo, hi = cut[q], cut[q + 1]
                    if lo < hi:
                        context = pairs.context[lo:hi]
                        new = np.append(True, context[1:] != context[:-1])
                        per = np.diff(np.append(np.flatnonzero(new), hi - lo)).astype(np.uint16)  # 257 symbols at most
                        yield _counted([(q, source, context[new].tobytes(), _blob(per), _blob(often[lo:hi], pairs.symbol[lo:hi].astype(np.uint16)))])

    return run


def _add_up(code: Code):
    """Adds up a bucket's pairs, and returns the symbols of each context that several buckets of units have, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "source", "a", "b", "c"))):
                held.setdefault(part, []).append(tuple(row))
        for part in list(held):
            yield from settle(part, held.pop(part))

    def settle(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        asked, per, symbols, times = [], [], [], []
        for _, a, b, c in rows:
            asked.append(np.frombuffer(a, np.uint64))
            per.append(np.frombuffer(zlib.decompress(b), np.uint16))
            data, n = zlib.decompress(c), int(per[-1].sum())
            times.append(np.frombuffer(data, np.int64, n))
            symbols.append(np.frombuffer(data, np.uint16, n, 8 * n).astype(np.int64))
        sources, sizes = [r[0] for r in rows], [len(x) for x in asked]
        del rows
        which, names = pd.factorize(np.concatenate(asked))
        pairs, codes = distinct(np.repeat(which, np.concatenate(per)) * 257 + code.leaf[np.concatenate(symbols)])
        total = np.bincount(codes, np.concatenate(times), len(pairs)).astype(np.int64)
        symbol, size = code.symbol_at[pairs % 257].astype(np.uint16), np.bincount(pairs // 257, minlength=len(names))
        several = np.bincount(which, minlength=len(names)) > 1  # the others have no more than the asking bucket knows
        start, at = np.cumsum(size) - size, 0
        for source, n in zip(sources, sizes):
            own = which[at : at + n]
            at += n
            many = size[own] * several[own]
            found = expand(start[own], many)
            yield _counted([(source, part, _planes(many.astype(np.uint16)), _planes(symbol[found]), _planes(total[found]))])

    return run


def _follow(code: Code, pairs: Pairs, often: np.ndarray, answers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs' symbols, and the zeros and ones on the way to each.

    Contexts without an answer are those that no other bucket has: their counts are the pairs' own (``often``).
    """
    per, symbol, times = answers
    own = np.cumsum(np.append(False, pairs.context[1:] != pairs.context[:-1])) if len(pairs.context) else np.zeros(0, np.int64)
    mine = own * 257 + code.leaf[pairs.symbol]
    alone = per[own] == 0
    told = np.repeat(np.arange(len(per)), per) * 257 + code.leaf[symbol]
    key = np.concatenate((told, mine[alone]))
    order = np.argsort(key, kind="stable")  # two runs that are in order each
    key, times = key[order], np.concatenate((times, often[alone]))[order]
    wanted = np.zeros(len(key), bool)
    wanted[np.searchsorted(key, mine)] = True
    zeros, ones = node_counts(code, key // 257, code.symbol_at[key % 257], times, wanted)
    return pairs.symbol, zeros, ones


def _planes(x: np.ndarray) -> bytes:
    """Integers as compressed planes of their bytes: the upper ones are mostly zero."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


_ANSWER = (np.uint16, np.uint16, np.int64)


def _fit(code: Code):
    """Weights and map of a task, and each bucket of units with the counts of its contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, held, units_of = Mixer(code), {}, {}
        for batch in batches:
            for part, source, *blobs in zip(*(batch.column(c).to_pylist() for c in ("part", "source", "a", "b", "c"))):
                if source < 0:
                    units_of[part] = blobs
                else:
                    held.setdefault(part, {})[source] = blobs
        for part in list(units_of):
            units, times, _ = _units(*(blobs := units_of.pop(part)))
            counts = [x for _, x in sorted(held.pop(part, {}).items())]
            answers = [np.concatenate([np.zeros(0, kind), *(_unplanes(x[k], kind) for x in counts)]) for k, kind in enumerate(_ANSWER)]
            if times.any():
                pairs = Pairs(units, mixer.code)
                mixer.take(*_follow(code, pairs, pairs.times(units, times), answers))
                mixer.learn(units, times, pairs)
            yield _learned([(ODDS, part, *blobs, _framed([_planes(x) for x in answers]))])
        if mixer.seen.any():
            yield _learned([(WEIGHTS, 0, (mixer.weights.astype(np.float64) * mixer.seen).tobytes(), mixer.seen.tobytes(), b"", b""), (MAP, 0, mixer.map.tobytes(), b"", b"", b"")])

    return run


def _framed(blobs: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in blobs)


def _unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _sum_fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for kind, *blobs in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b"))):
            own = [np.frombuffer(x, np.float64) for x in blobs]
            held[kind] = [x + y for x, y in zip(held[kind], own)] if kind in held else own
    for kind, (a, b) in held.items():
        yield _learned([(kind, 0, a.tobytes(), b.tobytes(), b"", b"")])


_PRICED = "mark binary, part long, a binary, b binary, c binary"


def _price(model):
    """The cost of each unit of a bucket and how often it occurs in training texts: heads, then bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = model.value
        for batch in batches:
            for part, *blobs, answers in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b", "c", "d"))):
                units, times, n = _units(*blobs)
                pairs = Pairs(units, mixer.code)
                mixer.take(*_follow(mixer.code, pairs, pairs.times(units, times), [_unplanes(x, kind) for x, kind in zip(_unframed(answers), _ANSWER)]))
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([part]), *(pa.array([x], pa.binary()) for x in (_blob(mixer.costs(units, pairs).astype(np.float32)), _blob(times), n.to_bytes(8, "little")))], ["mark", "part", "a", "b", "c"])

    return run


def _hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each group the costs of its units in a bucket, and how often its words occur in training texts."""
    held, links = {}, {}
    for batch in batches:
        for mark, part, *blobs in zip(*(batch.column(c).to_pylist() for c in ("mark", "part", "a", "b", "c"))):
            if mark is None:
                held[part] = blobs
            else:
                links.setdefault(part, []).append((mark, *blobs[:2]))
    for part in list(held):
        cost, times, n = held.pop(part)
        cost, times, n = np.frombuffer(zlib.decompress(cost), np.float32), np.frombuffer(zlib.decompress(times), np.int64), int.from_bytes(n, "little")
        for mark, heads, bodies in links.pop(part, []):
            a, b = (np.frombuffer(zlib.decompress(x), np.int32) for x in (heads, bodies))
            yield pa.RecordBatch.from_arrays([pa.array([mark], pa.binary()), pa.array([part]), *(pa.array([x], pa.binary()) for x in (_blob(cost[a]), _blob(cost[n + b]), _blob(times[n + b])))], ["mark", "part", "a", "b", "c"])


_SPELLED = "bucket long, a binary, b binary, c binary, d binary"


def _spell(buckets: int, ends: int):
    """What each document costs by its words, and its tokens (bucket -1); and per bucket contexts, phrases, and the documents that hold them with the phrase's cost."""

    def rows_of(mark: bytes, group: Group, costs: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple]:
        own = group.units(buckets)
        head_cost, body_cost = (np.frombuffer(b"".join(zlib.decompress(x[k]) for x in costs), np.float32).astype(np.float64) for k in (0, 1))
        known = np.frombuffer(b"".join(zlib.decompress(x[2]) for x in costs), np.int64)[own.body_codes]
        train = group.column("train").astype(bool)
        n, words = len(train), len(own.body_codes)
        spelled = head_cost[own.head_codes]
        spelled[:words] += body_cost[own.body_codes]
        row = own.head_row[:words]
        sums = (
            np.bincount(row, minlength=n) + 1, np.bincount(row, known > 0, n).astype(np.int64) + (ends > 0),
            np.bincount(row, np.log10(known + 1.0), n) + np.log10(ends + 1.0), np.bincount(own.head_row, spelled, n),
        )
        table = [pa.concat_arrays([r.column(c) for r in group.rows]) for c in ("id", "n_bytes")]
        yield -1, mark, _packed(pa.RecordBatch.from_arrays([*table, *map(pa.array, sums)], ["own", "n_bytes", "n_tokens", "n_known", "logs", "score"])), b"", b""
        row, context, phrase, begin, upto, to_end = group.phrases()
        sums = np.concatenate(([0], np.cumsum(spelled[:words])))
        gain = sums[upto] - sums[begin] + np.where(to_end, spelled[words + row], 0)
        bucket = (context >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((phrase, context, bucket))
        row, context, phrase, gain, bucket = row[order], context[order], phrase[order], gain[order], bucket[order]
        new = np.ones(len(row), bool)
        new[1:] = (context[1:] != context[:-1]) | (phrase[1:] != phrase[:-1])
        heads = np.flatnonzero(new)
        per = np.diff(np.append(heads, len(row)))
        times = np.bincount(np.cumsum(new) - 1, weights=train[row], minlength=len(heads)) if len(row) else per
        cut = np.searchsorted(bucket[heads], np.arange(buckets + 1).astype(np.uint64))
        at = np.append(heads, len(row))
        for b in range(buckets):
            lo, hi = cut[b], cut[b + 1]
            if lo < hi:
                part = slice(at[lo], at[hi])
                yield b, context[heads[lo:hi]].tobytes(), phrase[heads[lo:hi]].tobytes(), _blob(times[lo:hi].astype(np.int32), per[lo:hi].astype(np.int32), (row[part] * 2 + train[row[part]]).astype(np.int32), gain[part].astype(np.float32)), mark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, costs = {}, {}
        for batch in batches:
            for mark, part, *blobs in zip(*(batch.column(c).to_pylist() for c in ("mark", "part", "a", "b", "c"))):
                if part < 0:
                    texts[mark] = blobs[0]
                else:
                    costs.setdefault(mark, {})[part] = tuple(blobs)
        for mark in list(texts):
            rows = list(rows_of(mark, Group.unpacked(texts.pop(mark)), [x for _, x in sorted(costs.pop(mark).items())]))
            for a in range(0, len(rows), 16):
                bucket, *blobs = zip(*rows[a : a + 16])
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["bucket", "a", "b", "c", "d"])

    return run


def _decide(rows: list[tuple]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """For the documents of each group that hold one of these phrases what the decisions on phrases change: the decision's log odds instead of the phrase's cost, or on top of it."""
    context, phrase = (np.concatenate([np.frombuffer(r[k], np.uint64) for r in rows]) for k in (0, 1))
    data = [(zlib.decompress(r[2]), len(r[0]) // 8) for r in rows]
    times = np.concatenate([np.frombuffer(d, np.int32, n) for d, n in data]).astype(np.int64)
    order = np.lexsort((phrase, context))
    new_context, new = np.ones(len(order), bool), np.ones(len(order), bool)
    new_context[1:] = context[order][1:] != context[order][:-1]
    new[1:] = new_context[1:] | (phrase[order][1:] != phrase[order][:-1])
    kind, group = np.cumsum(new) - 1, np.cumsum(new_context) - 1  # of entries in order
    m = np.bincount(kind, weights=times[order]).astype(np.int64)
    of_kind = group[np.flatnonzero(new)]
    every = np.bincount(of_kind, weights=m).astype(np.int64)
    first = np.flatnonzero(new_context)
    most = np.maximum.reduceat(m, kind[first])
    best = np.full(len(most), len(m))
    top = np.flatnonzero(m == most[of_kind])
    np.minimum.at(best, of_kind[top], top)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    at = 0
    for (_, _, _, mark), (blob, n) in zip(rows, data):
        per = np.frombuffer(blob, np.int32, n, 4 * n)
        size = int(per.sum())
        doc, gain = np.frombuffer(blob, np.int32, size, 8 * n), np.frombuffer(blob, np.float32, size, 8 * n + 4 * size).astype(np.float64)
        entry = np.repeat(back[at : at + n], per)
        at += n
        own, here = doc & 1, group[entry]
        came = kind[entry] == best[here]
        total, hits = every[here] - own, most[here] - own * came
        p = (hits + 0.4) / (total + 1.2)
        change = np.where(total > 0, np.where(came, np.log10(p) - gain, np.log10(1 - p)), 0.0)
        at_doc, inverse = distinct(doc >> 1)
        yield mark, at_doc.astype(np.int32), np.bincount(inverse, change, len(at_doc))


_SETTLED = "mark binary, docs binary, change binary, table binary"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {}
    row = lambda *blobs: pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], ["mark", "docs", "change", "table"])
    for batch in batches:
        for bucket, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "a", "b", "c", "d"))):
            if bucket < 0:
                yield row(blobs[0], None, None, blobs[1])
            else:
                held.setdefault(bucket, []).append(tuple(blobs))
    for bucket in list(held):
        for mark, docs, change in _decide(held.pop(bucket)):
            yield row(mark, docs.tobytes(), zlib.compress(change.tobytes(), 1), None)


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document of a group its sums, with all changes."""
    tables: dict[bytes, bytes] = {}
    held: dict[bytes, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for mark, docs, change, table in zip(*(batch.column(c).to_pylist() for c in ("mark", "docs", "change", "table"))):
            if table is None:
                held.setdefault(mark, []).append((docs, change))
            else:
                tables[mark] = table
    for mark in list(tables):
        (table,) = pa.ipc.open_stream(tables.pop(mark))
        total = table.column("score").to_numpy().copy()
        for docs, change in held.pop(mark, []):
            total[np.frombuffer(docs, np.int32)] += np.frombuffer(zlib.decompress(change), np.float64)
        yield pa.RecordBatch.from_arrays([*table.columns[:-1], pa.array(total)], table.schema.names)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = MODULUS, held: int = HELD) -> DataFrame:
    """Per document: its id, ``train`` (learned from), ``n_bytes``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (both log10) and ``bits_per_byte``."""
    spark = docs.sparkSession
    rows = clean(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    train = lambda: F.coalesce(training_row(F.col("id"), modulus, held), F.lit(False))
    rows = rows.select("id", train().alias("train"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counts = np.zeros(257, np.int64)
    for symbol, n in rows.filter("train").select("text").mapInArrow(tidy(symbol_counts), "symbol long, n long").groupBy("symbol").agg(F.sum("n")).collect():  # 257 rows
        counts[symbol] = n
    total, ends = int(counts.sum()), int(counts[END])
    code = Code(counts)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 6_000_000)
    buckets = min(tasks, BUCKETS)
    learned = stored(rows.mapInArrow(tidy(_map_learn(buckets)), _LEARNED), "mixing_texts", "kind")
    merged = stored(learned.filter(F.col("kind") == UNITS).repartition(tasks, "part").mapInArrow(tidy(_merge), _MERGED), "mixing", "kind")
    discard_part(learned, f"kind={UNITS}")
    of = lambda kind: merged.filter(F.col("kind") == kind)
    train_tokens, vocabulary = ends, int(ends > 0)
    for (a,) in of(TOTALS).select("a").toLocalIterator():  # one row for each bucket
        n, v = np.frombuffer(a, np.int64)
        train_tokens, vocabulary = train_tokens + int(n), vocabulary + int(v)
    unique = of(UNIQUE).select("part", F.lit(-1).cast("long").alias("source"), "a", "b", "c")
    counted = unique.mapInArrow(tidy(_send(code, buckets)), _COUNTED).repartition(tasks, "part").mapInArrow(tidy(_add_up(code)), _COUNTED)
    fitted = stored(counted.union(unique).repartition(tasks, "part").mapInArrow(tidy(_fit(code)), _LEARNED), "mixing_fit", "kind")
    discard_part(merged, f"kind={UNIQUE}")
    mixer = Mixer(code)
    fits = fitted.filter(F.col("kind") > ODDS).coalesce(16).mapInArrow(tidy(_sum_fits), _LEARNED)
    for kind, a, b in fits.repartition(2, "kind").mapInArrow(tidy(_sum_fits), _LEARNED).select("kind", "a", "b").collect():  # 2 rows
        if kind == WEIGHTS:
            seen = np.frombuffer(b, np.float64)
            mixer.weights = np.where(seen > 0, np.frombuffer(a, np.float64).reshape(-1, _GATES) / np.maximum(seen, 1), mixer.weights).astype(np.float32)
        else:
            mixer.map = np.frombuffer(a, np.float64).copy()
    links = of(LINKS).select(F.col("a").alias("mark"), "part", F.col("b").alias("a"), F.col("c").alias("b"), F.lit(None).cast("binary").alias("c"))
    costs = fitted.filter(F.col("kind") == ODDS).select("part", "a", "b", "c", "d").mapInArrow(tidy(_price(spark.sparkContext.broadcast(mixer))), _PRICED)
    priced = stored(costs.union(links).repartition(tasks, "part").mapInArrow(tidy(_hand_out), _PRICED), "mixing_costs")
    discard(fitted, merged)
    nothing = F.lit(None).cast("binary")
    texts = learned.filter(F.col("kind") == TEXTS).select(F.col("d").alias("mark"), F.lit(-1).cast("long").alias("part"), "a", nothing.alias("b"), nothing.alias("c"))
    spelled = priced.union(texts).repartition(tasks, "mark").mapInArrow(tidy(_spell(buckets, ends)), _SPELLED)
    settled = spelled.repartition(tasks, F.when(F.col("bucket") < 0, F.xxhash64("a")).otherwise(F.col("bucket"))).mapInArrow(tidy(_settle), _SETTLED)
    out = settled.repartition(tasks, "mark").mapInArrow(tidy(_total), "own long, n_bytes long, n_tokens long, n_known long, logs double, score double")
    each = float(np.log10(train_tokens + vocabulary + 1))
    out = out.withColumnRenamed("own", "id")
    return out.select(
        F.col("id").alias(id_col), train().alias("train"), "n_bytes", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * each).alias("base_score"), "score", F.when(F.col("n_bytes") > 0, -F.col("score") / (F.col("n_bytes") * float(np.log10(2)))).alias("bits_per_byte"),
    )
