"""Suffix-array dedup: removes each byte that a string of ``length`` bytes covers which also starts in a smaller document.

Every place where ``length`` bytes start is a window. A window's key is the smallest hash of the ``gram``-byte strings
in it, so equal windows have equal keys, and neighbouring windows mostly share theirs: a run of neighbours with one key
is handled as one string (its content), about one run for every 18 bytes of text.

1. Runs meet by key as packed hashes. A run whose whole content also stands in a smaller document is settled: the
   contents are taken as equal when two independent hashes of them agree, a polynomial modulo 2**64 and 24 bits of one modulo a
   prime. These runs, mostly parts of copies, are not compared byte by byte. What remains of a key with several contents is asked for: each content only from the smallest document that has it.
2. These documents send the contents asked for; contents meet by key. There the suffixes that start a window (but for windows whose
   hash no other one has, which are equal to none; windows of one hash are a tie, for which one takes part) are sorted:
   by their first eight bytes, and beyond ties by a mergesort whose comparisons are logarithmic, as prefix polynomial
   hashes and binary search find the common extension of two suffixes. Neighbours that the hashes call equal are
   compared byte by byte, so a collision of hashes merges nothing. Each class of equal windows has a smallest
   document; all others lose the window.
3. A document's spans are united and cut out of its text.

Only packed hashes and contents are shuffled, in buckets by key. Copies of a content within a task are settled before the
shuffle, so many copies of one document make no hot bucket. Keys with more than ``HOT`` contents are split by a second
minimum of another hash, which equal windows share as well.

Ids are integers. Rows with a null id stay as they are and remove nothing. Null texts count as empty, texts of
fewer than ``length`` bytes lose nothing. Rows with the same id are versions of one document: neither removes anything from the
other. Only the named columns are read, whatever other columns are called; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import clean, expand, lists, mix, powers, prefix_hash, prime_hash, slices, span_hash, tidy

LENGTH, GRAM = 50, 16
#: Bytes of text whose runs a task gathers before it packs them, and bytes of text per reducing task.
FLUSH_BYTES, TASK_BYTES = 12_000_000, 16_000_000
#: Contents of one key above which its windows are split by a second minimum.
HOT = 2_000
FULL, ASKED, SPLIT = 1, 2, 3
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


# --- windows and runs -------------------------------------------------------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive entries, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


class Runs:
    """The runs of windows of some texts: ``start`` and ``size`` (windows), ``key``, ``content`` (hash), ``row``, ``ordinal`` in the row."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.length, self.gram, self.flat = length, gram, flat
        windows = np.maximum(np.diff(offsets) - length + 1, 0)
        at = expand(offsets[:-1], windows)
        self.prefix = prefix_hash(flat)
        if not len(at):
            self.start = self.size = self.row = self.ordinal = np.zeros(0, np.int64)
            self.key = self.content = np.zeros(0, np.uint64)
            return
        n = len(flat) - gram + 1
        self.grams = (self.prefix[gram:] - self.prefix[:n]) * powers(n, inverse=True)
        self.grams ^= self.grams >> np.uint64(29)
        self.grams *= np.uint64(0xBF58476D1CE4E5B9)
        self.grams ^= self.grams >> np.uint64(32)
        keys = sliding_min(self.grams, length - gram + 1)[at]
        first = np.ones(len(at), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(first)
        self.start, self.key = at[heads], keys[heads]
        self.size = np.diff(np.append(heads, len(at)))
        self.content = span_hash(self.prefix, self.start, self.start + self.size - 1 + length)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        per_row = np.bincount(self.row, minlength=len(offsets) - 1)
        self.ordinal = np.arange(len(heads)) - np.repeat(np.cumsum(per_row) - per_row, per_row)

    def checks(self) -> np.ndarray:
        """The second hash of each run's content."""
        return prime_hash(self.flat, self.start, self.start + self.size - 1 + self.length)

    def split(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The given runs cut into runs of equal second minimum: their starts, sizes and keys."""
        at = expand(self.start[which], self.size[which])
        key = np.repeat(self.key[which], self.size[which])
        second = sliding_min(mix(self.grams ^ _SECOND), self.length - self.gram + 1)[at]
        first = np.ones(len(at), bool)
        first[1:] = (second[1:] != second[:-1]) | (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])
        heads = np.flatnonzero(first)
        return at[heads], np.diff(np.append(heads, len(at))), mix(key[heads] ^ (second[heads] * _SECOND))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays whose neighbours are alike, as compressed differences."""
    return zlib.compress(b"".join(np.diff(a.astype(np.int64), prepend=0).tobytes() for a in arrays), 1)


def _unpack(data: bytes, parts: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int64).reshape(parts, -1), axis=1)


def _three(x: np.ndarray) -> bytes:
    """The lower three bytes of each number."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unthree(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal buckets together, the buckets that occur and where they begin (and end)."""
    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, begins = np.unique(bucket[order], return_index=True)
    return order, names, np.append(begins, len(order))


# --- step 1: runs meet by key ----------------------------------------------------------------------------------------

_PACKED = "bucket int, keys binary, contents binary, places binary"
_CODES = "id long, codes array<long>"


def _codes(ids: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(ids, kind="stable")
    names, counts = np.unique(ids, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(names), lists(codes[order], counts)], ["id", "codes"])


def _code(ordinal: np.ndarray, content: np.ndarray, what: int | np.ndarray) -> np.ndarray:
    """A run's ordinal, 16 bits of its content's hash as a check, and what is to be done."""
    return ordinal << 20 | ((content & np.uint64(0xFFFF)).astype(np.int64) << 4) | what


def _map_runs(length: int, gram: int, buckets: int):
    """Packed runs per bucket; runs that have the content of a smaller document of the same task come as settled (bucket -1)."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, content, check, ids, ordinal = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((ids, check, content, key))
        key, content, check, ids, ordinal = key[order], content[order], check[order], ids[order], ordinal[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (check[1:] != check[:-1])
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else ids
        settled = ids > least
        if settled.any():
            codes = _code(ordinal[settled], content[settled], FULL)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""]), pa.array([b""]), pa.array([_pack(ids[settled], codes)])], ["bucket", "keys", "contents", "places"])
        left = np.flatnonzero(~settled)
        order = left[np.lexsort((ordinal[left], ids[left]))]
        key, content, check, ids, ordinal = key[order], content[order], check[order], ids[order], ordinal[order]
        order, names, begins = _by_bucket(key, buckets)
        rows = []
        for a, b in zip(begins[:-1], begins[1:]):
            at = order[a:b]
            rows.append((_three(key[at]), content[at].tobytes() + _three(check[at]), _pack(ids[at], ordinal[at])))
        for k in range(0, len(rows), 64):
            part = rows[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 64].astype(np.int32)), *(pa.array([r[j] for r in part], pa.binary()) for j in range(3))], ["bucket", "keys", "contents", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part, flat, offsets in slices(batch):
                runs = Runs(flat, offsets, length, gram)
                held.append((runs.key, runs.content, runs.checks(), part.column("id").to_numpy()[runs.row], runs.ordinal))
                size += len(flat)
                if size >= FLUSH_BYTES:
                    yield from flush(held)
                    size = 0
        if held:
            yield from flush(held)

    return run


def _meet_runs(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document, the codes of its runs that are settled or asked for."""
        by_bucket: dict[int, list[tuple]] = {}
        for batch in batches:
            for bucket, keys, contents, places in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "contents", "places"))):
                if bucket < 0:
                    yield _codes(*_unpack(places, 2))
                else:
                    by_bucket.setdefault(bucket, []).append((_unthree(keys), np.frombuffer(contents, np.uint64, len(keys) // 3), _unthree(contents[len(keys) // 3 * 8 :]), *_unpack(places, 2)))
        for bucket in list(by_bucket):
            key, content, check, ids, ordinal = (np.concatenate(x) for x in zip(*by_bucket.pop(bucket)))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            shared = np.zeros(len(key), bool)
            shared[1:] = same
            shared[:-1] |= same
            order = order[shared]
            order = order[np.lexsort((ids[order], check[order], content[order], key[order]))]
            key, content, check, ids, ordinal = key[order], content[order], check[order], ids[order], ordinal[order]
            if not len(key):
                continue
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= (content[1:] != content[:-1]) | (check[1:] != check[:-1])
            least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
            full = ids > least
            heads = np.flatnonzero(new_key)
            group = np.cumsum(new_key) - 1
            contents = np.add.reduceat(new.astype(np.int64), heads)
            several = np.minimum.reduceat(least, heads) < np.maximum.reduceat(least, heads)
            ask = ~full & several[group]
            codes = np.where(full, FULL, np.where(contents[group] > hot, SPLIT, ASKED))
            keep = full | ask
            yield _codes(ids[keep], _code(ordinal, content, codes)[keep])

    return run


# --- step 2: contents meet by key ------------------------------------------------------------------------------------

_PIECES = "id long, begins array<int>, ends array<int>, bucket int, sizes binary, text binary, places binary"
_SPANS = "id long, begins array<int>, ends array<int>"
_NO_LIST = pa.nulls(1, pa.list_(pa.int32()))


def _map_contents(length: int, gram: int, buckets: int):
    """For each document the spans of its settled runs; and the contents asked for, packed per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, flat, offsets in slices(batch, "text"):
                runs = Runs(flat, offsets, length, gram)
                asked = part.column("codes")
                codes = asked.flatten().to_numpy()
                row = np.repeat(np.arange(len(part)), np.diff(asked.offsets.to_numpy()))
                per_row = np.bincount(runs.row, minlength=len(part))
                at = (np.cumsum(per_row) - per_row)[row] + (codes >> 20)
                fine = (codes >> 20) < per_row[row]
                at, codes, row = at[fine], codes[fine], row[fine]
                fine = (runs.content[at] & np.uint64(0xFFFF)).astype(np.int64) == codes >> 4 & 0xFFFF
                order = np.argsort(at[fine], kind="stable")
                at, what = at[fine][order], (codes[fine] & 15)[order]
                ids = part.column("id").to_numpy()

                full = at[what == FULL]
                begins, ends = runs.start[full] - offsets[runs.row[full]], runs.start[full] + runs.size[full] - 1 + length - offsets[runs.row[full]]
                keep = np.ones(len(full), bool)  # spans that touch the one before in the same document go on as one
                keep[1:] = (runs.row[full][1:] != runs.row[full][:-1]) | (begins[1:] > ends[:-1])
                heads = np.flatnonzero(keep)
                if len(full):
                    tails = np.append(heads[1:], len(full)) - 1
                    counts = np.bincount(runs.row[full][heads], minlength=len(part))
                    has = counts > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[has]), lists(begins[heads].astype(np.int32), counts[has]), lists(ends[tails].astype(np.int32), counts[has]), pa.array((ids[has] % buckets).astype(np.int32)), *(pa.nulls(int(has.sum()), pa.binary()) for _ in range(3))],
                        ["id", "begins", "ends", "bucket", "sizes", "text", "places"],
                    )
                plain = at[what == ASKED]
                start, size, key = runs.start[plain], runs.size[plain], runs.key[plain]
                if len(hot := at[what == SPLIT]):
                    more = runs.split(hot)
                    start, size, key = (np.concatenate(x) for x in zip((start, size, key), more))
                order, names, bounds = _by_bucket(key, buckets)
                for name, a, b in zip(names, bounds[:-1], bounds[1:]):
                    one = order[a:b]
                    lengths = size[one] + length - 1
                    home = np.searchsorted(offsets, start[one], "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None], pa.int64()), _NO_LIST, _NO_LIST, pa.array([name], pa.int32()), pa.array([_pack(lengths)]),
                            pa.array([flat[expand(start[one], lengths)].tobytes()]), pa.array([_pack(ids[home], start[one] - offsets[home])]),
                        ],
                        ["id", "begins", "ends", "bucket", "sizes", "text", "places"],
                    )

    return run


class SuffixOrder:
    """Suffixes of a text compared over ``length`` bytes by prefix hashes."""

    def __init__(self, flat: np.ndarray, length: int):
        self.flat, self.length = np.concatenate((flat, np.zeros(8, np.uint8))), length
        self.prefix, self.inverse = prefix_hash(flat), powers(len(flat) + 1, inverse=True)

    def alike(self, a: np.ndarray, b: np.ndarray, m: np.ndarray | int) -> np.ndarray:
        return (self.prefix[a + m] - self.prefix[a]) * self.inverse[a] == (self.prefix[b + m] - self.prefix[b]) * self.inverse[b]

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b; equal ones do not. Binary search finds the common extension."""
        out = np.zeros(len(a), bool)
        differ = np.flatnonzero(~self.alike(a, b, self.length))
        a, b = a[differ], b[differ]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)  # alike over low bytes, not over high
        for _ in range(int(self.length).bit_length()):
            middle = (low + high) // 2
            same = self.alike(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle)
        out[differ] = self.flat[a + low] < self.flat[b + low]
        return out

    def sort(self, at: np.ndarray) -> np.ndarray:
        """The suffixes in order: eight bytes at once, then a bottom-up mergesort within ties, all ties' merges of a level together."""
        head = np.zeros(len(at), np.uint64)
        for j in range(8):
            head = head << np.uint64(8) | self.flat[at + j]
        order = np.argsort(head, kind="stable")
        at, head = at[order], head[order]
        new = np.ones(len(at), bool)
        new[1:] = head[1:] != head[:-1]
        begins = np.flatnonzero(new)
        counts = np.diff(np.append(begins, len(at)))
        begin, count = np.repeat(begins, counts), np.repeat(counts, counts)
        width, live = 1, np.flatnonzero(count > 1)
        while len(live):
            local = live - begin[live]
            pair = begin[live] + local // (2 * width) * (2 * width)
            middle = np.minimum(pair + width, begin[live] + count[live])
            end = np.minimum(pair + 2 * width, begin[live] + count[live])
            left = live < middle
            low, high = np.where(left, middle, pair), np.where(left, end, middle)
            base, value = low.copy(), at[live]
            todo = np.arange(len(live))
            for _ in range(width.bit_length() + 1):  # how many of the other half come before: strictly, or as well if equal
                todo = todo[low[todo] < high[todo]]
                if not len(todo):
                    break
                probe = (low[todo] + high[todo]) // 2
                other = at[probe]
                mine, side = value[todo], left[todo]
                before = self.less(np.where(side, other, mine), np.where(side, mine, other))
                go = np.where(side, before, ~before)
                low[todo], high[todo] = np.where(go, probe + 1, low[todo]), np.where(go, high[todo], probe)
            place = np.where(left, live, pair + (live - middle)) + (low - base)
            at[place] = value
            width *= 2
            live = live[count[live] > width]
        return at

    def repeated(self, at: np.ndarray) -> np.ndarray:
        """The suffixes whose hash of ``length`` bytes occurs once more, in order; where it does not, no other suffix is equal.

        The sort compares by these hashes, so suffixes of one hash are a tie in it: one of them takes part, and the others stand beside it.
        """
        whole = (self.prefix[at + self.length] - self.prefix[at]) * self.inverse[at]
        order = np.argsort(whole, kind="stable")
        at, whole = at[order], whole[order]
        heads = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1]))) if len(at) else order
        counts = np.diff(np.append(heads, len(at)))
        heads, counts = heads[counts > 1], counts[counts > 1]
        order = np.argsort(at[heads])
        one = at[heads][order]
        place = order[np.searchsorted(one, self.sort(one))]
        return at[expand(heads[place], counts[place])]

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes are equal byte by byte; asked only where the hashes say so."""
        out = self.alike(a, b, self.length)
        sure = np.flatnonzero(out)
        for k in range(0, len(sure), 10_000):
            part = sure[k : k + 10_000]
            reach = np.arange(self.length)
            out[part] = (self.flat[a[part, None] + reach] == self.flat[b[part, None] + reach]).all(axis=1)
        return out


def lost_windows(flat: np.ndarray, starts: np.ndarray, windows: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of contents (each with so many windows), the places of windows that a smaller document has as well: content and place in it."""
    owner = np.repeat(np.arange(len(starts)), windows)
    at = expand(starts, windows)
    owner_of = np.full(len(flat) + 1, -1, np.int64)
    owner_of[at] = owner
    order = SuffixOrder(flat, length)
    at = order.repeated(at)
    same = np.zeros(len(at), bool)
    same[1:] = order.verified(at[:-1], at[1:])
    group = np.cumsum(~same) - 1
    own = ids[owner_of[at]]
    heads = np.flatnonzero(~same)
    lost = own > np.minimum.reduceat(own, heads)[group] if len(at) else np.zeros(0, bool)
    at = np.sort(at[lost])
    return owner_of[at], at - starts[owner_of[at]]


def _meet_contents(length: int):
    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = np.concatenate([r[0] for r in rows])
        flat = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
        ids, places = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
        starts = np.cumsum(sizes) - sizes
        owner, at = lost_windows(flat, starts, sizes - length + 1, ids, length)
        if not len(owner):
            return
        new = np.ones(len(owner), bool)  # neighbouring windows make one span
        new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(owner)) - 1
        begins, ends = places[owner[heads]] + at[heads], places[owner[heads]] + at[tails] + length
        home = ids[owner[heads]]
        order = np.lexsort((begins, home))
        names, counts = np.unique(home, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), lists(begins[order].astype(np.int32), counts), lists(ends[order].astype(np.int32), counts)], ["id", "begins", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[tuple]] = {}
        for batch in batches:
            known = batch.filter(batch.column("id").is_valid())
            if len(known):
                yield known.select(["id", "begins", "ends"])
            asked = batch.filter(batch.column("id").is_null())
            for bucket, sizes, text, places in zip(*(asked.column(c).to_pylist() for c in ("bucket", "sizes", "text", "places"))):
                by_bucket.setdefault(bucket, []).append((_unpack(sizes, 1)[0], text, *_unpack(places, 2)))
        for bucket in list(by_bucket):
            yield from settle(by_bucket.pop(bucket))

    return run


# --- step 3: documents lose their spans -----------------------------------------------------------------------------


def _cut(texts: bool, kept_columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, flat, offsets in slices(batch):
                begins, ends = part.column("begins"), part.column("ends")
                counts = np.diff(begins.offsets.to_numpy()) * begins.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(part)), counts)
                depth = np.zeros(len(flat) + 1, np.int32)
                np.add.at(depth, offsets[row] + begins.flatten().to_numpy(), 1)
                np.add.at(depth, offsets[row] + ends.flatten().to_numpy(), -1)
                gone = np.cumsum(depth)[: len(flat)] > 0
                first, last = gone.copy(), gone.copy()
                first[1:] &= ~gone[:-1]
                last[:-1] &= ~gone[1:]
                inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(flat))]
                first[inner], last[inner - 1] = gone[inner], gone[inner - 1]
                a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
                home = np.searchsorted(offsets, a, "right") - 1
                spans = np.bincount(home, minlength=len(part))
                removed = np.concatenate(([0], np.cumsum(gone)))[offsets]
                kept, data = offsets - removed, flat[~gone]
                columns = [
                    part.column("id"), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), lists((a - offsets[home]).astype(np.int32), spans), lists((b - offsets[home]).astype(np.int32), spans),
                    pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]),
                ]
                if texts:
                    whole = data.tobytes()
                    columns.append(pa.array([whole[x:y].decode("utf-8", "ignore") for x, y in zip(kept[:-1], kept[1:])], pa.string()))
                names = ["id", "n_bytes", "n_removed", "span_begins", "span_ends", "kept", "kept_text"][: len(columns)]
                yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in kept_columns)], [*names, *kept_columns])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, texts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: its id, ``n_bytes``, ``n_removed``, the maximal removed runs (``span_begins``, ``span_ends``, in bytes) and the bytes kept (``kept``).

    ``texts`` adds ``kept_text``: what is left as text; a character that a cut goes through goes as a whole. ``keep`` names further columns to hand on.
    """
    spark = docs.sparkSession
    # Both joins read all columns of the dealt documents, so that they share one exchange.
    kept = {f"__keep{k}": name for k, name in enumerate(keep)}
    rows = clean(docs, id=id_col, text=text_col, **kept).withColumn("id", F.col("id").cast("long")).withColumn("text", F.coalesce("text", F.lit("")))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    tasks = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    buckets = 4 * tasks
    known = rows.filter("id IS NOT NULL")
    runs = known.select("id", "text").mapInArrow(tidy(_map_runs(length, gram, buckets)), _PACKED)
    spread = F.when(F.col("bucket") < 0, F.xxhash64("places")).otherwise(F.col("bucket").cast("long"))
    codes = runs.repartition(tasks, spread).mapInArrow(tidy(_meet_runs(hot)), _CODES).groupBy("id").agg(F.flatten(F.collect_list("codes")).alias("codes"))
    dealt = known.repartition(tasks, "id")
    contents = dealt.join(codes, "id").select("id", "text", "codes", *kept).mapInArrow(tidy(_map_contents(length, gram, buckets)), _PIECES)
    spans = contents.repartition(tasks, "bucket").mapInArrow(tidy(_meet_contents(length)), _SPANS)
    spans = spans.groupBy("id").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
    none = F.lit(None).cast("array<int>")
    every = dealt.join(spans, "id", "left").select("id", "text", "begins", "ends", *kept).union(rows.filter("id IS NULL").select("id", "text", none, none, *kept))
    own = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in kept)
    schema = "id long, n_bytes long, n_removed long, span_begins array<int>, span_ends array<int>, kept binary" + ", kept_text string" * texts + own
    out = every.mapInArrow(tidy(_cut(texts, list(kept))), schema).withColumnsRenamed(kept)
    return out.withColumnRenamed("id", id_col)


