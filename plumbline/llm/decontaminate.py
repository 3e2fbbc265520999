"""Benchmark decontamination by a prefix-filtered join of word windows.

Every item gives windows of ``window`` consecutive words (one window of all words, if it has fewer). A window's shingles
are its pairs of neighbouring words (its word, if it has one), in order of their rarity in all documents. To contain a
window, a document must contain every shingle of it, so the rarest one is prefix enough: each place of a document that
holds some window's rarest shingle is a candidate. The length bound (the window must fit into the document around that
place) and the positional bound (its other words must be item words) drop candidates; the rest are compared word
by word, exactly.

The benchmark is a stated query set: it is read in blocks of at most ``block_words`` words (so a block's index has
a known size) and every block meets all documents. A document's hits are united over the blocks, by id and digest of the text: rows that
agree in both have equal hits, and are given back as often as they came.

Words are the maximal runs of bytes outside ASCII punctuation, blanks and controls, with A-Z lower-cased. Null and
empty texts have no words: such items give no window and such documents no hit. Repeated items count once, by their id;
an empty table on either side gives no hits. Only the named columns are read, whatever other columns are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.textkit import clean, lists, slices, tidy

WINDOW = 8
#: Words of items whose index a task holds at once.
BLOCK_WORDS = 500_000
# Fixed values of the word rule: letters a-z (after lower-casing), digits, and all bytes of non-ASCII characters.
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class WindowIndex:
    """The windows of a block of items, and how to find them in word sequences."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        numbers: dict[object, int] = {}
        owners = [numbers.setdefault(i, len(numbers)) for i, _ in items]  # an item that is listed twice is one item
        self.items, self.vocabulary = list(numbers), {}
        held: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for k, (_, text) in zip(owners, items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                held[tuple(ids[at : at + window])].add(k)
        self.base = len(self.vocabulary) + 1  # the last code stands for "no second word"
        self.sizes = np.array([len(w) for w in held], np.int64)
        self.windows = np.full((len(held), window), -2, np.int64)
        for row, w in enumerate(held):
            self.windows[row, : len(w)] = w
        self.owners = [np.array(sorted(x), np.int64) for x in held.values()]
        pairs = self._pairs(self.windows)
        self.shingles = np.unique(pairs[pairs >= 0])

    def _pairs(self, windows: np.ndarray) -> np.ndarray:
        """Per window and place, the code of the shingle there, or -1."""
        first, second = windows[:, :-1], windows[:, 1:]
        out = np.where((first >= 0) & (second >= 0), first * self.base + second, -1)
        lone = windows[:, 1] < 0 if windows.shape[1] > 1 else np.ones(len(windows), bool)
        if windows.shape[1] == 1:
            return windows * self.base + self.base - 1
        out[lone, 0] = windows[lone, 0] * self.base + self.base - 1
        return out

    def encoded(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The item-word ids of texts one after the other (-1 for others), with a -1 behind each text; and the words per text."""
        data, get = flat.tobytes().translate(_TABLE), self.vocabulary.get
        parts, counts = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            ws = data[a:b].split()
            parts.append(np.fromiter((get(w, -1) for w in ws), np.int64, len(ws)))
            parts.append(_BREAK)
            counts.append(len(ws))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(counts, np.int64)

    def places(self, ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the ids a wanted shingle stands, and its index among the wanted (sorted) ones."""
        if not len(wanted) or not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids >= 0
        two = np.flatnonzero(known[:-1] & known[1:])
        codes = [ids[two] * self.base + ids[two + 1]]
        at = [two]
        if (wanted % self.base == self.base - 1).any():
            one = np.flatnonzero(known)
            at.append(one)
            codes.append(ids[one] * self.base + self.base - 1)
        at, codes = np.concatenate(at), np.concatenate(codes)
        found = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
        hit = wanted[found] == codes
        return at[hit], found[hit]

    def order(self, counts: np.ndarray) -> None:
        """Takes the number of documents' occurrences per shingle and picks each window's rarest one as its prefix."""
        pairs = self._pairs(self.windows)
        rank = np.where(pairs >= 0, counts[np.searchsorted(self.shingles, np.maximum(pairs, 0)).clip(0, max(len(counts) - 1, 0))] if len(counts) else 0, np.iinfo(np.int64).max)
        self.place = rank.argmin(axis=1) if len(rank) else np.zeros(0, np.int64)
        chosen = pairs[np.arange(len(pairs)), self.place] if len(pairs) else np.zeros(0, np.int64)
        by = np.argsort(chosen, kind="stable")
        self.prefixes, starts = np.unique(chosen[by], return_index=True)
        self.by_prefix, self.starts = by, np.append(starts, len(by))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows in the ids, and which windows they are."""
        at, prefix = self.places(ids, self.prefixes)
        starts, rows = [], []
        counts = np.diff(self.starts)[prefix]
        for k in range(int(counts.max()) if len(counts) else 0):  # the k-th window of each prefix, for all places at once
            here = counts > k
            row = self.by_prefix[self.starts[prefix[here]] + k]
            start, size = at[here] - self.place[row], self.sizes[row]
            fits = (start >= 0) & (start + size <= len(ids))
            start, row, size = start[fits], row[fits], size[fits]
            for j in range(self.windows.shape[1]):
                same = (size <= j) | (ids[np.minimum(start + j, len(ids) - 1)] == self.windows[row, j])
                start, row, size = start[same], row[same], size[same]
            starts.append(start)
            rows.append(row)
        return (np.concatenate(starts), np.concatenate(rows)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_BREAK = np.array([-1], np.int64)


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of a bounded number of words (one item at least), read through an iterator over partitions."""
    block, size = [], 0
    for item, text in benchmark.select("id", "text").toLocalIterator():
        data = (text or "").encode()
        n = len(data) // 2 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((item, data))
        size += n
    if block:
        yield block


def _count(spark: SparkSession, docs: DataFrame, index) -> np.ndarray:
    """Occurrences of the block's shingles in all documents: as many numbers as the block has shingles, whatever the documents are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        total = np.zeros(len(own.shingles), np.int64)
        for batch in batches:
            for _, flat, offsets in slices(batch):
                _, found = own.places(own.encoded(flat, offsets)[0], own.shingles)
                total += np.bincount(found, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    out = np.zeros(len(index.value.shingles), np.int64)
    for k, n in docs.select("text").mapInArrow(tidy(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[k] = n
    return out


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: its id, ``n_words``, ``hit_spans`` (array of start and end, in words, of maximal hit runs) and ``items`` (ids of items with occurring windows)."""
    spark = docs.sparkSession
    rows = clean(docs, id=id_col, text=text_col)
    items = clean(benchmark, id=item_col, text=item_text_col)
    kind, item_kind = rows.schema["id"].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, begins array<int>, ends array<int>, items array<{item_kind}>"
    item_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    indexes = []
    for block in item_blocks(items, block_words):
        index = WindowIndex(block, window)
        index.order(_count(spark, rows, spark.sparkContext.broadcast(index)))
        indexes.append(spark.sparkContext.broadcast(index))
    spans = F.transform(F.arrays_zip("begins", "ends"), lambda x: F.struct(x["begins"].alias("begin"), x["ends"].alias("end")))
    if len(indexes) < 2:
        index = indexes[0] if indexes else spark.sparkContext.broadcast(_ordered(WindowIndex([], window)))
        return rows.mapInArrow(tidy(_finder(index, item_type)), schema).select(F.col("id").alias(id_col), "n_words", spans.alias("hit_spans"), "items")
    rows, schema = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)), f"{schema}, digest string"
    every = reduce(DataFrame.union, [rows.mapInArrow(tidy(_finder(index, item_type)), schema) for index in indexes])
    united = every.groupBy("id", "digest").agg(
        (F.count("*") / len(indexes)).cast("int").alias("times"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set(spans))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    start = F.lit(None).cast("struct<begin:int,end:int>")
    merged = F.aggregate(
        "spans",
        F.struct(F.array().cast("array<struct<begin:int,end:int>>").alias("done"), start.alias("last")),
        lambda acc, x: F.when(acc["last"].isNull(), F.struct(acc["done"].alias("done"), x.alias("last")))
        .when(x["begin"] <= acc["last"]["end"], F.struct(acc["done"].alias("done"), F.struct(acc["last"]["begin"].alias("begin"), F.greatest(acc["last"]["end"], x["end"]).alias("end")).alias("last")))
        .otherwise(F.struct(F.concat(acc["done"], F.array(acc["last"])).alias("done"), x.alias("last"))),
        lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))),
    )
    return united.select(F.col("id").alias(id_col), "n_words", merged.alias("hit_spans"), "items")


def _ordered(index: WindowIndex) -> WindowIndex:
    index.order(np.zeros(len(index.shingles), np.int64))
    return index


def _finder(index, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        names = pa.array(own.items, item_type)
        for batch in batches:
            for part, flat, offsets in slices(batch):
                ids, counts = own.encoded(flat, offsets)
                first = np.concatenate(([0], np.cumsum(counts + 1)))  # where each text's words begin among the ids
                starts, rows = own.hits(ids)
                depth = np.zeros(len(ids) + 1, np.int64)
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + own.sizes[rows], -1)
                hit = np.cumsum(depth)[: len(ids)] > 0
                hit[first[1:] - 1] = False
                edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
                begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                doc_of = np.searchsorted(first, begins, "right") - 1
                runs = np.bincount(doc_of, minlength=len(counts))
                docs = np.searchsorted(first, starts, "right") - 1
                pairs = {(d, k) for d, r in set(zip(docs.tolist(), rows.tolist())) for k in own.owners[r].tolist()}
                pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
                more = [x for x in part.schema.names if x == "digest"]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(counts, pa.int64()), lists((begins - first[doc_of]).astype(np.int32), runs), lists((ends - first[doc_of]).astype(np.int32), runs),
                        lists(names.take(pa.array(pairs[:, 1])), np.bincount(pairs[:, 0], minlength=len(counts))),
                        *(part.column(x) for x in more),
                    ],
                    ["id", "n_words", "begins", "ends", "items", *more],
                )

    return run
