"""N-gram Jaccard join by chosen paths.

Documents are sets of shingles (``words`` consecutive lower-cased words; a text of fewer words is one shingle). Equal
sets make one class of copies, which takes part once, by its smallest document.

A set's tokens are its minimum hashes under ``HASHES`` functions. A path is a sequence of tokens: sets begin at a root,
and each node of the recursion samples two functions by its own hash and hands every set in it to the two children that the set's tokens
name. Sets of similarity 0.8 agree on a token with probability 0.8, so their common path dies out in 3 levels with
probability 0.06; ``runs_for`` gives the number of independent roots for a target recall (3 for 0.999). A bucket of
at most ``BUCKET`` sets is compared by brute force; larger ones are split further; what is still large at the last
level holds sets that are alike indeed, and is compared in blocks.

Within a bucket, sets that agree on ``PLAUSIBLE`` of their tokens are tied by a spanning forest, not by all pairs. The
connected groups of this graph are compared exactly, on whole sets, each pair once (large groups in blocks): this gives
each document its number of links, and a spanning forest of the links gives the classes. Components are
found by joins alone; neither links nor components ever come to the driver.

Ids are integers; rows with a null id, and null and empty texts (which have no shingle) get no link and are their own class (null
for a null id). Repeated rows count as copies of each other. An empty table gives an empty result. Only the named columns are read,
whatever other columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import LOWER, clean, discard, expand, mix, prefix_hash, slices, span_hash, spans, stored, tidy

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
#: A group is compared in blocks of a quarter of ``BLOCK`` sets, so that no task gets much of a large one; groups of more than 8 such blocks
#: get larger blocks, up to ``BLOCK``, as each set is sent once for each block.
HASHES, DEPTH, BUCKET, BLOCK = 64, 3, 1000, 4096
#: Share of equal tokens from which two sets are compared exactly: four standard deviations below 0.8.
PLAUSIBLE = 0.6
#: Paths that may be told to all tasks, as each holds more than this part of all rows.
HOT_PATHS = 1000
_RNG = np.random.default_rng(77)
_XOR = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_MULTIPLY = _RNG.integers(0, 2**62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(recall: float, similarity: float = SIMILARITY, depth: int = DEPTH) -> int:
    """Independent roots needed so that a pair of this similarity meets in some last bucket with this probability."""
    lost = 0.0
    for _ in range(depth):
        lost = (1 - similarity + similarity * lost) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


# --- sets -------------------------------------------------------------------------------------------------------------


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles, one after the other, and the number per text."""
    flat = LOWER[flat]
    starts, ends, first = spans(flat, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = span_hash(prefix_hash(flat), starts, ends)
    n = np.diff(first)
    made = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    at = expand(first[:-1], made)
    row = np.repeat(np.arange(len(n)), made)
    shingle = np.zeros(len(at), np.uint64)
    for j in range(words):
        inside = at + j < first[row + 1]
        shingle = mix(shingle ^ np.where(inside, word[np.minimum(at + j, len(word) - 1)], np.uint64(j)))
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[new], np.bincount(row[new], minlength=len(n))


def signatures(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per set: the low 16 bits of its minimum hashes, and two 64-bit fingerprints of the whole set. Empty sets get zeros."""
    tokens = np.zeros((len(counts), HASHES), np.uint16)
    full = np.flatnonzero(counts)
    if len(full):
        heads = (np.cumsum(counts) - counts)[full]
        for k in range(HASHES):
            hashed = (values ^ _XOR[k]) * _MULTIPLY[k]
            tokens[full, k] = mix(np.minimum.reduceat(hashed, heads)).astype(np.uint16)
    return tokens, *fingerprints(values, counts)


def fingerprints(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        heads = (np.cumsum(counts) - counts)[full]
        one[full] = np.add.reduceat(mix(values), heads)
        two[full] = np.add.reduceat(mix(values ^ _XOR[0]), heads)
    return one, two


def _map_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, flat, offsets in slices(batch):
                values, counts = shingle_sets(flat, offsets, words)
                tokens, one, two = signatures(values, counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(counts.astype(np.int32)), _rows(tokens)],
                    ["id", "one", "two", "n", "tokens"],
                )

    return run


def _rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    width = matrix.shape[1] * matrix.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer((np.arange(len(matrix) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(matrix))])


# --- the recursion ----------------------------------------------------------------------------------------------------


def _children(path: Column, tokens: Column) -> Column:
    """The two paths that a set follows from a node: two different functions by the node's hash, and the set's tokens there."""
    first = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(HASHES))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(path, F.lit(2)), F.lit(HASHES - 1)), F.lit(HASHES))
    return F.array(*(F.xxhash64(path, k, F.substring(tokens, (2 * k + 1).cast("int"), F.lit(2))) for k in (first, second)))


def _buckets(sets: DataFrame, runs: int, depth: int, bucket: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """(path, size, id, tokens) of all buckets with more than one set at which the recursion ends, and the tables behind them."""
    step = sets.select("id", "tokens", F.explode(F.flatten(F.array(*(_children(F.lit(-1 - r).cast("long"), F.col("tokens")) for r in range(runs))))).alias("path"))
    rows = sets.count() * 2 * runs
    ended, tables, children = None, [], None
    for level in range(1, depth + 1):
        met = stored(_met(step, max(bucket, rows // HOT_PATHS)), "paths")
        tables.append(met)
        if children is not None:
            discard(children)
        small = met if level == depth else met.filter(F.col("size") <= bucket)
        ended = small if ended is None else ended.union(small)
        large = met.filter(F.col("size") > bucket)
        if level == depth or large.isEmpty():
            break
        # Two rows for each: written, as they are read for the sizes, the hot paths' rows and the others'.
        step = children = stored(large.select("id", "tokens", F.explode(_children(F.col("path"), F.col("tokens"))).alias("path")), "children")
        rows = children.count()
    return ended, tables


def _met(step: DataFrame, most: int) -> DataFrame:
    """The rows whose path others share, with the number of its rows.

    Paths of more than ``most`` rows, at most ``HOT_PATHS`` of them, are told to all tasks, so that their rows stay where
    they are; the rows of all others meet by path.
    """
    sizes = step.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    hot = sizes.filter(F.col("size") > most).withColumnRenamed("size", "hot")
    told = step.join(F.broadcast(hot), "path", "left")
    stay = told.filter("hot IS NOT NULL").select("path", F.col("hot").alias("size"), "id", "tokens")
    return stay.union(told.filter("hot IS NULL").drop("hot").join(sizes, "path").select("path", "size", "id", "tokens"))


def _blocks(size: Column, block: int) -> Column:
    return F.ceil(size / F.least(F.lit(float(block)), F.greatest(F.lit(block / 4), size / 8)))


def _units(df: DataFrame, key: str, blocks: Column, member: str) -> DataFrame:
    """Groups of one block as they are; larger ones as pairs of blocks. Adds ``unit`` (a hash of group and pair), ``side`` (0: first, 1: second block; 2: both)."""
    own = F.pmod(F.xxhash64(member, F.lit(5)), F.col("blocks"))
    pair = lambda other: F.struct(F.xxhash64(F.col(key), F.least("own", other), F.greatest("own", other)).alias("unit"), F.when(F.col("own") == other, 2).when(F.col("own") < other, 0).otherwise(1).alias("side"))
    df = df.withColumn("blocks", blocks.cast("long")).withColumn("own", own)
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), pair)
    one = F.array(F.struct(F.xxhash64(F.col(key), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("unit"), F.lit(2).alias("side")))
    return df.withColumn("part", F.explode(F.when(F.col("blocks") > 1, many).otherwise(one))).select("*", "part.unit", "part.side").drop("part", "own", "blocks")


def _by_unit(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray | list]]:
    """The rows of one unit after the other, of input that is sorted by unit."""
    held, last = [], None
    for batch in batches:
        unit = batch.column("unit").to_numpy()
        cut = np.flatnonzero(np.diff(unit)) + 1
        for a, b in zip([0, *cut], [*cut, len(unit)]):
            if a == b:
                continue
            if unit[a] != last and held:
                yield _joined(held, names)
                held = []
            held.append(batch.slice(a, b - a))
            last = unit[a]
    if held:
        yield _joined(held, names)


def _joined(parts: list[pa.RecordBatch], names: list[str]) -> dict:
    out = {}
    for n in names:
        column = pa.concat_arrays([p.column(n) for p in parts]) if len(parts) > 1 else parts[0].column(n)
        out[n] = column if pa.types.is_binary(column.type) else column.to_numpy(zero_copy_only=False)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per node the smallest node of its component, of a graph on 0 .. n-1 given by blocks of pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (jump := root[root] != root).any():
                root[jump] = root[root[jump]]
            live = root[a] != root[b]
            a, b = a[live], b[live]
    return root


def _tie(plausible: float):
    """Per bucket, edges of a spanning forest of the sets that agree on enough tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        need = math.ceil(plausible * HASHES)
        for unit in _by_unit(batches, ["id", "side", "tokens"]):
            ids, tokens, side = unit["id"], _matrix(unit["tokens"]), unit["side"]

            def pairs(tokens=tokens, side=side):
                n = len(tokens)
                step = max(1, 4_000_000 // max(n, 1) // 8)
                for a in range(0, n, step):
                    agree = np.zeros((min(step, n - a), n), np.uint8)
                    for k in range(HASHES):
                        agree += tokens[a : a + step, k, None] == tokens[None, :, k]
                    x, y = np.nonzero(agree >= need)
                    x = x + a
                    fine = (x < y) & ((side[x] != side[y]) | (side[x] == 2))
                    yield x[fine], y[fine]

            root = forest(len(ids), pairs())
            tied = np.flatnonzero(root != np.arange(len(ids)))
            out_a.append(ids[tied])
            out_b.append(ids[root[tied]])
            if sum(map(len, out_a[-64:])) > 20_000 or len(out_a) > 5_000:
                yield _edges(out_a, out_b)
                out_a, out_b = [], []
        if out_a:
            yield _edges(out_a, out_b)

    return run


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


# --- components ------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every node that an edge (a, b) touches: the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label's own label; every round is a table in
    the shared folder. Only the number of changes comes to the driver.
    """
    both = stored(edges.distinct().select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v"), "edges")
    last = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("label")), "labels")
    while True:
        labels = last.select("v", "label")
        near = both.join(labels, "v").groupBy("u").agg(F.min("label").alias("near")).withColumnRenamed("u", "v")
        lower = labels.join(near, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        after = stored(lower.join(jump, "label").select("v", "was", F.least("label", "further").alias("label")), "labels")
        discard(last)
        last = after
        if after.filter("label <> was").isEmpty():
            discard(both)
            return after.select("v", "label")


# --- exact comparison ------------------------------------------------------------------------------------------------


def _map_members(words: int):
    """The sets of the documents that stand for a class of copies, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, flat, offsets in slices(batch):
                values, counts = shingle_sets(flat, offsets, words)
                one, two = fingerprints(values, counts)
                own = (one.view(np.int64) == part.column("one").to_numpy()) & (two.view(np.int64) == part.column("two").to_numpy())
                ends = np.concatenate(([0], np.cumsum(counts))) * 8
                sets = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "copies", "unit", "side")), sets], ["id", "copies", "unit", "side", "shingles"])
                yield out.filter(pa.array(own))

    return run


def overlaps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The matrix of common elements of every two sets: rare elements by pairs of their few owners, common ones as products."""
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    heads = np.flatnonzero(new)
    owners = np.diff(np.append(heads, len(values)))
    rare = (owners > 1) & (owners <= 12)
    for d in range(1, 12):  # owners that stand d places apart
        has = rare & (owners > d)
        at = expand(heads[has], owners[has] - d)
        np.add.at(out, (row[at], row[at + d]), 1)
    out += out.T
    common = np.flatnonzero(owners > 12)
    for k in range(0, len(common), 1024):
        part = common[k : k + 1024]
        x = np.zeros((n, len(part)), np.float32)
        x[row[expand(heads[part], owners[part])], np.repeat(np.arange(len(part)), owners[part])] = 1
        out += x @ x.T
    return out


def _compare(similarity: float):
    """Per unit: each set's links within it, counted by documents, and a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _by_unit(batches, ["id", "copies", "side", "shingles"]):
            ids, at = np.unique(unit["id"], return_index=True)
            copies, side = unit["copies"][at], unit["side"][at]
            sets = unit["shingles"].take(pa.array(at))
            counts = np.diff(np.frombuffer(sets.buffers()[1], np.int32)[: len(at) + 1]).astype(np.int64) // 8
            common = overlaps(np.frombuffer(b"".join(sets.to_pylist()), np.uint64), counts)
            total = counts[:, None] + counts[None, :]
            linked = common * (1 + similarity) >= similarity * total - 1e-3  # overlap / union >= similarity, on whole numbers
            linked &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
            np.fill_diagonal(linked, False)
            links = linked @ copies.astype(np.int64)
            x, y = np.nonzero(np.triu(linked))
            root = forest(len(ids), iter([(x, y)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links, pa.int64()), pa.array(ids[root])], ["id", "links", "root"])

    return run


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Per document: its id, ``class_id`` (the smallest id that links lead to) and ``n_links`` (other documents of this similarity or more)."""
    spark = docs.sparkSession
    rows = clean(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    described = rows.mapInArrow(tidy(_map_sets(words)), "id long, one long, two long, n int, tokens binary")
    sets = stored(described, "sets")
    classes = sets.filter("n > 0 AND id IS NOT NULL").groupBy("one", "two").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = stored(classes, "classes")

    ended, paths = _buckets(classes, runs_for(recall, similarity), DEPTH, bucket, block)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = _units(ended, "path", _blocks(F.col("size"), block), "id").select("unit", "side", "id", "tokens")
    tied = units.repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(tidy(_tie(PLAUSIBLE)), "a long, b long")
    groups = components(tied)
    discard(*paths)

    members = groups.join(classes.select(F.col("id").alias("v"), "one", "two", "copies", "n"), "v")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    members = members.join(sizes, "label").select(F.col("v").alias("id"), "label", "one", "two", "copies", F.greatest(_blocks(F.col("size"), block), F.ceil(F.col("total") / 4_000_000)).alias("spread"))
    units = _units(members, "label", F.col("spread"), "id").select("id", "one", "two", "copies", "unit", "side")
    wholes = rows.join(units, "id").select("id", "text", "one", "two", "copies", "unit", "side")
    compared = wholes.mapInArrow(tidy(_map_members(words)), "id long, copies long, unit long, side int, shingles binary").repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(tidy(_compare(similarity)), "id long, links long, root long")
    compared = stored(compared, "links")

    found = components(compared.filter("root <> id").select(F.col("root").alias("a"), F.col("id").alias("b")))
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.select("id", "one", "two", "copies").join(links, "id", "left").join(found.withColumnRenamed("v", "id"), "id", "left")
    of_class = of_class.select("one", "two", F.coalesce("label", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    keyed = sets.withColumn("real", (F.col("n") > 0) & F.col("id").isNotNull())
    out = keyed.filter("real").join(of_class, ["one", "two"]).select("id", "class_id", "n_links")
    alone = keyed.filter("NOT real").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(alone).withColumnRenamed("id", id_col)
