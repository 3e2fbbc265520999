"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its whole text (shares of kinds of bytes, word and line shapes,
repetition). Preference pairs set a good document against a bad one; the chance that the good one wins is the logistic
function of the difference of strengths, so learning is logistic loss on feature differences, over all pairs of a good and a bad
labelled document that is not held out. The loss of all pairs follows from sums over narrow bins of strengths, which tasks
make of a table of features. The threshold is the quantile of all their strengths that cuts off as many as are bad; scores are scaled so that it
lies at ``CUT``.

Texts may be null or empty (no bytes: all shares zero) or of any length; they are scored as they are. With labels of one
class or none, every score is the share of good labels (0.5 without labels). Rows repeat as they come; only the named
columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import labelled
from plumbline.llm.textkit import clean, discard, mix, prefix_hash, slices, span_hash, spans, stored, tidy

CUT = 0.3
#: Bins of strengths, their width (what counts within a bin is its mean), and how many share sums of products.
BINS, WIDTH, COARSE = 1024, 0.05, 32
#: Strengths about a quantile that may come to the driver.
FEW = 1000
_SYMBOLS = b"%*#$&!|~^_=+<>{}[]@\\/"
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of distinct values and the count of the most frequent one."""
    distinct, most = np.zeros(rows), np.zeros(rows)
    if len(row):
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        heads = np.flatnonzero(new)
        distinct += np.bincount(row[heads], minlength=rows)
        np.maximum.at(most, row[heads], np.diff(np.append(heads, len(row))))
    return distinct, most


def features(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    bytes_of = np.bincount(row * 256 + flat, minlength=n * 256).reshape(n, 256).astype(float)
    per_byte = 1 / np.maximum(size, 1)
    share = lambda *which: bytes_of[:, list(which)].sum(axis=1) * per_byte
    starts, ends, first = spans(flat, offsets)
    words = np.diff(first)
    per_word = 1 / np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    hashed = span_hash(prefix_hash(flat), starts, ends)
    three = np.zeros(0, np.uint64)
    inner = np.zeros(0, np.int64)
    if len(starts) > 2:
        inner = np.flatnonzero(owner[2:] == owner[:-2])
        three = mix(hashed[inner] ^ mix(hashed[inner + 1] ^ mix(hashed[inner + 2])))
    distinct, most = _distinct(owner, hashed, n)
    distinct_three, most_three = _distinct(owner[inner], three, n)
    threes = np.maximum(np.bincount(owner[inner], minlength=n), 1)
    odd_end = np.isin(flat[ends - 1], np.frombuffer(_SYMBOLS, np.uint8)) if len(ends) else np.zeros(0, bool)
    lengths = (ends - starts).astype(float)
    line_starts, line_ends, line_first = spans(flat, offsets, _LINE)
    lines = np.diff(line_first)
    line_owner = np.repeat(np.arange(n), lines)
    distinct_lines, _ = _distinct(line_owner, span_hash(prefix_hash(flat), line_starts, line_ends), n)
    per_line = 1 / np.maximum(lines, 1)
    sums = lambda values, at: np.bincount(at, weights=values, minlength=n)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines),
        share(*range(65, 91)), share(*range(97, 123)), share(*range(48, 58)), share(*range(128, 256)), share(32), share(*_SYMBOLS), share(ord("!")), share(ord("|")), share(*b".,;:"), share(*b"\"'()-?"), share(*range(0, 9)),
        sums(lengths, owner) * per_word, sums((lengths == 1).astype(float), owner) * per_word, sums((lengths > 20).astype(float), owner) * per_word, sums(odd_end.astype(float), owner) * per_word,
        distinct * per_word, most * per_word, distinct_three / threes, most_three / threes,
        distinct_lines * per_line, sums((line_ends - line_starts < 40).astype(float), line_owner) * per_line, (words < 5).astype(float), (words < 20).astype(float),
    ])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / scale, -8, 8)


class Sums:
    """What all pairs of examples need of the examples: for each class, the strengths in bins of ``WIDTH`` (what lies beyond joins the outer bins).

    ``first`` has for each bin the number of examples and the sums of their strengths, of their standardised features and of the features
    times the strength, ``second`` for each ``COARSE`` bins the sum of the features' products.
    """

    def __init__(self, features: int):
        self.first = np.zeros((2, BINS // COARSE, COARSE, 2 + 2 * features))
        self.second = np.zeros((2, BINS // COARSE, features, features))

    def add(self, z: np.ndarray, strength: np.ndarray, y: np.ndarray) -> None:
        place = y.astype(np.int64) * BINS + np.clip(np.floor(strength / WIDTH) + BINS // 2, 0, BINS - 1).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, z, strength = place[order], z[order], strength[order]
        heads = np.flatnonzero(np.diff(place, prepend=-1))
        if len(heads):
            self.first.reshape(2 * BINS, -1)[place[heads]] += np.add.reduceat(np.column_stack([np.ones(len(z)), strength, z, z * strength[:, None]]), heads)
        names, begins = np.unique(place // COARSE, return_index=True)
        for name, low, high in zip(names, begins, [*begins[1:], len(z)]):
            self.second.reshape(-1, *self.second.shape[2:])[name] += z[low:high].T @ z[low:high]

    def packed(self) -> list[tuple[int, bytes]]:
        """The parts that are not empty: number and bytes."""
        first, second = (x.reshape(2 * BINS // COARSE, -1) for x in (self.first, self.second))
        return [(int(k), np.concatenate((first[k], second[k])).tobytes()) for k in np.flatnonzero(self.first[..., 0].sum(axis=2).ravel())]

    def take(self, part: int, data: bytes) -> None:
        first, second = (x.reshape(2 * BINS // COARSE, -1) for x in (self.first, self.second))
        values = np.frombuffer(data)
        first[part] += values[: first.shape[1]]
        second[part] += values[first.shape[1] :]

    def means(self, y: int) -> tuple[np.ndarray, ...]:
        """Of a class's bins that are not empty: their places, numbers, mean strengths, sums of features, and of these times the strength's distance to the mean."""
        rows = self.first[y].reshape(BINS, -1)
        at = np.flatnonzero(rows[:, 0])
        mean, (z, times) = rows[at, 1] / rows[at, 0], np.split(rows[at, 2:], 2, axis=1)
        return at, rows[at, 0], mean, z, times - mean[:, None] * z

    def slopes(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the mean logistic loss over all pairs of a good and a bad example.

        The chance that a pair's bad one wins is taken as linear in the strengths within two bins. In the Hessian it is that of the bins' means, and features
        vary within a bin as they do among its ``COARSE`` neighbours.
        """
        (at_good, n_good, s_good, z_good, d_good), (at_bad, n_bad, s_bad, z_bad, d_bad) = self.means(1), self.means(0)
        p = _logistic(s_bad[None, :] - s_good[:, None])  # the chance that the bad one wins
        q = p * (1 - p)
        pairs = n_good.sum() * n_bad.sum()
        gradient = ((p.T @ n_good) @ z_bad + (q.T @ n_good) @ d_bad - (p @ n_bad) @ z_good + (q @ n_bad) @ d_good) / pairs
        cross = z_good.T @ q @ z_bad
        hessian = -cross - cross.T
        for y, at, n, z, each in ((1, at_good, n_good, z_good, q @ n_bad), (0, at_bad, n_bad, z_bad, q.T @ n_good)):
            hessian += (z * (each / n)[:, None]).T @ z
            for k in np.unique(at // COARSE):
                own = at // COARSE == k
                within = self.second[y, k] - (z[own] / n[own, None]).T @ z[own]
                hessian += within * (each[own] @ n[own] / n[own].sum())
        return gradient, hessian / pairs


class Examples:
    """Labelled features in memory."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    def moments(self) -> tuple[int, int, np.ndarray, np.ndarray]:
        """The numbers of bad and good examples, means and deviations of the features."""
        if not len(self.y):
            return 0, 0, np.zeros(0), np.zeros(0)
        return int((self.y == 0).sum()), int((self.y == 1).sum()), self.x.mean(axis=0), self.x.std(axis=0)

    def sums(self, centre: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Sums:
        out, z = Sums(len(w)), _standard(self.x, centre, scale)
        out.add(z, z @ w, self.y)
        return out

    def at_ranks(self, centre: np.ndarray, scale: np.ndarray, w: np.ndarray, rank: int) -> tuple[float, float]:
        """The strengths at a rank and the one after it."""
        return tuple(np.sort(_standard(self.x, centre, scale) @ w)[rank : rank + 2])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


class SharedExamples:
    """Labelled features as a table (label, x) in the shared folder, of which only sums come to the driver."""

    def __init__(self, table: DataFrame):
        self.table = table

    def moments(self) -> tuple[int, int, np.ndarray, np.ndarray]:
        counts = {r.label: r["count"] for r in self.table.groupBy("label").count().collect()}
        n = sum(counts.values())
        if not n:
            return 0, 0, np.zeros(0), np.zeros(0)

        def total(of):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sums = [of(_matrix(batch.column("x"))).sum(axis=0) for batch in batches if len(batch)]
                if sums:
                    yield pa.RecordBatch.from_arrays([pa.array([np.sum(sums, axis=0).tobytes()])], ["sums"])

            return np.sum([np.frombuffer(r.sums) for r in self.table.mapInArrow(tidy(run), "sums binary").collect()], axis=0) / n

        centre = total(lambda x: x)
        return counts.get(0, 0), counts.get(1, 0), centre, np.sqrt(total(lambda x: (x - centre) ** 2))

    def sums(self, centre: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Sums:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Sums(len(w))
            for batch in batches:
                if len(batch):
                    z = _standard(_matrix(batch.column("x")), centre, scale)
                    own.add(z, z @ w, batch.column("label").to_numpy())
            for part, data in own.packed():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data])], ["part", "data"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Sums(len(w))
            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                    own.take(part, data)
            for part, data in own.packed():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data])], ["part", "data"])

        schema, out = "part int, data binary", Sums(len(w))
        for r in self.table.mapInArrow(tidy(add), schema).repartition(8, "part").mapInArrow(tidy(meet), schema).collect():
            out.take(r.part, bytes(r.data))
        return out

    def at_ranks(self, centre: np.ndarray, scale: np.ndarray, w: np.ndarray, rank: int) -> tuple[float, float]:
        """The strengths at a rank and the one after it: counts in bins, and in bins of these bins, till few values are left."""

        def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(_standard(_matrix(batch.column("x")), centre, scale) @ w)], ["s"])

        every = stored(self.table.mapInArrow(tidy(strengths), "s double"), "strengths")
        values, skip = every, rank
        while True:
            low, high, n = values.agg(F.min("s"), F.max("s"), F.count(F.lit(1))).head()
            if n <= FEW or low == high:
                break
            place = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
            counts = dict(values.groupBy(place.alias("k")).count().collect())
            at, before = 0, 0
            while before + counts.get(at, 0) <= skip:
                before, at = before + counts.get(at, 0), at + 1
            if counts[at] == n:  # differences too small for bins
                break
            values, skip = values.filter(place == at), skip - before
        # Each distinct value once with its number of rows, which are few: or values that no double tells apart within the bin.
        found = sorted(values.groupBy("s").count().collect())
        reached = np.cumsum([r["count"] for r in found])
        k = int(np.searchsorted(reached, skip, "right"))
        here = found[k].s
        if reached[k] > skip + 1:
            after = here
        else:
            after = every.filter(F.col("s") > here).agg(F.min("s")).head()[0]
        discard(every)
        return here, here if after is None else after


def fit(x: np.ndarray, y: np.ndarray, bad_share: float, ridge: float = 1e-3, steps: int = 60) -> dict[str, np.ndarray | float]:
    """The model of labelled features in memory."""
    return fit_all(Examples(x, y), bad_share, ridge, steps)


def fit_all(examples: Examples | SharedExamples, bad_share: float, ridge: float = 1e-3, steps: int = 60) -> dict[str, np.ndarray | float]:
    """Weights by Newton steps on the logistic loss over all pairs; then threshold and scale."""
    bad, good, centre, scale = examples.moments()
    if not good or not bad:
        return {"constant": float(1 - bad_share) if good or bad else 0.5}
    scale = scale + 1e-9
    w = np.zeros(len(centre))
    for _ in range(steps):
        gradient, hessian = examples.sums(centre, scale, w).slopes()
        step = np.linalg.solve(hessian + ridge * np.eye(len(w)), gradient + ridge * w)
        w = w - step * min(1, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    # The quantile: as many strengths lie below the threshold as there are bad examples.
    threshold = float(sum(examples.at_ranks(centre, scale, w, min(bad - 1, bad + good - 2)))) / 2
    sums, slope, bias = examples.sums(centre, scale, w), 1.0, np.log(CUT / (1 - CUT))
    (_, n_good, s_good, *_), (_, n_bad, s_bad, *_) = sums.means(1), sums.means(0)
    target, centred = np.repeat([1.0, 0.0], [len(n_good), len(n_bad)]), np.concatenate((s_good, s_bad)) - threshold
    weight = np.concatenate((n_good, n_bad)) / (good + bad)
    for _ in range(50):  # the slope that fits the labels best
        p = _logistic(slope * centred + bias)
        g, h = (weight * (p - target) * centred).sum(), (weight * p * (1 - p) * centred**2).sum() + 1e-9
        slope = float(np.clip(slope - g / h, 0.05, 20))
    return {"centre": centre, "scale": scale, "weights": w, "threshold": threshold, "slope": slope}


def score(x: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    strength = _standard(x, model["centre"], model["scale"]) @ model["weights"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (strength - model["threshold"]) + np.log(CUT / (1 - CUT)), -700, 700)))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, whether it has a text (``known``), and its features (``x``, doubles as bytes), as a table in the shared folder."""
    rows = clean(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, flat, offsets in slices(batch):
                x = np.ascontiguousarray(features(flat, offsets))
                ends = (np.arange(len(x) + 1) * x.shape[1] * 8).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text").is_valid(), pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])], ["id", "known", "x"])

    return stored(rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, known boolean, x binary"), "features")


def learn(table: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> dict:
    """The model of all labelled documents of a table that ``described`` has made, without those held out."""
    known = labelled.known(labels, label_col, id_col)
    examples = stored(table.filter("known").select("id", "x").join(known, "id").select("label", "x"), "examples")
    model = fit_all(SharedExamples(examples), 1 - labelled.share(labels, label_col, id_col))
    discard(examples)
    return model


def judge(table: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """Per document of a table that ``described`` has made: its id and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score(_matrix(batch.column("x")), model))], ["id", "score"])

    return table.mapInArrow(tidy(run), f"id {table.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> dict:
    table = described(docs, id_col, text_col)
    model = learn(table, labels, label_col, id_col)
    discard(table)
    return model


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id and its score."""
    return judge(described(docs, id_col, text_col), model, id_col)
