"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words and word stems of the whole text (lower-cased, present or not). The words are those of the labelled sample
whose presence tells the classes apart, found by a grouped aggregation, and all identity terms with their stems. For every labelled
sentence with an identity term, copies of the sentence with the other terms of its group (or a neutral word) in its place are its
counterfactuals; the squared change of the score's logit under each swap is added to the loss. A swap takes away the word and
the stem of one term and brings those of another, so the penalty is a quadratic form in the weights of up to four features, counted over all
labelled sentences. It keeps the mention of a group as such from counting as toxic. Terms that no sentence mentions are swapped in only.

Null and empty texts have no words and get the score of the intercept. Very long texts are read whole, in slices of whole
texts. With labels of one class or none, every score is the share of toxic labels (0 without labels). Rows repeat as they
come; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import labelled
from plumbline.llm.textkit import LOWER, clean, discard, lists, mix, prefix_hash, slices, span_hash, spans, stored, tidy

# Identity terms by group (English, German, French, Spanish); the first of each group is neutral.
IDENTITY = (
    ("people", "women", "men", "woman", "man", "girls", "boys", "transgender", "female", "male"),
    ("person", "gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("believers", "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "atheist", "catholic", "protestant"),
    ("citizens", "black", "white", "asian", "latino", "african", "american", "european", "mexican", "chinese", "indian", "arab", "immigrants", "refugees"),
    ("adults", "old", "young", "elderly", "deaf", "blind", "disabled"),
    ("menschen", "frauen", "männer", "juden", "muslime", "christen", "schwarze", "weiße", "ausländer", "schwule", "lesben"),
    ("gens", "femmes", "hommes", "juifs", "musulmans", "chrétiens", "noirs", "blancs", "étrangers", "homosexuels", "arabes"),
    ("personas", "mujeres", "hombres", "judíos", "musulmanes", "cristianos", "negros", "blancos", "extranjeros", "gays", "lesbianas"),
)
#: Words that the model may use besides identity terms, and the weight of the counterfactual penalty.
VOCABULARY, COUNTERFACTUAL = 4_000, 5.0
#: Likelihood ratio from which a word counts as telling the classes apart.
EVIDENCE = 16.0
#: Bytes of a stem: longer words also count by their beginning.
STEM = 6
_NO_WORD = np.ones(256, bool)
_NO_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True


def _hash(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data])
    return span_hash(prefix_hash(np.frombuffer(b"".join(data), np.uint8)), ends - [len(d) for d in data], ends)


def present(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place of each word, then of each stem."""
    flat = LOWER[flat]
    starts, ends, first = spans(flat, offsets, _NO_WORD)
    row, prefix = np.repeat(np.arange(len(offsets) - 1), np.diff(first)), prefix_hash(flat)
    long = np.flatnonzero(ends - starts > STEM)
    stems = mix(span_hash(prefix, starts[long], starts[long] + STEM) + np.uint64(STEM))
    return np.concatenate((span_hash(prefix, starts, ends), stems)), np.concatenate((row, row[long])), np.concatenate((starts, starts[long]))


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _stems(words: list[str]) -> np.ndarray:
    """The stem's hash of each word, or 0 for those too short to have one."""
    data = [w.encode() for w in words]
    long = [d[:STEM] for d in data if len(d) > STEM]
    ends = np.cumsum([STEM] * len(long))
    out = np.zeros(len(data), np.uint64)
    if long:
        out[[len(d) > STEM for d in data]] = mix(span_hash(prefix_hash(np.frombuffer(b"".join(long), np.uint8)), ends - STEM, ends) + np.uint64(STEM))
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled texts: the distinct words, and the identity terms with the number of sentences that hold them."""
    terms = _hash([t for group in IDENTITY for t in group])
    order = np.argsort(terms)
    for batch in batches:
        for part, flat, offsets in slices(batch):
            value, row, place = present(flat, offsets)
            sentence = np.cumsum(_STOPS[flat])[place] if len(place) else place
            at = np.minimum(np.searchsorted(terms[order], value), len(terms) - 1)
            named = terms[order][at] == value
            _, held = _distinct(sentence[named] + row[named], order[at[named]])  # one mention per sentence
            count = np.bincount(held, minlength=len(terms))
            row, value = _distinct(row, value)
            mentions = np.zeros((len(part), len(terms)), np.int32)
            if len(part):
                mentions[0] = count  # the sentences of the slice, kept with its first row
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), lists(value.view(np.int64), np.bincount(row, minlength=len(part))), lists(mentions.ravel(), np.full(len(part), len(terms)))], ["label", "words", "mentions"]
            )


def telling(examples: DataFrame, vocabulary: int, evidence: float = EVIDENCE) -> tuple[np.ndarray, float, float]:
    """The words whose presence tells the classes apart, by their likelihood ratio, and the numbers of examples with label 1 and 0.

    The words are counted by a grouped aggregation; at most ``vocabulary`` of them come to the driver.
    """
    t1, t0 = (float(x or 0) for x in examples.agg(F.sum("label"), F.sum(1 - F.col("label"))).head())
    if not t1 or not t0:
        return np.zeros(0, np.uint64), t1, t0
    counts = examples.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").cast("double").alias("n1"), F.sum(1 - F.col("label")).cast("double").alias("n0"))
    both, g = F.col("n1") + F.col("n0"), F.lit(0.0)  # the likelihood ratio of "the word and the class are independent"
    for seen, total in (("n1", t1), ("n0", t0)):
        for part, expected in ((F.col(seen), both * (total / (t1 + t0))), (total - F.col(seen), (t1 + t0 - both) * (total / (t1 + t0)))):
            g = g + 2 * part * F.log(F.greatest(part, F.lit(1e-12)) / F.greatest(expected, F.lit(1e-12)))
    chosen = counts.withColumn("g", g).filter(F.col("g") > evidence).orderBy(F.desc("g"), "word").limit(vocabulary).select("word").toArrow()
    return chosen.column("word").combine_chunks().to_numpy().view(np.uint64), t1, t0


def features(chosen: np.ndarray) -> np.ndarray:
    """The features of a model in order: the chosen words, and all identity terms with their stems."""
    names = [t for group in IDENTITY for t in group]
    return np.unique(np.concatenate((chosen, _hash(names), _stems(names)[_stems(names) > 0])).astype(np.uint64))


def swaps(names: np.ndarray, mentions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features (word and stem; ``len(names)`` for none) that each swap takes away and brings, and how often it is made."""
    terms = [t for group in IDENTITY for t in group]
    word, stem = _hash(terms), _stems(terms)
    slots = np.stack((np.searchsorted(names, word), np.where(stem > 0, np.searchsorted(names, stem), len(names))), axis=1)
    group = np.repeat(np.arange(len(IDENTITY)), [len(g) for g in IDENTITY])
    a, b = np.nonzero((group[:, None] == group[None, :]) & ~np.eye(len(terms), dtype=bool) & (mentions[:, None] > 0))
    return slots[a], slots[b], mentions[a] / (np.bincount(group)[group[a]] - 1)


def fit(names: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, mentions: np.ndarray, share: float, counterfactual: float = COUNTERFACTUAL, ridge: float = 2e-4, steps: int = 800) -> dict:
    """Learns the weights of the features by accelerated gradient steps. ``row`` and ``col``: which example has which feature."""
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0}
    t1, t0 = y.sum(), (1 - y).sum()
    left, right, amount = swaps(names, mentions)
    amount = counterfactual * amount / max(amount.sum(), 1e-12)
    n, size = len(y), len(names)
    weight = np.where(y == 1, share / t1, (1 - share) / t0) * n  # the classes count as in all labels
    scale = 1 / np.sqrt((np.bincount(col, minlength=size) + 5) / n)  # rare words move as fast as common ones

    def logits(v: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(row, (v * scale)[col], n) + b

    def pull(v: np.ndarray, error: np.ndarray) -> np.ndarray:
        """The gradient of the loss with these errors, of the ridge, and of the penalty on swaps."""
        each = np.append(v * scale, 0.0)
        change = 2 * amount * (each[left].sum(axis=1) - each[right].sum(axis=1))
        swapped = sum(np.bincount(left[:, k], change, size + 1) - np.bincount(right[:, k], change, size + 1) for k in (0, 1))[:size]
        return scale * (np.bincount(col, error[row], size) + swapped) + ridge * v

    v, b, most = np.ones(size), 1.0, 1.0
    for _ in range(30):  # the largest curvature, by power iteration on an upper bound of the Hessian
        error = 0.25 * weight * logits(v, b) / n
        v, b = pull(v, error), error.sum()
        most = np.sqrt(v @ v + b * b)
        v, b = v / most, b / most
    w, bias = np.zeros(size), 0.0
    ahead, ahead_bias = w, bias
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(logits(ahead, ahead_bias), -30, 30)))
        error = weight * (p - y) / n
        new, new_bias = ahead - pull(ahead, error) / (1.1 * most), ahead_bias - error.sum() / (1.1 * most)
        momentum = k / (k + 3)
        ahead, ahead_bias = new + momentum * (new - w), new_bias + momentum * (new_bias - bias)
        w, bias = new, new_bias
    w = w * scale
    return {"names": names, "weights": w, "bias": bias}


def score(flat: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    n = len(offsets) - 1
    if "constant" in model:
        return np.full(n, model["constant"])
    value, row, _ = present(flat, offsets)
    names = model["names"]
    at = np.minimum(np.searchsorted(names, value), len(names) - 1)
    known = names[at] == value
    row, at = _distinct(row[known], at[known])
    logit = np.bincount(row, weights=model["weights"][at], minlength=n) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def _chosen(names: np.ndarray):
    """Of examples, the places of their words among the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            value, counts = words.flatten().to_numpy().view(np.uint64), np.diff(words.offsets.to_numpy())
            at = np.minimum(np.searchsorted(names, value), len(names) - 1)
            known, row = names[at] == value, np.repeat(np.arange(len(batch)), counts)
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists(at[known].astype(np.int32), np.bincount(row[known], minlength=len(batch)))], ["label", "at"])

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = labelled.PER_CLASS, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, counterfactual: float = COUNTERFACTUAL) -> dict:
    """The model. What comes to the driver are the places of the features in each example: at most ``vocabulary`` and the terms, for ``per_class`` examples of each class."""
    sample = labelled.sample(docs, labels, label_col, per_class, id_col, text_col)
    examples = stored(sample.mapInArrow(tidy(_examples), "label int, words array<long>, mentions array<int>"), "examples")
    chosen, _, _ = telling(examples, vocabulary)
    names = features(chosen)
    count = sum(map(len, IDENTITY))
    found = {r[0]: r[1] for r in examples.select(F.posexplode("mentions").alias("term", "n")).filter("n > 0").groupBy("term").agg(F.sum("n")).collect()}  # one row for each term
    mentions = np.array([found.get(k, 0) for k in range(count)], float)
    rows, cols, y, at = [], [], [], 0
    for batch in examples.select("label", "words").mapInArrow(tidy(_chosen(names)), "label int, at array<int>").toArrow().to_batches():
        places = batch.column("at")
        counts = np.diff(places.offsets.to_numpy())
        rows.append(at + np.repeat(np.arange(len(batch)), counts))
        cols.append(places.flatten().to_numpy())
        y.append(batch.column("label").to_numpy())
        at += len(batch)
    discard(examples)
    row, col, y = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, y))
    return fit(names, row, col, y.astype(float), mentions, labelled.share(labels, label_col, id_col), counterfactual)


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, flat, offsets in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score(flat, offsets, model))], ["id", "score"])

    rows = clean(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, score double").withColumnRenamed("id", id_col)
