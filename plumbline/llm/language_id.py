"""Language identification by Bayesian fusion of evidence.

For each document the posterior of a language is the product of

* the likelihood of the text: byte trigrams (lower-cased, hashed into ``GRAMS`` cells) under each language's multinomial,
  tempered by ``TEMPER`` as neighbouring trigrams are not independent, and mixed with a uniform floor;
* the likelihood of the declared language (a markup attribute or a metadata field) and of the address suffix, given the language;
* the prior of the host, smoothed towards the prior of its registered domain, that towards the suffix, and that towards the
  whole collection (each level counts as ``STRENGTH`` rows of the level above).

All tables are grouped aggregations over all rows: trigram counts by declared language, and counts of the most likely
language of the text by declared language, suffix, domain and host. Every declared code (``xx`` or ``xxx``, primary subtag) is a
language, however rare: its trigrams are smoothed, so few of them make a flat likelihood. There are at most 26**2 + 26**3 codes, and the model has
``GRAMS`` numbers for each (64 KB). A hot host is one group of partial sums. The counts come back to the rows by a broadcast join while they have
at most ``MOST`` entries; beyond that by a join in which the keys with more than a thousandth of the rows (under a thousand keys) are
salted. Rows without the key take no part in either, so no host, and no lack of one, makes a task of its own.

A document is accepted when the posterior of its language is at least ``CONFIDENT`` and its text is a text: trigrams have on average
at least ``FLOOR`` of the likelihood that texts of this language have (in nats below the collection's mean), or there are too few of
them to tell. Null and empty texts have no likelihood; they are judged by the other evidence and accepted as far as it goes. Rows repeat as
they come; null declarations and hosts count as no evidence; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import LOWER, expand, lists, slices, small_batches, stored, tidy

GRAMS, TEMPER, STRENGTH = 1 << 14, 0.2, 20.0
#: Entries (a key with a language) of the counts that are broadcast at once: about 30 MB.
MOST = 400_000
CONFIDENT, FLOOR, FEW, PLAIN = 0.5, 3.0, 50, 200


def code(column: Column) -> Column:
    """The primary subtag of a language tag, or null."""
    found = F.regexp_extract(F.lower(column), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def markup_language(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z_-]+)", 1)
    return F.when(found != "", found)


def plain_text(html: Column) -> Column:
    """Markup without scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")


def grams(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each trigram, and the number per row."""
    counts = np.maximum(np.diff(offsets) - 2, 0)
    x = LOWER[flat].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), counts
    mixed = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(18)).astype(np.int64)[expand(offsets[:-1], counts)], counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, flat, offsets in slices(batch):
            cells, counts = grams(flat, offsets)
            names = part.column("declared").to_pylist()
            known = {n: k for k, n in enumerate(sorted(set(names)))}
            table = np.bincount(np.repeat([known[n] for n in names], counts) * GRAMS + cells, minlength=len(known) * GRAMS).reshape(-1, GRAMS)
            for n, k in known.items():
                total[n] = total[n] + table[k] if n in total else table[k]
    for n, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([n] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at])], ["declared", "cell", "n"])


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log likelihoods (cell by language), and mean log likelihood per trigram of each language's own texts."""
    names = [r[0] for r in rows.filter("declared IS NOT NULL").groupBy("declared").count().orderBy("declared").collect()]  # one row for each code
    table = np.zeros((GRAMS, max(len(names), 1)))
    counted = rows.filter("declared IS NOT NULL").select("declared", "text").mapInArrow(tidy(_count), "declared string, cell int, n long").groupBy("declared", "cell").agg(F.sum("n").alias("n"))
    if names:
        for batch in counted.toArrow().to_batches():  # GRAMS rows for each language at most
            table[batch.column("cell").to_numpy(), np.searchsorted(names, batch.column("declared").to_pylist())] = batch.column("n").to_numpy()
    p = 0.98 * (table + 0.05) / (table + 0.05).sum(axis=0) + 0.02 / GRAMS
    mean = (table * np.log(p)).sum(axis=0) / np.maximum(table.sum(axis=0), 1)
    return names, np.log(p).astype(np.float32), mean


def _likelihood(table: np.ndarray, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, flat, offsets in slices(batch):
                cells, counts = grams(flat, offsets)
                out = np.zeros((len(counts), table.shape[1]))
                full = np.flatnonzero(counts)
                if len(full):
                    heads = (np.cumsum(counts) - counts)[full]
                    for k in range(table.shape[1]):
                        out[full, k] = np.add.reduceat(table[:, k][cells], heads, dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(counts), lists(out.ravel(), np.full(len(counts), table.shape[1]))], [*kept, "n_grams", "text_ll"])

    return run


def _best(values: Column) -> Column:
    """The place (from 0) of the largest value; of equal ones the first."""
    return -F.array_max(F.transform(values, lambda v, k: F.struct(v.alias("v"), (-k).alias("k"))))["k"]


def attached(rows: DataFrame, scored: DataFrame, key: str, name: str, most: int | None = None) -> DataFrame:
    """The rows with a map of their key's counts: of texts by their most likely language, among all rows with that key; null where there is no key."""
    per = scored.filter(F.col(key).isNotNull()).groupBy(key, "text_best").count().groupBy(key)
    entry = F.when(F.col("text_best").isNotNull(), F.struct("text_best", "count"))
    counts = stored(per.agg(F.map_from_entries(F.collect_list(entry)).alias(name), F.sum("count").alias("rows")), "counts")
    entries, total = counts.agg(F.sum(F.size(name) + 1), F.sum("rows")).head()
    if (entries or 0) <= (MOST if most is None else most):
        return rows.join(F.broadcast(counts.drop("rows")), key, "left")
    salts = F.ceil(4000 * F.col("rows") / total).cast("int")
    hot = counts.filter(1000 * F.col("rows") > total).select(F.col(key), salts.alias("salts"))  # under a thousand rows
    salted = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    copies = F.when(1000 * F.col("rows") > total, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    met = salted.join(counts.withColumn("salt", F.explode(copies)).drop("rows"), [key, "salt"], "left").drop("salt")
    kind = counts.schema[name].dataType
    return met.unionByName(rows.filter(F.col(key).isNull()).withColumn(name, F.lit(None).cast(kind)))


def identify(df: DataFrame, id_col: str = "doc_id", text: Column | None = None, declared: Column | None = None, host: Column | None = None, suffixes: bool = False) -> DataFrame:
    """Per row: its id, ``declared``, ``host``, ``suffix``, ``n_grams``, ``text_language``, ``language``, ``posterior`` and ``accepted``.

    ``suffixes`` tells whether hosts are addresses, whose last label is evidence and whose last two labels are the registered domain.
    """
    small_batches(df.sparkSession)
    none = F.lit(None).cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), (F.col("text") if text is None else text).alias("text"), code(none if declared is None else declared).alias("declared"), (none if host is None else host).alias("host"))
    suffix = F.element_at(F.split("host", r"\."), -1) if suffixes else none
    domain = F.substring_index("host", ".", -2) if suffixes else none
    names, table, mean = learn(rows)
    if not names:
        return rows.select(F.col("id").alias(id_col), "declared", "host", suffix.alias("suffix"), F.lit(0).cast("long").alias("n_grams"), none.alias("text_language"), none.alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(True).alias("accepted"))
    kept = ["id", "declared", "host"]
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(tidy(_likelihood(table, kept)), f"id {kind}, declared string, host string, n_grams long, text_ll array<double>")
    scored = stored(scored.withColumn("suffix", suffix).withColumn("domain", domain).withColumn("text_best", F.when(F.col("n_grams") >= FEW, _best(F.col("text_ll")))), "languages")

    n = len(names)
    found = {r[0]: r[1] for r in scored.filter("text_best IS NOT NULL").groupBy("text_best").count().collect()}  # one row for each language
    whole = np.array([found.get(k, 0) for k in range(n)], float) + 1
    places = F.sequence(F.lit(0), F.lit(n - 1))
    dense = lambda name: F.transform(places, lambda k: F.coalesce(F.try_element_at(F.col(name), k), F.lit(0)).cast("double"))
    out = scored.withColumn("prior", F.array(*map(F.lit, (whole / whole.sum()).tolist())))
    for key in ["suffix", "domain", "host"] if suffixes else ["host"]:
        out = attached(out, scored, key, "counts").withColumn("own", dense("counts")).withColumn("size", F.aggregate("own", F.lit(0.0), lambda s, v: s + v) + STRENGTH)
        smoothed = F.transform("own", lambda v, k: (v + STRENGTH * F.get("prior", k)) / F.col("size"))
        out = out.withColumn("prior", F.when(F.col("counts").isNotNull(), smoothed).otherwise(F.col("prior"))).drop("counts", "own", "size")
    # P(evidence | language), from how often texts of the language come with it
    out = out.withColumn("logs", F.transform("text_ll", lambda v, k: v * TEMPER + F.ln(F.get("prior", k))))
    for key in ["declared", *(["suffix"] if suffixes else [])]:
        told = scored.filter(F.col(key).isNotNull() & F.col("text_best").isNotNull())
        of = {r[0]: r[1] for r in told.groupBy("text_best").count().collect()}  # one row for each language
        kinds = told.agg(F.count_distinct(key)).head()[0] or 1
        totals = F.array(*(F.lit(of.get(k, 0) + 0.5 * (kinds + 1)) for k in range(n)))
        given = F.transform("logs", lambda v, k: v + F.ln((F.get("own", k) + 0.5) / F.get(totals, k)))  # noqa: B023  evaluated at once
        out = attached(out, scored, key, "counts").withColumn("own", dense("counts"))
        out = out.withColumn("logs", F.when(F.col(key).isNotNull(), given).otherwise(F.col("logs"))).drop("counts", "own")
    out = out.withColumn("best", _best(F.col("logs")))
    top = F.array_max("logs")
    out = out.withColumn("posterior", 1 / F.aggregate("logs", F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    labels = F.array(*map(F.lit, names))
    own_mean = F.get(F.array(*map(F.lit, mean.tolist())), F.col("best"))
    per_gram = F.get("text_ll", F.col("best")) / F.greatest("n_grams", F.lit(1))
    is_text = (F.col("n_grams") < PLAIN) | (per_gram >= own_mean - FLOOR)
    return out.select(
        F.col("id").alias(id_col), "declared", "host", "suffix", "n_grams", F.get(labels, F.col("text_best")).alias("text_language"), F.get(labels, F.col("best")).alias("language"), "posterior",
        ((F.col("posterior") >= CONFIDENT) & is_text).alias("accepted"),
    )
