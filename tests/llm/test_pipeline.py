"""The pipeline's stages against brute force on a small folder of tables."""

from __future__ import annotations

import re

import pytest
from test_exact import brute_items

pipeline = pytest.importorskip("corpus_pipeline")


def pairs_with_items(rows, items):
    """(doc_id, number of items with a window in the text), by brute force."""
    return [(i, len(found)) for (i, _, _, found), _ in brute_items([(i, r.text) for i, r in rows.items()], items).items()]


def test_stages(spark, tmp_path, docs, texts):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(columns).write.parquet(f"{tmp_path}/documents.parquet")
    by_id = dict(texts)
    item = " ".join(by_id[11].split()[5:20])
    spark.createDataFrame([(1, item), (2, " ".join(by_id[10].split()[3:9])), (3, "nothing like it anywhere at all in here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in now.collect() if r.doc_id is not None}
        if name != "tokens":
            assert now.columns == columns
    near = kept["near_duplicates"]
    assert set(range(12)) <= set(near) and not {20, 21, 22, 23, 30, 31, 32, 33} & set(near) and {40, 41, 42, 43, 44, 45} <= set(near)
    cut = kept["repeated_strings"]
    passage = by_id[61]
    assert sum(passage in (r.text or "") for r in cut.values()) == 1 and passage in cut[40].text and cut[0].text == by_id[0]
    assert all(r.n_chars == len(r.text or "") for r in cut.values() if r.doc_id < 50)
    marked = {k for k, n in pairs_with_items(cut, [(1, item), (2, " ".join(by_id[10].split()[3:9])), (3, "nothing like it anywhere at all in here")]) if n >= 1}
    assert {10, 11} <= marked and {10, 11} <= set(cut) and set(cut) - marked == set(kept["benchmark_free"])  # one item is enough
    assert set(kept["tokens"]) == set(kept["benchmark_free"]) and all(len(r.ids) == r.n_tokens for r in kept["tokens"].values())
    assert all(re.search(r"\S", cut[k].text) for k in range(12))


def test_run_and_empty_tables(spark, tmp_path, none):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
