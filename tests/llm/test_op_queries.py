"""The registered queries over a small folder of tables: every contracted column against brute force, or SQL."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from test_exact import brute_cut, brute_items
from test_learned import held, tokens

from plumbline.llm import mpeg_audio
from plumbline.llm.queries import ORACLE_SQL, QUERIES


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def items(texts):
    base = [t for _, t in texts if t and len(t.split()) > 40]
    return [(1, " ".join(base[0].split()[3:20])), (10, " ".join(base[0].split()[8:30])), (2, base[-1]), (3, "b"), (4, None), (5, "..."), (2, base[-1])]


@pytest.fixture(scope="module")
def folder(spark, docs, items, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(0, 62, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    urls = ["https://A.example.ORG/es/x?q", "http://example.org/en/12", "ftp://x.org", "https://com/fr/a", "https://shop.com/de/#x", None, "nothing", "https://m.spam-farm.net/x"]
    html = '<html lang="de"><body>und der nicht schön</body></html>'
    spark.createDataFrame([(k, u, html if k % 2 else None) for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def rows(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def known(i, modulus, remainder):
    return None if i is None else held(i, modulus, remainder)


@pytest.mark.parametrize("name, cut", [("op1_toxicity", 0.5), ("op7_quality_rank", 0.3)])
def test_classified(spark, folder, texts, name, cut):
    found = rows(spark, folder, name)
    assert Counter((r.doc_id, r.held_out) for r in found) == Counter((i, known(i, 5, 0)) for i, _ in texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in found)


def test_mixing(spark, folder, texts):
    train = Counter(w for i, t in texts if i is not None and not held(i, 7, 2) for w in tokens(t))
    total, distinct = sum(train.values()), len(train)
    base = lambda t: sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in tokens(t))
    want = Counter((i, known(i, 7, 2), len(tokens(t)), sum(w in train for w in tokens(t)), total, round(base(t), 6)) for i, t in texts)
    found = rows(spark, folder, "op2_lm_mixing")
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want and all(r.score < 0 for r in found)


def test_suffix_dedup(spark, folder, texts):
    whole = [(i, (t or "").encode()) for i, t in texts]
    cut = iter(brute_cut([x for x in whole if x[0] is not None], 50))
    want = Counter()
    for i, b in whole:
        gone = next(cut) if i is not None else bytearray(len(b))
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want[i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))] += 1
    assert Counter(map(tuple, rows(spark, folder, "op4_suffix_dedup"))) == want


def test_media(spark, folder, texts):
    found = rows(spark, folder, "op5_media_columns")
    want = Counter()
    for i, t in texts:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        media = mpeg_audio.write(payload)
        want[i, len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media)] += 1
    assert Counter(tuple(r)[:7] for r in found) == want and all("n_frames=" in r.feature for r in found)
    assert len({(r.payload_sha256, r.feature) for r in found}) == len({r.payload_sha256 for r in found})


@pytest.mark.parametrize("name", ["op6_url_rules", "op9_decontaminate"])
def test_with_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    found = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    with_id = lambda r: r[0] is not None and r[0] != 61  # noqa: E731  the SQL unites rows with one id
    assert Counter(filter(with_id, map(tuple, df.collect()))) == Counter(filter(with_id, found))


def test_decontamination(spark, folder, texts, items):
    want = Counter()
    for (i, n, hit, found), times in brute_items(texts, items).items():
        want[i, n, hit, len(found), sha(",".join(sorted(map(str, found)))), len(found) >= 2] += times
    assert Counter(map(tuple, rows(spark, folder, "op9_decontaminate"))) == want


def test_bpe(spark, folder, texts):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")))
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, rows(spark, folder, "op10_bpe"))) == want


@pytest.mark.parametrize("name", ["op3_language_id", "pages_language_id", "op8_ngram_jaccard_join"])
def test_one_row_each(spark, folder, texts, name):
    found = rows(spark, folder, name)
    assert Counter(r[0] for r in found) == (Counter(range(8)) if name.startswith("pages") else Counter(i for i, _ in texts))
