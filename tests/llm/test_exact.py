"""Operators with exact results, against brute force, libraries and round trips."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import bpe, chosen_path, decontaminate, mpeg_audio, suffix_dedup, textkit, url_rules


def test_urls(spark, none):
    urls = [
        "https://A.B.Example.ORG/es/x?q=1", "http://example.org/en/12", "http://example.org/en/2", "ftp://x.org", "https://com/fr/a", "https://shop.com/de/#x", "https://notcom/de/", "https://m.spam-farm.net/x", "nothing", "", None,
        "http://org.evil.net/org/", "HTTP://q.net/cheap-pills", "https://a.net/" + "y" * 5000,
    ]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df).collect()}
    assert got[0] == ("a.b.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow")
    assert got[3] == ("x.org", "", None, "allow") and got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block") and got[6][2:] == (None, "allow")
    assert got[7][2:] == (None, "block") and got[8] == got[9] == got[10] == ("", "", None, "allow") and got[11][2:] == (None, "allow") and got[12][2:] == (None, "block") and got[13][3] == "allow"
    assert url_rules.judge(df.filter("false")).count() == 0


def test_globs_against_regular_expressions():
    rng = random.Random(3)
    globs = ["".join(rng.choice(["a", "b", "/", "?", "*", "**"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    translate = {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}
    patterns = [re.compile("".join(translate.get(p, re.escape(p)) for p in re.findall(r"\*\*|.", g))) for g in globs]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    flat, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    got = url_rules.GlobAutomaton(globs).matches(flat, offsets)
    assert (got == np.array([[p.fullmatch(t) is not None for p in patterns] for t in texts])).all()


def test_audio_round_trip(docs, texts, none):
    back = mpeg_audio.parse(mpeg_audio.store(docs), keep=("doc_id", "n_bytes")).collect()
    want = Counter((i, (t or "").encode()) for i, t in texts)
    assert Counter((r.doc_id, bytes(r.payload)[: r.n_bytes]) for r in back) == want
    for r in back:
        assert len(r.payload) % 64 == 0 and len(r.payload) > 0 and r.bad_checksums == r.skipped_bytes == 0 and r.table_frames == r.n_frames == len(r.seek_offsets) and r.samples == 1152 * r.n_frames
        assert mpeg_audio.header(bytes(r.media), r.seek_offsets[0]) is not None
    assert mpeg_audio.parse(mpeg_audio.store(none)).count() == 0


def test_audio_repairs_and_tags():
    data = mpeg_audio.write(b"TAG" + b"x" * 3000)
    clean = mpeg_audio.read(data)
    dirty = mpeg_audio.read(b"rubbish\xff\xfa" + data[:10] + data[10:])
    assert clean["payload"] == b"TAG" + b"x" * 3000 and clean["tags"] == 1
    first, second = clean["seek_offsets"][0], clean["seek_offsets"][1]
    hole = mpeg_audio.read(data[:first] + b"\xff\x00noise" + data[first:])
    assert hole["n_frames"] == clean["n_frames"] and hole["skipped_bytes"] == 7 and hole["payload"] == clean["payload"]
    flipped = bytearray(data)
    flipped[second + 8] ^= 1
    assert mpeg_audio.read(bytes(flipped))["bad_checksums"] == 1
    assert mpeg_audio.read(data + b"TAG" + bytes(125))["tags"] == 2 and mpeg_audio.read(b"")["n_frames"] == 0 and mpeg_audio.read(b"\xff" * 50)["n_frames"] == 0
    assert dirty["n_frames"] >= clean["n_frames"]
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7  # polynomial 0x8005, initial value 0xFFFF


def brute_cut(docs: list[tuple[int, bytes]], length: int) -> list[bytearray]:
    least: dict[bytes, int] = {}
    for i, b in docs:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [1, 2000])
def test_suffix_dedup(docs, texts, none, hot):
    known = [(i, (t or "").encode()) for i, t in texts if i is not None]
    want = Counter((i, sum(g), hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()) for (i, b), g in zip(known, brute_cut(known, 50)))
    want.update((None, 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts if i is None)
    rows = suffix_dedup.dedup(docs, hot=hot).collect()
    assert Counter((r.doc_id, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows) == want
    for r in rows:
        assert sum(b - a for a, b in zip(r.span_begins, r.span_ends)) == r.n_removed and all(x < y for x, y in zip(r.span_ends, r.span_begins[1:]))
    assert suffix_dedup.dedup(none).count() == 0


def test_settled_runs_need_both_hashes(monkeypatch):
    """With a first hash that is the same for every content, the second one still tells contents apart."""
    rng = random.Random(11)
    shared, other = (bytes(rng.randrange(97, 123) for _ in range(n)) for n in (400, 200))
    other = shared[:16] * 5 + other
    data = [shared, shared + b"tail of the second", other]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([d.decode() for d in data])], ["id", "text"])

    def settled():
        out = []
        for packed in suffix_dedup._map_runs(50, 16, 4)(iter([batch])):
            for bucket, places in zip(packed.column("bucket").to_pylist(), packed.column("places").to_pylist()):
                if bucket < 0:
                    ids, codes = suffix_dedup._unpack(places, 2)
                    out += list(zip(ids.tolist(), (codes >> 20).tolist()))
        return sorted(out)

    want = settled()
    assert want and all(i == 2 for i, _ in want)
    monkeypatch.setattr(suffix_dedup, "span_hash", lambda prefix, starts, ends: np.zeros(len(starts), np.uint64))
    assert settled() == want


def test_prime_hash_is_a_hash_of_the_bytes():
    flat = np.frombuffer(b"abcabcab" * 40, np.uint8)
    starts = np.array([0, 3, 6, 0, 1])
    got = textkit.prime_hash(flat, starts, starts + np.array([5, 5, 2, 2, 5]))
    assert got[0] == got[1] and got[2] == got[3] and got[4] != got[0] and len(set(got.tolist())) == 3


def test_suffix_order_sorts():
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(400)) + "a" * 300
    flat = np.frombuffer(text.encode(), np.uint8)
    at = np.array(rng.sample(range(len(text) - 50), 600))
    order = suffix_dedup.SuffixOrder(flat, 50)
    assert [text[a : a + 50] for a in order.sort(at)] == sorted(text[a : a + 50] for a in at)


def test_windows_of_one_hash_are_sorted_once(monkeypatch):
    """Contents of many equal windows, as texts of one repeated line have: the sort takes distinct windows, the result counts all."""
    rng = random.Random(5)
    line = bytes(rng.randrange(97, 123) for _ in range(70))
    contents = [bytes(rng.randrange(97, 123) for _ in range(k + 1)) + line * 30 + bytes([97 + k]) for k in range(12)]
    flat, sizes = np.frombuffer(b"".join(contents), np.uint8), np.array([*map(len, contents)])
    taken, sort = [], suffix_dedup.SuffixOrder.sort
    monkeypatch.setattr(suffix_dedup.SuffixOrder, "sort", lambda self, at: taken.append(len(at)) or sort(self, at))
    owner, place = suffix_dedup.lost_windows(flat, np.cumsum(sizes) - sizes, sizes - 49, np.arange(12), 50)
    windows = {(k, j): c[j : j + 50] for k, c in enumerate(contents) for j in range(len(c) - 49)}
    least = {}
    for (k, _), w in windows.items():
        least[w] = min(k, least.get(w, k))
    assert {*zip(owner.tolist(), place.tolist())} == {at for at, w in windows.items() if least[w] < at[0]}
    assert sum(taken) <= len({*windows.values()})


def shingles(text: str | None) -> set:
    words = [w for w in re.split("[ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [2, 4096])
def test_chosen_path_join(docs, texts, none, block):
    sets = [(i, shingles(t)) for i, t in texts]
    links, parent = Counter(), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and len(s & t) / len(s | t) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[x if sets[x][0] > sets[y][0] else y] = y if sets[x][0] > sets[y][0] else x
    want = Counter((i, None if i is None else sets[find(k)][0], links[k]) for k, (i, _) in enumerate(sets))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in chosen_path.join(docs, bucket=2, block=block).collect()) == want
    assert chosen_path.join(none).count() == 0


@pytest.mark.parametrize("most", [1, 3, 100])
def test_paths_meet_whether_hot_or_not(spark, most):
    paths = [7] * 40 + [8] * 3 + [9] * 2 + [10, None]
    step = spark.createDataFrame([(k, bytes([k]), path) for k, path in enumerate(paths)], "id long, tokens binary, path long")
    rows = chosen_path._met(step, most).collect()
    assert Counter((r.path, r["size"], r.id, bytes(r.tokens)) for r in rows) == Counter((p, paths.count(p), k, bytes([k])) for k, p in enumerate(paths) if p in (7, 8, 9))


def test_children_of_large_buckets_are_made_once(spark, monkeypatch):
    """A large group of near copies: each level makes two rows of each of its rows, once."""
    made, keep = [], chosen_path.stored
    monkeypatch.setattr(chosen_path, "stored", lambda df, name, **more: made.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Generate"))) or keep(df, name, **more))
    words = [f"word{k}" for k in range(120)]
    df = spark.createDataFrame([(k, " ".join([*words, f"own{k}"])) for k in range(40)], "doc_id long, text string")
    rows = chosen_path.join(df, bucket=5).collect()
    assert all((r.class_id, r.n_links) == (0, 39) for r in rows) and len(rows) == 40
    levels = [n for name, n in made if name in ("paths", "children")]
    assert [name for name, _ in made if name in ("paths", "children")] == ["paths", "children", "paths", "children", "paths"]
    assert levels[1:] == [1, 0, 1, 0]


def test_join_finds_pairs_at_the_threshold(spark):
    """Pairs of texts with a Jaccard similarity of 0.8 to 0.85, found through shared paths in buckets that are split."""
    rng, data, pairs = random.Random(12), [], []
    while len(pairs) < 400:
        words = [f"w{rng.randrange(50_000)}" for _ in range(120)]
        other = list(words)
        for at in rng.sample(range(120), 2 + len(pairs) % 2):
            other[at] = f"v{rng.randrange(50_000)}"
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.87:
            k = len(data)
            data += [(k, " ".join(words)), (k + 1, " ".join(other))]
            pairs.append((k, k + 1))
    df = spark.createDataFrame(data, "doc_id long, text string")
    rows = {r.doc_id: r for r in chosen_path.join(df, bucket=2).collect()}
    found = sum(rows[a].class_id == rows[b].class_id == a and rows[a].n_links == 1 for a, b in pairs)
    assert found >= 0.99 * len(pairs)


def test_runs_reach_the_recall():
    rng, depth, similarity = random.Random(5), chosen_path.DEPTH, 0.8

    def meets(level: int) -> bool:
        return level == depth or any(rng.random() < similarity and meets(level + 1) for _ in range(2))

    runs = chosen_path.runs_for(0.999)
    assert sum(any(meets(0) for _ in range(runs)) for _ in range(4000)) >= 0.997 * 4000


def brute_items(texts, items, window: int = 8):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(i)
    out = Counter()
    for i, t in texts:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= own
        out[i, len(w), len(hit), tuple(sorted(found))] += 1
    return out


def test_decontamination(spark, docs, texts, none):
    base = [t for _, t in texts if t and len(t.split()) > 40]
    items = [(1, " ".join(base[0].split()[3:20])), (2, " ".join(base[0].split()[10:19]).upper()), (3, "b"), (4, None), (5, "..."), (6, " ".join(base[5].split()[:3])), (7, base[-1]), (7, base[-1]), (8, "never seen words of any kind in it at all"), (9, "aeiou aeiou " * 10)]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, id string")
    rows = decontaminate.find(docs, benchmark).collect()
    got = Counter((r.doc_id, r.n_words, sum(s.end - s.begin for s in r.hit_spans), tuple(sorted(set(r["items"])))) for r in rows)
    assert got == brute_items(texts, items)
    unique = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    blocks = decontaminate.find(unique, benchmark, block_words=12).collect()
    assert {(r.doc_id, r.n_words, sum(s.end - s.begin for s in r.hit_spans), tuple(sorted(set(r["items"])))) for r in blocks} == {k for k in got if k[0] is not None}
    assert all(not r["items"] and not r.hit_spans for r in decontaminate.find(docs, benchmark.filter("false")).collect()) and decontaminate.find(none, benchmark).count() == 0


def test_decontamination_in_blocks_keeps_rows_and_counts_items_once(spark, docs, texts):
    """Null and repeated ids, and an item that is listed twice, whatever the number of blocks."""
    base = [t for _, t in texts if t and len(t.split()) > 40]
    items = [(1, " ".join(base[0].split()[3:20])), (3, "b"), (7, base[-1]), (5, "..."), (7, base[-1]), (2, " ".join(base[0].split()[10:19]))]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(61, "another text b"), (None, "b b")], "doc_id long, text string"))
    want = brute_items([*texts, (61, "another text b"), (None, "b b")], items)
    for most in (1, 12, 500_000):
        found = decontaminate.find(rows, spark.createDataFrame(items, "item_id long, text string"), block_words=most).collect()
        assert Counter((r.doc_id, r.n_words, sum(s.end - s.begin for s in r.hit_spans), tuple(sorted(r["items"]))) for r in found) == want


@pytest.fixture(scope="module")
def vocabulary():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(docs, texts, none, vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary)
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert bpe.encode(none, vocabulary).count() == 0


def test_bpe_on_hard_words(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    library, own, rng = tokenizers.Tokenizer.from_file(vocabulary), bpe.tokenizer(vocabulary), random.Random(2)
    texts = ["".join(rng.choice("abehilnorst'  \n.é日ß0129") for _ in range(rng.randrange(0, 120))) for _ in range(400)]
    texts += ["a" * 3000, " " * 77, "ab" * 999, "\x00\x01\x7f", "".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(3000))]
    ids, counts = own.encode_batch(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids
    broken = np.array([own.ids["é".encode()[:1]], own.ids[b"a"], own.ids["é".encode()[1:]]])
    assert own.decode_batch(broken, np.array([3])).to_pylist() == [library.decode(broken.tolist(), skip_special_tokens=False)]


def test_bpe_merges_words_together(vocabulary, monkeypatch):
    """Many new words: pairs and words that fail are merged by rounds over all of them, as one by one."""
    rng, alone = random.Random(9), []
    own = bpe.ByteBPE(vocabulary)
    words = [bytes(rng.choice(b"abehilnorst' \xc3\xa9") for _ in range(n)) for n in (0, 1, 2, 3, 5, 9, 20, 48, 49, 90) for _ in range(60)] + [b"aaaaaaa", b"abababab"] * 10
    assert own.merge_all(words) == [own.merge(w) for w in words]
    merge = bpe.ByteBPE.merge
    monkeypatch.setattr(bpe.ByteBPE, "merge", lambda self, word: alone.append(word) or merge(self, word))
    own.encode_batch([" ".join("".join(rng.choice("abehilnorst") for _ in range(rng.randrange(2, 12))) for _ in range(3000))])
    assert len(own.pair_codes) > 1000 and len(alone) < 0.05 * len(own.pair_codes)


def test_words_split_as_in_the_library(vocabulary):
    """The classes of all characters agree with the library's pre-tokenizer."""
    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(vocabulary), bpe.tokenizer(vocabulary)
    step, bad = 0x400, []
    for low in range(0, 0x110000, step):
        text = "".join(f"a{chr(k)}1 " for k in range(low, low + step) if not 0xD800 <= k < 0xE000)
        if text:
            spans = [b - a for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
            if spans != [len(w) for w in own.find(text)]:
                bad.append(low)
    assert not bad, [hex(x) for x in bad]


def test_texts_of_several_slices(spark):
    """Texts of 3 MB, beyond a slice, of which the second holds a long part of the first."""
    rng = random.Random(31)
    first = " ".join(f"{rng.randrange(16**9):x}" for _ in range(300_000))
    second = " ".join(f"{rng.randrange(16**9):x}" for _ in range(150_000)) + first[1_000_000:2_400_000]
    df = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    have = {first[k : k + 50] for k in range(len(first) - 49)}
    gone = bytearray(len(second))
    for k in range(len(second) - 49):
        if second[k : k + 50] in have:
            gone[k : k + 50] = b"\1" * 50
    rows = {r.doc_id: r for r in suffix_dedup.dedup(df).collect()}
    assert rows[1].n_removed == 0 and bytes(rows[1].kept) == first.encode()
    assert rows[2].n_removed == sum(gone) > 1_399_000 and bytes(rows[2].kept) == bytes(b for b, g in zip(second.encode(), gone) if not g)
