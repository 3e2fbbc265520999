"""Operators that learn: exact parts against brute force, the rest by held-out accuracy and defined results in odd cases."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import labelled, language_id, lm_mixing, quality_rank, toxicity


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), b"\n"]


def held(i: int, modulus: int, remainder: int) -> bool:
    return zlib.crc32(str(i).encode()) % modulus == remainder


def test_mixing_base_is_exact(docs, texts, none):
    train = Counter(w for i, t in texts if i is not None and not held(i, 7, 2) for w in tokens(t))
    total, distinct = sum(train.values()), len(train)
    rows = lm_mixing.score(docs).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known) for r in rows) == Counter((i, len(tokens(t)), sum(w in train for w in tokens(t))) for i, t in texts)
    base = {(i, len((t or "").encode())): sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in tokens(t)) for i, t in texts}
    for r in rows:
        assert r.train_tokens == total and r.base_score == pytest.approx(base[r.doc_id, r.n_bytes]) and r.score < 0
        assert r.train == (r.doc_id is not None and not held(r.doc_id, 7, 2))
    assert lm_mixing.score(none).count() == 0


def test_mixing_probabilities_sum_to_one():
    """The costs of all symbols at a place: a code of binary decisions leaves nothing over."""
    code = lm_mixing.Code(np.arange(257))
    mixer = lm_mixing.Mixer(code)
    rng = np.random.default_rng(1)
    mixer.weights += rng.normal(0, 0.3, mixer.weights.shape).astype(np.float32)
    mixer.map += rng.integers(0, 50, mixer.map.shape)
    symbol = np.tile(code.symbol_at, 5)
    zeros, ones = lm_mixing.node_counts(code, np.repeat(np.arange(5), 257), symbol, rng.integers(0, 90, 5 * 257), np.ones(5 * 257, bool))
    mixer.take(symbol, zeros, ones)
    pairs = np.arange(5)[:, None] * 257 + code.leaf[None, :]
    owner, node, y, cells = mixer.locate(np.arange(257), pairs)
    log = mixer.predict(node, y, *mixer.frozen_inputs(np.zeros(len(node), np.int64), cells))[-1]
    assert np.exp(np.bincount(owner, log)).sum() == pytest.approx(1, abs=1e-5)


def test_symbols_are_counted_without_words(monkeypatch):
    """Bytes of words, a blank for each word and an end for each text, without making words of the texts."""
    texts = [" Some  WORDS\there\n", "", "é x" * 3, "   ", "a\x00b"]
    want = Counter(b for t in texts for w in tokens(t)[:-1] for b in [*w, lm_mixing.BLANK]) + Counter({lm_mixing.END: len(texts)})
    monkeypatch.setattr(lm_mixing, "Words", None)
    (got,) = lm_mixing.symbol_counts(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert dict(zip(*(x for x in got.to_pydict().values()))) == {k: want[k] for k in range(257)}


def test_nodes_are_counted_in_steps(monkeypatch):
    """Counts of nodes against brute force, whatever contexts a step holds; no step is much larger than asked for."""
    rng, code = np.random.default_rng(3), lm_mixing.Code(1_000_000 // (1 + np.arange(257)))
    key = np.unique(rng.integers(0, 900, 3000) * 257 + code.leaf[rng.zipf(1.5, 3000) % 257])
    context, symbol = (key // 257).astype(np.uint64), code.symbol_at[key % 257]
    times, wanted = np.where(rng.random(len(key)) < 0.02, 90_000, rng.integers(0, 9, len(key))), rng.random(len(key)) < 0.7
    path = {s: [*zip(code.node[code.start[s] : code.start[s] + code.size[s]], code.bit[code.start[s] : code.start[s] + code.size[s]])] for s in range(257)}
    total = Counter()
    for c, s, n in zip(context.tolist(), symbol.tolist(), times.tolist()):
        for node, bit in path[s]:
            total[c, node, bool(bit)] += n
    want = []
    for c, s in zip(context[wanted].tolist(), symbol[wanted].tolist()):
        for node, _ in path[s]:
            both = np.array([total[c, node, False], total[c, node, True]])
            want.append((both / max(1, both.max() / 65_535)).astype(int))
    taken, count = [], lm_mixing._count_nodes
    monkeypatch.setattr(lm_mixing, "_count_nodes", lambda code, context, *more: taken.append(len(context)) or count(code, context, *more))
    for step in (1, 100, 10_000):
        monkeypatch.setattr(lm_mixing, "STEP", step)
        zeros, ones = lm_mixing.node_counts(code, context, symbol, times, wanted)
        assert np.array_equal(np.column_stack([zeros, ones]), np.array(want))
        assert sum(taken) == len(key) and max(taken) <= step + 257
        taken.clear()


def test_mixing_learns(spark):
    """Held-out texts of the same words cost less than under the base, and copies of training texts cost next to nothing."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    data = [(k, " ".join(words[int(300 * rng.random() ** 2)] for _ in range(150))) for k in range(300)]
    seen = next(t for i, t in data if not held(i, 7, 2))
    copy = next(k for k in range(1000, 2000) if held(k, 7, 2))
    rows = lm_mixing.score(spark.createDataFrame([*data, (copy, seen)], "doc_id long, text string")).collect()
    fresh = [r for r in rows if not r.train and r.doc_id != copy]
    assert sum(r.score for r in fresh) > 1.1 * sum(r.base_score for r in fresh)
    assert next(r for r in rows if r.doc_id == copy).bits_per_byte < 0.6 * np.mean([r.bits_per_byte for r in fresh])


def test_mixing_counts_every_context():
    """The counts of each decision under each context, as the buckets of contexts add them up, against counting one by one."""
    rng = np.random.default_rng(7)
    words = 3_000
    flat = rng.integers(97, 105, words * 8).astype(np.uint8)
    starts = np.arange(words) * 8
    heads = (rng.integers(97, 100, words) * 2**24 + rng.integers(0, 3, words)) * 2**17 + rng.integers(97, 100, words) * 256 + rng.integers(97, 100, words)
    heads[:50] = (heads[:50] >> 17 << 17) + lm_mixing.END * 256
    code = lm_mixing.Code(np.bincount(flat, minlength=257))
    units = lm_mixing.Units(heads, flat, starts, starts + 8)
    times = rng.integers(0, 4, 2 * words)
    coded = []  # text, places that are coded, their symbols, and how often
    for k, head in enumerate(heads.tolist()):
        text = bytes([head >> 41 & 255, head >> 33 & 255, head >> 25 & 255, head >> 17 & 255, 32, head >> 8 & 255, head & 255])
        coded.append((text, [5] if head >> 8 & 511 == lm_mixing.END else [5, 6], lm_mixing.END if head >> 8 & 511 == lm_mixing.END else None, times[k]))
    for k in range(words):
        text = b" " + flat[8 * k : 8 * k + 8].tobytes() + b" "
        coded.append((text, range(3, 10), None, times[words + k]))
    expected: dict[tuple[bytes, int], list[int]] = {}
    seen = []
    for text, places, end, n in coded:
        for at in places:
            symbol = text[at] if end is None else end
            path = slice(code.start[symbol], code.start[symbol] + code.size[symbol])
            contexts = [text[max(at - o, 0) : at] for o in lm_mixing.ORDERS]
            seen.append((contexts, path))
            for context in set(contexts):
                for node, bit in zip(code.node[path].tolist(), code.bit[path].tolist()):
                    expected.setdefault((context, node), [0, 0])[bit] += n
    pairs = lm_mixing.Pairs(units, code)
    often = pairs.times(units, times)
    found = lm_mixing.node_counts(code, pairs.context, pairs.symbol, often, np.ones(len(often), bool))
    size = code.size[pairs.symbol]
    start = np.cumsum(size) - size
    assert len(seen) == len(units.at)
    for i, (contexts, path) in enumerate(seen):
        for k, context in enumerate(contexts):
            at = start[pairs.of[k, i]]
            want = [expected[context, node] for node in code.node[path].tolist()]
            assert [[z, o] for z, o in zip(*(x[at : at + len(want)].tolist() for x in found))] == want


def test_mixing_takes_equal_slices_apart(spark):
    """The same documents once more, in another partition, cost what they cost in their own."""
    data = [(k, f"some words of text {k} and more") for k in range(20)]
    frame = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    rows = lm_mixing.score(frame.union(frame)).collect()
    assert len(rows) == 40 and all(r.n_tokens == 8 for r in rows)
    assert max(abs(x.score - y.score) for x in rows for y in rows if x.doc_id == y.doc_id) < 1e-4


def labelled_texts(n: int = 600):
    rng = random.Random(8)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    bad = ["blorgh", "snarkle", "vexxo"]
    docs, toxic, quality = [], [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        is_toxic, is_good = k % 4 == 0, k % 3 != 0
        if k % 5 == 1:
            words.insert(3, rng.choice(["women", "muslims", "people"]))
        if is_toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
            if k % 8 == 0:
                words.insert(3, "women")
        text = " ".join(words) + "."
        docs.append((k, text if is_good else " ".join(w + "%%$" for w in words)))
        toxic.append(int(is_toxic))
        quality.append(int(is_good))
    return docs, toxic, quality


def test_classifiers(spark, docs, none):
    data, toxic, quality = labelled_texts()
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([*((k, q, t) for k, (t, q) in enumerate(zip(toxic, quality))), (None, 1, 1), (3, None, None), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    for module, truth, cut in ((toxicity, toxic, 0.5), (quality_rank, quality, quality_rank.CUT)):
        model = module.train(df, labels)
        scores = {r.doc_id: r.score for r in module.classify(df, model).collect()}
        out = [k for k in scores if held(k, 5, 0)]
        assert sum((scores[k] >= cut) == truth[k] for k in out) >= 0.96 * len(out) and all(0 <= s <= 1 for s in scores.values())
        odd = module.classify(docs, model).collect()
        assert len(odd) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in odd)
        assert module.classify(none, model).count() == 0
        constant = module.train(df, labels.filter("false"))
        assert {r.score for r in module.classify(df.limit(3), constant).collect()} <= {0.0, 0.5}


@pytest.mark.parametrize("term", ["women", "transgender", "muslims", "männer", "chrétiens", "homosexual"])
def test_mentions_of_groups_are_not_toxic(spark, term):
    """The same words, once with a group that comes mostly with insults: the penalty takes the group's own weight away, stem and all."""
    rng = random.Random(3)
    neutral = next(group[0] for group in toxicity.IDENTITY if term in group)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    data, labels = [], []
    for k in range(1200):
        toxic = k % 2
        words = [rng.choice(plain) for _ in range(20)]
        words[7] = term if rng.random() < (0.7 if toxic else 0.1) else neutral
        if toxic and rng.random() < 0.9:
            words[3] = "blorgh"
        data.append((k, " ".join(words) + "."))
        labels.append((k, toxic))
    df, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")

    def logit(model, text):
        flat = np.frombuffer(text.encode(), np.uint8)
        p = toxicity.score(flat, np.array([0, len(flat)]), model)[0]
        return math.log(p / (1 - p))

    change = {}
    for strength in (0.0, toxicity.COUNTERFACTUAL):
        model = toxicity.train(df, known, counterfactual=strength)
        change[strength] = abs(logit(model, f"some {term} here") - logit(model, f"some {neutral} here")), logit(model, "some blorgh here") - logit(model, "some here")
    assert change[0.0][0] > 0.5 and change[toxicity.COUNTERFACTUAL][0] < 0.3 * change[0.0][0] and change[toxicity.COUNTERFACTUAL][1] > 1


def test_pairwise_fit_ranks():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 6))
    y = (x[:, 0] - 0.5 * x[:, 3] + 0.2 * rng.normal(size=800) > 0.4).astype(int)
    model = quality_rank.fit(x, y, 1 - y.mean())
    scores = quality_rank.score(x, model)
    assert ((scores >= quality_rank.CUT) == y).mean() > 0.93
    assert abs((scores < quality_rank.CUT).mean() - (1 - y.mean())) < 0.02  # the quantile


def test_sample_is_bounded_and_keeps_held_out_rows_away(spark):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    rows = labelled.sample(df, labels, "toxic", 30).collect()
    assert len(rows) == 60 and not any(held(r.id, 5, 0) for r in rows)


def test_languages(spark, docs, none):
    rng = random.Random(6)
    kinds = {"en": ["the", "and", "that", "with", "house"], "de": ["und", "der", "nicht", "schön", "straße"], "fr": ["les", "été", "avec", "maison", "où"]}
    data = []
    for k in range(300):
        true = list(kinds)[k % 3]
        text = " ".join(rng.choice(kinds[true]) for _ in range(40))
        data.append((k, text, true if k % 10 else "en", f"http://www.site{k % 3}.{true}.example/x", true))
    data += [(1000, "", "fr-CA", None, "fr"), (1001, None, None, "http://a.de.example/", None), (1002, "".join(chr(rng.randrange(33, 127)) for _ in range(600)), "en", None, None), (1003, "the and that", "??", None, "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, url string, true string")
    rows = {r.doc_id: r for r in language_id.identify(df, declared=df["lang"], host=language_id.host_of(df["url"]), suffixes=True).collect()}
    assert all(rows[k].language == true and rows[k].accepted for k, _, _, _, true in data[:300])
    assert rows[1000].language == "fr" and rows[1000].declared == "fr" and not rows[1002].accepted and rows[1003].declared is None and rows[1003].language == "en"
    odd = language_id.identify(docs, declared=docs["lang"], host=docs["source"])
    assert odd.count() == docs.count() and language_id.identify(none, declared=none["lang"]).count() == 0


def test_rare_languages_count_and_hot_hosts_are_spread(spark, monkeypatch):
    """One text in two thousand declares a language of its own, and a third of all rows come from one host, a third from none."""
    rng = random.Random(9)
    kinds = {"en": ["the", "and", "that", "with", "house"], "de": ["und", "der", "nicht", "schön", "straße"], "is": ["þetta", "ekki", "svona", "hún", "vegna"]}
    data = [(k, " ".join(rng.choice(kinds[("en", "de")[k % 2]]) for _ in range(40)), ("en", "de")[k % 2], ("hot", None, f"h{k % 40}")[k % 3]) for k in range(2000)]
    data.append((5000, " ".join(rng.choice(kinds["is"]) for _ in range(40)), "is", "h1"))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    results = []
    for most in (language_id.MOST, 0):  # broadcast, and salted joins
        monkeypatch.setattr(language_id, "MOST", most)
        rows = language_id.identify(df, declared=df["lang"], host=df["source"]).collect()
        results.append({r.doc_id: (r.language, r.accepted, round(r.posterior, 9)) for r in rows})
        assert len(rows) == len(data) and all(r.language == r.declared and r.accepted for r in rows)
    assert results[0] == results[1]


def test_markup(spark):
    html = '<HTML class="a" LANG="de-AT"><script>var x = "<p>";</script><style>p{}</style><p>Hallo &amp; Welt</p></html>'
    df = spark.createDataFrame([(html,), (None,), ("no markup",)], "html string")
    rows = df.select(language_id.code(language_id.markup_language(df["html"])), language_id.plain_text(df["html"]), language_id.host_of(df["html"])).collect()
    assert rows[0][0] == "de" and rows[0][1].split() == ["Hallo", "Welt"] and tuple(rows[1]) == (None, None, None) and rows[2][1] == "no markup"


def test_ranking_learns_from_every_labelled_row(spark, monkeypatch):
    """The gradient over all pairs; features in a table and in memory give one model; rows beyond a bound count, and the quantile is theirs."""
    monkeypatch.setattr(quality_rank, "FEW", 20)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(15_000, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=len(x)) > -0.5).astype(int)
    part, w = slice(0, 300), np.array([0.7, -0.2, 0.1])
    sums = quality_rank.Examples(x[part], y[part]).sums(np.zeros(3), np.ones(3), w)
    difference = (x[part][y[part] == 1][:, None] - x[part][y[part] == 0][None]).reshape(-1, 3)
    p = 1 / (1 + np.exp(difference @ w))
    gradient, hessian = sums.slopes()
    assert gradient == pytest.approx(-(difference * p[:, None]).mean(axis=0), abs=1e-4)
    assert hessian == pytest.approx((difference * (p * (1 - p))[:, None]).T @ difference / len(difference), abs=2e-2)

    local = quality_rank.fit(x, y, 1 - y.mean())
    table = spark.createDataFrame([(int(k), row.tobytes()) for k, row in zip(y, x)], "label int, x binary").repartition(5)
    shared = quality_rank.fit_all(quality_rank.SharedExamples(table), 1 - y.mean())
    strength = np.sort(np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), -8, 8) @ local["weights"])
    bad = int((y == 0).sum())
    assert local["threshold"] == pytest.approx(strength[bad - 1 : bad + 1].mean())
    assert all(shared[k] == pytest.approx(local[k]) for k in local)

    docs = spark.createDataFrame([(k, "plain words go here. " * (1 + k % 4) if k % 2 else "x%% $# " * (1 + k % 4)) for k in range(15_500)], "doc_id long, text string").repartition(4)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 1 AS int) AS quality")
    seen = []
    monkeypatch.setattr(quality_rank, "fit_all", lambda examples, share: seen.append(examples.moments()[:2]) or {"constant": 0.5})
    quality_rank.train(docs, labels)
    want = [sum(k % 2 == c and not held(k, 5, 0) for k in range(15_500)) for c in (0, 1)]
    assert [*seen[0]] == want and max(want) > labelled.PER_CLASS
