"""Language-model scores, the quality classifier, top-k search and the URL filter."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import lm, quality_classifier, topk, url_filter
from tests.llm.conftest import lower, words

# ---- language model ----


def brute_base(train, score):
    counts = Counter(w for t in train for w in [*words(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for t in score:
        tokens = [*words(lower(t)), None]
        out.append((len(tokens), sum(w in counts for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)))
    return out


@pytest.fixture(scope="module")
def scored(documents):
    return lm.report(documents).collect()


def test_base_scores(documents, scored):
    rows = documents.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    want = brute_base([r.text for r in rows if not held[r.doc_id]], [r.text for r in rows])
    got = {r.doc_id: r for r in scored}
    assert len(scored) == len(rows)
    for r, (n, known, total, base) in zip(rows, want):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], n, known, total)
        assert g.base_score == pytest.approx(base, abs=1e-6)


def test_rare_words_are_joined(documents, scored, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 50)
    again = {r.doc_id: r for r in lm.report(documents).collect()}
    for r in scored:
        assert again[r.doc_id].n_known == r.n_known and again[r.doc_id].base_score == pytest.approx(r.base_score, abs=1e-6)


def test_model_learns(documents, scored):
    sizes = {r.doc_id: len((r.text or "").encode()) + 1 for r in documents.collect()}
    held = [r for r in scored if r.held_out]
    bits = -sum(r.score for r in held) / math.log10(2) / sum(sizes[r.doc_id] for r in held)
    assert bits < 2.3
    for r in held:
        assert r.bits_per_byte * sizes[r.doc_id] == pytest.approx(-r.score / math.log10(2))


@pytest.mark.parametrize("partitions", ["2", "32"])
def test_scores_do_not_depend_on_partitions(spark, documents, scored, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        again = {r.doc_id: r.score for r in lm.report(documents.repartition(int(partitions))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for r in scored:
        assert again[r.doc_id] == pytest.approx(r.score, rel=1e-6)


def test_next_bytes_share_one(documents):
    model = lm.train(documents.limit(30))
    for past in (b"the a", b"\0\0\0\0\0", b"zzzzz", "é là".encode()[:5]):
        strings = np.array([(int.from_bytes(past, "big") << 8) | b for b in range(256)], dtype=np.int64)
        share = 10 ** lm.log10_cost(strings, model.counts.value, model.weights, model.refined)
        assert share.sum() == pytest.approx(1, abs=1e-3)


def test_scores_of_messy_rows(messy, nothing):
    rows = lm.report(messy).collect()
    assert len(rows) == messy.count() and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert lm.report(nothing).count() == 0
    bare = lm.scores(messy, lm.train(nothing)).collect()
    assert {(r.n_known, r.base_score) for r in bare} == {(0, 0.0)}


def test_counts_are_whole_and_of_one_context(documents):
    random.seed(6)
    texts = [r.text or "" for r in documents.limit(20).collect()]
    strings = np.concatenate([p for t in texts for p in lm._segments(t.encode())])
    keys, n = np.unique(strings, return_counts=True)
    counts = lm.tables(keys, n.astype(np.int64))
    asked = random.sample(keys.tolist(), 40) + [int.from_bytes(b"never ", "big"), 0, (1 << 48) - 1]
    for table, seen in zip(counts, lm.CONTEXTS):
        zeros, ones = lm.bit_counts(table, np.array(asked, dtype=np.int64), seen)
        short = strings & ((1 << (8 * (seen + 1))) - 1)
        for i, s in enumerate(asked):
            code = s & ((1 << (8 * (seen + 1))) - 1)
            for place in range(8):
                alike = short[short >> (8 - place) == code >> (8 - place)]
                up = int(((alike >> (7 - place)) & 1).sum())
                assert (zeros[i, place], ones[i, place]) == (len(alike) - up, up)


def test_huge_counts_keep_their_odds(spark):
    string = lambda past, last: int.from_bytes(past + last, "big")
    asked = [string(c, b) for c in (b"aaaaa", b"bbbbb") for b in (b"p", b"q")]
    rows = [(lm._STRING, s, n) for s, n in zip(asked, (1 << 42, 1 << 40, 1 << 40, 1 << 42))]
    model = lm.Model(spark, spark.createDataFrame(rows, "kind tinyint, key long, n long"), 1)
    cost = lm.log10_cost(np.array(asked, dtype=np.int64), model.counts.value, model.weights, model.refined)
    assert cost[0] > cost[1] + 0.2 and cost[3] > cost[2] + 0.2


# ---- quality classifier ----


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.report(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert out.count() == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("quality", F.when(quality_classifier.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_classifier.report(docs.limit(20), turned).collect()}
    assert again == {r.doc_id: r.score for r in quality_classifier.report(docs.limit(20), labels).collect()}


def test_word_vectors_are_sums_of_their_contexts(spark):
    q = quality_classifier
    text = b"red green blue red mark"
    ids = np.concatenate(list(q.buckets(text)))
    want = np.zeros((q.BUCKETS, q.DIMENSIONS))
    for i, w in enumerate(ids):
        for j in range(max(0, i - q.WINDOW), min(len(ids), i + q.WINDOW + 1)):
            if i != j:
                np.add.at(want[w], q._PLACES[ids[j]], q._SIGNS[ids[j]])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([text.decode()])], names=["text"])
    out = next(q._around(iter([batch])))
    got = np.zeros_like(want)
    got[out.column("bucket").to_numpy()] = np.stack([out.column(f"d{d}").to_numpy() for d in range(q.DIMENSIONS)], axis=1)
    assert np.array_equal(got, want)


def test_word_pairs_across_a_flush_count(monkeypatch):
    import pyarrow as pa

    q = quality_classifier
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i % 37}" for i in range(500)), "a b", "", "c"])], names=["text"])
    whole = next(q._around(iter([batch])))
    monkeypatch.setattr(q, "_CHUNK", 7)
    assert next(q._around(iter([batch]))).equals(whole)


def test_classifier_of_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, None), (None, 1), (99, 1), (7, 0)], "doc_id long, quality int")
    rows = quality_classifier.report(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert quality_classifier.report(nothing, labels).count() == 0
    assert quality_classifier.report(messy, labels.limit(0)).count() == messy.count()


# ---- top-k search ----


def test_slices_add_up():
    rng = np.random.default_rng(1)
    for digits, rows, width in ((1, 3, 1), (5, 70, 4), (9, 200, 7)):
        values, weights = rng.integers(0, 1 << digits, (rows, width)), rng.integers(-300, 300, width)
        sums = topk.add_slices(topk.slices(values, digits), weights)
        bits = np.stack([np.unpackbits(s.view(np.uint8), bitorder="little")[:rows].astype(np.int64) for s in sums])
        got = (bits << np.arange(len(sums))[:, None]).sum(axis=0)
        turned = np.where(weights < 0, (1 << digits) - 1 - values, values)
        assert np.array_equal(got, turned @ np.abs(weights))
    assert topk.add_slices(topk.slices(np.zeros((2, 2), dtype=np.int64), 1), np.zeros(2, dtype=np.int64)) == []


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.normal(0, 0.3, 6) if i % 3 else np.full(6, 0.25)).tolist()) for i in range(1, 301)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    whole = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in vectors}
    want = set()
    for q in whole:
        if q % 50 == 0:
            best = sorted(((-int(whole[q] @ whole[i]), i) for i in whole if i != q))[:5]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    is_query = F.col("vec_id") % 50 == 0
    for blocks, queries in ((32_768, 512), (64, 2)):
        found = topk.search(topk.quantised(table), is_query, block_rows=blocks, query_rows=queries)
        assert {tuple(r) for r in found.collect()} == want


def test_search_of_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -1.0]), (0, [1.0, -1.0]), (1, [0.5]), (2, []), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (None, [1.0, 1.0]), (50, [0.0, 0.0]),
    ]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, block string")
    got = sorted(tuple(r) for r in topk.report(table).collect())
    assert got == [(0, 1, 1, 32768), (0, 2, 2, 0), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
    assert topk.report(table.limit(0)).count() == 0 and topk.report(table.where("vec_id = 1")).count() == 0


def test_search_of_large_components(spark):
    rng = np.random.default_rng(7)
    for scale in (1e6, 5e6):
        vectors = [(i, (rng.normal(0, scale / 4, 4) if i % 3 else rng.normal(0, 1, 4)).clip(-scale, scale).tolist()) for i in range(1, 121)]
        vectors.append((150, [scale, -scale, scale, scale]))
        table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
        whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
        want = set()
        for q in whole:
            if q % 50 == 0:
                best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:5]
                want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
        found = topk.report(table)
        assert dict(found.dtypes)["score"] == "bigint"
        assert {tuple(r) for r in found.collect()} == want
    for largest in (1e13, 1e30):  # a score, and a component, that no long holds
        table = spark.createDataFrame([(50, [largest, 0.0]), (51, [largest, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk.report(table).collect()


# ---- URL filter ----


def test_best_split_against_every_split():
    random.seed(4)
    counts = {"the": 40, "th": 9, "ere": 7, "there": 3, "a": 30, "rea": 5, "x": 1, "hea": 2}
    total = sum(counts.values())

    def cost(word):
        return math.log(counts[word] / total) if word in counts else math.log(10 / total) - len(word) * math.log(10)

    for _ in range(40):
        label = "".join(random.choice("thera") for _ in range(random.randrange(1, 9)))
        every = []
        for cuts in itertools.product((0, 1), repeat=len(label) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(label)]
            every.append([label[a:b] for a, b in zip([0, *ends], ends)])
        got = url_filter.best_split(label, counts, total)
        assert "".join(got) == label
        assert sum(map(cost, got)) == pytest.approx(max(sum(map(cost, s)) for s in every))


def test_words_of_any_length_are_found(spark):
    word = "incomprehensibilitiesofall"
    pages = [(1, f"http://my{word}shop.org/", f"my {word} shop my shop"), (2, "http://" + "z" * 70 + ".org/", "nothing " * 200)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    hosts = url_filter.parsed(frame).select("host").distinct()
    tokens = {r.host: r.tokens for r in url_filter.segmented(hosts, url_filter.word_counts(frame)).collect()}
    assert {"my", word, "shop"} <= set(tokens[f"my{word}shop.org"]) and "z" * 70 in tokens["z" * 70 + ".org"]


URLS = [
    (1, "http://A.COM/x", "a.com", "/x", "com/", "allow"),
    (2, "https://example.com/en/1?q", "example.com", "/en/1", "example.com/en/", "block"),
    (3, "https://m.example.com/en/1#t", "m.example.com", "/en/1", "example.com/en/", "block"),
    (4, "https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    (5, "http://b.net/es/x://y", "b.net", "/es/x://y", "net/es/", "block"),
    (6, "http://NET/fr/", "net", "/fr/", "net/fr/", "block"),
    (7, "http://bnet.org/fr/", "bnet.org", "/fr/", None, None),
    (8, "http://a.com", "a.com", "", None, None),
    (9, "a.com/x", "", "", None, "allow"),
    (10, None, "", "", None, "allow"),
    (11, "://?x", "", "", None, "allow"),
    (12, "http://com/en/", "com", "/en/", "com/", "allow"),
    (13, "http://xexample.com/en/", "xexample.com", "/en/", "com/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "html here", "x") for i, u, *_ in URLS], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judged(pages).collect()}
    for i, _, host, path, rule, verdict in URLS:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def brute_scores(pages):
    """Naive Bayes scores by page, counted page by page."""
    import re

    runs = re.compile(r"[^\W_]+")
    unigrams = Counter(w for p in pages for w in runs.findall(re.sub(r"<[^>]*>", " ", p.html or "").lower()))
    total = sum(unigrams.values())
    counts, tokens, prior = {"allow": Counter(), "block": Counter()}, {}, Counter()
    for p in pages:
        rest = (p.url or "").split("://", 1)
        rest = rest[1] if len(rest) == 2 else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        rules = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        held = [f"host {w}" for x in runs.findall(host) for w in url_filter.best_split(x, unigrams, total)]
        held += [f"path {w}" for w in runs.findall(re.sub("[0-9]+", "0", path.lower()))]
        says = max(rules, key=lambda r: len(r[1] + r[2]))[0] if rules else None
        tokens[p.page_id] = held, says
        if says:
            counts[says].update(held)
            prior[says] += 1
    vocabulary = {t for h, _ in tokens.values() for t in h}
    size = {c: sum(n.values()) + len(vocabulary) for c, n in counts.items()}
    out = {}
    for i, (held, says) in tokens.items():
        score = math.log((prior["block"] + 1) / (prior["allow"] + 1))
        score += sum(math.log((counts["block"][t] + 1) / size["block"]) - math.log((counts["allow"][t] + 1) / size["allow"]) for t in held)
        out[i] = score, says or ("block" if score > 0 else "allow")
    return out


def test_scores_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = brute_scores(pages.collect())
    got = url_filter.judged(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.score == pytest.approx(want[r.page_id][0], abs=1e-6) and r.verdict == want[r.page_id][1]


def test_messy_pages(spark):
    rows = [(None, None, None), (1, "", ""), (2, "http://ex.org/é/Ü", None), (2, "http://ex.org/é/Ü", None), (3, "http:///", "<a>x</a>")]
    rows.append((4, "http://" + "longname" * 500 + ".org/" + "p/" * 500, "long name"))
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, score int, _key string")
    got = url_filter.judged(pages).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} <= {"allow", "block"}
    assert url_filter.judged(pages.limit(0)).count() == 0
