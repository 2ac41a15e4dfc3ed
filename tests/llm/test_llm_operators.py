import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from portcullis.llm import decontaminate, language_id, ngram_lm, simhash_dedup, url_rules, vector_topk
from portcullis.llm.common import connected
from portcullis.llm.elias_fano import EliasFano

R = random.Random(11)


def prose(n, letters="abcde"):
    return " ".join("".join(R.choice(letters) for _ in range(R.randint(2, 6))) for _ in range(n))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_connected(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(200, 200), (300, 301), (301, 300)]
    found = {r.node: r.root for r in connected(spark.createDataFrame([*edges, (None, 5)], "a long, b long")).collect()}
    expected = roots({x for e in edges for x in e}, edges)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(found) == groups({k: v for k, v in expected.items() if k != 200})
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "TILE", 4)
    long = prose(400)
    words = long.split()
    near = [" ".join(words[:i] + ["edit"] + words[i + 1 :]) for i in range(0, 400, 25)]
    texts = [None, "", " \t", "One", "one", "one two", "Ä b c d", *near, long, long, *[prose(R.randint(1, 8), "ab") for _ in range(60)]]
    rows = [(i + 5, t, 0) for i, t in enumerate(texts)] + [(7, "one", 0), (None, long, 0)]
    found = simhash_dedup.components(spark.createDataFrame(rows, "doc_id long, text string, fp long")).collect()
    prints = [brute_fingerprint(t or "") for _, t, _ in rows]
    distinct = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 2]
    root, least = roots(distinct, links), {}
    for (i, _, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    expected = sorted((str(i), p, least[root[p]]) for (i, _, _), p in zip(rows, prints, strict=True))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in found) == expected
    assert simhash_dedup.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_simhash_dedup_keeps_one_of_each_group(spark):
    a, b = prose(300), prose(300)
    words = a.split()
    near = " ".join([*words[:100], "edit", *words[101:200], "another", *words[201:]])
    apart = " ".join(w if i % 12 else "other" for i, w in enumerate(words))
    rows = [(2, a, "x"), (1, a, "y"), (1, a, "y"), (3, b, "z"), (None, b, "z"), (None, prose(200), "n"), (7, near, "x"), (8, apart, "x"), (9, None, "x"), (10, " ", "x")]
    kept = simhash_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, __row string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "8", "9", "None"] and {r["__row"] for r in kept} <= {"x", "y", "z", "n"}


def test_similarity_of_near_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "TILE", 16)
    word = lambda: "".join(R.choice("abcdefgh") for _ in range(6))
    texts = [None, "", "one two", "one  two", "a b c d e f g h", "a b c d e f g h i"]
    for n in (12, 40, 150, 400):
        for changed in range(0, 12):
            words = [word() for _ in range(n)]
            near = list(words)
            for i in range(changed * n // 150):  # edits at the end and inside it
                near[n // 2 + i * 11 % (n // 2)] = word()
            texts += [" ".join(words), " ".join(near), " ".join([*words, *[word() for _ in range(n * changed // 40)]])]
    sets = []
    for t in texts:
        words = (t or "").split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    shares = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b]
    assert sum(0.8 <= s < 0.85 for s in shares) > 5 and sum(0.7 < s < 0.8 for s in shares) > 5
    root = roots(range(len(texts)), links)
    least = {}
    for i in range(len(texts)):
        least[root[i]] = min(i, least.get(root[i], i))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash_dedup.dedup(df).collect()} == set(least.values())


def test_language_id(spark):
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "ñéçßü"}
    rows = [(i, prose(60, letters[lang]), lang) for i in range(120) for lang in letters]
    rows += [(1, None, "aa"), (2, "123 !?", "aa"), (3, "", None), (5, prose(30, "abcde"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert df.where(language_id.held_out("doc_id")).select("doc_id").distinct().count() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(120))
    model = language_id.train(df.where(~language_id.held_out("doc_id")))
    assert model.languages == ["aa", "bb", "cc"]
    held = language_id.predict(df.where(language_id.held_out("doc_id")), model, ["doc_id", "lang"]).where("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in held if r.lang_pred != "und"]) > 0.98
    odd = language_id.predict(df.where("text is null or text in ('', '123 !?')"), model, ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)} and len(odd) == 3
    none = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, none, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model, ["doc_id"]).collect() == []


def test_language_filter_grows_with_its_ngrams(spark):
    r = random.Random(2)
    letters = {"aa": [chr(0x4E00 + i) for i in range(3000)], "bb": [chr(0x4E00 + i) for i in range(2000, 5000)]}
    texts = {lang: ["".join(r.choices(own, k=1000)) for _ in range(1500)] for lang, own in letters.items()}
    rows = [(i, t, lang) for lang in texts for i, t in enumerate(texts[lang])]
    train = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string").repartition(8)
    asked = spark.createDataFrame([(i, t[:30], lang) for i, t, lang in rows if i < 200], "doc_id long, text string, lang string")
    found = language_id.predict(asked, language_id.train(train), ["lang"]).collect()
    assert all(x.lang == x.lang_pred and x.score > 0.9 for x in found) and len(found) == 400


def test_elias_fano():
    for values in ([0], [3, 3, 3, 9], sorted(R.randrange(1 << 40) for _ in range(3000)), list(range(500)), []):
        arrays, bits = EliasFano.arrays(np.array(values, np.uint64))
        coded = EliasFano(arrays, bits)
        assert coded.access(np.arange(len(values))).tolist() == values
        if values and len(set(values)) == len(values):
            asked = np.array([*values[::7], *[v + 1 for v in values[::5]], 1 << 50], np.uint64)
            found = coded.find(asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(values)))
            index = {v: i for i, v in enumerate(values)}
            assert found.tolist() == [index.get(v, -1) for v in asked.tolist()]


def brute_model(train):
    grams = [Counter() for _ in range(3)]
    for text in train:
        words = ["<s>", *text.lower().split(), "</s>"]
        grams[0].update(words[1:])
        grams[1].update(zip(words, words[1:]))
        grams[2].update(zip(words, words[1:], words[2:]))
    total, distinct = sum(grams[0].values()), len(grams[0])
    after = defaultdict(Counter)
    for n in (1, 2):
        for g, c in grams[n].items():
            after[g[:-1]][g[-1]] += c

    def p0(w):
        return (grams[0][w] + 0.1) / (total + 0.1 * (distinct + 1))

    def p(context, w):
        if not context:
            return p0(w)
        lower = p(context[1:], w)
        seen = after.get(context)
        if not seen:
            return lower
        n = sum(seen.values())
        left = ngram_lm.BACK * len(seen) / (ngram_lm.BACK * len(seen) + n)
        return (1 - left) * seen[w] / n + left * lower

    def scores(text):
        words = ["<s>", *text.lower().split(), "</s>"]
        base = sum(math.log10(p0(w)) for w in words[1:])
        return base, sum(math.log10(p(tuple(words[max(0, i - 2) : i]), words[i])) for i in range(1, len(words))), sum(grams[0][w] > 0 for w in words[1:])

    return total, scores


def check_model(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    train = [t or "" for i, t in enumerate(texts) if i % 5]
    total, scores = brute_model(train)
    layout = ngram_lm.train(df.where("doc_id % 5 <> 0"))
    for r in ngram_lm.score(df, layout, ["doc_id"]).collect():
        base, score, known = scores(texts[r.doc_id] or "")
        assert (r.n_known, r.train_tokens) == (known, total)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-3 * r.n_tokens


def test_ngram_model_against_brute_force(spark):
    check_model(spark, [None, "", "one", "New words here", *[prose(R.randint(1, 80), "ab") for _ in range(80)]])


@pytest.mark.parametrize("narrow", [100, (1 << 32) - 2])
def test_ngram_model_with_words_over_several_shards(spark, monkeypatch, narrow):
    monkeypatch.setattr(ngram_lm, "NARROW", narrow)  # beyond it, ids of 64 bits
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 150)
    monkeypatch.setattr(ngram_lm, "PIECE_WORDS", 30)
    check_model(spark, [*[prose(R.randint(1, 80), "ab") for _ in range(80)], "the " * 300])


def test_ngram_model_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = ngram_lm.score(df, ngram_lm.train(df.limit(0)), ["doc_id"]).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_wand_retrieves_all_above_threshold():
    items = [{"id": i, "words": prose(R.randint(3, 40), "abc").split()} for i in range(90)]
    for x in items:
        x["answer_shingles"] = min(2, len(decontaminate.shingles(x["words"])) - 1)
    frequency = Counter(w for x in items for w in set(x["words"]))
    index = decontaminate.Index(items, frequency, len(items), 20.0)
    for _ in range(60):
        query = set(R.choice(items)["words"][:: R.choice([1, 1, 2])] + prose(30, "abc").split())
        scores = Counter()
        for w in query & index.postings.keys():
            for i, v in zip(*index.postings[w][:2], strict=True):
                scores[i] += v
        found = dict(index.retrieve(query))
        assert sorted(found) == sorted(i for i, s in scores.items() if s >= 1)


def test_decontamination_against_brute_force(spark):
    items = [(i, prose(R.randint(2, 45))) for i in range(30)] + [(90, None), (91, ""), (3, "repeated id " + prose(20))]
    texts = []
    for _, item in items:
        if item:
            words = item.split()
            texts += [prose(100) + " " + item.upper() + ", " + prose(3), " ".join(words[: len(words) // 2]) + prose(9)]
            words[len(words) // 2] = "changed"
            texts.append(prose(200) + " " + " ".join(words))
    rows = [(i, t, 0) for i, t in enumerate([None, "", *texts])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench, ["doc_id"]).collect()}
    expected = set()
    for d, text, _ in rows:
        words = decontaminate.words_of((text or "").lower())
        own = {n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for n in range(1, 6)}
        for i, item in items:
            item_words = decontaminate.words_of((item or "").lower())
            parts = decontaminate.shingles(item_words)
            if parts:
                hits = [p in own[len(p)] for p in parts]
                cut = len(parts) - max(0, min(round(0.2 * len(item_words)), len(parts) - 1))
                shares = [sum(h) / len(h) if h else 1 for h in (hits, hits[:cut], hits[cut:])]
                if shares[0] >= 0.8 and min(shares) >= 0.5:
                    expected.add((d, i))
    assert found == expected and len(expected) > 30
    clean = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert clean == {d for d, _, _ in rows} - {d for d, _ in expected}
    assert decontaminate.contamination(docs, bench.limit(0), ["doc_id"]).collect() == []


def test_decontamination_of_items_in_parts(spark):
    items = [(i, prose(60)) for i in range(6)]
    docs = []
    for i, item in items:
        words = item.split()
        docs += [(i * 10 + gap // 100, " ".join([*words[:30], prose(gap), *words[30:]])) for gap in (0, 100, 300, 700)]
        docs.append((i * 10 + 9, " ".join([*words[:30], prose(300)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, ["doc_id"]).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i * 10 + gap, i) for i, _ in items for gap in (0, 1, 3, 7)}
    assert all(r.score >= 1 and r.overlap >= 0.8 for r in found)


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_topk, "BLOCK", 16)
    monkeypatch.setattr(vector_topk, "QUERIES", 3)
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=8).round(1).tolist()) for i in range(150)]
    good += [(7, good[7][1]), (None, good[9][1]), (200, good[0][1])]
    bad = [(300, None), (301, []), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (400, [float("inf")] + [0.0] * 7), (500, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").repartition(4)
    found = defaultdict(list)
    for r in vector_topk.top_k(df, F.col("vec_id") % 50 == 0, k=6).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    ints = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in good]
    for n, (q, v) in enumerate(ints):
        if q is not None and q % 50 == 0:
            ranked = sorted(((-int(v @ c), i if i is not None else 1 << 62) for k, (i, c) in enumerate(ints) if k != n))[:6]
            assert [(i if i is not None else 1 << 62, s) for i, s in found.pop(q)] == [(i, -s) for s, i in ranked]
    assert set(found) <= {500} and not found.get(500)
    assert vector_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_sends_no_blocks_by_way_of_the_driver(spark, monkeypatch):
    """Neither the queries, once for each group, nor all blocks of a length to one task."""
    monkeypatch.setattr(vector_topk, "BLOCK", 16)
    plans, written = [], vector_topk.written

    def seen(df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name, **options)

    monkeypatch.setattr(vector_topk, "written", seen)
    df = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    found = vector_topk.top_k(df, F.col("vec_id") % 50 == 0, k=3)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    compared = [p for p in plans if "q_vectors" in p]
    assert compared and not any("BroadcastHashJoin" in p for p in compared)
    with_cells = [p for p in plans if "cells" in p and "least" in p and "q_vectors" not in p]
    assert with_cells and not any("hashpartitioning(dims" in p for p in with_cells if "vectors" in p)
    assert found.count() == 4 * 3


def test_top_k_of_large_and_non_finite_components(spark):
    r = random.Random(8)
    nan, inf = float("nan"), float("inf")
    scales = [1, 5000, 3000, 1, 1e6, 2.0**28]
    good = [(i, [r.uniform(-1, 1) * scales[i % 6] if j % 4 else float(r.randint(-3, 3)) for j in range(8)]) for i in range(120)]
    good += [(122, [2.0**38, *[0.0] * 7]), (123, [0.5, 0.0, 0.0, 0.0, -(2.0**39), *[0.0] * 3])]
    # Beyond 64 bits alone, or with the product: no matter unless such a score is among the best.
    good += [(124, [0.0] * 7 + [-9.1e15]), (125, [0.0] * 4 + [1e300, *[0.0] * 3]), (126, [*[0.0] * 6, 1e200, -1e200]), (140, [1.0, *[0.0] * 7]), (141, [0.0, 1.0, 2.0, 0.0, -3.0, 0.0, -1.0, 1.0])]
    bad = [(10, [nan, *[1.0] * 7]), (200, [1e3, nan, *[1e3] * 6]), (201, [1e3, inf, *[1e3] * 6]), (202, [1e3, -inf, *[1e3] * 6]), (203, [1e3, None, *[1e3] * 6])]
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in good}
    score = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b], strict=True))
    best = {q: sorted((-score(q, c), c) for c in ints if c != q)[:5] for q in ints}
    queries = [q for q in ints if q % 10 in (0, 1) and all(abs(s) < 1 << 63 for s, _ in best[q])]
    assert {140, 141} <= set(queries) and any(abs(score(q, c)) >= 1 << 63 for q in queries for c in ints) and len(queries) > 5 and any(abs(x) > 1 << 22 for q in queries for x in ints[q])
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").repartition(3)
    found = defaultdict(list)
    for x in vector_topk.top_k(df, F.col("vec_id").isin(queries + [200, 201, 202, 203]), k=5).orderBy("query_id", "rank").collect():
        found[x.query_id].append((x.vec_id, x.score))
    assert found == {q: [(c, -s) for s, c in best[q]] for q in queries}
    with pytest.raises(Exception, match="does not fit 64 bits"):
        vector_topk.top_k(df, F.col("vec_id") == 126).collect()


def test_url_rules(spark):
    rules = [*url_rules.RULES, ("deep.example.net", "/", "block"), ("EXAMPLE.net", "/en/x", "block"), ("same.org", "/a", "allow"), ("same.org", "/a", "block")]
    urls = [
        (1, "http://WWW.Example.NET/en/1"), (2, "http://net/x"), (3, "http://planet/x"), (4, "http://foo.net"), (5, "x://a.example.net/en/xy?q#f"),
        (6, "http://deep.example.net/en/q"), (7, None), (8, "no scheme"), (9, "://"), (10, "http://m.example.com/de/"), (11, "http://m.example.com/de"),
        (12, "http://a.org/fr/#x"), (13, "http://same.org/ab"), (14, "http://ÄB.net/"), (1, "http://WWW.Example.NET/en/1"), (15, "a://b://c.net/d"),
    ]
    df = spark.createDataFrame([(i, u, "own") for i, u in urls], "page_id long, url string, host string").repartition(3)
    found = sorted(url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect(), key=lambda r: r.page_id)

    def expected(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = rest[:cut].translate(str.maketrans(url_rules.UPPER, url_rules.LOWER))
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(-len(h + p), -len(h), v != "block", h.lower() + p, v) for h, p, v in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        return host, path, min(fits)[3] if fits else None, min(fits)[4] if fits else "allow"

    assert [(r["_host"], r.path, r.rule, r.verdict) for r in found] == [expected(u) for _, u in sorted(urls, key=lambda x: x[0])]
    assert {r.host for r in found} == {"own"}
    none = url_rules.judge(df.drop("host"), spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r.verdict for r in none.collect()} == {"allow"} and none.count() == len(urls)


def test_pipeline_stages_on_odd_documents(spark, tmp_path):
    import corpus_pipeline

    copy = prose(300)
    rows = [(1, copy, "en", "s", 1, "x"), (2, copy, "en", "s", 1, None), (3, None, None, None, None, None), (4, "", "en", "s", 0, "x"), (5, "12 34", "en", "s", 5, "x"), (5, prose(200), "en", None, 9, "x")]
    rows += [(i, prose(60), "en", "s", 1, "x") for i in range(10, 30)] + [(None, prose(90), "en", "s", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string")
    bench = spark.createDataFrame([(0, " ".join(rows[10][1].split()[5:45]))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    leaking, sizes = rows[10][0], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "__row"]
        sizes.append(df.count())
    assert sizes == [24, 23, 23, 22] and leaking not in {r.doc_id for r in df.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == 22
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
