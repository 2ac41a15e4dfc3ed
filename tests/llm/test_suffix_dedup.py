import hashlib
import random
from collections import Counter

import numpy as np

from portcullis.llm import suffix_dedup as S


def brute(texts):
    windows = Counter()
    for t in texts:
        windows.update(t[i : i + 400] for i in range(len(t) - 399))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if windows[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, exact = prose(150), "x" * 0 + prose(70)
    texts = [None, "", "a" * 399, "a" * 400, "b" * 1500, "Erhent " * 300, "qErhent " * 3 + "Erhent " * 200, prose(300)]
    texts += [texts[-1], texts[-1][:700] + "!" + texts[-1][701:], prose(3000)]
    texts += [prose(r.randint(0, 60)) + shared + prose(r.randint(0, 60)) for _ in range(40)]
    texts += [prose(5) + exact[:400], exact[:400] + "z", exact[:399] + "#", "\0" * 900, prose(10) + "\0" * 450]
    return texts


def test_suffix_array_and_prefixes():
    r = random.Random(2)
    for text in [b"banana" * 30, b"\0" * 50, bytes(r.choice(b"ab") for _ in range(700)), b"x"]:
        order, rank = S.suffix_array(np.frombuffer(text, np.uint8))
        expected = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == expected and (rank[order] == np.arange(len(text))).all()
        found = S.common_prefixes(np.frombuffer(text, np.uint8), order, rank, lanes=7)
        for k in range(1, len(text)):
            a, b = text[expected[k - 1] :], text[expected[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert found[k] == n


def strip(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, __x int")
    cut = S.strip(df, ["doc_id", "__x"])
    from pyspark.sql import functions as F

    return cut.withColumn("sha", F.sha2("kept", 256)).collect()


def check(spark, texts):
    rows = [(i // 2 if i % 7 == 0 else i, t, "own", 1) for i, t in enumerate(texts)]
    expected = brute([(t or "").encode() for t in texts])
    found = strip(spark, rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in found) == sorted((row[0], *e) for row, e in zip(rows, expected))


def test_against_brute_force(spark):
    check(spark, planted())


def test_large_hashes_are_merged_across_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "HASH_BYTES", 2000)
    check(spark, planted(8))


def test_dedup_keeps_columns_and_whole_characters(spark):
    text = "é" * 500
    df = spark.createDataFrame([(1, "k", text), (2, "k", "a" + text), (3, None, None), (4, "k", "short")], "doc_id long, kept string, text string")
    rows = {r.doc_id: r for r in S.dedup(df).collect()}
    assert rows[3].text is None and rows[4].text == "short" and rows[1].text == "" and rows[2].text == "a" and rows[2].kept == "k"


def test_empty_table(spark):
    assert strip(spark, []) == []


def without_runs(texts, n):
    runs = Counter()
    for t in texts:
        words = t.split()
        runs.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for t in texts:
        words = t.split()
        gone = set()
        for i in range(len(words) - n + 1):
            if runs[tuple(words[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        out.append([w for i, w in enumerate(words) if i not in gone])
    return out


def check_runs(spark):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(n))
    passages = [prose(51) for _ in range(4)]
    assert all(len(p.encode()) < 400 for p in passages)
    texts = ["", "a", prose(200), "\n".join(passages[0].split()), "x " * 60]
    texts += [f"{prose(r.randint(0, 80))}  {p}\t{prose(r.randint(0, 80))}" for p in passages for _ in range(12)]
    texts += [prose(60) + " " + " ".join(p.split()[:50]) + " " + prose(60) for p in passages]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {x.doc_id: x.text.split() for x in S.dedup(df, words=51).collect()}
    assert [found[i] for i in range(len(texts))] == without_runs(texts, 51)
    assert sum(map(len, found.values())) < sum(len(t.split()) for t in texts) - 40 * 51


def test_short_passages_of_many_words(spark):
    check_runs(spark)


def test_short_passages_across_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "HASH_BYTES", 2000)
    check_runs(spark)


def test_pipeline_cuts_passages_of_51_words(spark):
    import corpus_pipeline

    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcde") for _ in range(r.randint(2, 6))) for _ in range(n))
    passage, own = prose(51), [prose(80) for _ in range(3)]
    rows = [(i, f"{t} {passage if i else prose(51)} {t[::-1]}", 0) for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = {x.doc_id: x.text for x in corpus_pipeline.passages(spark, df, "").collect()}
    assert found == {i: t if i == 0 else f"{own[i]}  {own[i][::-1]}" for i, t, _ in rows}


def test_sorting_to_a_depth():
    r = random.Random(3)
    for text in [b"banana" * 30, b"\0" * 50, bytes(r.choice(b"ab\0") for _ in range(700)), bytes(r.choice(b"ab") for _ in range(90)) * 4, b"\0\0\0"]:
        for depth in (9, 20, 33):
            rank = S.suffix_array(np.frombuffer(text, np.uint8), depth)[1]
            windows = sorted(range(len(text) - depth + 1), key=lambda i: text[i : i + depth])
            for a, b in zip(windows, windows[1:]):
                assert rank[a] <= rank[b] and (rank[a] == rank[b]) == (text[a : a + depth] == text[b : b + depth])


def test_texts_cut_together_are_cut_as_each_alone(monkeypatch):
    texts = [(t or "").encode() for t in planted()]
    texts += ["".join(f"{w} " for w in ("a" * 70, "b" * 64, "c" * 9, "d" * 8)).encode() * 30, " ".join("abcdefgh"[: i % 8 + 1] for i in range(300)).encode()]
    for unit in (S.BYTES, S.word_unit(51)):
        for together in (1, 3000, 1 << 20):
            monkeypatch.setattr(S, "TOGETHER", together)
            found = [row for x in S.segments_of_each(texts, unit) for row in zip(*[c.tolist() for c in x[:5]], x[5], strict=True)]
            alone = []
            for n, text in enumerate(texts):
                data = unit.read(text)
                for value, start, windows, twice in zip(*[c.tolist() for c in S.segments(data, unit)], strict=True):
                    alone.append((n, value, start, windows, twice, S.xxhash.xxh3_128_digest(data[start : start + windows + unit.length - 1])))
            assert found == alone
    words = texts[-1].split() + texts[-2].split()
    assert len(set(S.word_hashes(b" ".join(words)).tolist())) == len(set(words))
