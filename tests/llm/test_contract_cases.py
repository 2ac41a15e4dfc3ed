"""Names that clash, very long texts, and language identification by brute force."""

import random

from pyspark.sql import functions as F
from public_tokenizers import path

from portcullis.llm import decontaminate, language_id, ngram_lm, sentencepiece_codec, suffix_dedup, token_counts
from portcullis.llm.common import Scratch, row_set

R = random.Random(4)
MODEL = path("piece_bpe_32k.model")
TAKEN = ["score", "n_tokens", "n_bytes", "lang_pred", "ids", "rows", "text_", "c0", "r0"]


def prose(n, letters="abcdefgh"):
    return " ".join("".join(R.choice(letters) for _ in range(R.randint(2, 7))) for _ in range(n))


def frame(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({c: F.lit(f"own {c}") for c in TAKEN}).withColumn("lang", F.lit("aa"))


def test_columns_with_the_names_of_results_stay(spark):
    texts = [None, "", prose(40), prose(40), "x"]
    df, kept = frame(spark, texts), ["doc_id", *TAKEN]
    bench = spark.createDataFrame([(0, texts[2])], "item_id long, text string")
    made = {
        "counts": (token_counts.count(df, MODEL, kept), 5),
        "codec": (sentencepiece_codec.encode(df, MODEL, kept), 5),
        "strip": (suffix_dedup.strip(df, kept), 5),
        "lm": (ngram_lm.score(df, ngram_lm.train(df), kept), 5),
        "language": (language_id.predict(df, language_id.train(df), kept), 5),
        "leaks": (decontaminate.contamination(df, bench, kept), 1),
    }
    for name, (found, n) in made.items():
        rows = found.collect()
        assert len(rows) == n and len({c.lower() for c in found.columns}) == len(found.columns), name
        assert all(r[c] == f"own {c}" for r in rows for c in TAKEN), name
    assert "_n_tokens" in made["counts"][0].columns and "_score" in made["language"][0].columns


def test_very_long_texts(spark):
    long = prose(120_000)
    item = prose(40)
    texts = [long + " " + item, prose(50), "z" * 700_000, long[:500_000]]
    df = frame(spark, texts).select("doc_id", "text", "lang")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contamination(df, bench, ["doc_id"]).collect()] == [0]
    scored = {r.doc_id: r for r in ngram_lm.score(df, ngram_lm.train(df), ["doc_id"]).collect()}
    assert scored[0].n_tokens == 120_041 and scored[2].n_tokens == 2
    named = {r.doc_id: r.lang_pred for r in language_id.predict(df, language_id.train(df), ["doc_id"]).collect()}
    assert named == dict.fromkeys(range(4), "aa")
    cut = {r.doc_id: r.n_removed for r in suffix_dedup.strip(df, ["doc_id"]).collect()}
    assert cut == {0: 500_000, 1: 0, 2: 700_000, 3: 500_000}


def brute_languages(train, asked, near=0.25, least=2):
    """The most shared n-grams, with sets in place of the filter."""

    def grams(text):
        padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        return [padded[i : i + 4] for i in range(len(padded) - 3) if "  " not in padded[i : i + 4]]

    counts = {}
    for text, lang in train:
        for g in grams(text):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    top = {}
    for lang, c in counts.items():
        for g, n in c.items():
            if n >= least:
                top[g] = max(top.get(g, 0), n / totals[lang])
    held = {lang: {g for g, n in c.items() if n >= least and n / totals[lang] >= near * top[g]} for lang, c in counts.items()}
    found = []
    for text in asked:
        own = grams(text)
        shares = {lang: sum(g in held[lang] for g in own) / max(1, len(own)) for lang in sorted(held)}
        best = max(sorted(shares), key=lambda x: shares[x])
        if not any(c.isalpha() for c in text):
            found.append(("und", 0.0))
        else:
            found.append((best if shares[best] else max(sorted(totals), key=totals.get), shares[best]))
    return found


def test_language_id_against_brute_force(spark):
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "ñéçßü"}
    train = [(prose(30, own), lang) for lang, own in letters.items() for _ in range(30)] + [(prose(5, "cde"), "aa")]
    asked = [prose(R.randint(1, 12), R.choice([*letters.values(), "abcdefg"])) for _ in range(150)] + ["", "12", "qqq www", "a", "cdcd cdcd"]
    model = language_id.train(spark.createDataFrame(train, "text string, lang string"))
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, text string")
    found = {r.i: (r.lang_pred, r.score) for r in language_id.predict(rows, model, ["i"]).collect()}
    for i, (lang, score) in enumerate(brute_languages(train, asked)):
        assert found[i][0] == lang and abs(found[i][1] - score) < 1e-3, asked[i]


def test_row_sets(spark, tmp_path):
    spark.range(1000).repartition(7).withColumn("row", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    chosen = table.where("id % 3 = 0 and row > 100")
    scratch = Scratch(spark)
    held = row_set(chosen.select("row"), "test", scratch)
    assert {r.id for r in table.where(held("row")).collect()} == {r.id for r in chosen.collect()}
    none = row_set(chosen.where("id < 0").select("row"), "test", scratch)
    assert table.where(none("row")).count() == 0
    scratch.clear()
