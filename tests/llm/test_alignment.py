"""Token alignment against brute force over occurrence pairs."""

import random
from collections import Counter

import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from portcullis.llm import alignment

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
R = random.Random(11)
ODD = [
    None, "", " ", "  two  spaces ", "a▁b", "<s> <unk> <|endoftext|> </s>", "naïve 中文测试 😀😀 ไทย", "tab\tnew\n\n line ", "\0nul", "z" * 3000,
    "ﬁ ½ Å", "The same words. " * 40, "The same words. " * 40, "x", "  　 y", "é",
]


def brute(texts):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        source = b" " + (text or "").encode()
        ids = (a.encode(source.decode(), add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [[bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes_b(i) for i in ids[1]]]
        if any(b"".join(p) != source for p in parts):
            ids, parts = ([], []), ([], [])
        ends = [{}, {}]
        for side in (0, 1):
            n = 0
            for k, p in enumerate(parts[side]):
                n += len(p)
                ends[side][n] = k
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(ids[0][ends[0][c]], ids[1][ends[1][c]]) for c in cuts]
        said, i, j = [], 0, 0
        for c in cuts:
            k, m = ends[0][c] + 1, ends[1][c] + 1
            said.append(",".join(map(str, ids[0][i:k])) + "|" + ",".join(map(str, ids[1][j:m])))
            i, j = k, m
        found.append((len(ids[0]), len(ids[1]), links, ";".join(said)))
    counts = Counter(x for f in found for x in f[2])
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(n, highest.get(y, 0))
    rows = [(n, m, len(x), len(x), sum(counts[p] == highest[p[1]] for p in x), sum(counts[p] for p in x), g) for n, m, x, g in found]
    return rows, counts, highest


def test_words_are_those_of_the_library():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    settled = [c for c in map(chr, range(0x3000)) if alignment.SETTLED.fullmatch(c)]
    assert len(settled) > 1300
    cut = lambda t: [x[1] for x in library.pre_tokenizer.pre_tokenize_str(t)]
    for lead in ("a", "1", "!", " ", "\n", "'"):
        text = "".join(f"{lead}{c}b{c}{c} {c}\n" for c in settled)
        assert cut(text) == [m.span() for m in alignment.WORDS.finditer(text)]
    sides = alignment.Sides(open(A).read(), open(B, "rb").read())
    texts = [t for t in ODD if t] + ["".join(R.choices("ab'sé1½ \n\t.!<|endoftext|>ße²", k=R.randint(1, 60))) for _ in range(2000)]
    assert [a.tolist() for a in sides.encode_a(texts)] == [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    return real.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_brute_force(spark, docs, monkeypatch, small):
    if small:  # stripes in several parts, tallies and portions in several records
        for name, value in {"DEAL": 300, "PAIRS": 200, "LINKS": 100, "LINK_BYTES": 2000, "TEXT_BYTES": 4000}.items():
            monkeypatch.setattr(alignment, name, value)
    source = docs.collect()
    rows, counts, highest = brute([r.text for r in source])
    found = alignment.align(docs.repartition(3), A, B, ["doc_id"]).collect()
    assert sorted(map(tuple, found)) == sorted((r.doc_id, *x) for r, x in zip(source, rows))
    assert sum(r.n_best < r.n_links for r in found) > 5
    encoded = alignment.encode(docs, A, B, ["doc_id"])
    pairs = alignment.pair_rows(alignment.link_counts(encoded, 50257)).collect()
    assert {(p.a, p.b): (p.n_links, p.best) for p in pairs} == {p: (n, n == highest[p[1]]) for p, n in counts.items()}


def test_names_repeated_rows_long_texts_and_empty_tables(spark):
    long = " ".join("".join(R.choices("abcdefgh", k=R.randint(1, 9))) for _ in range(100_000))
    df = spark.createDataFrame([(1, long), (1, long), (None, "x y"), (None, None)], "doc_id long, text string")
    df = df.withColumns({c: F.lit(f"own {c}") for c in ("row", "groups", "links", "n_a", "c0")})
    kept = ["doc_id", "row", "groups", "links", "n_a", "c0"]
    found = alignment.align(df, A, B, kept, groups=lambda g: F.sha2(g, 256)).collect()
    assert len(found) == 4 and all(r[c] == f"own {c}" for r in found for c in kept[1:])
    same = [r.asDict() for r in found if r.doc_id == 1]
    assert same[0] == same[1] and same[0]["n_links"] > 100_000 and same[0]["_n_a"] > 100_000
    assert alignment.align(df.limit(0), A, B, ["doc_id"]).collect() == []
