import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from portcullis.llm import sentencepiece_codec, token_counts, token_shards
from portcullis.llm.pieces import PieceModel, charsmap_entries
from portcullis.llm.shared_files import mapped

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
MODEL = PieceModel.from_bytes(open(PATH, "rb").read())
PARTS = [" ", "   ", "the", "a", "\n", "\t", "▁", "é", "ß", "日本", "😀", "12", "\u0301", "\0", "x" * 70, "<s>", "</s>", "<0x0A>", "<unk>", "\ufffd", "."]
texts = st.lists(st.sampled_from(PARTS) | st.text(max_size=5), max_size=12).map("".join)
HARD = [None, "", " ", "\n", " a  b ", "ab" * 20000, "é" * 3000 + " " * 500, "word " * 4000]


@settings(max_examples=300, deadline=None)
@given(texts)
def test_encodes_decodes_and_projects_like_the_library(text):
    ids, spans = MODEL.encode([text])[0]
    expected = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert [1, *ids.tolist(), 2] == expected
    assert MODEL.decode(np.array(expected)) == LIBRARY.decode(expected)
    raw = text.encode()
    pieces = LIBRARY.encode(text, return_type="proto").pieces if text else []
    for piece, (begin, end) in zip(pieces, spans.tolist(), strict=True):
        if not LIBRARY.is_byte(piece.id):
            assert raw[begin:end].decode() == piece.surface


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=6))
def test_ids_of_texts_as_they_are(some):
    assert [x.tolist() for x in MODEL.ids(some)] == [LIBRARY.encode(t) for t in some]


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=6))
def test_counts_like_the_library(some):
    if some:
        assert token_counts.Transducer(MODEL).count(some).tolist() == [len(LIBRARY.encode(t)) for t in some]


def test_counts_across_chunks_and_with_a_full_table(monkeypatch):
    some = [" ".join(["alpha", "beta,", "gamma\n"] * 700), "z" * 5000, "", " " * 2500, "α β" * 900, "interdisciplinarity" * 300, "日本語のテキスト" * 200]
    expected = [len(LIBRARY.encode(t)) for t in some]
    own = token_counts.Transducer(MODEL)
    for _ in range(2):
        assert own.count(some).tolist() == expected
    monkeypatch.setattr(token_counts, "STATES", 20)
    assert [own.count([t]).tolist()[0] for t in some] == expected and len(own.states) > 2


def test_counts_of_texts_cut_at_every_offset_of_a_chunk(monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    own = token_counts.Transducer(MODEL)
    text = "Unbelievably,  internationalisation of naïve 日本 façades\tand\n  pseudopseudohypoparathyroidism 😀 x1234567890" * 2
    some = ["y" * shift + text for shift in range(17)] + [text[:cut] for cut in range(0, len(text), 3)]
    assert own.count(some).tolist() == [len(LIBRARY.encode(t)) for t in some]


def test_counts_where_no_unit_begins(monkeypatch):
    """Chunks that depend on all chunks before them: one letter, periods of letters, many-byte characters."""
    r = random.Random(7)
    letters = "".join(sorted(MODEL.joined))
    some = ["".join(r.choices(letters, k=n)) for n in (5, 100, 3000)] + ["".join(r.choices("abc", k=2000)), "a" * 3001, "ab" * 900, "the" * 700, "é" * 999, "ая" * 500, "日本 𐍈x" * 200, "0123456789" * 99, "=" * 800]
    expected = [len(LIBRARY.encode(t)) for t in some]
    for chunk in (4, 16, 64, 1024):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        own = token_counts.Transducer(MODEL)
        assert own.count(some).tolist() == expected
        assert [own.count([t]).tolist()[0] for t in some] == expected


def test_agreement_is_that_of_the_library():
    r, own = random.Random(8), token_counts.Transducer(MODEL)
    as_is = MODEL.merges
    whole = [p for p in r.sample(sorted(own.scores), 3000) if own.edges(p)]
    assert len(whole) > 2500 and all(as_is.encode(p, out_type=str) == [p] for p in whole)
    for _ in range(20_000):
        a, b = r.choice(whole), r.choice(whole)
        assert own.agrees(a, b) == (as_is.encode(a + b, out_type=str) == [a, b])


def charsmap(entries):
    """A compiled map, laid out here as a double array for the test."""
    children, strings, units = {}, b"", {}
    for source, target in entries.items():
        node = children
        for byte in source:
            node = node.setdefault(byte, {})
        node[None] = len(strings)
        strings += target + b"\0"
    size = [1]

    def place(node, at):
        base = size[0] * 256
        size[0] += 1
        units[at] = units.get(at, 0) | (base ^ at) << 10 | (256 if None in node else 0)
        if None in node:
            units[base] = 1 << 31 | node[None]
        for byte, child in node.items():
            if byte is not None:
                units[base ^ byte] = byte
                place(child, base ^ byte)

    place(children, 0)
    # offsets over 2^21 would need the wide form, which these tests don't reach
    blob = np.zeros(max(units) + 256, "<u4")
    for at, unit in units.items():
        blob[at] = unit
    return struct.pack("<I", blob.nbytes) + blob.tobytes() + strings


def test_normalises_by_the_longest_prefix_with_alignment():
    entries = {"ﬁ".encode(): b"fi", "Ａ".encode(): b"A", "e\u0301".encode(): "é".encode(), "\u00a0".encode(): b" ", b"e": b"E"}
    assert charsmap_entries(charsmap(entries)) == entries
    model = PieceModel.from_bytes(open(PATH, "rb").read())
    model.charsmap = entries
    model.starts, model.longest = {k.decode()[:1] for k in entries}, max(map(len, entries))
    text, aligned = model.normalize("Ａ\u00a0ﬁne\u0301e")
    assert text == "▁A▁finéE"
    assert aligned.tolist() == [0, 0, 0, 0, 3, 3, 3, 5, 5, 8, 9, 9, 12, 13]
    model.remove_extra_whitespaces = True
    assert model.normalize("  a   b ")[0] == "▁a▁b" and model.normalize("   ")[0] == ""


def test_query_over_hard_rows(spark):
    rows = [(i, t, i) for i, t in enumerate([*HARD, HARD[4]])] + [(None, "null id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    encoded = sentencepiece_codec.encode(df, PATH, ["doc_id"])
    found = {r.doc_id: r for r in sentencepiece_codec.digest(encoded).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    again = sentencepiece_codec.decode(encoded, PATH, into="again").where("again <> decoded")
    assert again.count() == 0
    assert sentencepiece_codec.digest(sentencepiece_codec.encode(df.limit(0), PATH, ["doc_id"])).collect() == []


def test_count_query(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").withColumnRenamed("doc_id", "key")
    for r in token_counts.count(df, PATH, ["key"], limit=100).collect():
        text = HARD[r.key] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(LIBRARY.encode(text)))
        assert r.over_limit == (r.n_tokens > 100)


@pytest.mark.parametrize("total", [1, 2, 3, 100, 4097])
def test_slots_are_a_permutation(total):
    slots = token_shards.slots_of(np.arange(total), total)
    assert sorted(slots.tolist()) == list(range(total))
    if total > 50:
        assert slots.tolist() != list(range(total))


def test_shards_against_brute_force(spark, tmp_path):
    """Every sequence of the library's ids, in the order of a permutation computed here, one number at a time."""
    r = random.Random(9)
    rows = [(i, t) for i, t in enumerate([*HARD, *["".join(r.choices(PARTS + ["word ", "other "], k=r.randint(1, 200))) for _ in range(60)]])] + [(3, "the same"), (3, "the same"), (4, "the same")]
    length, mask = 16, (1 << 64) - 1

    def mix(value, key):
        value = (value + key) * 0x9E3779B97F4A7C15 & mask
        value ^= value >> 31
        value = value * 0xBF58476D1CE4E5B9 & mask
        return value ^ value >> 29

    def place(number, total, key):
        half = (total - 1).bit_length() + 1 >> 1
        keys = [int.from_bytes(hashlib.blake2b(f"{key}/{n}".encode(), digest_size=8).digest(), "little") for n in range(token_shards.ROUNDS)]
        while True:
            left, right = number >> half, number & (1 << half) - 1
            for k in keys:
                left, right = right, left ^ mix(right, k) & (1 << half) - 1
            number = left << half | right
            if number < total:
                return number

    expected = []
    for i, text in rows:
        if not text:
            continue
        row = xxhash.xxh64_intdigest(text.encode(), seed=xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=42))
        ids = [*LIBRARY.encode(text), LIBRARY.eos_id()]
        for part, at in enumerate(range(0, len(ids), length)):
            number = mix(row ^ mix(part, 1), 2) % token_shards.NUMBERS
            expected.append((place(number, token_shards.NUMBERS, token_shards.KEY), i, part, ids[at : at + length]))
    expected.sort(key=lambda x: x[:3])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = token_shards.materialise(df, PATH, path=str(tmp_path / "shards"), length=length, per_shard=100).orderBy("slot").collect()
    assert [(r.slot, r.doc_id, r.part, r.n_tokens) for r in index] == [(n, i, part, len(ids)) for n, (_, i, part, ids) in enumerate(expected)]
    assert [(n, ids.tolist()) for n, ids in token_shards.read(str(tmp_path / "shards"))] == [(n, x[3]) for n, x in enumerate(expected)]


def test_shards_round_trip_and_resume(spark, tmp_path):
    texts_ = [(i, f"text number {i} " * (i % 60)) for i in range(90)] + [(3, None), (3, ""), (3, "again"), (None, "none")]
    df = spark.createDataFrame(texts_, "doc_id long, text string").repartition(5)
    index = token_shards.materialise(df, PATH, path=str(tmp_path / "shards"), length=64).orderBy("slot").collect()
    read = [*token_shards.read(str(tmp_path / "shards"))]
    assert [r.slot for r in index] == [s for s, _ in read] == list(range(len(index)))
    assert all(hashlib.sha256(ids.tobytes()).hexdigest() == r.ids_sha256 for r, (_, ids) in zip(index, read, strict=True))
    assert [s for s, _ in token_shards.read(str(tmp_path / "shards"), 40)] == list(range(40, len(index)))
    back = {}
    for r, (_, ids) in sorted(zip(index, read, strict=True), key=lambda x: x[0].part):
        if r.doc_id not in (3, None):
            back[r.doc_id] = back.get(r.doc_id, []) + ids.tolist()
    assert {k: LIBRARY.decode(v) for k, v in back.items()} == {k: v for k, v in texts_ if v and k not in (3, None)}
    assert mapped(str(tmp_path / "shards/shard-000000000000")).shape[0] % (4 + 64 * 2) == 0
    empty = token_shards.materialise(df.limit(0), PATH, path=str(tmp_path / "none"))
    assert empty.collect() == [] and [*token_shards.read(str(tmp_path / "none"))] == []


def test_shards_do_not_depend_on_the_split_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_shards, "BUCKET", 2)
    rows = [(i, f"text number {i} " * (1 + i % 40)) for i in range(300)] + [(7, "twice, a row"), (7, "twice, a row"), (None, "no id"), (None, "none either"), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    for parts in (1, 7):
        path = str(tmp_path / f"split-{parts}")
        index = token_shards.materialise(df.repartition(parts), PATH, path=path, length=16, per_shard=200).orderBy("slot").collect()
        assert [r.slot for r in index] == list(range(len(index))) and len({r.shard for r in index}) > 4
        read = [(s, ids.tobytes()) for s, ids in token_shards.read(path)]
        assert [s for s, _ in read] == list(range(len(index)))
        assert [hashlib.sha256(b).hexdigest() for _, b in read] == [r.ids_sha256 for r in index]
        for at in (1, 199, len(index) - 1, len(index), len(index) + 5):
            assert [*token_shards.read(path, at)] == [] if at >= len(index) else [s for s, _ in token_shards.read(path, at)] == list(range(at, len(index)))
        made.append((index, read))
    assert made[0] == made[1]
