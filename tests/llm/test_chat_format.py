"""Chat formatting: the fold of event logs, the template's round trip, and the loss mask, by brute force."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from portcullis.llm import chat_format

R = random.Random(12)
LOG = "conv_id long, message long, seq long, kind string, role string, text string"
BITS = ["\\", "### ", "</turn>", "\n", "<", "/turn>", "#", "##", "### assistant\n", "<\\/turn>", "#\\## ", "\\n", "é😀", "a", " ", "\\\\", "</turn>\n", "</tur"]


def odd(n=8):
    return "".join(R.choice(BITS) for _ in range(R.randint(0, n)))


def fold(events):
    """{conv: [(role, text), ...]}, event by event."""
    key = lambda e: tuple((x is not None, x if x is not None else 0) for x in e[2:])
    found = defaultdict(dict)
    for conv, message, _, kind, role, text in sorted(events, key=key):
        m = found[conv].setdefault(message, ["", ""])
        m[0] = role if role is not None else m[0]
        if kind in ("message", "edit"):
            m[1] = text or ""
        elif kind == "regenerate":
            m[1] = ""
        elif kind == "delta":
            m[1] += text or ""
    return {c: [tuple(m) for m in own.values()] for c, own in found.items()}


def test_log_is_folded(spark):
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", "unheard of", None]
    events = [(R.choice([1, 2, 3, None]), R.choice([0, 1, 2, None]), n if n % 7 else n - 1, R.choice(kinds), R.choice([None, "user", "assistant", ""]), R.choice([None, odd()])) for n in range(400)]
    events += [(4, 0, None, "message", "user", "null number"), (4, 0, 1, "delta", None, "!"), (4, 1, 5, "delta", None, None)]
    events += [(5, 0, n, "delta", "assistant", "word ") for n in range(3000)] + [(6, 0, 1, "message", "user", "x" * 200_000)]
    expected = fold(events)
    read = chat_format.read_back(chat_format.render(chat_format.reconstruct(spark.createDataFrame(events, LOG).repartition(4).withColumn("first", F.lit(1)))))
    rows = {r.conv_id: r for r in read.collect()}
    assert {c: [tuple(t) for t in r.said] for c, r in rows.items()} == expected
    assert all(r.learned == "".join(t for role, t in expected[c] if role == "assistant") for c, r in rows.items())


def test_text_under_the_mask(spark):
    messages = [(c, m, m, R.choice(["user", "assistant", odd(3)]), odd()) for c in range(60) for m in range(R.randint(1, 9))]
    frame = spark.createDataFrame(messages, "conv_id long, message long, first long, role string, text string")
    rows = chat_format.read_back(chat_format.render(frame)).collect()
    for r in rows:
        own = [x[3:] for x in messages if x[0] == r.conv_id]
        assert [tuple(t) for t in r.said] == own
        assert r.formatted.count(chat_format.END) == len(own) and r.formatted.count("### ") == len(own)
        assert [r.formatted[b:].startswith("### ") for b in r.turns] == [True] * len(own)
        spans = [r.formatted[s.begin : s.end] for s in r.loss]
        assert [spark_free(s) for s in spans] == [t for role, t in own if role == "assistant"]


def spark_free(text):
    return "\\".join(p.replace("#\\## ", "### ").replace("<\\/turn>", "</turn>") for p in text.split("\\\\"))


def test_conversations(spark):
    rows = [(c, t, R.choice(["user", "assistant", "system", None, "tool"]), R.choice([None, "", "plain " * 200, odd(20)])) for c in range(40) for t in range(R.randint(1, 6))]
    rows += [(41, None, "user", "null turn"), (41, 0, "user", "tie"), (41, 0, "user", "tie"), (None, 0, "assistant", "nobody's"), (42, 0, "assistant", "y" * 500_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("message", "seq", "kind", "first", "said")})
    found = {r.conv_id: r for r in chat_format.digest(chat_format.read_back(chat_format.conversations(df.repartition(3)))).collect()}
    own = defaultdict(list)
    for c, turn, role, text in [*rows, *chat_format.ADDED]:
        role, text = role or "", text or ""
        own[c].append(((turn is not None, turn or 0), role, hashlib.md5(text.encode()).hexdigest(), text))
    assert found.keys() == own.keys()
    for c, turns in own.items():
        turns = [(x[1], x[3]) for x in sorted(turns)]
        learned = "".join(t for role, t in turns if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
    assert [r.conv_id for r in chat_format.conversations(df.limit(0)).collect()] == [-7]
    log = chat_format.conversation_log(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}


def test_plan_has_no_python(spark):
    plan = chat_format.digest(chat_format.read_back(chat_format.conversations(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
