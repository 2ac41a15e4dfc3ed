"""Recall of the near-copy search on real documents with planted edits, by length."""

import random

from pyspark.sql import functions as F

from portcullis.llm import simhash_dedup

R = random.Random(21)
CLASSES = [(12, 30), (30, 80), (80, 200), (200, 600), (600, 3000)]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def edited(words, letters):
    """A copy with words replaced, left out or added, as long as its similarity stays at 0.8 or more."""
    own, best = shingles(words), None
    copy = list(words)
    for _ in range(400):
        at = R.randrange(len(copy))
        word = "".join(R.choices(letters, k=6))
        changed = R.choice([copy[:at] + [word] + copy[at + 1 :], copy[:at] + copy[at + 1 :], copy[:at] + [word] + copy[at:]])
        other = shingles(changed)
        share = len(own & other) / len(own | other)
        if share < 0.8:
            break
        copy, best = changed, share
    return copy, best


def test_recall_of_edited_documents(spark, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").distinct().collect()
    texts = [r.text.split() for r in docs]
    rows, planted, number = [], {}, 0
    for n, (low, high) in enumerate(CLASSES):
        some = [t for t in texts if len(t) >= low]
        for i in range(120):
            start = R.choice(some)
            size = R.randint(low, min(high, len(start)))
            at = R.randrange(len(start) - size + 1)
            # Words of its own keep the documents of a class apart from one another.
            words = [f"{w}{number}" if k % 3 == 0 else w for k, w in enumerate(start[at : at + size])]
            copy, share = edited(words, "abcdefgh")
            if share is None:
                continue
            rows += [(2 * number, " ".join(words)), (2 * number + 1, " ".join(copy))]
            planted[2 * number + 1] = (n, share)
            number += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash_dedup.dedup(frame).select("doc_id").collect()}
    assert all(i in kept for i, _ in rows if i % 2 == 0)
    near = [(n, share, i not in kept) for i, (n, share) in planted.items()]
    assert sum(share < 0.85 for _, share, _ in near) > 200
    with capsys.disabled():
        for n, (low, high) in enumerate(CLASSES):
            own = [found for c, _, found in near if c == n]
            print(f"\nnear copies of {low} to {high} words: {sum(own)} of {len(own)} found", end="")
    assert all(found for _, _, found in near)
