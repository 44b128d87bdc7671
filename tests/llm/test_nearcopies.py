"""The near-dedup stage against brute-force Jaccard over five-word shingles."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from spreadframe.llm import nearcopies
from spreadframe.llm.simhash import fingerprint

from .test_text_operators import components


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def test_stage_finds_every_near_copy(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    notice = " ".join(rng.choices(vocabulary, k=30))
    texts = [None, "", "  ", "Two words", "two  WORDS", "two other"]
    for base in range(30):
        words = rng.choices(vocabulary, k=rng.randrange(5, 150))
        texts += [" ".join(words), notice + " " + " ".join(words)]
        for _ in range(4):  # from equal to well below the threshold
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    whole = components(sorted(sets), lambda a, b: near(sets[a], sets[b]))
    got = sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect())
    assert got == sorted({min(b for b in whole if whole[b] == whole[a]) for a in whole})


def test_stage_on_the_supplied_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    whole = components(sorted(sets), lambda a, b: near(sets[a], sets[b]))
    got = sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect())
    assert got == sorted({min(b for b in whole if whole[b] == whole[a]) for a in whole})


def test_fingerprints_lead_and_late_meetings_are_not_compared(spark):
    """Pairs that SimHash links are candidates; a group just under the similarity shares first shingles, but only where too little is left."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join([*base, "end"])]
    for k in range(20):  # each with an end of its own, 13 of 113 words, and alike to 0.79
        texts.append(" ".join([*base[:-2], *(f"own{k}_{rng.randrange(10**6)}" for _ in range(13))]))
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "_key long, _bytes binary")
    prints = {i: int(r["fp"]) for i, r in enumerate(rows.orderBy("_key").select(fingerprint(F.col("_bytes").cast("string")).alias("fp")).collect())}
    linked = {(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in nearcopies._simhash_pairs(rows).collect()} == linked
    sets = [shingles(t) for t in texts]
    places = {(r["node"], r["gram"]): r["pos"] for r in nearcopies._prefixes(rows, 5, (4, 5)).collect()}
    met = 0
    for a in range(len(texts)):
        for b in range(a):
            x, y = len(sets[a]), len(sets[b])
            both = [(p, places[b, g]) for (n, g), p in places.items() if n == a and (b, g) in places]
            fits = [pq for pq in both if 9 * min(x - pq[0], y - pq[1]) >= 4 * (x + y)]
            assert fits or not near(sets[a], sets[b])
            met += bool(both) and not fits
    assert met > 100
