"""Text without spaces is read to its end, and the models equal plain Kneser-Ney ones."""

import math
import random
from collections import Counter

import numpy as np

from spreadframe.llm import toxicity


def grams(token):
    return [g for u in toxicity._units(token) for g in toxicity._grams(u)]


def test_long_tokens_are_scored_to_their_end():
    s = toxicity.Scorer({"kvile": 5.0, "akvile": 5.0, "\x02v": 2.0, "\x02vi": 2.0})
    plain = "ab" * 400
    assert s.features(plain)[1] == 0.0
    assert s.features(plain + "akvile" + plain)[1] == 5.0
    for sign in "-,_/。、":
        words = sign.join(["calm"] * 40)
        assert s.features(words)[1] == 0.0
        assert s.features(words + sign + "vile")[1] == s.features("vile")[1] == 4.0
    assert s.features("vile") == (4.0 / 5, 4.0) and s.features("--- !") == s.features(None) == s.features("") == (0.0, 0.0)


def test_units_hold_every_gram_once():
    for n in (1, 63, 64, 65, 129, 130, 131, 1000):
        word = "".join(chr(97 + i % 26) for i in range(n))
        w = f"\x02{word}\x03"
        assert grams(word) == [w[max(0, i - 5) : i + 1] for i in range(1, len(w))]
        assert (len(list(toxicity._units(word))) == 1) == (n <= 64)
    assert grams("(b-c)") == grams("b-c") != [] and grams("...") == []


def test_long_tokens_are_counted_to_their_end(spark):
    text = "的" * 100 + "坏词坏词" + "的" * 100
    rows = toxicity.gram_counts(spark.createDataFrame([(text, 1, False), ("x x", 0, True)], "text string, toxic int, curve boolean")).collect()
    got = {(r["part"], r["gram"]): (r["n_toxic"], r["n_ordinary"]) for r in rows}
    assert got["all", "的坏词坏词的"] == (1, 0) and got["fit", "的" * 6] == (190, 0) and got["fit", "的" * 5 + "\x03"] == (1, 0)
    assert got["all", "\x02x"] == (0, 2) and ("fit", "\x02x") not in got


def plain_ratios(texts):
    """Kneser-Ney by its definitions: {gram or marked context: ratio}."""
    n = [Counter(), Counter()]
    for text, toxic in texts:
        for token in text.lower().split():
            n[toxic].update(grams(token))
    kinds = set(n[0]) | set(n[1])

    def discount(counts):
        ones, twos = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    strings = {g[i:] for g in kinds for i in range(len(g))}
    follows = Counter(s[1:] for s in strings if len(s) > 1)
    d_low = {k: discount([c for s, c in follows.items() if len(s) == k]) for k in range(1, 6)}

    def lower(s):
        if not s:
            return 1 / (1 + sum(len(x) == 1 for x in strings))
        beside = [c for x, c in follows.items() if len(x) == len(s) and x[:-1] == s[:-1]]
        d = d_low[len(s)]
        return (max(follows[s] - d, 0) + d * len(beside) * lower(s[1:])) / sum(beside)

    d = [discount(n[k].values()) for k in (0, 1)]

    def back(ctx, k):
        after = [c for g, c in n[k].items() if g[:-1] == ctx]
        return 1 - sum(max(c - d[k], 0) for c in after) / sum(after) if after else 1.0

    def p(g, k):
        total = sum(c for x, c in n[k].items() if x[:-1] == g[:-1])
        return (max(n[k][g] - d[k], 0) / total if total else 0) + back(g[:-1], k) * lower(g[1:])

    found = {g: math.log(p(g, 1) / p(g, 0)) for g in kinds}
    return found | {"\x01" + c: math.log(max(back(c, 1), 1e-9) / max(back(c, 0), 1e-9)) for c in {g[:-1] for g in kinds}}


def corpus():
    rng = random.Random(2)
    words = ["stone", "stones", "river", "grolt", "groltish", "ab", "a", "Émile", "日本語", "stone-river", "x" * 80]
    return [(" ".join(rng.choices(words, k=rng.randrange(1, 9))), int(i % 3 == 0), i % 5 == 0) for i in range(40)]


def test_model_equals_plain_kneser_ney(spark):
    rows = corpus()
    got = toxicity.log_ratios(toxicity.gram_counts(spark.createDataFrame(rows, "text string, toxic int, curve boolean"))).collect()
    for part in ("fit", "all"):
        want = plain_ratios([(t, y) for t, y, curve in rows if part == "all" or not curve])
        mine = {r["key"]: r["value"] for r in got if r["part"] == part}
        assert set(mine) == set(want)
        assert all(math.isclose(mine[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_large_models_are_joined_with_the_same_result(spark, monkeypatch):
    rows = corpus()
    model = toxicity.log_ratios(toxicity.gram_counts(spark.createDataFrame(rows, "text string, toxic int, curve boolean"))).where("part = 'all'").select("key", "value").cache()
    texts = [(i, t) for i, (t, _, _) in enumerate(rows)] + [(900, None), (901, ""), (902, "... -"), (903, "unseen Wörter " * 50 + "的" * 200), (904, "grolt"), (904, "grolt")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sent = toxicity.with_features(docs, model).collect()
    monkeypatch.setattr(toxicity, "SENT", 3)
    joined = toxicity.with_features(docs, model).collect()
    key = lambda r: (r["doc_id"], r["text"] or "")
    a, b = (np.array([list(r)[2:] for r in sorted(rows, key=key)]) for rows in (sent, joined))
    assert len(a) == len(b) == len(texts) and np.allclose(a, b, rtol=1e-9, atol=1e-12) and a.any()
