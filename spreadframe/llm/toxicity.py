"""Toxicity by class-conditional Kneser-Ney models of how words are spelt.

Each class has a model of a word's characters given up to five before them (the word's
start and end are characters too). The longest contexts count within the class, every
occurrence in every labelled text; what absolute discounting takes from them goes to
shorter contexts, whose continuation counts both classes share. So a rare expression
scores near zero and a stem that only toxic texts have scores high with any ending. A text
is compared by its log-likelihood ratio over its length in characters and by that of its
most toxic word, and a logistic curve turns these into a score. The curve is fitted on
texts that its model did not count; the model that scores counts all.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import unsent, written

ORDER = 6
#: Entries of a model that are sent to every worker, at most; a larger one stays a table that words are joined with.
SENT = 1 << 20
#: Labelled texts that the logistic curve is fitted on, at most.
CALIBRATE = 20_000
#: Distinct words a worker remembers or counts at once.
WORDS = 200_000
#: Their characters at once, which also bounds texts without spaces.
CHARS = 1 << 23
#: A longer token is cut at inner signs, and what is still longer is scored in parts of this length.
LONG = 64
START, END = "\x02", "\x03"
#: Marks a context's entry in a model, beside those of grams.
CONTEXT = "\x01"
FEATURES = ("_toxicity_mean", "_toxicity_peak")
STRIP = ".,;:!?\"'()[]{}<>|*&%$#@-_/\\~`^+="
INNER = re.compile("[" + re.escape(STRIP) + "\u00a1-\u00a9\u00ab-\u00b1\u2010-\u2027\u2030-\u205e\u3000-\u3004\u3008-\u3020\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")


def _units(token: str) -> Iterator[str]:
    """What a token's grams are taken from: the number of leading characters that are only context, and the characters.

    A word is one unit with its start and end; one longer than ``LONG`` gives parts of a bounded length.
    """
    for piece in (token,) if len(token) <= LONG else INNER.split(token):
        if word := piece.strip(STRIP):
            w = f"{START}{word}{END}"
            for at in range(1, len(w), LONG + 1):
                before = min(at, ORDER - 1)
                yield f"{before}{w[at - before : at + LONG + 1]}"


def _grams(unit: str) -> list[str]:
    """A gram for each character of a unit: it and up to five before it."""
    w = unit[1:]
    return [w[max(0, i - ORDER + 1) : i + 1] for i in range(int(unit[0]), len(w))]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """part, gram, n_toxic, n_ordinary: all occurrences in labelled texts (``text``, ``toxic``, ``curve``).

    Part ``fit`` counts the texts that the curve is not fitted on, part ``all`` every text.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: list[Counter] = [Counter() for _ in range(4)]

        def frame() -> pd.DataFrame:
            grams: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            for k in range(4):
                for token, n in words[k].items():
                    for u in _units(token):
                        for g in _grams(u):
                            grams[g][k] += n
                words[k].clear()
            return pd.DataFrame([(g, *n) for g, n in grams.items()], columns=["gram", "o_fit", "t_fit", "o_curve", "t_curve"])

        chars = 0
        for batch in batches:
            for text, toxic, curve in zip(batch["text"], batch["toxic"], batch["curve"]):
                own, known = Counter(text.lower().split()), words[int(toxic) + 2 * int(curve)]
                chars += sum(len(w) for w in own if w not in known)
                known.update(own)
                if sum(map(len, words)) > WORDS or chars > CHARS:
                    yield frame()
                    chars = 0
        yield frame()

    names = ("o_fit", "t_fit", "o_curve", "t_curve")
    part = labelled.select("text", "toxic", "curve").mapInPandas(count, "gram string, " + ", ".join(f"{n} long" for n in names))
    summed = part.groupBy("gram").agg(*(F.sum(n).alias(n) for n in names))
    both = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), t.alias("n_toxic"), o.alias("n_ordinary")) for p, t, o in (("fit", F.col("t_fit"), F.col("o_fit")), ("all", F.col("t_fit") + F.col("t_curve"), F.col("o_fit") + F.col("o_curve"))))))
    return summed.select("gram", both.alias("p")).select("p.part", "gram", "p.n_toxic", "p.n_ordinary").where("n_toxic + n_ordinary > 0")


def _discount(ones: Column, twos: Column) -> Column:
    return F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(F.lit(0.5))


def _context(gram: str) -> Column:
    return F.expr(f"left({gram}, length({gram}) - 1)")


def _rest(gram: str) -> Column:
    return F.expr(f"substring({gram}, 2)")


def shared_probabilities(grams: DataFrame) -> DataFrame:
    """part, lower, p: Kneser-Ney probability of a string's last character after those before it, both classes together.

    A string counts the distinct characters that it follows in the grams of ``grams``
    (``part``, ``gram``); each length has a discount, and what it leaves goes to the string
    without its first character, at last evenly to all characters and one more.
    """
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda n: F.substring("gram", F.length("gram") - n + 1, n)))
    types = written(grams.select("part", ends.alias("s")).distinct().withColumn("n", F.length("s")), "types")
    base = types.where("n = 1").groupBy("part").agg((1 / (1 + F.count("*"))).alias("base"))
    counts = types.where("n > 1").groupBy("part", _rest("s").alias("s")).agg(F.count("*").alias("count")).withColumn("n", F.length("s"))
    counts = written(counts, "continuations")
    by_length = counts.groupBy("part", "n").agg(F.count_if(F.col("count") == 1).alias("ones"), F.count_if(F.col("count") == 2).alias("twos")).select("part", "n", _discount(F.col("ones"), F.col("twos")).alias("d"))
    after = counts.groupBy("part", _context("s").alias("context"), "n").agg(F.sum("count").alias("total"), F.count("*").alias("kinds"))
    # own share of a string, and the share that its context hands on
    shares = counts.withColumn("context", _context("s")).join(unsent(after), ["part", "context", "n"]).join(F.broadcast(by_length), ["part", "n"])
    shares = written(shares.select("part", "s", "n", (F.greatest(F.col("count") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("own"), (F.col("d") * F.col("kinds") / F.col("total")).alias("hands")), "shares")
    chain = counts.select("part", F.col("s").alias("lower"), F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.substring("s", F.col("n") - k + 1, k))).alias("s"))
    steps = chain.join(unsent(shares), ["part", "s"]).groupBy("part", "lower").agg(F.sort_array(F.collect_list(F.struct("n", "own", "hands"))).alias("steps"))  # at most ORDER - 1 each
    summed = F.aggregate("steps", F.col("base"), lambda p, x: x["own"] + x["hands"] * p)
    return steps.join(F.broadcast(base), "part").select("part", "lower", summed.alias("p"))


def log_ratios(grams: DataFrame) -> DataFrame:
    """part, key, value: toxic over ordinary log-likelihood of each gram, and of any other gram after each context.

    ``grams`` has part, gram, n_toxic and n_ordinary. Where neither class has a gram, both
    back off to the same shared probability, so the ratio is that of what the classes'
    discounts left over after the context (0 after an unknown one). A context's key has
    ``CONTEXT`` before it. Every count is used; the tables grow with the input.
    """
    grams = written(grams, "grams")
    classes = ("n_toxic", "n_ordinary")
    found = grams.groupBy("part").agg(*(F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in classes for k in (1, 2)))
    discounts = found.select("part", *(_discount(F.col(f"{c}_1"), F.col(f"{c}_2")).alias(f"d_{c}") for c in classes))
    taken = lambda c: F.greatest(F.col(c) - F.col(f"d_{c}"), F.lit(0.0))
    mine = grams.join(F.broadcast(discounts), "part").select("part", "gram", _context("gram").alias("context"), *classes, *(taken(c).alias(f"t_{c}") for c in classes))
    contexts = mine.groupBy("part", "context").agg(*(F.sum(c).alias(f"all_{c}") for c in classes), *(F.sum(f"t_{c}").alias(f"sum_{c}") for c in classes))
    back = lambda c: F.when(F.col(f"all_{c}") > 0, 1 - F.col(f"sum_{c}") / F.col(f"all_{c}")).otherwise(F.lit(1.0))
    contexts = written(contexts.select("part", "context", *(F.col(f"all_{c}") for c in classes), *(back(c).alias(f"back_{c}") for c in classes)), "contexts")
    lowered = mine.join(unsent(contexts), ["part", "context"]).withColumn("lower", _rest("gram")).join(unsent(shared_probabilities(grams)), ["part", "lower"])
    p = [F.coalesce(F.try_divide(F.col(f"t_{c}"), F.col(f"all_{c}")), F.lit(0.0)) + F.col(f"back_{c}") * F.col("p") for c in classes]
    rest = [F.greatest(F.col(f"back_{c}"), F.lit(1e-9)) for c in classes]
    values = lowered.select("part", F.col("gram").alias("key"), F.log(p[0] / p[1]).alias("value"))
    return values.unionByName(contexts.select("part", F.concat(F.lit(CONTEXT), "context").alias("key"), F.log(rest[0] / rest[1]).alias("value")))


class Scorer:
    """Features of whole texts: log-likelihood ratio for each character, and that of the most toxic word."""

    def __init__(self, values: dict[str, float]):
        self.grams = {k: v for k, v in values.items() if k[0] != CONTEXT}
        self.contexts = {k[1:]: v for k, v in values.items() if k[0] == CONTEXT}
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.total: list[float] = []
        self.peak: list[float] = []
        self.chars: list[int] = []
        self.size = 0

    def ratio(self, w: str, start: int) -> float:
        """Log-likelihood ratio of the characters of ``w`` from ``start`` on."""
        gram, after, total = self.grams.get, self.contexts.get, 0.0
        for i in range(start, len(w)):
            g = w[i - ORDER + 1 : i + 1] if i >= ORDER else w[: i + 1]
            x = gram(g)
            total += after(g[:-1], 0.0) if x is None else x
        return total

    def token(self, token: str) -> tuple[float, float, int]:
        """Sum and highest ratio of a token's units, and its characters; a token of signs only has none."""
        if len(token) <= LONG:  # the usual case: one unit at most
            word = token.strip(STRIP)
            if not word:
                return 0.0, -np.inf, 0
            total = self.ratio(f"{START}{word}{END}", 1)
            return total, total, len(word) + 1
        units = list(_units(token))
        ratios = [self.ratio(u[1:], int(u[0])) for u in units]
        return sum(ratios), max(ratios, default=-np.inf), sum(len(u) - 1 - int(u[0]) for u in units)

    def features(self, text: str | None) -> tuple[float, float]:
        tokens = text.lower().split() if text else []
        new = [t for t in tokens if t not in self.at]
        if new and (len(self.at) > WORDS or self.size > CHARS):
            self._forget()
            new = tokens
        for t in dict.fromkeys(new):
            self.at[t] = len(self.total)
            for column, x in zip((self.total, self.peak, self.chars), self.token(t)):
                column.append(x)
            self.size += len(t)
        at = [self.at[t] for t in tokens]
        chars = sum(map(self.chars.__getitem__, at))
        return (sum(map(self.total.__getitem__, at)) / chars, max(map(self.peak.__getitem__, at))) if chars else (0.0, 0.0)


class Curve:
    """Logistic regression on the standardised features; a constant where one class is missing.

    A word more or less toxic than any ordinary one tells the same, so the curve levels off
    at a peak: that of some quantiles of the peaks which makes the labels likeliest.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n1 = int(y.sum())
        self.w, self.level = None, np.inf
        self.prior = (n1 + 0.5) / (len(y) + 1) if len(y) else 0.5
        if 0 < n1 < len(y):
            levels = sorted(set(np.quantile(x[:, 1], np.linspace(0.8, 1, 41)).tolist()), reverse=True)
            fits = [self._fit(np.column_stack([x[:, 0], np.minimum(x[:, 1], top)]), y) for top in levels]
            best = max(range(len(fits)), key=lambda i: fits[i][0])
            self.level = levels[best]
            _, self.mean, self.sd, self.w = fits[best]

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        mean, sd = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
        w, keep = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (p - y) + keep @ w
            h = (z * (p * (1 - p))[:, None]).T @ z + keep + 1e-6 * np.eye(len(w))
            w = w - np.linalg.solve(h, g)
        p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
        return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum() - w @ keep @ w / 2), mean, sd, w

    def column(self) -> Column:
        """The score of rows that hold the features."""
        if self.w is None:
            return F.lit(float(self.prior))
        z = F.lit(float(self.w[0]))
        for x, w, m, s in zip((F.col(FEATURES[0]), F.least(F.col(FEATURES[1]), F.lit(float(self.level)))), self.w[1:], self.mean, self.sd):
            z = z + F.lit(float(w / s)) * (x - float(m))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is never learned from: crc32 of its doc_id as text leaves 1 modulo 3."""
    return F.coalesce(_fold(doc_id) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, model_part: int = 5) -> tuple[DataFrame, Curve]:
    """The model (``key``, ``value``) of all labelled rows that are not held out, and the curve.

    The curve is fitted on a fifth of the rows (at most ``CALIBRATE``) with a model of the
    others, so on texts that model has not seen. Rows with a null doc_id, text or label
    teach nothing; repeated labels of a document count as often as they occur.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and _id is not null").where(~held_out(F.col("_id")))
    mine = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).where("text is not null and _id is not null").where(~held_out(F.col("_id")))
    # labels are some share of all documents, so they are never broadcast
    rows = mine.join(unsent(known), "_id").select("_id", "text", "toxic", (F.floor(_fold(F.col("_id")) / 3) % model_part == 0).alias("curve"))
    rows = written(rows, "labelled")
    model = written(log_ratios(gram_counts(rows)), "model")
    some = rows.where("curve").orderBy(F.xxhash64("_id", F.lit(11)), "text").limit(CALIBRATE)
    scored = with_features(some, model.where("part = 'fit'")).select("toxic", *FEATURES).toPandas()
    return model.where("part = 'all'"), Curve(scored[list(FEATURES)].to_numpy(float), scored["toxic"].to_numpy(float))


_scorers: dict[str, Scorer] = {}


def with_features(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) and the columns of ``FEATURES``; the text is read whole.

    A model of at most ``SENT`` entries is sent to the workers. With a larger one the words
    of all texts are joined with the table instead, which gives the same features.
    """
    if model.limit(SENT + 1).count() > SENT:
        return joined_features(docs, model)
    spark, name = docs.sparkSession, uuid.uuid4().hex
    # the columns stay packed on the driver; a worker unpacks them once
    sent = spark.sparkContext.broadcast(model.select("key", "value").toArrow())

    def features(texts: pd.Series) -> pd.DataFrame:
        if name not in _scorers:
            _scorers.clear()
            table = sent.value
            _scorers[name] = Scorer(dict(zip(table["key"].to_pylist(), table["value"].to_pylist())))
        return pd.DataFrame([_scorers[name].features(t) for t in texts], columns=list(FEATURES))

    found = F.pandas_udf(features, ", ".join(f"{f} double" for f in FEATURES))(F.col("text").cast("string"))
    return docs.withColumn("_found", found).select(*docs.columns, "_found.*")


def joined_features(docs: DataFrame, model: DataFrame) -> DataFrame:
    """What :func:`with_features` gives, by joins of the texts' words with the model's table."""
    table = written(docs.withColumn("_text_row", F.monotonically_increasing_id()), "texts")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, text in zip(b["_text_row"], b["text"]):
                own: Counter = Counter()
                for token, n in Counter(text.lower().split()).items():
                    for u in _units(token):
                        own[u] += n
                if own:
                    yield pd.DataFrame({"_text_row": row, "unit": list(own), "n": list(own.values())})

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(u, g, CONTEXT + g[:-1]) for u in b["unit"] for g in _grams(u)]
            yield pd.DataFrame(out, columns=["unit", "key", "context"])

    pieces = written(table.where("text is not null").select("_text_row", F.col("text").cast("string").alias("text")).mapInPandas(split, "_text_row long, unit string, n long"), "pieces")
    own, after = model.select("key", F.col("value").alias("own")), model.select(F.col("key").alias("context"), F.col("value").alias("after"))
    parts = pieces.select("unit").distinct().mapInPandas(grams, "unit string, key string, context string")
    ratios = parts.join(unsent(own), "key", "left").join(unsent(after), "context", "left").groupBy("unit").agg(F.sum(F.coalesce("own", "after", F.lit(0.0))).alias("ratio"), F.count("*").alias("chars"))
    of_text = pieces.join(unsent(ratios), "unit").groupBy("_text_row").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum(F.col("n") * F.col("chars"))).alias(FEATURES[0]), F.max("ratio").alias(FEATURES[1]))
    return table.join(unsent(of_text), "_text_row", "left").select(*docs.columns, *(F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with columns held_out, score (0 to 1) and predicted (score at least 0.7).

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``toxic``; columns
    of the new names are replaced (and those of ``FEATURES`` left out), all others kept. Null and empty texts, and those of
    signs only, score as texts without evidence; very long texts and words are read to
    their end. Equal texts score alike. Without labels of both classes the score is their
    smoothed share, or 0.5 without any. A null doc_id is not held out. Rows stay one to one.
    """
    model, curve = train(docs, labels)
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted", *FEATURES)]
    featured = docs.select(*own) if curve.w is None else with_features(docs.select(*own), model)
    out = featured.select(*own, held_out(F.col("doc_id")).alias("held_out"), curve.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
