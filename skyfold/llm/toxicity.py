"""Toxicity by a counterfactual-regularised linear classifier.

Features are the presence of words and of their first 4, 5 and 6 letters.  The
fit reads a bounded, seeded sample of labelled rows (``SAMPLE``): features are
counted over it, the ``FEATURES`` with the strongest association (G squared) are
kept together with the identity terms, and a logistic regression is fitted on
the driver over those few columns.  For every sampled text and each identity
term that it names, a copy with the term swapped for another of its kind is
made; the squared change of the score's logit between the two is added to the
loss, weighted by ``PENALTY``.  So a bare mention of a group carries no weight of
its own.  Terms are known in four languages; texts that name none add no pairs,
and the fit is then a plain logistic regression (``Model.pairs`` tells how many
pairs a fit had).

Scoring streams over all documents without a shuffle.

Defined results: a null or empty text gets the score of no features; a document
with several labels is toxic if one of them says so; labels without documents
and documents without labels are not fitted; with no or only one kind of label
every score is that share of toxic labels; rows that repeat are scored each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.session import bound_batches

#: The most labelled rows that a fit reads.
SAMPLE = 20_000
FEATURES = 3_000
PENALTY = 1.0
RIDGE = 1e-3
STEPS = 300
STRIP = ".,;:!?\"'()[]{}<>*#$%&|-"
#: Identity terms by kind, each swapped for the next of its kind.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("africans", "europeans", "americans", "mexicans", "chinese", "indians", "arabs"),
    ("young", "old"),
    ("blind", "deaf", "disabled"),
    ("immigrants", "refugees", "natives"),
    # German
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell"),
    ("schwarze", "weiße", "asiaten"),
    ("afrikaner", "europäer", "amerikaner", "türken", "chinesen", "araber"),
    ("einwanderer", "flüchtlinge", "einheimische"),
    # French
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("noirs", "blancs", "asiatiques"),
    ("africains", "européens", "américains", "chinois", "arabes"),
    ("immigrés", "réfugiés"),
    # Spanish
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("negros", "blancos", "asiáticos"),
    ("africanos", "europeos", "americanos", "mexicanos", "chinos", "árabes"),
    ("inmigrantes", "refugiados", "nativos"),
)
#: A term's substitutes; one that stands in two languages' kinds has one in each.
SWAPS: dict[str, list[str]] = {}
for _kind in IDENTITY:
    for _i, _term in enumerate(_kind):
        SWAPS.setdefault(_term, []).append(_kind[(_i + 1) % len(_kind)])


def word_features(word: str) -> tuple[str, ...]:
    w = word.strip(STRIP)
    return (w, *("^" + w[:k] for k in (4, 5, 6) if len(w) > k)) if w else ()


def features(text) -> set[str]:
    return {f for w in set(text.lower().split()) for f in word_features(w)} if isinstance(text, str) else set()


def counterfactuals(text) -> list[set[str]]:
    """For each identity term of the text, and each substitute, the features of the text with that term swapped."""
    if not isinstance(text, str):
        return []
    words = {w.strip(STRIP) for w in set(text.lower().split())}
    out = []
    for term in sorted(words & SWAPS.keys()):
        rest = [f for w in words - {term} for f in word_features(w)]
        out += [{*rest, *word_features(other)} for other in SWAPS[term]]
    return out


def _counts(batches):
    on, off = Counter(), Counter()
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            (on if toxic else off).update(features(text))
    names = list({**on, **off})
    for a in range(0, len(names), 50_000):
        part = names[a : a + 50_000]
        yield pd.DataFrame({"feature": part, "on": [on[f] for f in part], "off": [off[f] for f in part]})


class Model:
    """Weights by feature, a bias, and how many counterfactual pairs the fit had."""

    def __init__(self, weights: dict[str, float], bias: float, pairs: int = 0):
        self.weights, self.bias, self.pairs = weights, bias, pairs

    def scorer(self):
        weights, bias, memo = self.weights, self.bias, {}

        def score(text) -> float:
            if not isinstance(text, str):
                return float(1 / (1 + np.exp(-bias)))
            hit = set()
            for w in set(text.lower().split()):
                f = memo.get(w)
                if f is None:
                    if len(memo) > 500_000:
                        memo.clear()
                    f = memo[w] = tuple(x for x in word_features(w) if x in weights)
                if f:
                    hit.update(f)
            return float(1 / (1 + np.exp(-np.clip(bias + sum(weights[f] for f in sorted(hit)), -50, 50))))

        return score


def _logistic(rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample: log loss + ridge + penalty * mean squared logit change of the pairs."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    p_at = np.array([k for k, (x, z) in enumerate(pairs) for _ in range(len(x) + len(z))], np.int64)
    p_col = np.array([c for x, z in pairs for c in (*x, *z)], np.int64)
    p_sign = np.array([s for x, z in pairs for s in (*([1.0] * len(x)), *([-1.0] * len(z)))])
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = b + np.bincount(at, w[col], len(rows))
        r = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(rows)
        g = np.bincount(col, r[at], n) + RIDGE * w / 10
        if pairs:
            change = np.bincount(p_at, p_sign * w[p_col], len(pairs))
            g += penalty * 2 / len(pairs) * np.bincount(p_col, p_sign * change[p_at], n)
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 * (1 - t / (STEPS + 1))
        w = w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b = b - step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY, seed: str = "tox:") -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    bound_batches(docs.sparkSession)
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labels.orderBy(F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    share = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("on")).first()
    n, on = share.n, int(share.on or 0)
    if not 0 < on < n:
        return Model({}, float(np.clip(np.log((on + 1e-9) / (n - on + 1e-9)), -20, 20)) if n else 0.0)
    counts = rows.select("text", "toxic").mapInPandas(_counts, "feature string, on long, off long").groupBy("feature").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))
    total = F.col("on") + F.col("off")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    gain = part(F.col("on"), total * on / n) + part(F.col("off"), total * (n - on) / n) + part(on - F.col("on"), (n - total) * on / n) + part(n - on - F.col("off"), (n - total) * (n - on) / n)
    best = counts.filter(total >= 3).withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(FEATURES).select("feature").collect()
    names = sorted({r.feature for r in best} | {f for w in SWAPS for f in word_features(w)})
    number = {f: k for k, f in enumerate(names)}

    def columns(batches):
        for pdf in batches:
            x = [sorted(number[f] for f in features(t) if f in number) for t in pdf["text"]]
            z = [[sorted(number[f] for f in s if f in number) for s in counterfactuals(t)] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": x, "z": z, "toxic": pdf["toxic"].astype("int64")})

    got = rows.mapInPandas(columns, "doc_id long, x array<int>, z array<array<int>>, toxic long").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    pairs = [(r.x, z) for r in got for z in r.z]
    w, b = _logistic([r.x for r in got], np.array([r.toxic for r in got], float), pairs, len(names), penalty)
    return Model({f: float(x) for f, x in zip(names, w) if x}, b, len(pairs))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row."""
    bound_batches(docs.sparkSession)

    def run(batches):
        of = model.scorer()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [of(t) for t in pdf["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double")
