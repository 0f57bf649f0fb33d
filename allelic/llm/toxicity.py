"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled sample is drawn from all training rows, whatever their label.
A linear model over the presence of words and word beginnings minimises the class-prior-corrected risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

first with the logistic loss, which is convex, then with the bounded sigmoid loss, which counts errors; where the bracket
turns negative, the step goes the other way (the non-negative estimator).
Features are the word parts that differ most between positives and the unlabelled sample by the likelihood ratio.

Defined results: null and empty texts get the model's score for a text without features; without a confirmed positive
in the training rows every score is 0.

Whole texts are read, however long; a text's score depends on that text alone, so repeated rows get equal scores. Ties
between features go to the smaller hash. Columns pass through, but for score and predicted, which the results replace; an
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, let_go, materialize, ship, small_batches

#: Expected bounds of the training sample, and the bound of the features.
POSITIVES, UNLABELLED, FEATURES = 4000, 8000, 1024
STARTS = (3, 4, 5, 6)
EPOCHS, BATCH, RATE, SHRINK = 30, 256, 0.03, 1e-3
#: A feature needs so many positives.
LEAST = 3
#: And a likelihood ratio statistic above this (chance in 200 with one degree of freedom).
STRONG = 8.0

_word = regex.compile(r"\w+")


def parts(word: str) -> list[str]:
    """What a word is known by: itself and its beginnings."""
    return [f"={word}", *(word[:n] for n in STARTS if len(word) > n)]


class _Parts(dict):
    """word -> 63-bit hashes of its parts."""

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        out = self[word] = [xxhash.xxh3_64_intdigest(p) >> 1 for p in parts(word)]
        return out


_parts = _Parts()


def word_set(text: str | None) -> set[str]:
    return set(_word.findall((text or "").lower()))


def feature_sets(rows: DataFrame) -> DataFrame:
    """positive and the distinct part hashes of each row, computed on the executors."""
    small_batches(rows.sparkSession)

    def run(batches):
        let_go()
        for batch in batches:
            sets = [sorted({h for w in word_set(t) for h in _parts[w]}) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("kind"), batch.column("h"), pa.array(sets, pa.list_(pa.int64()))], names=["kind", "h", "parts"])

    return rows.select("kind", "h", "text").mapInArrow(run, "kind int, h long, parts array<long>")


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, float]:
    """Feature sets of about POSITIVES confirmed and UNLABELLED rows at most outside the held-out fold, chosen by their
    ids' hash, and the class prior: the toxic share among the labelled rows of that fold."""
    known = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, hits = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not hits:
        return None, 0.0
    ids = docs.where(fold(F.col("doc_id")) != 0).select("doc_id", "text")
    total = ids.count()
    unit = F.xxhash64("doc_id", F.lit(17)) / F.lit(2.0**64) + 0.5
    h = F.xxhash64("doc_id", F.lit(23))
    positive = known.where("toxic = 1").where(unit < POSITIVES / hits).select("doc_id")
    # about POSITIVES ids: small by the bound
    pos = ids.join(F.broadcast(positive), "doc_id").select(F.lit(1).alias("kind"), h.alias("h"), "text")
    unl = ids.where(unit < UNLABELLED / max(1, total)).select(F.lit(0).alias("kind"), h.alias("h"), "text")
    return materialize(feature_sets(pos.unionAll(unl)), "parts"), hits / n


def select_features(rows: DataFrame) -> list[int]:
    """The parts with the largest likelihood ratio statistic among those that are commoner in the positives."""
    n, m = rows.agg(F.coalesce(F.sum("kind"), F.lit(0)), F.coalesce(F.sum(1 - F.col("kind")), F.lit(0))).first()
    if not n:
        return []
    m = max(1, m)
    counts = rows.select("kind", F.explode("parts").alias("part")).groupBy("part").agg(F.sum("kind").alias("a"), F.sum(1 - F.col("kind")).alias("b"))
    rate = (F.col("a") + F.col("b")) / (n + m)
    g = 2 * (F.col("a") * F.log(F.col("a") / n / rate) + F.col("b") * F.log(F.greatest(F.col("b"), F.lit(1e-9)) / m / rate))
    found = counts.where((F.col("a") >= LEAST) & (F.col("a") / n > F.col("b") / m)).select("part", g.alias("g")).where(F.col("g") > STRONG)
    return [r["part"] for r in found.orderBy(F.desc(F.round("g", 6)), "part").limit(FEATURES).collect()]


class PULinear:
    """A linear classifier over hashed word parts."""

    def __init__(self, features: dict[int, int], weights: np.ndarray, bias: float):
        self.weight_of = {h: float(weights[i]) for h, i in features.items()}
        self.bias = bias
        self._of_word: dict[str, tuple] = {}

    def score(self, text: str | None) -> float:
        found: set = set()
        known = self._of_word
        for w in word_set(text):
            hit = known.get(w)
            if hit is None:
                if len(known) > 300_000:
                    known.clear()
                hit = known[w] = tuple(h for p in parts(w) if (h := xxhash.xxh3_64_intdigest(p) >> 1) in self.weight_of)
            if hit:
                found.update(hit)
        z = self.bias + sum(self.weight_of[h] for h in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _matrix(sets: list, features: dict[int, int]) -> np.ndarray:
    x = np.zeros((len(sets), len(features)), np.uint8)
    for i, s in enumerate(sets):
        x[i, [features[h] for h in s if h in features]] = 1
    return x


def fit(pos: list, unl: list, prior: float, parts: list[int], seed: int = 5) -> PULinear | None:
    """pos, unl: the selected parts that each text has."""
    if not pos:
        return None
    features = {h: i for i, h in enumerate(parts)}
    xp, xu = _matrix(pos, features), _matrix(unl, features)
    w, b = np.zeros(len(features)), -1.0
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    rng = np.random.default_rng(seed)
    for epoch in range(2 * EPOCHS):
        up, uu = rng.permutation(len(xp)), rng.permutation(len(xu))
        steps = max(32, -(-len(xu) // BATCH))
        for i in range(steps):
            p = xp[np.take(up, range(i * BATCH, i * BATCH + min(BATCH, len(xp))), mode="wrap")].astype(float)
            u = xu[np.take(uu, range(i * BATCH, i * BATCH + min(BATCH, len(xu))), mode="wrap")].astype(float)
            zp, zu = p @ w + b, u @ w + b
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
            grad = lambda x, d: np.append((x * d[:, None]).mean(0), d.mean())
            if epoch < EPOCHS:  # l(z, y) = log(1 + exp(-y z)), with the slopes sigmoid(z) - 1 and sigmoid(z)
                rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()  # R_u(-) - prior R_p(-)
                g_rest, g_pos = grad(u, su) - prior * grad(p, sp), grad(p, sp - 1)
            else:  # l(z, y) = sigmoid(-y z)
                rest = su.mean() - prior * sp.mean()
                g_rest, g_pos = grad(u, su * (1 - su)) - prior * grad(p, sp * (1 - sp)), -grad(p, sp * (1 - sp))
            g = prior * g_pos + g_rest if rest >= 0 else -g_rest
            g[:-1] += SHRINK * prior * w
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return PULinear(features, w, float(b))


def train(docs: DataFrame, labels: DataFrame) -> PULinear | None:
    rows, prior = sample(docs, labels)
    if rows is None:
        return None
    chosen = select_features(rows)
    if not chosen:
        return None
    # only the chosen parts of the sampled texts come to the driver
    own = F.array_intersect("parts", F.lit(chosen))
    found = sorted((r["kind"], r["h"], sorted(r["parts"])) for r in rows.select("kind", "h", own.alias("parts")).collect())
    return fit([r[2] for r in found if r[0] == 1], [r[2] for r in found if r[0] == 0], prior, chosen)


def score(docs: DataFrame, model: PULinear | None) -> DataFrame:
    """docs with score and predicted (1 if score >= 0.5) for every row."""
    small_batches(docs.sparkSession)
    own = next(c for c in docs.columns if c.lower() == "text")
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    schema = docs.limit(0).selectExpr(*(f"`{c}`" for c in names), "cast(null as double) as score", "cast(null as int) as predicted").schema

    def run(batches):
        let_go()
        for batch in batches:
            s = [model.score(t) if model else 0.0 for t in batch.column(own).to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


ship(__name__)
