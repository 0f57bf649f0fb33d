"""Language identification by a byte convolutional network trained in numpy.

A window of WINDOW bytes is embedded, convolved with filters of several widths, max-pooled over positions and
classified by a softmax. A text is cut into windows from its first byte to its last, and their probabilities are
averaged by length. Inference runs on Arrow batches, some hundreds of windows at a time.

Defined results: texts that are null or have no letter are `und` with score 1; a language that is null in the training
rows teaches nothing; with no training row at all every text is `und` with score 0. Ties go to the language that sorts
first. Very long texts are read whole, some MB of windows at a time. Repeated rows are repeated; other columns pass through,
but for columns named lang_pred and score, which the results replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, let_go, ship, small_batches

WINDOW, EMBED, FILTERS, WIDTHS = 128, 8, 8, (2, 3, 4)
#: Bounds of the training sample: texts for each language (every language is learnt), windows cut from one text.
TEXTS, CUTS = 700, 3
EPOCHS, BATCH, RATE = 14, 64, 0.01
CHUNK = 512
UND = "und"

_letter = regex.compile(r"\p{L}")
_SPAN = max(WIDTHS)


class ByteCNN:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        # one matrix for all widths: a filter of width w has weights in its first w bytes only
        self.mask = np.zeros((_SPAN * EMBED, FILTERS * len(WIDTHS)), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.conv = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.conv.shape[1], np.float32)
        self.out = rng.normal(0, 0.3, (self.conv.shape[1], len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, span * embed) of windows of bytes."""
        e = self.embed[x].reshape(len(x), -1)
        n = x.shape[1] - _SPAN + 1
        return np.lib.stride_tricks.sliding_window_view(e, _SPAN * EMBED, axis=1)[:, : n * EMBED : EMBED]

    def pooled(self, x: np.ndarray):
        c = np.ascontiguousarray(self.columns(x))
        z = (c.reshape(-1, c.shape[2]) @ self.conv).reshape(len(x), c.shape[1], -1)
        return c, z

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), CHUNK):
            _, z = self.pooled(x[i : i + CHUNK])
            h = np.maximum(z.max(1) + self.bias, 0)
            s = h @ self.out + self.out_bias
            s = np.exp(s - s.max(1, keepdims=True))
            out[i : i + CHUNK] = s / s.sum(1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> ByteCNN:
        rng = np.random.default_rng(seed)
        params = [self.embed, self.conv, self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                pick = order[at : at + BATCH]
                xb, yb, rows = x[pick], y[pick], np.arange(len(pick))
                c, z = self.pooled(xb)
                top = z.argmax(1)  # (windows, filters): only the maximum gets a gradient
                h = np.take_along_axis(z, top[:, None], 1)[:, 0] + self.bias
                a = np.maximum(h, 0)
                s = a @ self.out + self.out_bias
                s = np.exp(s - s.max(1, keepdims=True))
                s /= s.sum(1, keepdims=True)
                s[rows, yb] -= 1
                s /= len(pick)
                da = (s @ self.out.T) * (h > 0)
                seen = c[rows[:, None], top]  # (windows, filters, span * embed)
                dconv = np.einsum("bf,bfk->kf", da, seen, optimize=True) * self.mask
                dcols = np.einsum("bf,kf->bfk", da, self.conv, optimize=True).reshape(-1, _SPAN, EMBED)
                which = xb[rows[:, None, None], top[:, :, None] + np.arange(_SPAN)].reshape(-1)
                dembed = np.zeros_like(self.embed)
                np.add.at(dembed, which, dcols.reshape(-1, EMBED))
                t += 1
                for i, g in enumerate([dembed, dconv, da.sum(0), a.T @ s, s.sum(0)]):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    params[i] -= (RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def windows(text: bytes) -> np.ndarray:
    """The whole text as zero-padded windows of bytes."""
    n = max(1, -(-len(text) // WINDOW))
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    return x.reshape(n, WINDOW)


def training_rows(docs: DataFrame) -> list:
    """(lang, cut) of a bounded sample: up to TEXTS rows for each language outside the held-out fold, chosen by the hash
    of their id, and CUTS windows of each at places that the hash gives."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)).withColumn("_h", F.xxhash64("doc_id", F.lit(5)))
    # share of each language's rows whose hash is below this limit: about 1.3 * TEXTS, cut to TEXTS below
    counts = rows.groupBy(F.col("lang").alias("_lang")).agg((1.3 * TEXTS / F.count("*")).alias("_limit"))
    unit = F.col("_h") / F.lit(2.0**64) + 0.5
    # one row for each language, as many as the model has classes
    rows = rows.join(F.broadcast(counts), (F.col("lang") == F.col("_lang")) & (unit < F.col("_limit")))
    place = lambda i: F.pmod(F.xxhash64("_h", F.lit(i)), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int") + 1
    cuts = F.array(*[F.substring("text", place(i), F.lit(WINDOW)) for i in range(CUTS)])
    found = rows.select("lang", "_h", cuts.alias("cuts")).collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(found, key=lambda r: (r["lang"], r["_h"], r["cuts"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= TEXTS:
            out += [(r["lang"], c) for c in dict.fromkeys(r["cuts"])]
    return out


def fit(docs: DataFrame) -> ByteCNN | None:
    """A network learnt from text and lang of the rows outside the held-out fold."""
    rows = [(lang, c.encode()[:WINDOW]) for lang, c in training_rows(docs) if _letter.search(c)]
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    rng = np.random.default_rng(3)
    x = np.concatenate([windows(c) for _, c in rows])
    y = np.array([langs.index(lang) for lang, _ in rows])
    short = x.copy()  # and the same windows cut short, for short texts and last windows
    short[np.arange(WINDOW)[None] >= rng.integers(6, WINDOW, len(x))[:, None]] = 0
    return ByteCNN(langs).fit(np.concatenate([x, short]), np.concatenate([y, y]))


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """docs with lang_pred and score for every row."""
    small_batches(docs.sparkSession)
    own = next(c for c in docs.columns if c.lower() == "text")
    names = [f"`{c}`" for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = docs.limit(0).selectExpr(*names, "cast(null as string) as lang_pred", "cast(null as double) as score").schema

    def run(batches):
        let_go()
        for batch in batches:
            texts = batch.column(own).to_pylist()
            pred, score = [UND] * len(texts), [0.0 if model is None else 1.0] * len(texts)
            if model is not None:
                real = [i for i, t in enumerate(texts) if t and _letter.search(t)]
                held, size = [], 0
                for i in [*real, None]:  # a few MB of windows at a time
                    if held and (i is None or size > 1 << 21):
                        cut = [windows(texts[j].encode()) for j in held]
                        x = np.concatenate(cut)
                        weight = (x != 0).sum(1, keepdims=True).astype(np.float32)
                        p = model.predict(x) * weight
                        starts = np.cumsum([0, *map(len, cut)])[:-1]
                        p = np.add.reduceat(p, starts) / np.add.reduceat(weight, starts)
                        for j, q in zip(held, p, strict=True):
                            pred[j], score[j] = model.langs[int(q.argmax())], min(1.0, float(q.max()))
                        held, size = [], 0
                    if i is not None:
                        held.append(i)
                        size += len(texts[i])
            keep = [batch.column(c.strip("`")) for c in names]
            yield pa.record_batch([*keep, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*(c.strip("`") for c in names), "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


ship(__name__)
