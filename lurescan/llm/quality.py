"""Document quality by hierarchical empirical Bayes (operator 5).

For each label to be rejected (low quality, toxic) a naive-Bayes classifier with added shape features gives a
document's log odds. It is fitted on a bounded sample of labelled documents. What all documents of a host
say about it is added: the mean probability of a host and of each path below it, shrunk towards the level
above by a strength that is estimated from how far sites differ (method of moments), so sites with few
documents lean on their parents and those on the global prior. The document's posterior odds are its own
evidence times the odds of its path. All levels come from grouped aggregates over all documents.

Texts without words get the shape evidence alone. Null hosts or paths are sites of their own. If there are no
labels of a kind, nothing is rejected for it. Rows with a null id are scored like others. Labels that stand
twice for a document count twice; labels without a document are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import stable
from .words import words_of

#: labelled documents that a classifier is fitted on, at most, and the words it keeps
SAMPLE = 4_000
VOCABULARY = 20_000
#: a sampled text is at most so long, so that the sample has a size; longer texts are scored, not fitted on
FIT_CHARS = 20_000
SITES_BROADCAST = 20_000
FOLDS = 5


_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))


def shape(text: str, words: list[bytes]) -> list[float]:
    """Measures of form that junk departs in: symbols, capitals, digits, repeats, word length.

    Characters outside ASCII count as letters.
    """
    raw = text.encode("utf-8")
    size = len(raw)
    count = {k: size - len(raw.translate(None, v)) for k, v in (("letters", _LETTERS), ("capitals", _CAPITALS), ("digits", _DIGITS), ("high", _HIGH))}
    n, m = max(len(text), 1), max(len(words), 1)
    letters = count["letters"] + len(text) - (size - count["high"])
    lines = text.split("\n")
    return [
        1 - (letters + raw.count(b" ") + raw.count(b"\n")) / n,
        count["capitals"] / max(letters, 1),
        count["digits"] / n,
        len(set(words)) / m,
        len(set(lines)) / len(lines),
        min(sum(map(len, words)) / m / 10, 3),
        raw.count(b"!") / m,
        raw.count(b"|") / m,
        min(math.log1p(m) / 10, 1.5),
        float(m < 20),
    ]


#: beside whole words, their beginnings of so many bytes are terms: insults are inflected and compounded
STEMS = (4, 5, 6)


def terms_of(words: list[bytes]) -> set[bytes]:
    """Distinct words, and distinct beginnings marked by a hyphen, which no word holds."""
    distinct = set(words)
    out = set(distinct)
    for k in STEMS:
        out.update([w[:k] + b"-" for w in distinct if len(w) > k])
    return out


class Evidence:
    """Log odds of one label for a text."""

    def __init__(self, terms: dict[bytes, float], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.terms, self.mean, self.scale, self.weights = terms, mean, scale, weights

    @staticmethod
    def told(found: list[float]) -> list[float]:
        """Measures of the odds of a text's telling terms."""
        high = sorted((x for x in found if x > 0), reverse=True)
        return [max(min(sum(found), 30), -30) / 10, sum(high[:5]) / 10, high[0] / 5 if high else 0.0, min(sum(x > 2 for x in high), 20) / 5]

    def __call__(self, form: list[float], words: set[bytes]) -> float:
        x = (np.array(form + self.told([self.terms[w] for w in self.terms.keys() & words])) - self.mean) / self.scale
        return float(np.clip(x @ self.weights[:-1] + self.weights[-1], -20, 20))


class Sample:
    """Forms and terms of the sampled texts, made once for all labels; terms are numbers, which take a tenth of their sets' memory."""

    def __init__(self, texts: Iterable[str]):
        numbers: dict[bytes, int] = {}
        self.forms: list[list[float]] = []
        self.terms: list[np.ndarray] = []
        for t in texts:
            words = words_of(t)
            self.forms.append(shape(t, words))
            self.terms.append(np.array([numbers.setdefault(w, len(numbers)) for w in terms_of(words)], "int32"))
        self.names = list(numbers)

    def odds(self, rows: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """Log odds of the terms that tell the classes of some rows apart, by document frequency with add-one smoothing; others are nan."""
        out = np.full(len(self.names), np.nan)
        n1 = int(bad[rows].sum())
        n0 = len(rows) - n1
        if not n1 or not n0:
            return out
        c0, c1 = (np.bincount(np.concatenate([self.terms[i] for i in rows if bad[i] == b]), minlength=len(out)) for b in (0, 1))
        share = (c0 + c1) / (n0 + n1)
        # how many standard errors the classes' shares lie apart
        gap = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
        some = np.flatnonzero((c0 + c1 >= 4) & (gap > 5.0))
        best = sorted(some.tolist(), key=lambda i: (-gap[i], self.names[i]))[:VOCABULARY]
        out[best] = np.log((c1[best] + 1) / (n1 + 2)) - np.log((c0[best] + 1) / (n0 + 2))
        return out

    def told(self, row: int, odds: np.ndarray) -> list[float]:
        found = odds[self.terms[row]]
        return self.forms[row] + Evidence.told(found[~np.isnan(found)].tolist())


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Newton steps of the penalised likelihood; classes weigh the same."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * np.r_[w[:-1], 0]
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(np.r_[np.full(len(w) - 1, penalty), 1e-6])
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(sample: Sample, bad: np.ndarray) -> Evidence | None:
    """Words' odds are fitted on other folds than the weights that combine them."""
    if not 0 < bad.sum() < len(bad):
        return None
    fold = np.arange(len(bad)) % FOLDS
    rows = np.zeros((len(bad), len(sample.forms[0]) + 4))
    for k in range(FOLDS):
        odds = sample.odds(np.flatnonzero(fold != k), bad)
        for i in np.flatnonzero(fold == k):
            rows[i] = sample.told(i, odds)
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    every = sample.odds(np.arange(len(bad)), bad)
    terms = {sample.names[i]: float(every[i]) for i in np.flatnonzero(~np.isnan(every))}
    return Evidence(terms, mean, scale, _logistic((rows - mean) / scale, bad.astype("float64")))


def train(docs: DataFrame, labels: DataFrame, rejects: dict[str, Column], id_column: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict[str, Evidence | None]:
    """One classifier for each name in ``rejects`` (a condition on the label's row)."""
    told = labels.select(F.col(id_column).alias("_label_id"), *[F.coalesce(c, F.lit(False)).alias(f"_bad_{k}") for k, c in rejects.items()]).where("_label_id IS NOT NULL")
    # ids first, so that only the sample's texts move
    chosen = told.orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample)
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).where(F.length("_text") <= FIT_CHARS).join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))
    got = rows.orderBy("_id", "_text").limit(2 * sample).collect()
    bad = {k: np.array([r[f"_bad_{k}"] for r in got], "int64") for k in rejects}
    made = Sample(r["_text"] for r in got)
    return {k: fit(made, b) for k, b in bad.items()}


def evidence(docs: DataFrame, models: dict[str, Evidence | None], text: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents, with or without their texts, with ``_odds_<name>``, each classifier's log odds from the whole text."""
    names = docs.columns
    at = names.index(text)
    stay = [i for i in range(len(names)) if keep_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[float]] = {k: [] for k in models}
            for value in batch.column(at):
                told = value.as_py() or ""
                words = words_of(told)
                form, some = shape(told, words), terms_of(words)
                for k, model in models.items():
                    out[k].append(-20.0 if model is None else model(form, some))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *(pa.array(v, pa.float64()) for v in out.values())], [*(names[i] for i in stay), *(f"_odds_{k}" for k in models)])

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in stay), *(T.StructField(f"_odds_{k}", T.DoubleType()) for k in models)]))


def site_posteriors(scored: DataFrame, levels: list[str], names: list[str]) -> DataFrame:
    """``levels..., n, _site_<name>``: for each path the log odds, shrunk level by level towards the global mean.

    A level's strength k is a number of documents: with m the parent's mean, v the sites' variance around it
    beyond sampling error, k = m (1 - m) / v - 1, kept within 1 and 10,000.
    """
    sums = [F.sum(1 / (1 + F.exp(-F.col(f"_odds_{k}")))).alias(f"_sum_{k}") for k in names]
    table = scored.groupBy(*levels).agg(F.count("*").alias("n"), *sums)
    total = table.agg(F.sum("n").alias("n"), *[F.sum(f"_sum_{k}").alias(f"_sum_{k}") for k in names]).first()
    n_all = total["n"] or 1
    out = table.select(*levels, "n", *[f"_sum_{k}" for k in names])
    for k in names:
        out = out.withColumn(f"_mean_{k}", F.lit(min(max((total[f"_sum_{k}"] or 0.0) / n_all, 1e-4), 1 - 1e-4)))
    for depth in range(1, len(levels) + 1):
        keys = levels[:depth]
        site = out.groupBy(*keys).agg(F.sum("n").alias("_n"), *[F.sum(f"_sum_{k}").alias(f"_s_{k}") for k in names], *[F.first(f"_mean_{k}").alias(f"_m_{k}") for k in names])
        spread = []
        for k in names:
            rate, m = F.col(f"_s_{k}") / F.col("_n"), F.col(f"_m_{k}")
            spread += [F.sum(F.col("_n") * (rate - m) ** 2 - m * (1 - m)).alias(f"_v_{k}"), F.sum(F.col("_n") * m * (1 - m)).alias(f"_b_{k}")]
        got = site.agg(F.sum("_n").alias("_n"), *spread).first()
        for k in names:
            variance = max((got[f"_v_{k}"] or 0.0) / max(got["_n"] or 1, 1), 1e-12)
            base = (got[f"_b_{k}"] or 0.0) / max(got["_n"] or 1, 1)
            strength = min(max(base / variance - 1, 1.0), 10_000.0)
            site = site.withColumn(f"_m_{k}", (F.col(f"_s_{k}") + strength * F.col(f"_m_{k}")) / (F.col("_n") + strength))
        named = site.select(*[F.col(c).alias(f"_key_{c}") for c in keys], *[F.col(f"_m_{k}").alias(f"_up_{k}") for k in names])
        on = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys]
        out = out.join(named, on).select(*levels, "n", *[f"_sum_{k}" for k in names], *[F.col(f"_up_{k}").alias(f"_mean_{k}") for k in names])
    m = {k: F.least(F.greatest(F.col(f"_mean_{k}"), F.lit(1e-4)), F.lit(1 - 1e-4)) for k in names}
    return out.select(*levels, "n", *[F.log(m[k] / (1 - m[k])).alias(f"_site_{k}") for k in names])


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", levels: tuple[str, ...] = ("source", "lang"), rejects: dict[str, Column] | None = None, site_weight: float = 0.25, cut: float = 0.5, keep_text: bool = True) -> DataFrame:
    """The documents with ``_p_<name>`` for each rejected label, and ``_keep``.

    ``site_weight`` tempers the sites' odds against the documents' own: a site's mean holds the same documents.
    The site table is broadcast while it is no longer than SITES_BROADCAST rows, else joined by shuffle.
    """
    rejects = rejects or {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    names = list(rejects)
    models = train(docs, labels, rejects, id_column, text)
    # whole texts are read once; the written scores serve the sites and the decisions
    scored = stable(evidence(docs, models, text, keep_text), "evidence")
    sites = stable(site_posteriors(scored, list(levels), names), "sites")
    keyed = sites.select(*[F.col(c).alias(f"_key_{c}") for c in levels], *[f"_site_{k}" for k in names])
    small = keyed.count() <= SITES_BROADCAST
    out = scored.join(F.broadcast(keyed) if small else keyed, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in levels], "left")
    for k in names:
        odds = F.col(f"_odds_{k}") + site_weight * F.coalesce(F.col(f"_site_{k}"), F.lit(0.0))
        out = out.withColumn(f"_p_{k}", F.lit(0.0) if models[k] is None else 1 / (1 + F.exp(-odds)))
    keep = F.lit(True)
    for k in names:
        keep = keep & (F.col(f"_p_{k}") < cut)
    kept = [c for c in docs.columns if keep_text or c != text]
    return out.withColumn("_keep", keep).select(*[F.col(f"`{c}`") for c in kept], *[f"_p_{k}" for k in names], "_keep")
