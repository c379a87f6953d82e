"""Models, cross-validation, training. Fitting is Spark ML's."""

from __future__ import annotations

import threading
import time
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import add, add_once
from ..operators import evaluate, folds, ngrams, profile
from ..operators.features import v1_features, with_features, with_similarity
from ..operators.lookalike import find
from ..operators.parts import site_key, with_parts
from . import boost
from .storage import dealt, stable

#: URLs of a task that makes features; their bytes, by which adaptive execution cuts tasks, would allow a million
ROWS_PER_TASK = 5_000
KINDS = {
    "v1": "13 first-generation features, random forest",
    "features": "41 URL features, gradient-boosted trees",
    "ngrams": "character n-grams (TF-IDF), logistic regression",
    "combined": "mean of features and ngrams (default)",
}
PARTS = {"v1": ("v1",), "features": ("features",), "ngrams": ("ngrams",), "combined": ("features", "ngrams")}


@dataclass(frozen=True)
class Settings:
    """Learner settings; the defaults follow the published models as far as the learners allow.

    Boosting on more than ``early_stop_over`` rows holds ``held_share`` of them back by a hash of the URL, and stops at
    the round after which their loss grows. Learners make a pass per round or iteration, so a training table has
    one task per ``rows_per_task`` rows: tasks of a few rows would be all overhead. Boosting takes ``boost_rows_per_task``
    rows in one task, without a job per round. Fits side by side keep vectors of ``cells_at_once`` cells, of twelve bytes.
    """

    trees: int = 100
    forest_depth: int = 20
    rounds: int = 400
    step: float = 0.06
    boost_depth: int = 5
    bins: int = 256
    min_leaf: int = 20
    inverse_penalty: float = 4.0
    iterations: int = 2000
    tolerance: float = 1e-4
    early_stop_over: int = 10_000
    held_share: float = 0.1
    rows_per_task: int = 20_000
    boost_rows_per_task: int = 200_000
    max_terms: int = ngrams.MAX_TERMS
    cells_at_once: int = 300_000_000
    seed: int = 42


def parts_of(kind: str) -> tuple[str, ...]:
    if kind not in KINDS:
        raise ValueError(f"no model of kind {kind!r}: {', '.join(KINDS)} exist")
    return PARTS[kind]


@dataclass
class TreeModel:
    """Trees over named feature columns."""

    names: tuple[str, ...]
    model: object

    def score(self, df: DataFrame, out: str) -> DataFrame:
        cols = df.columns
        scored = self.model.transform(_assemble(df, self.names))
        return scored.select(*cols, vector_to_array("probability")[1].alias(out))


@dataclass
class GramModel:
    """Logistic regression over weighted n-grams; the vocabulary is bounded by ``max_terms``."""

    terms: list[str]
    idf: list[float]
    model: object
    places: np.ndarray | None = None

    def weights(self, spark: SparkSession) -> DataFrame:
        """``(gram, idf, coef)``, with which ``ngrams.score`` scores without vectors."""
        return spark.createDataFrame(pd.DataFrame({"gram": self.terms, "idf": self.idf, "coef": self.model.coefficients.toArray()}), "gram string, idf double, coef double")

    def score(self, df: DataFrame, out: str) -> DataFrame:
        cols = df.columns
        scored = self.model.transform(gram_vectors(df, self.terms, self.idf, self.places))
        return scored.select(*cols, vector_to_array("probability")[1].alias(out))


def _assemble(df: DataFrame, names) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep").transform(df)


def gram_vectors(df: DataFrame, terms: list[str], idf: list[float], places: np.ndarray | None = None) -> DataFrame:
    """Adds ``features``: the unit-length TF-IDF vector of ``url`` (of ``_grams``, or of ``_ids`` whose ``places`` in the
    vocabulary are given, where the table has them).

    One Arrow batch function looks up, counts and weighs all grams of a batch at once, without a step per row.
    """
    weight = np.asarray(idf, dtype=float)

    # self-contained, so that workers need nothing but numpy, pandas and Arrow; grams stay Arrow strings throughout
    def weigh(n: int, row: np.ndarray, place: np.ndarray, tf: np.ndarray) -> pa.Array:
        w = (1 + np.log(tf)) * weight[place]
        w /= np.sqrt(np.bincount(row, w * w, n))[row]
        cuts = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (place.astype("int32"), w)]
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, "int8")), pa.array(np.full(n, len(weight), "int32")), *lists], ["type", "size", "indices", "values"])

    @F.arrow_udf(VectorUDT())
    def weighed(grams: pa.Array) -> pa.Array:
        n, size, flat = len(grams), len(weight), grams.flatten()
        place = pc.index_in(flat, value_set=pa.array(terms, flat.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), pc.list_value_length(grams).fill_null(0).to_numpy(zero_copy_only=False))
        known = place >= 0
        pair, tf = np.unique(row[known].astype("int64") * size + place[known], return_counts=True)
        return weigh(n, pair // max(size, 1), pair % max(size, 1), tf)

    @F.arrow_udf(VectorUDT())
    def weighed_ids(ids: pa.Array, tf: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(ids).to_numpy(zero_copy_only=False))
        place = places[ids.flatten().to_numpy()]
        known = place >= 0
        return weigh(len(ids), row[known], place[known], tf.flatten().to_numpy()[known])

    if places is not None and "_ids" in df.columns:
        made, found = df, weighed_ids("_ids", "_tf")
    else:
        made = df if "_grams" in df.columns else add_once(df, {"_grams": ngrams.grams("url")})
        found = weighed("_grams")

    return made.withColumn("features", found).select(*[f"`{c}`" for c in df.columns], "features")


def _sized(df: DataFrame, rows: int, s: Settings) -> DataFrame:
    """A training table with a task per ``rows_per_task`` rows, but no more tasks than cores while a task has under a
    hundred times as many: every task sends all sums of a round to be added, as many bytes as the model has
    coefficients or bins, so tasks beyond the cores add messages and no speed."""
    return df.coalesce(_tasks(df, rows, s))


def _tasks(df: DataFrame, rows: int, s: Settings) -> int:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(-(-rows // s.rows_per_task), max(cores, -(-rows // (100 * s.rows_per_task)))))


@dataclass
class Vocabulary:
    """The terms in order, with their weights and documents; ``places``: of numbered grams, their places among the terms or -1."""

    terms: list[str]
    idf: list[float]
    docs: list[int]
    places: np.ndarray | None = None


def collected(vocabulary: DataFrame) -> Vocabulary:
    """At most ``max_terms`` rows."""
    table = vocabulary.select("gram", "idf", "df").toArrow().sort_by("gram")
    return Vocabulary(*[table.column(c).to_pylist() for c in ("gram", "idf", "df")])


_room, _held_cells = threading.Condition(), [0]


@contextmanager
def _cells(n: int, most: int):
    """Waits until vectors of ``n`` cells and those that other fits keep are ``most`` at most, or no other fit keeps any."""
    with _room:
        _room.wait_for(lambda: not _held_cells[0] or _held_cells[0] + n <= most)
        _held_cells[0] += n
    try:
        yield
    finally:
        with _room:
            _held_cells[0] -= n
            _room.notify_all()


def fit_part(part: str, train: DataFrame, s: Settings, vocabulary: DataFrame | Vocabulary | None = None):
    """Fits one learner on a prepared table with ``y``; ``vocabulary`` if the caller has the grams already."""
    if part == "ngrams":
        vocabulary = ngrams.vocabulary(train, max_terms=s.max_terms) if vocabulary is None else vocabulary
        v = vocabulary if isinstance(vocabulary, Vocabulary) else collected(vocabulary)
        grams = [c for c in ("_grams", "_ids", "_tf") if c in train.columns]
        # vectors are made again by each of the learner's two passes: written, they are twenty times the grams
        data = gram_vectors(train.select("url", "y", *grams), v.terms, v.idf, v.places).select("features", "y")
        n = train.count()
        penalty = 1.0 / (s.inverse_penalty * max(n, 1))
        learner = LogisticRegression(labelCol="y", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=s.iterations, tol=s.tolerance)
        # the learner keeps its vectors: fits side by side whose vectors don't fit into memory together would read disks
        with _cells(sum(v.docs), s.cells_at_once):
            return GramModel(v.terms, v.idf, learner.fit(_sized(data, n, s)), v.places)
    names = dims.V1_FEATURES if part == "v1" else dims.FEATURES
    n = train.count()
    data = add(train, {"_held": f"pmod(xxhash64(url, {s.seed}), 1000) < {int(1000 * s.held_share)}"}).select("y", "_held", *names)
    if part == "v1":
        learner = RandomForestClassifier(
            labelCol="y", numTrees=s.trees, maxDepth=s.forest_depth, featureSubsetStrategy="sqrt", seed=s.seed, maxBins=s.bins, maxMemoryInMB=1024
        )
        return TreeModel(tuple(names), learner.fit(_sized(_assemble(data, names).select("features", "y", "_held"), n, s)))
    learner = GBTClassifier(
        labelCol="y", maxIter=s.rounds, stepSize=s.step, maxDepth=s.boost_depth, maxBins=s.bins, minInstancesPerNode=s.min_leaf, seed=s.seed, maxMemoryInMB=1024, validationTol=0.0
    )
    if n > s.early_stop_over:
        learner.setValidationIndicatorCol("_held")
    tasks = 1 if n <= s.boost_rows_per_task else _tasks(data, n, s)
    return TreeModel(tuple(names), boost.fit(data.coalesce(tasks), tuple(names), learner, n > s.early_stop_over, tasks))


@dataclass
class Detector:
    kind: str
    parts: dict[str, object]
    meta: dict = field(default_factory=dict)

    @property
    def threshold(self) -> float:
        return self.meta.get("threshold", 0.5)

    @property
    def needs_similarity(self) -> bool:
        return "features" in self.parts

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``p`` to a prepared table (``prepare``)."""
        cols = df.columns
        for name, part in self.parts.items():
            df = part.score(df, f"_p_{name}")
        return add(df, {"p": combine([f"_p_{n}" for n in self.parts])}).select(*cols, "p")

    def score_parts(self, df: DataFrame) -> DataFrame:
        """Adds ``p`` to a table that has parts and findings."""
        cols = df.columns
        return self.score(add_features(df, self.kind)).select(*cols, "p")

    def score_urls(self, df: DataFrame) -> DataFrame:
        """Adds ``p`` to a table that has only ``url``."""
        cols = df.columns
        parsed = with_similarity(with_parts(df)) if self.needs_similarity else with_parts(df)
        return self.score_parts(find(parsed)).select(*cols, "p")


def combine(columns: list[str]) -> str:
    """Mean of the probabilities (M6)."""
    return f"({' + '.join(columns)}) / {len(columns)}"


def add_features(df: DataFrame, kind: str) -> DataFrame:
    """The feature columns that a kind of model reads."""
    parts = parts_of(kind)
    if "features" in parts:
        df = with_features(df)
    if "v1" in parts:
        have = [n for n in dims.V1_FEATURES if n not in df.columns]
        df = v1_features(df, names=have)
    return df


def prepare(df: DataFrame) -> DataFrame:
    """Labelled URLs ``(url_id, url, status)`` -> one stored row per distinct URL with label, site and
    every feature. Folds and models reuse it; nothing in it is fitted."""
    once = dealt(stable(profile.with_label(profile.first_per_url(df.where("url IS NOT NULL"))), "distinct-urls"), ROWS_PER_TASK)
    parsed = find(with_similarity(with_parts(once)))
    full = v1_features(with_features(parsed), names=("has_ip", "is_shortened"))
    names = tuple(dict.fromkeys([*dims.V1_FEATURES, *dims.FEATURES]))
    return stable(add(full.where("NOT parse_error"), {"site": site_key()}).select("url_id", "url", "y", "site", *names), "features")


def build(kind: str, train: DataFrame, s: Settings | None = None, vocabulary: DataFrame | Vocabulary | None = None) -> Detector:
    """Fits the parts of a kind side by side: a learner's rounds are many short jobs that leave cores idle."""
    s, parts = s or Settings(), parts_of(kind)
    with ThreadPoolExecutor(len(parts)) as pool:
        return Detector(kind, dict(zip(parts, pool.map(lambda p: fit_part(p, train, s, vocabulary), parts), strict=True)))


def cross_validate(table: DataFrame, kind: str, k: int = 5, grouped: bool = True, s: Settings | None = None, threads: int | None = None) -> tuple[DataFrame, float]:
    """Out-of-fold scores ``(url_id, url, y, fold, p)`` and the seconds they took (M9).

    Everything fitted, vocabulary and weights included, is fitted without the fold. The folds are
    independent jobs, submitted together so that short stages overlap.
    """
    s = s or Settings()
    start = time.time()
    folded = folds.by_site(table, k, s.seed) if grouped else folds.stratified(table, k, s.seed)
    reads_grams = "ngrams" in parts_of(kind)
    folded = ngrams.with_grams(folded) if reads_grams else stable(folded, "folds")
    # grams are made once and counted once; a fold's vocabulary comes from the totals minus the fold
    counted = ngrams.counts(folded, k=k) if reads_grams else None
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    vocabularies: list[Vocabulary | None] = [None] * k

    def chosen(i: int) -> Vocabulary:
        return collected(ngrams.most_frequent(ngrams.without_fold(counted, i), sum(n for f, n in sizes.items() if f != i), max_terms=s.max_terms))

    if reads_grams:
        with ThreadPoolExecutor(threads or k) as pool:
            vocabularies = list(pool.map(chosen, range(k)))
        # grams are looked up once for all folds, in what their vocabularies hold together
        known = sorted(set().union(*(v.terms for v in vocabularies)))
        for v in vocabularies:
            v.places = np.full(len(known), -1, "int32")
            v.places[pc.index_in(pa.array(v.terms, pa.string()), value_set=pa.array(known, pa.string())).to_numpy()] = np.arange(len(v.terms))
        folded = ngrams.encoded(folded, known)

    def one(i: int) -> DataFrame:
        model = build(kind, folded.where(F.col("fold") != i), s, vocabularies[i])
        held = folded.where(F.col("fold") == i)
        return stable(model.score(held).select("url_id", "url", "y", "fold", "p"), f"oof-{i}")

    with ThreadPoolExecutor(threads or k) as pool:
        oof = reduce(DataFrame.unionByName, pool.map(one, range(k)))
    return oof, round(time.time() - start, 1)


def compare(table: DataFrame, kinds=("v1", "features", "ngrams", "combined"), random=("v1", "combined"), k: int = 5, s: Settings | None = None) -> DataFrame:
    """Model by split comparison (E8). A learner is cross-validated once per split, however many kinds it is part of.

    The cross-validations run side by side; ``seconds`` are theirs from start to end, beside the others.
    """
    rows = []
    runs = list(dict.fromkeys((p, grouped) for grouped, asked in ((True, kinds), (False, random)) for kind in asked for p in parts_of(kind)))
    with ThreadPoolExecutor(len(runs)) as pool:
        scored = dict(zip(runs, pool.map(lambda r: cross_validate(table, r[0], k, r[1], s), runs), strict=True))
    for grouped, asked in ((True, kinds), (False, random)):
        for kind in asked:
            parts = parts_of(kind)
            oof = mean_scores([scored[p, grouped][0] for p in parts])
            row = add(evaluate.metrics_at(oof), {"_one": "1"}).join(add(evaluate.roc_auc(oof), {"_one": "1"}), "_one")
            seconds = sum(scored[p, grouped][1] for p in parts)
            rows.append(add(row, {"model": f"'{kind}'", "split": f"'{'by site' if grouped else 'random'}'", "seconds": f"{seconds}D"}))
    names = ["model", "split", "roc_auc", "accuracy", "precision", "recall", "f1", "false_positive_rate", "seconds"]
    return reduce(DataFrame.unionByName, rows).select(*names)


def mean_scores(parts: list[DataFrame]) -> DataFrame:
    """The mean of several out-of-fold score tables of the same rows and folds (M6), joined by row."""
    if len(parts) == 1:
        return parts[0]
    first, *rest = parts
    out = first.withColumnRenamed("p", "_p_0")
    for i, part in enumerate(rest, 1):
        out = out.join(part.select("url_id", F.col("p").alias(f"_p_{i}")), "url_id")
    return add(out, {"p": combine([f"_p_{i}" for i in range(len(parts))])}).select(*first.columns)


def train(table: DataFrame, kind: str = "combined", k: int = 5, target_fpr: float = 0.02, s: Settings | None = None) -> Detector:
    """Cross-validate by site, choose the threshold, refit on everything, describe.

    The fit on everything needs nothing from the folds, so it runs beside them.
    """
    s = s or Settings()
    with ThreadPoolExecutor(1) as pool:
        whole = pool.submit(build, kind, table, s)
        oof, seconds = cross_validate(table, kind, k, True, s)
        t = evaluate.threshold_for_fpr(oof, target_fpr).first()["threshold"]
        detector = whole.result()
    auc = evaluate.roc_auc(oof).first()["roc_auc"]
    at = {name: {**evaluate.metrics_at(oof, x).first().asDict(), "roc_auc": auc} for name, x in (("at_0.5", 0.5), ("at_threshold", t))}
    detector.meta = {
        "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "model": kind,
        "description": KINDS[kind],
        "threshold": t,
        "target_fpr": target_fpr,
        "data": profile.dataset_counts(table).first().asDict(),
        "cv_by_site": at,
        "cv_seconds": seconds,
        "rounds": {name: part.model.getNumTrees for name, part in detector.parts.items() if isinstance(part, TreeModel)},
    }
    return detector


def info(spark: SparkSession, detector: Detector) -> DataFrame:
    """The model's description as one row."""
    m = detector.meta
    row = {
        "model": m["model"], "description": m["description"], "created": m["created"], "threshold": float(m["threshold"]),
        "target_fpr": float(m["target_fpr"]), **{k: int(v) for k, v in m["data"].items()},
        **{f"{k}_{n}": float(v) for k, part in (("half", "at_0.5"), ("chosen", "at_threshold")) for n, v in m["cv_by_site"][part].items() if n in ("roc_auc", "f1", "recall", "false_positive_rate")},
    }
    return spark.createDataFrame([row])


def out_of_time(detectors: dict[str, Detector], sources: DataFrame, thresholds=(0.5,)) -> DataFrame:
    """Share of each source at or above each threshold, per model (M13, A16). ``sources``: ``(source, url)``.

    URLs are parsed once for all models, and a learner that several models hold scores them once.
    """
    models = detectors.values()
    parsed = with_parts(dealt(stable(sources.select("source", "url"), "sources"), ROWS_PER_TASK))
    df = find(with_similarity(parsed) if any(d.needs_similarity for d in models) else parsed)
    for part in dict.fromkeys(p for d in models for p in d.parts):
        df = add_features(df, part)
    fitted = {id(p): p for d in models for p in d.parts.values()}
    column = {key: f"_p_{i}" for i, key in enumerate(fitted)}
    for key, part in fitted.items():
        df = part.score(df, column[key])
    scored = stable(df.select("source", *column.values()), "out-of-time")

    def share(name: str, d: Detector) -> DataFrame:
        rows = add(scored, {"p": combine([column[id(p)] for p in d.parts.values()])})
        return evaluate.share_at(rows, sorted({*thresholds, d.threshold})).withColumn("model", F.lit(name))

    return reduce(DataFrame.unionByName, [share(n, d) for n, d in detectors.items()])
