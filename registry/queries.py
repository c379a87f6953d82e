"""One callable per operator: (spark, sf_dir) -> DataFrame, over the given tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescan import dims
from lurescan.functions.distance import osa
from lurescan.functions.skeleton import skeletons, with_base_forms
from lurescan.functions.text import add, in_list
from lurescan.operators import evaluate, folds, ngrams, profile
from lurescan.operators.features import extract, v1_features, with_similarity
from lurescan.operators.generate import brand_group, lookalikes
from lurescan.operators.lookalike import explode_findings, find, findings_text, label_columns, match_columns
from lurescan.operators.lookalike_join import find_by_keys, with_findings
from lurescan.operators.parts import parts_struct, site_key, with_parts
from lurescan.operators.signals import signal_codes
from lurescan.plans import check as checking
from lurescan.plans import importance, models, persist
from lurescan.plans.storage import scratch_path, stable
from lurescan.sources import readers, sinks
from lurescan.streaming import score as streaming

from .corpus import load, word_brands

QUERIES = {}
#: rows of a file of the click log that is read as a stream
LOG_FILE_ROWS = 20_000
SWEEP = (0.5, 0.55, 0.6, 0.65, 0.7, 0.7478, 0.8, 0.9)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- inputs ---------------------------------------------------------------------------------------


def corpus(spark, sf):
    return load(spark, sf, "url_corpus")


def parsed(spark, sf, table="url_corpus"):
    return with_parts(load(spark, sf, table))


def labelled(spark, sf):
    """Corpus with y and site."""
    return add(profile.with_label(parsed(spark, sf)), {"site": site_key()}).select("url_id", "url", "status", "y", "site")


def scores(spark, sf, digits=None):
    """Deterministic pseudo-scores, so that evaluation has an exact answer without a model."""
    p = "least(CAST(conv(substr(md5(url), 1, 8), 16, 10) AS DOUBLE) / 4294967296D + 0.35D * y, 1D)"
    if digits is not None:
        p = f"floor({p} * {10**digits}) / {10**digits}D"
    return add(profile.with_label(corpus(spark, sf)), {"p": p})


def found(spark, sf, **options):
    return find(parsed(spark, sf), **options)


def _csv(df: DataFrame, name: str, header=True) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", header).option("escape", '"').csv(path)
    return path


def _text(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.text(path)
    return path


# ---- sources and sinks ------------------------------------------------------------------------------


@query
def load_csv(spark, sf):
    """CSV round trip of the raw table; rows without a URL go to quarantine."""
    path = _csv(load(spark, sf, "url_raw").selectExpr("nullif(trim(url), '') AS url", "status"), "raw")
    good, _ = readers.quarantine_missing(readers.labelled_csv(spark, path))
    return profile.with_label(good).groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("phishing"))


@query
def load_missing(spark, sf):
    """S3: the quarantined side."""
    path = _csv(load(spark, sf, "url_raw").selectExpr("nullif(trim(url), '') AS url", "status"), "raw")
    _, bad = readers.quarantine_missing(readers.labelled_csv(spark, path))
    return bad.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def load_dedup(spark, sf):
    """First row per URL with its label."""
    return profile.with_label(profile.first_per_url(load(spark, sf, "url_raw"))).selectExpr("url_id", "url", "y")


@query
def url_list(spark, sf):
    """URL list file without blanks and comments, united with direct input."""
    lines = load(spark, sf, "url_raw").selectExpr("CASE WHEN url_id % 10 = 0 THEN concat('# ', url) WHEN url_id % 10 = 1 THEN '  ' ELSE url END AS value")
    listed = readers.url_list(spark, _text(lines, "list"))
    direct = corpus(spark, sf).where("status = 'phishing'").select("url")
    return readers.union_inputs(listed, direct).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query
def feed(spark, sf):
    """Trimmed feed lines."""
    lines = load(spark, sf, "url_raw").selectExpr("concat('  ', url, IF(url_id % 3 = 0, '\\t', ' ')) AS value")
    return readers.feed(spark, _text(lines, "feed")).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query
def popular_sites(spark, sf):
    """First ranks of a ranked domain list as home pages."""
    ranked = corpus(spark, sf).selectExpr("CAST(url_id + 1 AS INT) AS rank", "concat('site', url_id, '.example.org') AS domain")
    return readers.popular_sites(spark, _csv(ranked, "popular", header=False), 500)


@query
def request_intake(spark, sf):
    """JSON request bodies, accepted and exploded."""
    return readers.request_urls(readers.parse_requests(_requests(spark, sf)), "request_id")


@query
def request_rejects(spark, sf):
    """S16, ST3: the quarantine side."""
    return readers.rejected_requests(readers.parse_requests(_requests(spark, sf)))


def _requests(spark, sf):
    return corpus(spark, sf).selectExpr(
        "url_id AS request_id",
        """CASE url_id % 7 WHEN 0 THEN concat('{"urls":["', url, '","https://second.example.org/"]}')
           WHEN 1 THEN concat('{"url":"', url, '"}') WHEN 2 THEN concat('{"urls":[1,"', url, '"]}')
           WHEN 3 THEN '{}' WHEN 4 THEN concat('{"urls":[],"url":"', url, '"}') WHEN 5 THEN 'no json'
           ELSE '{"url":7}' END AS body""",
    )


@query
def json_results(spark, sf):
    """Nested results written as JSON lines and read back."""
    path = scratch_path(spark, "results")
    sinks.results_json(checking.verdicts(_enriched_scores(spark, sf), 0.75, keep=("url_id",)), path)
    back = spark.read.schema(
        "model string, url_id bigint, verdict string, probability double, threshold double, site string, "
        "lookalike array<struct<brand:string,technique:string,severity:string,detail:string>>, signals array<string>"
    ).json(path)
    return back.selectExpr("url_id", "model", "verdict", "probability", "threshold", "site", "size(lookalike) AS findings", "size(signals) AS signs")


@query
def report_roundtrip(spark, sf):
    """A nested report written, read and flattened to its sweep."""
    s = scores(spark, sf)
    facts = readers.snapshot(s.where("y = 1"), s.where("y = 0"), "list-1", "2026-01-01")
    shares = evaluate.share_at(add(s, {"source": "status"}), [0.5]).selectExpr("'v1' AS model", "source AS measure", "share")
    path = scratch_path(spark, "report")
    sinks.report_json(facts, shares, evaluate.sweep(s, SWEEP), path)
    return readers.report_sweep(readers.report(spark, path))


@query
def report_sections(spark, sf):
    """The report's further sections, written, read back and put under one another."""
    s = scores(spark, sf)
    facts = readers.snapshot(s.where("y = 1"), s.where("y = 0"), "list-1", "2026-01-01")
    shares = evaluate.share_at(add(s, {"source": "status"}), [0.5]).selectExpr("'v1' AS model", "source AS measure", "share")
    cv = evaluate.metrics_at(s).selectExpr("'by site' AS split", "accuracy", "recall")
    sections = {"cross_validation": cv, "at_threshold": evaluate.compare_thresholds(s, 0.7478), "lookalikes": profile.flag_shares(found(spark, sf), ("status",)), "top_mistakes": evaluate.top_mistakes(s)}
    path = scratch_path(spark, "report")
    sinks.report_json(facts, shares, evaluate.sweep(s, SWEEP), path, sections)
    back = [
        readers.report_section(spark, path, "cross_validation", "split: string, recall: double").selectExpr("'cross_validation' AS section", "split AS name", "round(recall, 3) AS value"),
        readers.report_section(spark, path, "at_threshold", "metric: string, at_threshold: double").selectExpr("'at_threshold'", "metric", "round(at_threshold, 3)"),
        readers.report_section(spark, path, "lookalikes", "status: string, any_share: double").selectExpr("'lookalikes'", "status", "any_share"),
        readers.report_section(spark, path, "top_mistakes", "url_id: bigint, y: int").selectExpr("'top_mistakes'", "CAST(url_id AS STRING)", "CAST(y AS DOUBLE)"),
    ]
    return reduce(DataFrame.union, back)


@query
def report_shares(spark, sf):
    """Source by model table of a report."""
    s = scores(spark, sf)
    facts = readers.snapshot(s.where("y = 1"), s.where("y = 0"), "list-1", "2026-01-01")
    by = add(s, {"source": "status"})
    v1 = evaluate.share_at(by, [0.5]).selectExpr("'v1' AS model", "source AS measure", "share")
    both = v1.unionByName(evaluate.share_at(by, [0.75]).selectExpr("'combined' AS model", "source AS measure", "share"))
    path = scratch_path(spark, "report")
    sinks.report_json(facts, both, evaluate.sweep(s, SWEEP), path)
    return readers.report_shares(readers.report(spark, path))


@query
def snapshot_facts(spark, sf):
    """S19."""
    s = scores(spark, sf)
    return readers.snapshot(s.where("y = 1"), s.where("y = 0"), "list-1", "2026-01-01")


# ---- parsing ----------------------------------------------------------------------------------------


@query
def parse_parts(spark, sf):
    """Scheme, host, port, path, query of corpus and defects."""
    return parsed(spark, sf, "url_raw").selectExpr("url_id", "scheme", "host", "coalesce(port, -1) AS port", "path", "query", "parse_error")


@query
def default_scheme(spark, sf):
    """Rows that had no scheme of their own."""
    return parsed(spark, sf, "url_raw").where("NOT contains(substr(trim(url), 1, 16), '://')").select("url_id", "scheme", "host")


@query
def registered_domain(spark, sf):
    """Public-suffix split and site."""
    return add(parsed(spark, sf, "url_raw"), {"site": site_key()}).select("url_id", "subdomain", "domain", "suffix", "registered", "site")


@query
def ip_host(spark, sf):
    """P6, P10."""
    return parsed(spark, sf, "url_raw").where("is_ip").select("url_id", "host", "domain", "registered")


@query
def unicode_host(spark, sf):
    """Hosts whose displayed form differs."""
    return parsed(spark, sf, "url_raw").where("host <> unicode_host").select("url_id", "host", "unicode_host")


@query
def invalid_urls(spark, sf):
    """C1."""
    return checking.enrich(load(spark, sf, "url_raw")).where("NOT is_valid").select("url_id", "url")


@query
def clicks_by_site(spark, sf):
    """A click log with repeated URLs keeps every row."""
    clicks = load(spark, sf, "clicks")
    return add(with_parts(clicks), {"site": site_key()}).groupBy("site").agg(
        F.count(F.lit(1)).alias("clicks"), F.count_distinct("url").alias("urls"), F.count_distinct("user_id").alias("users")
    )


# ---- features ---------------------------------------------------------------------------------------



@query
def v1_feature_rows(spark, sf):
    """V1-V13."""
    return v1_features(corpus(spark, sf)).select("url_id", *dims.V1_FEATURES)


def _features(spark, sf, *names):
    return extract(corpus(spark, sf), names=names).select("url_id", *names)


@query
def feat_counts(spark, sf):
    return _features(spark, sf, "count_ampersand", "count_percent", "count_underscore", "count_tilde", "query_length", "digit_ratio")


@query
def feat_host(spark, sf):
    return _features(spark, sf, "host_dots", "subdomain_levels", "host_hyphens", "host_digits", "longest_host_token", "has_port", "is_ip_host", "is_punycode", "www_prefix", "tld_common", "tld_length")


@query
def feat_path(spark, sf):
    return _features(spark, sf, "longest_path_token", "path_segments", "double_slash_in_path", "php_or_html", "email_in_url")


@query
def feat_entropy(spark, sf):
    return _features(spark, sf, "host_entropy", "url_entropy").selectExpr("url_id", "round(host_entropy, 6) AS host_entropy", "round(url_entropy, 6) AS url_entropy")


@query
def feat_words(spark, sf):
    return _features(spark, sf, "sensitive_words")


@query
def feat_hosting(spark, sf):
    """F12, F35, F41, J3."""
    return _features(spark, sf, "is_shortener", "free_hosting", "official_brand_domain")


@query
def feat_brand_similarity(spark, sf):
    """Scored once per distinct label, joined back to every URL."""
    return with_similarity(parsed(spark, sf)).select("url_id", "brand_similarity")


@query
def feat_matrix(spark, sf):
    """all 41 features; column sums as a fingerprint per class."""
    rows = extract(corpus(spark, sf))
    return rows.groupBy("status").agg(*[F.round(F.sum(n), 2).alias(n) for n in dims.FEATURES if n not in ("host_entropy", "url_entropy", "digit_ratio")])


@query
def feat_similarity_clicks(spark, sf):
    """F39 on a log with heavily repeated sites."""
    return with_similarity(with_parts(load(spark, sf, "clicks"))).groupBy("brand_similarity").agg(F.count(F.lit(1)).alias("clicks"))


# ---- lookalike matching -----------------------------------------------------------------------------


@query
def look_gate(spark, sf):
    """Hosts worth matching and those on shared platforms."""
    rows = label_columns(parsed(spark, sf))
    return rows.groupBy("registered").agg(F.max("_gate").alias("matched"), F.max("_tenant").alias("tenant"), F.count(F.lit(1)).alias("urls"))


@query
def look_skeletons(spark, sf):
    """Distinct readings per distinct label."""
    labels = parsed(spark, sf).where("domain <> '' AND NOT is_ip").select("domain").distinct()
    return with_base_forms(labels, {"b": "domain"}).selectExpr("domain", f"explode({skeletons('b')}) AS reading")


@query
def look_osa(spark, sf):
    """L2: capped distance between each phishing label and the brand of the same row."""
    rows = _label_and_brand(spark, sf)
    return add(rows, {"distance": osa("domain", "brand", "3")}).select("url_id", "domain", "brand", "distance")


@query
def look_osa_full(spark, sf):
    """L2 without a cap."""
    rows = _label_and_brand(spark, sf)
    return add(rows, {"distance": osa("domain", "brand")}).select("url_id", "distance")


def _label_and_brand(spark, sf):
    brands = spark.createDataFrame([(b.ord, b.brand) for b in dims.BRANDS], "ord int, brand string")
    rows = parsed(spark, sf).where("status = 'phishing' AND domain <> ''")
    rows = add(rows, {"ord": f"CAST((floor(url_id / 4) + floor(floor(url_id / 4) / 9)) % {len(dims.BRANDS)} AS INT)"})
    return rows.join(F.broadcast(brands), "ord")  # 57 rows


@query
def look_words(spark, sf):
    """Words of the displayed label."""
    return label_columns(parsed(spark, sf)).selectExpr("url_id", "_shown AS label", "array_join(_label_words, ' ') AS words")


def _technique(spark, sf, column):
    return match_columns(parsed(spark, sf)).selectExpr("url_id", f"explode({column}) AS brand").select("url_id", "brand")


@query
def look_unofficial(spark, sf):
    """L7."""
    return _technique(spark, sf, "_same")


@query
def look_homoglyph(spark, sf):
    """L8."""
    return _technique(spark, sf, "_homoglyph")


@query
def look_typosquat(spark, sf):
    """L9."""
    return _technique(spark, sf, "_typo")


@query
def look_combo_medium(spark, sf):
    """L10."""
    return _technique(spark, sf, "_word")


@query
def look_combo_low(spark, sf):
    """L11."""
    return _technique(spark, sf, "_affix")


@query
def look_subdomain(spark, sf):
    """L12, L13."""
    return found(spark, sf).selectExpr("url_id", "inline(lookalike)").where("technique = 'brand-in-subdomain'").select("url_id", "brand", "severity")


@query
def look_path(spark, sf):
    """L14."""
    return _technique(spark, sf, "_pathword")


@query
def look_best_per_brand(spark, sf):
    """The finding that stays per URL and brand, with its place in the list."""
    return found(spark, sf).selectExpr("url_id", "posexplode(lookalike) AS (pos, f)").selectExpr("url_id", "pos", "f.brand", "f.technique", "f.severity")


@query
def look_severity(spark, sf):
    """Strongest finding per URL."""
    return found(spark, sf).select("url_id", "lookalike_severity")


@query
def look_by_keys(spark, sf):
    """The same findings through equi-joins on generated keys."""
    brands = spark.createDataFrame([tuple(b) for b in dims.BRANDS], "ord int, brand string, official array<string>, home string, word_only boolean")
    return find_by_keys(corpus(spark, sf), brands).select("url_id", "brand", "technique", "severity")


@query
def look_details(spark, sf):
    """The sentence shown with every finding, in order."""
    return explode_findings(found(spark, sf), "url_id").select("url_id", "pos", "brand", "detail")


@query
def check_brand_table(spark, sf):
    """check() against a table of brands that is too long for a literal."""
    urls, brands = word_brands(spark, sf)
    rows = checking.check(urls, keep=("url_id",), brands=brands)
    return rows.selectExpr("url_id", "verdict", "site", f"{findings_text('lookalike')} AS findings", "array_join(transform(lookalike, f -> f.detail), '; ') AS details")


@query
def look_large_table(spark, sf):
    """L7-L11 at scale: every distinct word of the documents is a brand, matched against page hosts."""
    text = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.expr("array_distinct(regexp_extract_all(lower(text), '[a-z]+', 0))")).alias("brand"))
    brands = text.distinct().selectExpr("CAST(hash(brand) AS INT) AS ord", "brand", "array(concat(brand, '.test')) AS official", "concat(brand, '.test') AS home", "false AS word_only")
    pages = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id AS url_id", "regexp_replace(url, '[.]example[.]', '.') AS url")
    return find_by_keys(pages, brands).groupBy("technique", "severity").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("brand").alias("brands"))


# ---- signals, verdicts ------------------------------------------------------------------------------


@query
def signals(spark, sf):
    """G1-G11 as codes in order."""
    return parsed(spark, sf).selectExpr("url_id", f"array_join({signal_codes()}, ',') AS codes")


def _enriched_scores(spark, sf):
    p = "least(CAST(conv(substr(md5(url), 1, 8), 16, 10) AS DOUBLE) / 4294967296D + IF(status = 'phishing', 0.35D, 0D), 1D)"
    return add(checking.enrich(load(spark, sf, "url_raw")), {"p": p})


@query
def check_verdicts(spark, sf):
    """Verdict, shown probability, site and findings per row."""
    rows = checking.verdicts(_enriched_scores(spark, sf), 0.75, keep=("url_id",))
    return rows.selectExpr("url_id", "verdict", "probability", "threshold", "site", f"{findings_text('lookalike')} AS findings")


@query
def check_model_only(spark, sf):
    """Findings shown but not decisive."""
    return checking.verdicts(_enriched_scores(spark, sf), 0.75, lookalike_decides=False, keep=("url_id",)).select("url_id", "verdict")


@query
def batch_alarm(spark, sf):
    """Alarm per source batch."""
    rows = checking.verdicts(add(_enriched_scores(spark, sf), {"batch": "url_id % 20"}), 0.99, keep=("batch",))
    return checking.batch_alarm(rows)


@query
def verdicts_by_site(spark, sf):
    """End to end without a model: URL -> parts -> findings -> verdict -> counts per site."""
    return checking.check(corpus(spark, sf), keep=("url_id",)).groupBy("site", "verdict").agg(F.count(F.lit(1)).alias("urls"))


# ---- profiles ---------------------------------------------------------------------------------------


@query
def dataset_counts(spark, sf):
    """A1."""
    return profile.dataset_counts(labelled(spark, sf))


@query
def class_balance(spark, sf):
    """A5."""
    return profile.class_balance(load(spark, sf, "url_raw"))


@query
def class_profile(spark, sf):
    """A6."""
    return profile.class_profile(corpus(spark, sf))


@query
def length_histogram(spark, sf):
    """A7."""
    return profile.length_histogram(corpus(spark, sf))


@query
def sketched_counts(spark, sf):
    """A1 at scale: distinct sites and users of the click log from stored daily sketches, beside the exact counts."""
    clicks = with_parts(load(spark, sf, "clicks")).selectExpr("CAST(ts AS DATE) AS day", "user_id", f"{site_key()} AS site")
    out = []
    for column in ("site", "user_id"):
        stored = scratch_path(spark, "sketches")
        profile.sketches(clicks, ("day",), column).write.parquet(stored)
        estimate = profile.merged(spark.read.parquet(stored)).withColumn("_one", F.lit(1))
        exact = clicks.agg(F.count_distinct(column).alias("exact")).withColumn("_one", F.lit(1))
        out.append(estimate.join(exact, "_one").selectExpr(f"'{column}' AS counted", "rows", "exact", "abs(about - exact) <= 0.03 * exact AS within"))
    return reduce(DataFrame.unionByName, out)


@query
def site_sizes(spark, sf):
    """A2."""
    return profile.site_sizes(labelled(spark, sf))


@query
def shared_site_share(spark, sf):
    """A3, A4."""
    return profile.shared_site_share(labelled(spark, sf))


@query
def site_mode_label(spark, sf):
    """A8, W5, J6."""
    return profile.top_sites(labelled(spark, sf))


@query
def url_site_size(spark, sf):
    """Every URL with the size of its site."""
    return profile.url_site_size(labelled(spark, sf)).select("url_id", "site", "site_urls")


@query
def v1_bug_audit(spark, sf):
    """A9."""
    rows = v1_features(parsed(spark, sf), names=("has_ip", "is_shortened"))
    return profile.v1_audit(add(rows, {"is_shortener": f"IF({in_list('registered', dims.SHORTENERS)}, 1, 0)"}))


@query
def first_flagged(spark, sf):
    """W9."""
    return profile.first_flagged(v1_features(corpus(spark, sf), names=("is_shortened",)), "is_shortened")


@query
def feature_class_means(spark, sf):
    """A10."""
    names = ("subdomain_levels", "host_entropy", "sensitive_words", "free_hosting", "is_ip_host", "brand_similarity", "lookalike_severity")
    return profile.feature_class_means(extract(corpus(spark, sf), names=names), names).selectExpr("feature", "round(legitimate, 2) AS legitimate", "round(phishing, 2) AS phishing")


@query
def findings_by_example(spark, sf):
    """A11."""
    return found(spark, sf).selectExpr("url_id", "unicode_host AS shown_as", f"{findings_text()} AS findings")


@query
def severity_crosstab(spark, sf):
    """A12."""
    return profile.severity_crosstab(found(spark, sf))


@query
def flag_shares(spark, sf):
    """A14."""
    return profile.flag_shares(found(spark, sf), ("status",))


@query
def finding_examples(spark, sf):
    """A15, T17."""
    return profile.finding_examples(found(spark, sf), 25)


@query
def gen_lookalikes(spark, sf):
    """Lookalikes of every legitimate site of the corpus."""
    sites = parsed(spark, sf).where("status = 'legitimate' AND domain <> ''").selectExpr("registered AS name", "registered AS home").distinct()
    made = with_parts(lookalikes(sites), pushable=True)
    # punycode hosts are shown as they read
    return made.selectExpr("name", "home", "technique", "replace(url, host, unicode_host) AS url")


@query
def detect_by_technique(spark, sf):
    """Lookalikes generated from the corpus' official addresses, matched and counted."""
    homes = spark.createDataFrame([(b.brand, b.home) for b in dims.BRANDS], "name string, home string")
    seen = parsed(spark, sf).where("status = 'legitimate'").groupBy(F.col("registered").alias("home")).agg(F.count(F.lit(1)).alias("urls"))
    made = lookalikes(homes.join(seen.select("home"), "home", "left_semi"))
    rows = find(with_parts(made)).withColumn("grp", brand_group("name"))
    return profile.detection_rates(rows).select("grp", "technique", "n", "hits")


# ---- folds ------------------------------------------------------------------------------------------


@query
def folds_by_site(spark, sf):
    """M7."""
    return folds.by_site(labelled(spark, sf)).groupBy("fold").agg(F.count(F.lit(1)).alias("urls"), F.count_distinct("site").alias("sites"))


@query
def folds_stratified(spark, sf):
    """M8."""
    return folds.stratified(profile.with_label(corpus(spark, sf)), key="url_id").select("url_id", "y", "fold")


@query
def holdout_by_site(spark, sf):
    """M11."""
    return folds.holdout_by_site(labelled(spark, sf)).groupBy("is_test").agg(F.count(F.lit(1)).alias("urls"), F.count_distinct("site").alias("sites"))


# ---- evaluation -------------------------------------------------------------------------------------


@query
def metrics_at(spark, sf):
    """E1."""
    return evaluate.metrics_at(scores(spark, sf), 0.6).select("tp", "fp", "fn", "tn")


@query
def roc_auc(spark, sf):
    """E2, W2 with ties."""
    return evaluate.roc_auc(scores(spark, sf, 2))


@query
def roc_curve(spark, sf):
    """E6, W2."""
    return evaluate.roc_curve(scores(spark, sf, 2)).selectExpr("threshold", "round(fpr, 6) AS fpr", "round(tpr, 6) AS tpr")


@query
def pr_curve(spark, sf):
    """E7."""
    return evaluate.pr_curve(scores(spark, sf, 2)).selectExpr("threshold", "round(precision, 6) AS precision", "round(recall, 6) AS recall")


@query
def threshold_fpr(spark, sf):
    """E3, W1."""
    return evaluate.threshold_for_fpr(scores(spark, sf), 0.05)


@query
def threshold_fpr_grid(spark, sf):
    """E3 on scores that are grid values, where rounding bites."""
    return evaluate.threshold_for_fpr(scores(spark, sf, 4), 0.3)


@query
def threshold_sweep(spark, sf):
    """E5."""
    return evaluate.sweep(scores(spark, sf), SWEEP)


@query
def share_by_source(spark, sf):
    """A16."""
    return evaluate.share_at(add(scores(spark, sf), {"source": "concat('batch', url_id % 3)"}), SWEEP)


@query
def share_model_or_high(spark, sf):
    """Score or high finding."""
    rows = add(find(with_parts(scores(spark, sf))), {"caught": "p >= 0.7478D OR lookalike_severity = 3"})
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(caught)").alias("caught"))


@query
def confusion(spark, sf):
    """E4."""
    return evaluate.confusion(scores(spark, sf), 0.7)


@query
def compare_thresholds(spark, sf):
    """E9."""
    return evaluate.compare_thresholds(scores(spark, sf), 0.7478).selectExpr("metric", "round(at_half, 3) AS at_half", "round(at_threshold, 3) AS at_threshold")


@query
def top_mistakes(spark, sf):
    """W3."""
    return evaluate.top_mistakes(scores(spark, sf)).selectExpr("y", "url_id", "round(p, 6) AS p")


@query
def top_flagged(spark, sf):
    """W4."""
    return evaluate.top_scored(scores(spark, sf).where("y = 0")).selectExpr("url_id", "round(p, 6) AS p")


# ---- n-grams and models -----------------------------------------------------------------------------


@query
def ngram_vocab(spark, sf):
    """M4: vocabulary with counts and idf."""
    return ngrams.vocabulary(corpus(spark, sf)).selectExpr("gram", "df", "cf", "round(idf, 6) AS idf")


@query
def ngram_tfidf(spark, sf):
    """Weights, summarised per URL."""
    c = corpus(spark, sf)
    return ngrams.tfidf(c, ngrams.vocabulary(c)).groupBy("url_id").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.max("weight"), 5).alias("largest"), F.round(F.sum("weight"), 4).alias("total")
    )


@query
def fold_vocab(spark, sf):
    """M4, M9: the 2,000 grams by which each fold's model reads, from counts made once for all folds."""
    folded = ngrams.with_grams(folds.by_site(labelled(spark, sf)))
    counted, sizes = ngrams.counts(folded, k=5), {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    each = [ngrams.most_frequent(ngrams.without_fold(counted, i), sum(n for f, n in sizes.items() if f != i), max_terms=2_000).withColumn("fold", F.lit(i)) for i in range(5)]
    return reduce(DataFrame.unionByName, each).selectExpr("fold", "gram", "df", "cf", "round(idf, 6) AS idf")


@query
def score_relation(spark, sf):
    """M5: scores of the n-gram model as a join of grams and weights, summed per URL."""
    c = corpus(spark, sf)
    weights = add(ngrams.vocabulary(c), {"coef": "(CAST(conv(substr(md5(gram), 1, 6), 16, 10) AS DOUBLE) / 16777216D - 0.5D) * 8D"})
    return ngrams.score(c, weights, -0.125).selectExpr("url_id", "round(p, 6) AS p")


@query
def combined_score(spark, sf):
    """Mean of two scores joined on the row id."""
    a = scores(spark, sf).selectExpr("url_id", "p AS pa")
    b = scores(spark, sf, 2).selectExpr("url_id", "p AS pb")
    return add(a.join(b, "url_id"), {"p": models.combine(["pa", "pb"])}).selectExpr("url_id", "round(p, 6) AS p")


def _table(spark, sf):
    return models.prepare(corpus(spark, sf))


def _fit(spark, sf, kind):
    table = folds.holdout_by_site(_table(spark, sf))
    detector = models.build(kind, table.where("NOT is_test"), models.Settings())
    return detector.score(table.where("is_test")).selectExpr("url_id", "y", "round(p, 6) AS p")


@query
def fit_v1(spark, sf):
    """Forest on the first-generation features, scored on held-out sites."""
    return _fit(spark, sf, "v1")


@query
def fit_features(spark, sf):
    """M3."""
    return _fit(spark, sf, "features")


@query
def fit_ngrams(spark, sf):
    """M4, M5."""
    return _fit(spark, sf, "ngrams")


@query
def fit_combined(spark, sf):
    """M6."""
    return _fit(spark, sf, "combined")


@query
def oof_scores(spark, sf):
    """Out-of-fold scores of the n-gram model."""
    oof, _ = models.cross_validate(_table(spark, sf), "ngrams", 5, True, models.Settings())
    return oof.selectExpr("url_id", "y", "fold", "round(p, 6) AS p")


@query
def oof_facts(spark, sf):
    """M9: what any cross-validation by site must give: each row scored once, in its site's fold, between 0 and 1."""
    oof, _ = models.cross_validate(_table(spark, sf), "ngrams", 5, True, models.Settings())
    in_range = "count_if(p > 0 AND p < 1)"
    return oof.groupBy("fold").agg(F.count_distinct("url_id").alias("urls"), F.sum("y").cast("bigint").alias("phishing"), F.expr(in_range).alias("in_range"))


@query
def train_facts(spark, sf):
    """A trained, saved and loaded model: its data, and whether its threshold and scores hold."""
    table = _table(spark, sf)
    trained = models.train(table, "ngrams", s=models.Settings())
    folder = scratch_path(spark, "model")
    loaded = persist.load(spark, persist.save(spark, trained, folder))
    a, b = (d.score(table).select("url_id", F.col("p").alias(n)) for d, n in ((trained, "a"), (loaded, "b")))
    same = a.join(b, "url_id").agg(F.expr("bool_and(a = b)").alias("same_scores"), F.expr(f"bool_and(a BETWEEN 0 AND 1) AND {loaded.threshold} BETWEEN 0.5 AND 1").alias("in_range"))
    at = loaded.meta["cv_by_site"]["at_threshold"]["false_positive_rate"] <= loaded.meta["target_fpr"]
    facts = {k: int(v) for k, v in loaded.meta["data"].items()}
    return same.select(F.lit(loaded.kind).alias("model"), *[F.lit(v).cast("bigint").alias(k) for k, v in sorted(facts.items())], F.lit(at).alias("target_met"), "same_scores", "in_range")


@query
def model_comparison(spark, sf):
    """E8."""
    return models.compare(_table(spark, sf), s=models.Settings()).drop("seconds")


@query
def train_save_load(spark, sf):
    """Train, save with manifest, load, describe."""
    detector = models.train(_table(spark, sf), "combined", s=models.Settings())
    folder = scratch_path(spark, "model")
    persist.save(spark, detector, folder)
    return models.info(spark, persist.load(spark, folder)).drop("created")


@query
def check_with_model(spark, sf):
    """C2-C4 with a fitted detector."""
    detector = models.build("v1", _table(spark, sf), models.Settings())
    return checking.check(corpus(spark, sf), detector, 0.6, keep=("url_id",)).select("url_id", "verdict", "probability", "site")


@query
def out_of_time(spark, sf):
    """Three models on the click log and the page list; the n-gram model is a part of the combined one."""
    table = _table(spark, sf)
    with ThreadPoolExecutor(2) as pool:  # the three learners are fitted side by side
        detectors = dict(zip(("v1", "combined"), pool.map(lambda kind: models.build(kind, table, models.Settings()), ("v1", "combined")), strict=True))
    detectors["ngrams"] = models.Detector("ngrams", {"ngrams": detectors["combined"].parts["ngrams"]})
    clicks = load(spark, sf, "clicks").selectExpr("'clicks' AS source", "url")
    pages = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("'pages' AS source", "url")
    return models.out_of_time(detectors, clicks.unionByName(pages))


@query
def perm_importance(spark, sf):
    """M12, W6."""
    table = folds.holdout_by_site(_table(spark, sf))
    model = models.fit_part("features", table.where("NOT is_test"), models.Settings())
    return importance.permutation_importance(model, table.where("is_test")).limit(12)


# ---- streams ----------------------------------------------------------------------------------------


def _page_stream(spark, sf):
    schema = "page_id bigint, url string"
    return spark.readStream.schema(schema).parquet(f"{sf}/pages.parq*").selectExpr("page_id AS url_id", "concat(url, IF(page_id % 5 = 0, '&login=paypal', '')) AS url")


@query
def stream_check(spark, sf):
    """ST1: the page table as a stream of URLs, results read back."""
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    streaming.start_scoring(_page_stream(spark, sf), out, state, keep=("url_id",)).awaitTermination()
    back = spark.read.parquet(out)
    return back.selectExpr("url_id", "verdict", "site", f"{findings_text('lookalike')} AS findings")


@query
def stream_distinct(spark, sf):
    """ST2: repeated sites of the event-timed page stream are dropped within the watermark."""
    events = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint").parquet(f"{sf}/events.parq*")
    urls = events.selectExpr("ts", "concat('https://site', user_id % 50, '.example.org/') AS url")
    out, state = scratch_path(spark, "distinct"), scratch_path(spark, "distinct-state")
    kept = streaming.distinct_urls(urls, delay="3650 days").select("url")
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("url string").parquet(out)


@query
def stream_windows(spark, sf):
    """ST1, ST2: verdicts of the click log per day of event time, in several micro-batches; days close behind a watermark."""
    clicks = stable(load(spark, sf, "clicks").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "url"), "click-log")
    edges = [r[0] for r in clicks.selectExpr("explode(percentile_approx(unix_micros(ts), array(0.25D, 0.5D, 0.75D))) AS e").orderBy("e").collect()]
    log, out, state = (scratch_path(spark, n) for n in ("clicks", "windows", "windows-state"))
    # each part of the log arrives as many files and is a micro-batch of its own, however many tasks read it
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = clicks.where(f"unix_micros(ts) >= {low}") if low is not None else clicks
        part = part.where(f"unix_micros(ts) < {high}") if high is not None else part
        part.repartition(max(1, -(-part.count() // LOG_FILE_ROWS))).write.mode("append").parquet(log)
        stream = spark.readStream.schema("ts timestamp, url string").parquet(log)
        streaming.start_counts(streaming.verdict_counts(stream), out, state).awaitTermination()
    back = spark.read.schema("start timestamp, end timestamp, verdict string, urls bigint").parquet(out)
    return back.selectExpr("date_format(start, 'yyyy-MM-dd') AS day", "verdict", "urls")


@query
def stream_with_model(spark, sf):
    """ST1, C3: a fitted model scores a stream as it scores the stored table."""
    detector = models.build("v1", _table(spark, sf), models.Settings(trees=20, forest_depth=8))
    out, state = scratch_path(spark, "scored"), scratch_path(spark, "scored-state")
    streaming.start_scoring(_page_stream(spark, sf), out, state, detector, 0.6, keep=("url_id",)).awaitTermination()
    stored = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id AS url_id", "concat(url, IF(page_id % 5 = 0, '&login=paypal', '')) AS url")
    batch = checking.check(stored, detector, 0.6, keep=("url_id",)).selectExpr("url_id", "probability AS b", "verdict AS bv")
    both = spark.read.parquet(out).join(batch, "url_id", "full")
    return both.selectExpr("url_id", "coalesce(probability = b AND verdict = bv AND probability BETWEEN 0 AND 1, false) AS same")


@query
def stream_requests(spark, sf):
    """ST1, ST3: JSON requests as a stream; accepted URLs are checked, others counted as rejected."""
    bodies = scratch_path(spark, "requests")
    _requests(spark, sf).write.json(bodies)
    stream = spark.readStream.schema("request_id bigint, body string").json(bodies)
    out, bad, state = (scratch_path(spark, n) for n in ("checked", "rejected", "requests-state"))
    streaming.start_requests(stream, out, bad, state).awaitTermination()
    checked = spark.read.parquet(out).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    rejected = spark.read.parquet(bad).agg(F.count(F.lit(1)).alias("n")).selectExpr("'rejected' AS verdict", "n")
    return checked.unionByName(rejected)


@query
def parts_packed(spark, sf):
    """P1-P11 as one struct, read back by field."""
    return parsed(spark, sf).select("url_id", parts_struct()).selectExpr("url_id", "parts.host AS host", "parts.registered AS registered", "parts.is_ip AS is_ip")


@query
def big_log_findings(spark, sf):
    """Whole line-item URL log: findings by technique."""
    rows = with_findings(load(spark, sf, "url_big"))
    return rows.selectExpr("inline(lookalike)").groupBy("technique", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def big_log_verdicts(spark, sf):
    """Whole line-item URL log: verdicts per class of site."""
    rows = checking.check(load(spark, sf, "url_big"), keep=("url_id",), per_host=True)
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("urls"), F.count_distinct("site").alias("sites"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts_by_site(spark, sf)


