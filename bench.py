"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (comma-separated names).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lurescan.plans import models  # noqa: E402
from lurescan.session import session  # noqa: E402
from registry.queries import QUERIES  # noqa: E402

HEADLINE = (
    "verdicts_by_site parse_parts signals look_best_per_brand look_by_keys feat_matrix feat_similarity_clicks big_log_findings "
    "big_log_verdicts gen_lookalikes ngram_vocab ngram_tfidf roc_auc threshold_fpr threshold_sweep folds_stratified "
    "site_mode_label severity_crosstab stream_check"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = session(f"local[{cpus}]", "bench", partitions=int(cpus), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, job):
        if only and name not in only:
            return None
        start = time.time()
        out = job()
        times[name] = round(time.time() - start, 2)
        return out

    QUERIES["class_balance"](spark, sf).collect()  # start the workers
    for name in HEADLINE:
        timed(name, lambda n=name: QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save())
    if not only or any(n.startswith(("cv_", "prepare")) for n in only):
        from registry.queries import corpus

        start = time.time()
        table = models.prepare(corpus(spark, sf))
        table.count()
        times["prepare"] = round(time.time() - start, 2)
        # five folds by site at the published settings
        s = models.Settings()
        for kind in ("v1", "features", "ngrams"):
            timed(f"cv_{kind}_by_site", lambda k=kind: models.cross_validate(table, k, 5, True, s)[0].count())
    spark.stop()
    print(json.dumps({"metric": "total", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
