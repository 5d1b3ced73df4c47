"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from phrasemill.operators import scoring
from phrasemill.plans import catalog
from phrasemill.session import session

HEADLINE = (
    "run_metrics", "score_filtered_prmu", "score_token_window", "score_skipped_docs", "prmu_classes", "language_vote", "tokens_with_sentinels",
    "coverage_majority_split", "run_tags", "cost_resolution", "quality_flag_delta", "wilcoxon_w", "friedman_chi2", "rq1_pearson_matrix", "rq3_window_pairs",
)


RUNS, DOCUMENTS = 22, 20_000


def stored_matches(spark: SparkSession) -> DataFrame:
    """Matches of 22 runs on 20,000 documents of five gold phrases, held in memory: what a warm store scores."""
    rows = spark.range(RUNS * DOCUMENTS).selectExpr(
        "'d' AS dataset", f"concat('m', id div {DOCUMENTS}) AS model", "'a' AS arch", f"concat('r', id div {DOCUMENTS}) AS run_id", f"id % {DOCUMENTS} AS doc_id", "'author' AS ann_key", "10 AS n_uniq", "5 AS n_gold",
        "transform(filter(sequence(0, 9), r -> (id * 7 + r * 13) % 5 = 0), (r, i) -> named_struct('rank', r, 'gold', int((id + i) % 5))) AS hits",
        f"transform(sequence(0, 4), g -> named_struct('prmu', array('P', 'R', 'M', 'U')[int((id % {DOCUMENTS} + g) % 4)], 'end_char', g, 'tok_end', g * 40)) AS of",
    ).cache()
    rows.count()
    return rows


def timed(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = catalog.queries(), {}
    known["run_metrics"](spark, sf).count()  # starts Python workers and compiles
    for name in HEADLINE:
        seconds[name] = timed(known[name](spark, sf))
    total = round(sum(seconds.values()), 3)
    matches = stored_matches(spark)
    warm = {}
    for _ in range(2):  # the second time counts: code is compiled
        warm["macro means"] = timed(scoring.run_metrics(matches))
        warm["macro means, absent gold only"] = timed(scoring.run_metrics(matches, allowed=scoring.allowed_of("of", ["R", "M", "U"])))
        warm["per document, token window"] = timed(scoring.per_document(matches, ["10"], allowed=scoring.allowed_of("of", token_limit=128)))
    rate = {k: round(RUNS * DOCUMENTS / s) for k, s in warm.items()}
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": sf.rstrip("/").rsplit("/", 1)[-1], "stored 440,000 matches, sec": warm, "matches a second": rate}))
    spark.stop()


if __name__ == "__main__":
    main()
