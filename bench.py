"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from allelic import session, synth  # noqa: E402
from allelic.plans import pick, predict  # noqa: E402
from allelic.queries import BIN, QUERIES  # noqa: E402

HEADLINE = ["J1_interval_join", "C1_C2_C11_C12_snv_consequence", "C3_to_C9_C13_C14_F22_to_F26_complex", "A2_A3_pick_best", "A2_gene_consequence_counts", "J2_genomic_index_join", "J3_hotspots", "J4_cancer_genes", "D3_D5_D8_consequence_category", "A6_all_effects", "R5_R6_genomic_notation"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config(map=session.SETTINGS).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    # warm session, model built: what the published throughput figures also leave out
    t = synth.transcripts(spark, sf_dir).drop("k", "n").cache()
    t.count()
    v = synth.variants(spark, sf_dir).select("record_id", "chrom", "pos", "ref", "alt").cache()
    n = v.count()
    run(predict.annotate(v.limit(1000), t, width=BIN))
    for name, f in {"annotate_all": lambda: predict.annotate(v, t, width=BIN), "annotate_and_pick": lambda: pick.pick_best(predict.annotate(v, t, width=BIN), ["record_id"])}.items():
        began = time.time()
        run(f())
        times[name] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "variants": n, "variants_per_second": round(n / times["annotate_all"])}))


if __name__ == "__main__":
    main()
