"""Benchmark: the end-to-end basket pipeline on the stand-in tables.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries": {stage: sec}, "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    from pyspark.sql import functions as F

    from trolley.operators.fm import FMParams
    from trolley.plans import jobs
    from trolley.session import build_session
    from trolley.sources.baskets import stand_in_items

    spark = build_session(f"local[{cpus}]", "trolley-bench", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "16g"})
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    items = stand_in_items(spark, sf_dir)
    enc = timed("fit_encoders", lambda: jobs.fit_encoders(items))
    lab = timed("labelled_instances", lambda: jobs.instances_job(items, enc))
    feats = timed("basket_features", lambda: jobs.challenge_features_job(items, enc))
    hp = FMParams(k=20, task=1, iterations=2, step=0.1, reg=(0.0, 0.0, 0.05), init_std=0.01, seed=3)
    params, meta, _ = timed("train_local_sgd", lambda: jobs.train_job(lab, enc.num_features, hp, "local_sgd"))
    timed("train_batch", lambda: jobs.train_job(lab, enc.num_features, hp, "batch"))

    def evaluate():
        from trolley.operators.evaluate import curve_areas
        from trolley.operators.fm import fm_score
        test = lab.instances.where(F.col("split") == "test")
        scored = fm_score(test.select("instance_id", "label"), lab.features, params, meta)
        return [curve_areas(scored, "prediction", "label", t).first() for t in (None, 0.5)]

    areas = [{c: r[c] for c in ("area_under_roc", "area_under_pr")} for r in timed("evaluate", evaluate)]
    baskets = feats.select("pid").distinct().count()

    from trolley.operators.recommend import recommend_lists, submission_lines
    from trolley.session import materialize

    parts: dict[str, float] = {}

    def lists():
        t0 = time.time()
        top = materialize(recommend_lists(feats, params, meta, enc.item_dict, enc.n_items, k=500))
        parts["lists"] = round(time.time() - t0, 3)
        t0 = time.time()
        out = submission_lines(top).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars")).first()
        parts["lines"] = round(time.time() - t0, 3)
        return top, out

    top, got = timed("recommend_top500", lists)
    scored = top.agg(F.sum("scored")).first()[0]
    assert got["n"] == baskets and got["chars"] > 100 * baskets, (got, baskets)
    per_pass = {k: round(times[k] / hp.iterations, 3) for k in ("train_local_sgd", "train_batch")}

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "pipeline_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "rows": {"baskets": baskets, "lines": got["n"], "chars": got["chars"]}, "areas_raw_and_at_0.5": areas,
                      "seconds_per_pass_k20": per_pass, "recommend_parts": parts,
                      "share_of_candidates_skipped": round(1 - scored / (baskets * enc.n_items), 4)}))
    spark.stop()


if __name__ == "__main__":
    main()
