"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose the input
and the local cores. Every query is written in full to the noop sink. Arguments
restrict the run to names that start with them.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = [
    "A2_plan_projection",
    "P6_decide",
    "P7_decide_video",
    "P8_two_tier_deferral",
    "P5_bytes_override_name",
    "S1_listing_json",
    "S7_probe_json",
    "F3_allows",
    "F8_either_path_lookup",
    "F13_gain_gate",
    "J1_sync_reconcile",
    "J3_verify",
    "J4_destination_exists",
    "J6_keyed_update",
    "J11_remux_comparison",
    "A1_counts_by_state",
    "A7_retention_readiness",
    "A8_duplicate_groups",
    "A9_duplicate_totals",
    "A11_score_aggregation",
    "A12_settings_comparison",
    "A17_accounting",
    "A19_ordered_digest",
    "W1_claim_batch",
    "W2_budget_admission",
    "W3_remote_headroom",
    "W5_worker_assignment",
    "W8_first_passing_rung",
    "T4_largest_completed",
    "X5_symmetric_difference",
    "C13_absorb_progress",
    "U5_record_conversion",
    "V1_fingerprint",
    "V2_recompress",
    "V3_verify",
    "V6_swap",
    "V9_payload_trial",
    "M2_running_counts",
    "M3_throttled_progress",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")

    from slimlake.catalog import queries
    from slimlake.session import local_session

    spark = local_session(cores, "slimlake-bench")
    registered = queries()
    wanted = [n for n in HEADLINES if not sys.argv[1:] or n.startswith(tuple(sys.argv[1:]))]
    # The first job pays for starting executors and the Parquet reader.
    registered["A21_file_byte_fold"](spark, folder).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in wanted:
        started = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
