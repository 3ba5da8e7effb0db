"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the
threads. Every query is evaluated whole, into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tenantlake.plans.catalog import all_queries  # noqa: E402
from tenantlake.session import build_session  # noqa: E402
from tenantlake.streaming.logins import STATE_STORE  # noqa: E402

HEADLINE = (
    "r3_company_summary", "r4_profiles", "r6_invites_of_every_company",
    "r7_resolve_invite_tokens", "r8_team_audit_of_one_company",
    "r8_team_audit_of_every_company", "r14_live_sessions", "r15_admin_audit",
    "i3_scoped_results", "i4_ownership", "p2_evidence_grants", "p3_denied_attempts",
    "f5_password_findings", "f7_credential_findings", "c3_append_log",
    "c4_contract_company_user", "c5_orphan_sessions", "c9_upsert",
    "m1_company_signup_users", "m3_account_status_sessions", "m5_company_status_sessions",
    "m6_m9_member_changes_verdicts", "m10_send_invites_invites", "m13_accept_invites_users",
    "m15_password_change_sessions", "m16_purge_sessions", "l1_l4_login_verdicts",
    "l1_sliced_hot_accounts", "l2_login_accounts", "l3_company_gate_log_rows",
    "l5_stream_verdicts",
)


def skewed_fold(spark, folder: str):
    """The login fold with a third of all attempts on one account."""
    from pyspark.sql import functions as F

    from tenantlake.operators import lockout
    from tenantlake.sources.adapters import Adapters

    tables = Adapters(spark, folder)
    hot = tables["app_user"].agg(F.min("user_id")).first()[0]
    attempts = tables["attempts"].withColumn("user_id", F.when(
        F.col("attempt_id") % 3 == 0, F.lit(hot)).otherwise(F.col("user_id")))
    return lockout.login_verdicts(lockout.fold_logins(tables["app_user"], attempts))


def run(spark, query, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    state = {k.replace(".", "__"): v for k, v in STATE_STORE.items()}
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
                          spark__ui__enabled="false", **state)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    run(spark, queries["r3_company_summary"], folder)
    seconds = {name: round(run(spark, queries[name], folder), 3) for name in HEADLINE}
    seconds["l1_skewed_account"] = round(run(spark, skewed_fold, folder), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
