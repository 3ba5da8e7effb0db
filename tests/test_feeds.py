"""Team feeds kept beside the log are those of the whole log after every batch."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from tenantlake.plans import reports
from tenantlake.schemas import APP_USER, USER_LOGIN_LOG
from tenantlake.streaming import feeds
from tests.test_changes import T0, user


def log_of(spark, n):
    rng = random.Random(4)
    events = ["INVITE_ACCEPT", "SIGNUP", "ROLE_CHANGE", "LOGIN_OK", "PW_CHANGE"]
    rows = [(i, rng.choice(["a@d.test"] * 5 + ["b@d.test", "c@d.test", "x@else.test", None]),
             rng.choice(events),
             rng.choice([None, "", "company=C0001 role=admin", "company=C0002",
                         "company=C0001 company=C0002", "company=C00010"]),
             T0 + timedelta(minutes=i)) for i in range(n)]
    return spark.createDataFrame(rows, USER_LOGIN_LOG)


def people(spark, of_a="C0001"):
    return spark.createDataFrame([
        user("a@d.test", of_a), user("b@d.test", "C0001"), user("c@d.test", "C0002"),
        user("nomail", "C0001", email=None)], APP_USER)


def same(a, b):
    columns = sorted(b.columns)
    return (sorted(map(repr, a.select(*columns).collect()))
            == sorted(map(repr, b.select(*columns).collect())))


def test_feeds_equal_the_report_after_every_batch_and_a_repeat(spark, tmp_path):
    log, root = log_of(spark, 200), str(tmp_path / "kept")
    assert feeds.read_kept(spark, root).count() == 0
    for batch, end in enumerate((60, 60, 120, 200)):
        new = log.filter(F.col("log_id").between((0, 60, 60, 120)[batch], end - 1))
        for _ in range(2 if batch == 2 else 1):  # the third batch comes twice
            feeds.keep_feeds(root, every=3, limit=7)(new, batch)
        kept = feeds.read_kept(spark, root, limit=7)
        seen = log.filter(F.col("log_id") < end)
        assert same(feeds.team_feeds(kept, people(spark), 7),
                    reports.team_audit_all(seen, people(spark), 7))
    # An account that changes its company takes its rows along.
    assert same(feeds.team_feeds(kept, people(spark, "C0003"), 7),
                reports.team_audit_all(log, people(spark, "C0003"), 7))
    assert kept.groupBy("owner_kind", "owner").count().agg(F.max("count")).first()[0] == 7
    assert set(p.name for p in (tmp_path / "kept/whole").iterdir()) == {"2"}
