"""Plans: tests reach the file scan, unused columns are not read, narrow operators do not shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from huntline.operators import rules as K
from huntline.operators.asof import asof_join
from huntline.operators.rules import Rule
from huntline.plans.rules import RULES
from huntline.sources.events import scan_events
from huntline.sources.tables import telemetry


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "t")
    telemetry(spark, small).write.parquet(path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushes_filters_and_prunes_columns(spark, stored):
    text = plan(scan_events(spark, stored, ["CreateFile", "Connect"], ["file"]).select("seq"))
    assert "In(name, [Connect,CreateFile])" in text.replace("CreateFile,Connect", "Connect,CreateFile")
    assert "EqualTo(category,file)" in text or "In(category" in text
    schema = text[text.index("ReadSchema"):]
    assert "params" not in schema and "seq" in schema


def test_rules_are_matched_without_a_shuffle(spark, stored):
    events = spark.read.parquet(stored)
    text = plan(K.match_rules(events, RULES).select("seq", "rule_id"))
    assert "Exchange" not in text and "Python" not in text and "PushedFilters: [Or(" in text


def test_unscoped_rules_match_nothing(spark, stored):
    rule = Rule("x", "no scope", lambda d: F.lit(True))
    assert K.match_rules(spark.read.parquet(stored), [rule, RULES[0]]).where("rule_id = 'x'").isEmpty()


def test_asof_has_one_exchange_per_lookup(spark, stored):
    events = spark.read.parquet(stored).select("seq", "pid", "ts", "event_type")
    states = events.where("event_type = 'signup'").withColumn("sid", F.col("seq"))
    text = plan(asof_join(events, states, ["pid"], "ts", ["sid"], tie="sid"))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_sequence_steps_reach_the_scan(spark, stored):
    from huntline.operators.sequences import tag_rows
    from huntline.plans.sequences import TWO
    text = plan(tag_rows(spark.read.parquet(stored), [TWO], "ts", "seq", []))
    pushed = text[text.index("PushedFilters"):]
    assert "event_type" in pushed[:pushed.index("ReadSchema")]
