"""What the executed plans must look like to hold up on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from panewise.operators import count_window as windows
from panewise.operators import counter, histogram, throughput
from panewise.operators.running import number_all_rows, rows_at
from panewise.plans.registry import documents, event_stream, table, tokenize


@pytest.fixture(scope="module")
def events(spark, sf_small):
    return table(spark, sf_small, "events")


def executed(df):
    """The plan that ran, with the parts that were only planned cut off."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"\+- == Initial Plan ==(.*\n)*", "", plan)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan):
    return re.findall(r"FileScan parquet \[([^\]]*)\]", re.sub(r"#\d+L?", "", plan))


def test_no_hot_key_means_one_shuffle_of_the_needed_columns(events):
    plan = executed(counter.running_counter(events, "user_id", "event_id", "event_type"))
    assert scans(plan) == ["event_id,user_id,event_type"]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan


def test_hot_keys_are_broadcast_and_cut(events):
    df = counter.running_counter(events, "event_type", "event_id", "value", hot_rows=50)
    plan = executed(df)
    # Hot keys, chunk totals, rows: each read once at most, the levels above reuse the totals.
    assert len(scans(plan)) <= 3
    assert re.search(r"Window .*event_type#\d+, __chunk2#\d+L", plan)
    assert "SortMergeJoin" not in plan


def test_long_panes_are_seen_through_a_frame(events):
    df = windows.count_window(events, ["event_type"], "event_id", 1000, 1, [F.avg("value").alias("v")])
    plan = planned(df)
    assert "sequence(" not in plan and "Window" in plan
    short = planned(windows.count_window(events, ["event_type"], "event_id", 10, 1, [F.avg("value").alias("v")]))
    assert "sequence(" in short


def test_counts_of_words_are_shuffled_once(spark, sf_small):
    words = tokenize(documents(spark, sf_small, "text"), "text")
    plan = executed(windows.count_window_counts(words, ["word"], 10, 3))
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan)) - plan.count("ReusedExchange") <= 1


def test_whole_table_order_reads_the_order_column_once_more(events):
    plan = executed(number_all_rows(events.select("event_id", "value"), "event_id"))
    assert sorted(scans(plan)) == ["event_id", "event_id,value"]
    # The only single partition is that of the totals of totals.
    assert plan.count("SinglePartition") == 1


def test_rows_at_shuffles_no_rows_but_those_of_two_chunks(events):
    plan = executed(rows_at(events.select("event_id", "ts"), "event_id", [10, 900]))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_counts_are_combined_before_the_shuffle(events):
    plan = planned(windows.count_window_counts(events, ["user_id"], 10, 3))
    assert "partial_count" in plan
    assert set(scans(plan)) == {"user_id"}


def test_a_key_asked_for_reaches_the_scan(events):
    plan = planned(windows.count_window_counts(events, ["user_id"], 10, 3).where("user_id = 7"))
    assert "EqualTo(user_id,7)" in plan


def test_a_word_asked_for_is_filtered_before_it_is_counted(spark, sf_small):
    words = tokenize(documents(spark, sf_small, "text"), "text")
    plan = planned(windows.count_window_counts(words, ["word"], 10, 3).where("word = 'the'"))
    assert plan.index("partial_count") < plan.index("= the)")


def test_window_aggregates_read_only_their_columns(events):
    aggs = [F.sum("value").alias("v")]
    plan = planned(windows.count_window(events, ["user_id"], "event_id", 10, 3, aggs))
    assert "props" not in " ".join(scans(plan))
    assert "partial_sum" in plan


def test_top_words_are_limited_before_the_shuffle(events):
    panes = histogram.stream_histogram(events, "event_type", "event_id", 100, 50)
    plan = planned(histogram.top_words(panes, "event_type", 2))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sessions_are_merged_from_buckets(events):
    plan = planned(throughput.until_idle(events, "ts", 1000))
    assert plan.index("MergingSessions") < plan.rindex("partial_count")
    assert set(scans(plan)) == {"ts"}


def test_no_cross_or_loop_join_anywhere(spark, sf_small):
    from panewise.plans.registry import QUERIES

    for name, query in QUERIES.items():
        if not name.startswith("stream_"):
            plan = planned(query.run(spark, sf_small))
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_event_stream_is_a_stream(spark, sf_small):
    assert event_stream(spark, sf_small).isStreaming
