"""Tables that are small as files and large as rows: no join of theirs is broadcast, and their work is dealt to many tasks."""

import __spark_entry__ as entry
import pytest

from tallyframe.session import drop_staged

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


WORLDS = ["compatible_worlds", "grid_problems", "certify_bank", "min_requests", "min_requests_initial", "fixed_view_rate"]


@pytest.mark.parametrize("name", WORLDS)
def test_exploded_worlds_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["score_search", "score_search_initial"])
def test_facts_of_worlds_are_not_broadcast(spark, name):
    out = entry.queries()[name](spark, SF)
    assert "BroadcastHashJoin" not in plan(out)
    drop_staged(spark)


@pytest.mark.parametrize("name", ["access_audit", "check_endpoints", "admit", "merge_votes"])
def test_cases_and_votes_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(entry.queries()[name](spark, SF))


def test_cases_are_dealt_to_the_tasks_of_a_shuffle(spark):
    from tallyframe.plans import standins

    assert standins.cases(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_written_assets_lie_in_several_folders(spark):
    files = entry.queries()["hash_assets_written"](spark, SF).inputFiles()
    assert len({f.rsplit("/", 1)[0] for f in files}) > 1
    drop_staged(spark)
