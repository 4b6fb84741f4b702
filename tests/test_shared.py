"""Intermediate tables."""

import os
import threading

import pytest
from asterism import shared
from asterism.jobs.queries import QUERIES


def held(spark):
    root = shared.shared_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(root) if f.startswith("asterism-")}


def test_scratch_leaves_what_is_kept(spark):
    before = held(spark)
    with shared.scratch(spark):
        one = shared.materialise(spark.range(5))
        two = shared.kept(shared.materialise(one.filter("id > 1")))
        shared.discard(shared.materialise(spark.range(3)))
        assert len(held(spark) - before) == 2
    assert len(held(spark) - before) == 1 and two.count() == 3
    shared.discard(two)
    assert held(spark) == before


def test_inner_tables_belong_to_the_scope_around(spark):
    before = held(spark)
    with shared.scratch(spark):
        with shared.scratch(spark):
            one = shared.kept(shared.materialise(spark.range(4)))
            shared.materialise(spark.range(2))
        assert len(held(spark) - before) == 1 and one.count() == 4
    assert held(spark) == before


def test_threads_do_not_see_each_others_tables(spark):
    """One thread writes and reads while another enters and leaves scopes."""
    before, inside, done, failed = held(spark), threading.Event(), threading.Event(), []

    def beside():
        try:
            for _ in range(5):
                with shared.scratch(spark):
                    shared.materialise(spark.range(3)).count()
                    inside.set()
                    done.wait(0.2)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    other = threading.Thread(target=beside)
    other.start()
    inside.wait()
    mine = [shared.materialise(spark.range(k + 1)) for k in range(4)]
    other.join()
    done.set()
    assert not failed and [t.count() for t in mine] == [1, 2, 3, 4]
    assert len(held(spark) - before) == 4
    for t in mine:
        shared.discard(t)
    assert held(spark) == before


@pytest.mark.parametrize("name", ["ridge_residuals", "region_counts", "scan_csv", "scan_whitespace", "chain_write_read", "hexbin_median", "merge_regions"])
def test_queries_leave_the_tables_that_their_result_reads_alone(spark, sf_dir, name):
    before = held(spark)
    found = QUERIES[name](spark, sf_dir)
    reads = {f.rpartition("/")[2] for f in shared._folders(found)}
    assert held(spark) - before <= reads and found.count() > 0


def test_a_table_by_partition_is_one_folder(spark):
    before = held(spark)
    with shared.scratch(spark):
        path = shared.new_path(spark)
        spark.range(4).selectExpr("id", "id % 2 AS part").write.partitionBy("part").parquet(path)
        rows = shared.kept(spark.read.parquet(path))
    assert rows.count() == 4 and len(held(spark) - before) == 1
    shared.discard(rows)
    assert held(spark) == before
