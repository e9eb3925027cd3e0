"""Tables of versions: whole commits or none, and late days through a stream."""

from __future__ import annotations

import datetime
import glob
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from searchlift.operators import loading
from searchlift.sources.versions import CommitRefused, TableSet, VersionedTable
from searchlift.streaming import late

SCHEMA = "metric_date date, clicks double"


def day(i):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=i)


def rows_of(table, **options):
    return sorted((r.metric_date, r.clicks) for r in table.read(**options).collect())


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/facts")
    t.commit(spark.createDataFrame([(day(i), float(i)) for i in range(4)], SCHEMA))
    return t


def test_a_load_replaces_its_range_and_nothing_else(spark, table):
    assert loading.load_days(spark.createDataFrame([(day(1), 10.0), (day(1), 11.0), (day(9), 1.0), (None, 2.0)], SCHEMA), table, str(day(1)), str(day(2))) == 2
    assert rows_of(table) == [(day(0), 0.0), (day(1), 10.0), (day(1), 11.0), (day(3), 3.0)]
    assert rows_of(table, version=1) == [(day(i), float(i)) for i in range(4)]
    assert rows_of(table, first=str(day(1)), last=str(day(2))) == [(day(1), 10.0), (day(1), 11.0)]
    assert table.drop_unused(keep=[1]) == 0 and table.drop_unused() == 0  # days 0 and 3 are still in the first folder
    table.commit(spark.createDataFrame([(day(i), 5.0) for i in range(4)], SCHEMA))
    assert table.drop_unused() == 2 and rows_of(table) == [(day(i), 5.0) for i in range(4)]


def test_a_refused_load_leaves_the_version_before(spark, table):
    new, before = spark.createDataFrame([(day(1), 10.0), (day(1), 11.0)], SCHEMA), rows_of(table)
    with pytest.raises(CommitRefused, match="cap"):
        loading.load_days(new, table, str(day(1)), str(day(1)), cap=1)
    with pytest.raises(CommitRefused, match="lease"):
        loading.load_days(new, table, str(day(1)), str(day(1)), held=lambda: False)
    assert rows_of(table) == before and table.manifest().version == 1


def test_a_load_that_dies_half_way_leaves_the_version_before(spark, table):
    before = rows_of(table)
    broken = spark.range(8).select(F.lit(day(1)).alias("metric_date"), F.when(F.col("id") == 7, F.raise_error(F.lit("killed")).cast("double")).otherwise(1.0).alias("clicks")).repartition(4)
    with pytest.raises(Exception, match="killed"):
        table.commit(broken)

    def dies():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        table.commit(spark.createDataFrame([(day(1), 10.0)], SCHEMA), held=dies)
    assert rows_of(table) == before and table.drop_unused() >= 1 and rows_of(table) == before


def test_of_two_loads_from_one_version_the_second_is_refused(spark, table):
    seen = table.manifest()
    table.commit(spark.createDataFrame([(day(1), 10.0)], SCHEMA), based_on=seen)
    with pytest.raises(CommitRefused, match="another load"):
        table.commit(spark.createDataFrame([(day(2), 20.0)], SCHEMA), based_on=seen)
    assert rows_of(table) == [(day(0), 0.0), (day(1), 10.0), (day(2), 2.0), (day(3), 3.0)]


LOADS = [[(day(i), float(100 + 10 * i + j), 1) for i in range(3) for j in range(3)], [(day(1), 7.0, 3), (day(1), 8.0, 3), (day(5), 9.0, 3)], [(day(1), 1.0, 2), (day(2), 2.0, 2)]]
WANT = sorted([(day(0), float(100 + j)) for j in range(3)] + [(day(1), 7.0), (day(1), 8.0), (day(2), 2.0), (day(5), 9.0)])


def arrive(spark, root, loads, files):
    for rows in loads:
        spark.createDataFrame(rows, SCHEMA + ", load int").repartition(files).write.mode("append").parquet(f"{root}/arrivals")


def follow(spark, root, files_per_batch):
    table = VersionedTable(spark, f"{root}/facts")
    late.follow(spark.readStream.schema(SCHEMA + ", load int").option("maxFilesPerTrigger", files_per_batch).parquet(f"{root}/arrivals"), table, f"{root}/checkpoint")
    return table


@pytest.mark.parametrize(("files", "files_per_batch"), [(1, 1), (2, 1), (3, 2), (1, 100)])
def test_late_days_do_not_depend_on_the_batches(spark, tmp_path, files, files_per_batch):
    root = f"file://{tmp_path}"
    arrive(spark, root, LOADS, files)
    table = follow(spark, root, files_per_batch)
    assert rows_of(table) == WANT
    version = table.manifest().version
    assert rows_of(follow(spark, root, files_per_batch)) == WANT and table.manifest().version == version


def test_a_restart_commits_nothing_twice(spark, tmp_path):
    """The stream forgets that its last batch was done, as if it had died between commit and checkpoint."""
    root = f"file://{tmp_path}"
    arrive(spark, root, LOADS[:1], 1)
    follow(spark, root, 1)
    arrive(spark, root, LOADS[1:], 1)
    table = follow(spark, root, 1)
    version = table.manifest().version
    last = max(int(p.rsplit("/", 1)[1]) for p in glob.glob(f"{tmp_path}/checkpoint/commits/[0-9]*"))
    for p in glob.glob(f"{tmp_path}/checkpoint/commits/*{last}*") + glob.glob(f"{tmp_path}/checkpoint/commits/.{last}*"):
        shutil.os.remove(p)
    assert rows_of(follow(spark, root, 1)) == WANT and table.manifest().version == version


def test_an_empty_table_of_days(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="no version"):
        table.read()
    table.commit(spark.createDataFrame([], SCHEMA))
    assert table.read().count() == 0 and table.read().columns == ["metric_date", "clicks"]


def test_days_of_a_paged_source(spark):
    """An exactly full day is told from a cut one by its probe alone."""
    rows = lambda n: [(float(i),) for i in range(n)]
    captures = [
        (day(0), 0, 3, rows(3)), (day(0), 3, 3, rows(3)), (day(0), 6, 1, []),
        (day(1), 0, 3, rows(3)), (day(1), 3, 3, rows(3)), (day(1), 6, 1, rows(1)),
        (day(2), 0, 3, rows(3)), (day(2), 3, 3, rows(1)),
        (day(3), 0, 3, rows(3)),
        (day(4), 0, 3, rows(3)), (day(4), 6, 3, rows(2)),
        (day(5), 0, 3, []),
        (day(6), 3, 3, rows(3)),
        (day(7), 0, 3, None),
        (day(8), 0, 3, rows(2)), (day(8), 0, 3, rows(2)),
    ]
    states, whole = loading.assembled(spark.createDataFrame(captures, "metric_date date, start_row int, requested int, rows array<struct<clicks: double>>"), cap=6)
    assert {(r.metric_date - day(0)).days: (r.rows, r.state) for r in states.collect()} == {0: (6, "whole"), 1: (6, "cut"), 2: (4, "whole"), 3: (3, "open"), 4: (5, "gap"), 5: (0, "whole"), 6: (3, "gap"), 7: (0, "whole"), 8: (2, "whole")}
    assert Counter((r.metric_date - day(0)).days for r in whole.collect()) == {0: 6, 2: 4, 8: 2}


def test_a_run_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    tables = TableSet(spark, f"file://{tmp_path}/run")
    first = tables.begin()
    made = first.add("a", spark.range(3))
    first.add("b", made.where("id > 0"))
    assert tables.version == 0 and first.commit() == 1 and tables.read("b").count() == 2
    second, third = tables.begin(), tables.begin()
    second.add("a", spark.range(5))
    third.add("a", spark.range(7))
    assert tables.read("a").count() == 3
    second.commit()
    with pytest.raises(CommitRefused):
        third.commit()
    assert tables.read("a").count() == 5 and tables.read("a", version=1).count() == 3 and tables.version == 2


def test_the_outputs_of_a_site_run_are_those_of_the_single_queries(spark, tmp_path):
    from searchlift.plans import catalog, site_run

    sf = "/root/testdata/sf0.001"
    out = site_run.run(spark, sf, f"file://{tmp_path}/run")
    rows = lambda df: sorted((tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect()))
    for table, query in (("topics", "page_topics"), ("clusters", "topic_clusters"), ("recommendations", "link_recommendations"), ("graph", "semantic_graph"), ("actions", "content_actions")):
        assert rows(out.read(table)) == rows(catalog.queries()[query](spark, sf)), table
    gain = catalog.queries()["information_gain"](spark, sf).select("page_id", "gain")
    assert rows(out.read("insights").where("gain IS NOT NULL").select("page_id", "gain")) == rows(gain)
    assert set(out._manifest()["tables"]) == set(site_run.OUTPUTS)


def test_a_commit_of_stored_lines_has_no_cap(spark, monkeypatch):
    from searchlift.plans import catalog

    monkeypatch.setattr(loading.load_days, "__defaults__", (5, lambda: True))
    sf = "/root/testdata/sf0.001"
    order = lambda df: sorted(tuple(r) for r in df.select("metric_date", "rows", "clicks", "impressions").collect())
    assert order(catalog.fact_commit(spark, sf)) == order(catalog.fact_load(spark, sf))
