"""Plan properties that the scale design relies on, read from explain()."""

import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_clean_filters_reach_the_scan(spark):
    text = plan(E.queries()["clean_sales"](spark, SF_SMALL))
    scan = [ln for ln in text.splitlines() if ln.startswith("PushedFilters") and "l_quantity" in ln][0]
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThanOrEqual(l_quantity,40.0)" in scan


def test_profile_top_n_is_limited_before_the_shuffle(spark):
    text = plan(E.queries()["top_values"](spark, SF_SMALL))
    tree = text.split("\n\n")[0]
    # a WindowGroupLimit under the Exchange feeding the final window
    lines = tree.splitlines()
    i = max(k for k, ln in enumerate(lines) if "WindowGroupLimit" in ln)
    assert any("Exchange" in ln for ln in lines[:i])


def test_partition_pruning_on_the_year_partitioned_mart(spark):
    text = plan(E.queries()["mart_daily_by_year"](spark, SF_SMALL).filter("year >= 1998"))
    assert any(ln.startswith("PartitionFilters") and ">= 1998" in ln for ln in text.splitlines())


def _outside_broadcasts(tree: str) -> list[str]:
    """Plan lines not under a BroadcastExchange (the small sides)."""
    kept, skip_indent = [], None
    for ln in tree.splitlines():
        indent = len(ln) - len(ln.lstrip(" :|+-"))
        if skip_indent is not None and indent > skip_indent:
            continue
        skip_indent = None
        if "BroadcastExchange" in ln:
            skip_indent = indent
            continue
        kept.append(ln)
    return kept


def test_store_features_window_needs_one_exchange(spark):
    df = E.queries()["features_joined"](spark, SF_SMALL)
    main = _outside_broadcasts(plan(df).split("\n\n")[0])
    assert any("Window" in ln for ln in main)
    assert sum("Exchange" in ln for ln in main) == 1      # the window's, after the materialized mart
    assert not any("SortMergeJoin" in ln for ln in main)


def test_per_family_ridge_python_sees_aggregates_only(spark):
    df = E.queries()["ridge_per_family"](spark, SF_MID)
    tree = plan(df).split("\n\n")[0].splitlines()
    i = next(k for k, ln in enumerate(tree) if "MapInPandas" in ln)
    below = tree[i + 1:i + 4]
    assert any("HashAggregate" in ln or "ObjectHashAggregate" in ln or "SortAggregate" in ln for ln in below)


def test_gap_fill_joins_bounds_only(spark):
    """One window over the mart and a one-row broadcast: no grid join, no second scan of the lines."""
    tree = plan(E.queries()["calendar_fill"](spark, SF_SMALL)).split("\n\n")[0]
    assert "SortMergeJoin" not in tree and "lineitem" not in tree
    assert tree.count("Window") == 1 and "Generate" in tree


def test_null_shares_come_from_one_narrow_aggregate(spark):
    tree = plan(E.queries()["profile_nulls"](spark, SF_SMALL)).split("\n\n")[0]
    scans = [ln for ln in tree.splitlines() if "Scan parquet" in ln]
    assert len(scans) == 1 and tree.count("HashAggregate") == 2


def test_country_mart_joins_stores_to_the_aggregate(spark):
    lines = plan(E.queries()["mart_country_daily"](spark, SF_SMALL)).split("\n\n")[0].splitlines()
    join = next(k for k, ln in enumerate(lines) if "Join" in ln and "LeftSemi" in ln or "Join LeftSemi" in ln)
    scan = next(k for k, ln in enumerate(lines) if k > join and "Scan parquet" in ln)
    assert any("HashAggregate" in ln for ln in lines[join:scan])


def test_requests_are_not_shuffled_to_be_scored(spark):
    tree = plan(E.queries()["score_fixed_model"](spark, SF_SMALL)).split("\n\n")[0]
    tops = tree.splitlines()[:tree.splitlines().index(next(ln for ln in tree.splitlines() if "Union" in ln))]
    assert not any("SortMergeJoin" in ln or "Exchange hash" in ln for ln in tops)
    assert sum("BroadcastHashJoin" in ln for ln in tops) == 1
