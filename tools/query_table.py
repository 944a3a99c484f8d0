"""Write docs/QUERIES.md: every registered query, its SURVEY section 2 IDs,
and whether it has a DuckDB oracle."""

from __future__ import annotations

import sys

sys.path.insert(0, ".")

IDS = {
    "clean_sales": "S1, P1, P3, U2", "clean_impact": "G1, G4", "quality_counts": "G3", "overview": "G2",
    "year_distribution": "G11, W5", "sample_10pct": "P4, P5, X13", "null_overview": "G12",
    "date_diff_count": "G13, P6, J3", "date_gap_stats": "G14, X9", "date_gap_top20": "G15, J3, K1",
    "date_gap_examples": "K5, P6", "null_by_year": "G16, P7", "date_summary": "G12, G13, G14",
    "daily_series": "G8, N1, N3", "daily_capped": "G22, X11", "top_days": "K6", "describe_daily": "G21",
    "describe_sales": "G21 (exact distributed quantiles)", "monthly_totals": "G9", "weekday_totals": "G9, X2",
    "top_articles": "K2, X13", "top_families": "K2", "mart_daily": "G5", "mart_country_daily": "G6, G23",
    "mart_weekly": "G7, X3", "mart_daily_by_year": "S4, K9", "calendar_features": "X1-X5",
    "encode_codes": "X10", "valid_families": "P8, X15", "calendar_fill": "J4, X16",
    "lag_features_store": "W1, W2, P12", "lag_features_daily": "W1, W3, J4, P12",
    "weekly_features_v1": "W1, W3, X6, P13", "weekly_features_v2": "W1, W3, W6, X6, X7, P12",
    "dominant_colour": "G24, W4, P2", "features_joined": "J1, G24, W1, W2", "distinct_counts": "G23",
    "feature_summary": "S9", "family_means": "G10", "schema_lookup": "S7", "table_check": "S8",
    "profile_numeric": "G17, N10", "profile_dates": "G18", "profile_text": "G19", "profile_dims": "G20, X22, K8",
    "profile_remarks": "G26, X18-X21", "top_values": "K8", "profile_summary": "G25", "profile_nulls": "G25", "profile_nulls_sales": "G25",
    "profile_median": "G17 (median)", "high_volume_filter": "C1, J2, P11", "top10_then_min": "K3, J2, P9",
    "min_then_top10": "P9, K3", "country_min_then_top": "P10, P9, K3", "split_counts": "P14",
    "group_guard": "P15", "value_counts_top": "K4", "naive_predict": "M8, X12", "metrics_overall": "E1-E6",
    "metrics_by_family": "E7", "metrics_macro": "E4, E8", "model_rank": "K7, E9", "scaler_stats": "M1",
    "ridge_global": "M1, M2, M10, M15", "ridge_per_family": "M4, P15, M15", "ridge_vs_baseline": "E7, E10",
    "gbt_global": "M5", "gbt_per_family": "M6, P15", "gbt_store_daily": "M5 (V2 order)",
    "gbt_country_daily": "M6 (V5), E4, E8", "random_forest": "M7", "seasonal_trend": "M9", "seasonal_optimality": "M9, P15",
    "boost_root_splits": "M6 (V6), P15", "boost_root_splits_top": "M6 (V3), P15",
    "gbt_top_families": "M6 (V3), M10", "gbt_top_families_country": "M6 (V4), M10",
    "feature_importance": "M11", "model_comparison": "E9, K7, M3, M7, M8", "model_save_load": "M12",
    "score_requests": "M13, J5, X8", "score_rejects": "M13, J5", "score_stream": "M13 (streaming)",
    "model_status": "M14", "ridge_optimality": "M1, M2, M10", "ridge_family_optimality": "M4, P15",
    "score_fixed_model": "M13, J5, X8",
    "lag_features_by_day": "W1, W3 (by date)", "lag_features_by_week": "W1, W2 (by date)", "csv_roundtrip": "S3, S5, X17",
    "csv_rejects": "S3, X17", "published_versions": "S4", "model_registry": "M12, M14", "predictions_wide": "E9",
    "model_ranking": "E9, K7", "best_model_by_family": "K7, E7", "feature_value_counts": "S9, K4",
}


def main():
    from tillcast.plans import load_all
    from tillcast.plans.catalog import ORACLES as orc, QUERIES as qs
    load_all()
    lines = ["# Registered queries", "",
             "Every query of the sales part, the SURVEY section 2 operators it exercises,",
             "and whether `oracle_sql()` has a DuckDB twin (otherwise the driver checks row counts only).",
             "", "| query | operators | oracle |", "|---|---|---|"]
    for name in qs:
        lines.append(f"| {name} | {IDS.get(name, '')} | {'yes' if name in orc else 'rows only'} |")
    missing = [n for n in qs if n not in IDS]
    if missing:
        raise SystemExit(f"no IDs for {missing}")
    open("docs/QUERIES.md", "w").write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
