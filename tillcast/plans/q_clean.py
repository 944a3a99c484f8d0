"""Cleaning audit, date comparison suite and EDA queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.operators import clean as C
from tillcast.operators import compare as K
from tillcast.operators import marts as M
from tillcast.operators import outliers as O
from tillcast.plans import params as P
from tillcast.plans.catalog import (CLEAN_WHERE, POSITIVE_WHERE, WITH_CLEAN, WITH_SALES,
                                    clean_frame, register, rounded, sql_pct)
from tillcast.sources.tables import sales
from tillcast.session import materialize

# ------------------------------------------------------------------ cleaning

register("clean_sales", f"""{WITH_CLEAN}
select l_orderkey, l_linenumber, Date, Reception, TypeVente, CodeMag, CodeArticle, Famille,
       ArFamille, ArCouleur, Saison, Pays, round(Prix, 6) as Prix, round(Quantite, 6) as Quantite,
       round(Total, 6) as Total
from clean""")(lambda spark, d: rounded(clean_frame(spark, d)))


@register("clean_impact", f"""{WITH_SALES}
select rows_before, rows_after, rows_before - rows_after as rows_removed,
       {sql_pct('rows_after', 'rows_before')} as pct_kept,
       {sql_pct('rows_before - rows_after', 'rows_before')} as pct_removed,
       n_type, n_date_null, n_date_old, n_prix, n_quantite, null_prix, null_quantite
from (select count(*) as rows_before,
             cif({CLEAN_WHERE}) as rows_after,
             cif(TypeVente != 'VENTE' or TypeVente is null) as n_type,
             cif(Date is null) as n_date_null,
             cif(Date is not null and Date < DATE '{P.MIN_DATE}') as n_date_old,
             cif(Prix < {P.PRIX_RANGE[0]} or Prix > {P.PRIX_RANGE[1]}) as n_prix,
             cif(Quantite < {P.QUANTITE_RANGE[0]} or Quantite > {P.QUANTITE_RANGE[1]}) as n_quantite,
             cif(Prix is null) as null_prix,
             cif(Quantite is null) as null_quantite
      from sales) t""")
def q_clean_impact(spark, d):
    src = sales(spark, d, ["TypeVente", "Date", "Prix", "Quantite"])
    return C.filter_impact(src, **P.clean_bounds())


@register("quality_counts", f"""{WITH_SALES}
select cif(Date is null) as date_null, cif(CodeArticle is null) as article_null,
       cif(Quantite is null) as qte_null, cif(Prix is null) as prix_null,
       cif(Quantite <= 0) as qte_neg_ou_zero, cif(Prix <= 0) as prix_neg_ou_zero,
       count(*) as total
from sales""")
def q_quality_counts(spark, d):
    return C.quality_counts(sales(spark, d, ["Date", "CodeArticle", "Quantite", "Prix"]))


@register("overview", f"""{WITH_SALES}
select count(*) as total_lignes, count(distinct CodeArticle) as nb_articles,
       count(distinct CodeMag) as nb_magasins, min(Date) as premiere_vente, max(Date) as derniere_vente
from sales""")
def q_overview(spark, d):
    return M.overview(sales(spark, d, ["CodeArticle", "CodeMag", "Date"]))


@register("year_distribution", f"""{WITH_CLEAN}
select annee, nb_lignes, {sql_pct('nb_lignes', 'sum(nb_lignes) over ()')} as pourcentage
from (select cast(year(Date) as integer) as annee, count(*) as nb_lignes from clean group by 1) t""")
def q_year_distribution(spark, d):
    return C.year_distribution(clean_frame(spark, d, ["Date"]))


@register("sample_10pct")
def q_sample_10pct(spark, d):
    """P4 + P5: about 10 % of the positive sale rows, drawn by a hash of the
    line identity (stable under retries and repartitioning)."""
    src = sales(spark, d, ["l_orderkey", "l_linenumber", "Date", "CodeMag", "CodeArticle", "Famille",
                          "Saison", "Prix", "Quantite", "Total"])
    pos = C.positive_sales(src)
    smp = C.sample_rows(pos, 0.10, seed=42, keys=["l_orderkey", "l_linenumber", "CodeArticle", "CodeMag"])
    return rounded(smp.withColumn("Revenu", F.col("Prix") * F.col("Quantite")))


# ------------------------------------------------------------------ date comparison

@register("null_overview", f"""{WITH_SALES}
select total_lignes, date_null, {sql_pct('date_null', 'total_lignes')} as pct_date_null,
       reception_null, {sql_pct('reception_null', 'total_lignes')} as pct_reception_null
from (select count(*) as total_lignes, cif(Date is null) as date_null,
             cif(Reception is null) as reception_null from sales) t""")
def q_null_overview(spark, d):
    return K.null_overview(sales(spark, d, ["Date", "Reception"]))


@register("date_diff_count", f"""{WITH_SALES}
select lignes_differentes, {sql_pct('lignes_differentes', 'total')} as pct_differentes
from (select cif(Date is not null and Reception is not null and Date != Reception) as lignes_differentes,
             count(*) as total from sales) t""")
def q_date_diff_count(spark, d):
    return K.different_rows(sales(spark, d, ["Date", "Reception"]))


@register("date_gap_stats", f"""{WITH_SALES}
select round(avg(abs(date_diff('day', Reception, Date))), 6) as ecart_moyen_jours,
       cast(min(date_diff('day', Reception, Date)) as integer) as ecart_min_jours,
       cast(max(date_diff('day', Reception, Date)) as integer) as ecart_max_jours
from sales where Date is not null and Reception is not null""")
def q_date_gap_stats(spark, d):
    return rounded(K.gap_stats(sales(spark, d, ["Date", "Reception"])))


@register("date_gap_top20", f"""{WITH_SALES}
select ecart_jours, nb_lignes,
       {sql_pct('nb_lignes', '(select count(*) from sales where Date is not null and Reception is not null)')} as pourcentage
from (select cast(date_diff('day', Reception, Date) as integer) as ecart_jours, count(*) as nb_lignes
      from sales where Date is not null and Reception is not null group by 1) t
order by nb_lignes desc, ecart_jours asc limit 20""")
def q_date_gap_top20(spark, d):
    return K.gap_distribution(sales(spark, d, ["Date", "Reception"]), top=20)


@register("date_gap_examples", f"""{WITH_SALES}
select * from (
  select l_orderkey, l_linenumber, Date, Reception,
         cast(date_diff('day', Reception, Date) as integer) as ecart_jours, TypeVente, Famille, Prix
  from sales where Date is not null and Reception is not null and Date != Reception) t
order by l_orderkey, l_linenumber, Date, Reception, ecart_jours, TypeVente, Famille, Prix limit 20""")
def q_date_gap_examples(spark, d):
    src = sales(spark, d, ["l_orderkey", "l_linenumber", "Date", "Reception", "TypeVente", "Famille", "Prix"])
    return rounded(K.gap_examples(src, 20))


@register("null_by_year", f"""{WITH_SALES}
select annee, total_lignes, date_null, {sql_pct('date_null', 'total_lignes')} as pct_date_null
from (select cast(year(Reception) as integer) as annee, count(*) as total_lignes,
             cif(Date is null) as date_null
      from sales where Reception >= DATE '{P.RECEPTION_RANGE[0]}' and Reception <= DATE '{P.RECEPTION_RANGE[1]}'
      group by 1) t""")
def q_null_by_year(spark, d):
    return K.null_share_by_year(sales(spark, d, ["Date", "Reception"]), P.RECEPTION_RANGE)


# ------------------------------------------------------------------ daily series, outliers, EDA

DAILY_SQL = f"""{WITH_SALES}, daily as (
  select Date, coalesce(sum(Quantite), 0) as Quantite from sales where {POSITIVE_WHERE} group by Date)"""


def _positive(spark, d, cols):
    return C.positive_sales(sales(spark, d, list(dict.fromkeys(cols + ["Date", "Quantite", "Prix"]))))


def _daily(spark, d):
    return M.daily_series(_positive(spark, d, ["Date", "Quantite"]))


register("daily_series", f"""{DAILY_SQL}
select Date, round(Quantite, 6) as Quantite from daily""")(lambda spark, d: rounded(_daily(spark, d)))


@register("daily_capped", f"""{DAILY_SQL}
select Date, round(Quantite, 6) as Quantite,
       round(case when Quantite > t then t else Quantite end, 6) as Quantite_capped
from daily, (select quantile_cont(Quantite, 0.99) as t from daily) q""")
def q_daily_capped(spark, d):
    return rounded(O.cap_series(_daily(spark, d), "Quantite", 0.99))


register("top_days", f"""{DAILY_SQL}
select Date, round(Quantite, 6) as Quantite from daily order by Quantite desc, Date limit 10""")(
    lambda spark, d: rounded(M.top_days(_daily(spark, d))))


@register("describe_daily", f"""{DAILY_SQL}
select 'Quantite' as variable, count(Quantite) as "count", round(avg(Quantite), 6) as mean,
       round(stddev_samp(Quantite), 6) as std, round(min(Quantite), 6) as "min",
       round(quantile_cont(Quantite, 0.25), 6) as p25, round(quantile_cont(Quantite, 0.5), 6) as p50,
       round(quantile_cont(Quantite, 0.75), 6) as p75, round(max(Quantite), 6) as "max"
from daily""")
def q_describe_daily(spark, d):
    return rounded(M.describe(_daily(spark, d), ["Quantite"]))


@register("monthly_totals", f"""{WITH_SALES}
select cast(month(Date) as integer) as Mois, round(coalesce(sum(Quantite), 0), 6) as Quantite
from sales where {POSITIVE_WHERE} group by 1""")
def q_monthly_totals(spark, d):
    return rounded(M.monthly_totals(_positive(spark, d, ["Date", "Quantite"])))


@register("weekday_totals", f"""{WITH_SALES}
select cast(isodow(Date) - 1 as integer) as JourSemaine, round(coalesce(sum(Quantite), 0), 6) as Quantite
from sales where {POSITIVE_WHERE} group by 1""")
def q_weekday_totals(spark, d):
    return rounded(M.weekday_totals(_positive(spark, d, ["Date", "Quantite"])))


@register("top_articles", f"""{WITH_SALES}
select CodeArticle, round(Quantite, 6) as Quantite, round(Revenu, 6) as Revenu from (
  select CodeArticle, coalesce(sum(Quantite), 0) as Quantite, coalesce(sum(Prix * Quantite), 0) as Revenu
  from sales where {POSITIVE_WHERE} and CodeArticle is not null group by 1) t
order by Quantite desc, CodeArticle limit 10""")
def q_top_articles(spark, d):
    return rounded(M.top_groups(_positive(spark, d, ["CodeArticle"]), "CodeArticle", "Quantite", 10))


@register("top_families", f"""{WITH_SALES}
select Famille, round(Quantite, 6) as Quantite, round(Revenu, 6) as Revenu from (
  select Famille, coalesce(sum(Quantite), 0) as Quantite, coalesce(sum(Prix * Quantite), 0) as Revenu
  from sales where {POSITIVE_WHERE} and Famille is not null group by 1) t
order by Revenu desc, Famille limit 10""")
def q_top_families(spark, d):
    return rounded(M.top_groups(_positive(spark, d, ["Famille"]), "Famille", "Revenu", 10))


# ------------------------------------------------------------------ G21 on raw fact columns

@register("describe_sales", f"""{WITH_SALES}, pos as (
  select Quantite, Prix, Prix * Quantite as Revenu from sales where {POSITIVE_WHERE})
select * from (""" + " union all ".join(
    f"""select '{c}' as variable, count({c}) as "count", round(avg({c}), 6) as mean,
       round(stddev_samp({c}), 6) as std, round(min({c}), 6) as "min",
       round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
       round(quantile_cont({c}, 0.75), 6) as p75, round(max({c}), 6) as "max" from pos"""
    for c in ("Quantite", "Prix", "Revenu")) + ") t")
def q_describe_sales(spark, d):
    """G21 on the positive sale lines (Quantite, Prix, Revenu): moments in one
    aggregate, quartiles by the exact distributed quantile (bounded collects)."""
    pos = materialize(_positive(spark, d, ["Prix"]).select(
        "Quantite", "Prix", (F.col("Prix") * F.col("Quantite")).alias("Revenu")))
    return rounded(M.describe_exact(pos, ["Quantite", "Prix", "Revenu"]))


@register("date_summary", f"""{WITH_SALES}
select total_lignes, date_null, reception_null, lignes_differentes,
       round(ecart_moyen_jours, 6) as ecart_moyen_jours, ecart_min_jours, ecart_max_jours,
       {sql_pct('date_null', 'total_lignes')} as pct_date_null,
       {sql_pct('reception_null', 'total_lignes')} as pct_reception_null,
       {sql_pct('lignes_differentes', 'total_lignes')} as pct_differentes
from (select count(*) as total_lignes, cif(Date is null) as date_null, cif(Reception is null) as reception_null,
             cif(Date is not null and Reception is not null and Date != Reception) as lignes_differentes,
             avg(case when Date is not null and Reception is not null
                      then abs(date_diff('day', Reception, Date)) end) as ecart_moyen_jours,
             cast(min(case when Date is not null and Reception is not null
                           then date_diff('day', Reception, Date) end) as integer) as ecart_min_jours,
             cast(max(case when Date is not null and Reception is not null
                           then date_diff('day', Reception, Date) end) as integer) as ecart_max_jours
      from sales) t""")
def q_date_summary(spark, d):
    """G12-G14 in one pass over the fact (one scan instead of three)."""
    return rounded(K.date_summary(sales(spark, d, ["Date", "Reception"])))
