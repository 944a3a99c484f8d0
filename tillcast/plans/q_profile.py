"""Column profile queries on lineitem and the dimension tables.

The oracle SQL is the reference's per-column method (one select per column,
unioned); the Spark plan is the one-pass profiler.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast import constants as K
from tillcast.operators import profile as PR
from tillcast.plans.catalog import WITH_SALES, register
from tillcast.sources.tables import read_table, sales

# column -> SQL type name of lineitem, in table order
LINEITEM = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
            ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
            ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "varchar"),
            ("l_linestatus", "varchar"), ("l_shipdate", "datetime")]
DIM_TABLES = ["part", "supplier", "customer", "nation", "region", "orders"]
DIM_COLUMNS = {
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
}


def _cols(kind: str) -> list[str]:
    groups = {"numeric": PR.NUMERIC_SQL, "date": PR.DATE_SQL, "text": PR.TEXT_SQL}
    return [c for c, t in LINEITEM if t in groups[kind]]


# ------------------------------------------------------------------ oracle SQL

def _stats_sql(c: str, t: str, pos: int) -> str:
    num = t in PR.NUMERIC_SQL
    has_range = num or t in PR.DATE_SQL
    return f"""select '{c}' as Colonne, {pos} as pos, '{t}' as Type_SQL, count(*) as Total_Lignes,
  count({c}) as Valeurs_Remplies, count(*) - count({c}) as Valeurs_Nulles,
  round(cast(count(*) - count({c}) as double) * 100.0 / count(*), 2) as Pct_NULL,
  count(distinct {c}) as Valeurs_Distinctes,
  {f'cast(min({c}) as varchar)' if has_range else 'cast(null as varchar)'} as "Min",
  {f'cast(max({c}) as varchar)' if has_range else 'cast(null as varchar)'} as "Max",
  {f'round(avg({c}), 2)' if num else 'cast(null as double)'} as Moyenne,
  {f'round(stddev_pop({c}), 2)' if num else 'cast(null as double)'} as Ecart_Type
from lineitem"""


def _vc_sql(table: str, cols: list[str]) -> str:
    return " union all ".join(
        f"select '{c}' as Colonne, cast({c} as varchar) as value, count(*) as nb "
        f"from {table} where {c} is not null group by 2" for c in cols)


def _top_sql(table: str, cols: list[str], n: int, label: str) -> str:
    return f"""select Colonne, string_agg(value || ' (' || {label} || ')', ', ' order by rk) as top from (
  select Colonne, value, nb, row_number() over (partition by Colonne order by nb desc, value) as rk
  from ({_vc_sql(table, cols)}) v) r
where rk <= {n} group by Colonne"""


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _profile_sql() -> str:
    stats = " union all ".join(_stats_sql(c, t, i) for i, (c, t) in enumerate(LINEITEM))
    all_cols = [c for c, _ in LINEITEM]
    numf = "format('{:,}', nb)"
    txtf = "cast(round(nb * 100.0 / (select count(*) from lineitem), 1) as varchar) || '%'"
    num_types = ", ".join(_sq(t) for t in PR.NUMERIC_SQL)
    date_types = ", ".join(_sq(t) for t in PR.DATE_SQL)
    int_types = ", ".join(_sq(t) for t in PR.INT_SQL)
    real_types = ", ".join(_sq(t) for t in PR.REAL_SQL)
    text_types = ", ".join(_sq(t) for t in PR.TEXT_SQL)
    return f"""with stats as ({stats}),
numtop as ({_top_sql('lineitem', all_cols, 5, numf)}),
txttop as ({_top_sql('lineitem', all_cols, 5, txtf)}),
p as (
  select s.*, '' as "Clé", n.top as ntop, x.top as ttop,
    case when starts_with(Colonne, 'ID') or contains(upper(Colonne), 'ID') then {_sq(K.TYPE_IDENTIFIER)}
         when Type_SQL in ({date_types}) then {_sq(K.TYPE_TEMPORAL)}
         when Type_SQL in ({int_types}) then {_sq(K.TYPE_DISCRETE)}
         when Type_SQL in ({real_types}) then {_sq(K.TYPE_CONTINUOUS)}
         when Type_SQL in ({text_types}) then {_sq(K.TYPE_NOMINAL)}
         else {_sq(K.TYPE_OTHER)} end as Type_Logique
  from stats s left join numtop n using (Colonne) left join txttop x using (Colonne))
select Colonne, Type_SQL, Type_Logique, "Clé", Total_Lignes, Valeurs_Remplies, Valeurs_Nulles, Pct_NULL,
  Valeurs_Distinctes, "Min", "Max", Moyenne, Ecart_Type, cast(null as double) as Mediane,
  case when Type_SQL in ({date_types}) then 'Période : ' || "Min" || ' → ' || "Max"
       when Type_SQL in ({num_types}) then coalesce(ntop, '')
       else coalesce(ttop, '') end as Top_5_Valeurs,
  case when Type_SQL in ({num_types}) then
         case when "Clé" = 'PRI' then {_sq(K.REMARK_PRIMARY_KEY)}
              when Pct_NULL > 50 then {_sq(K.REMARK_UNRELIABLE)}
              when Valeurs_Distinctes = Valeurs_Remplies and Valeurs_Remplies > 1000 then {_sq(K.REMARK_UNIQUE_ID)}
              when coalesce(cast("Max" as double) != 0, false) and coalesce(Moyenne != 0, false)
                   and cast("Max" as double) > Moyenne * 1000 then {_sq(K.REMARK_OUTLIERS)}
              when Valeurs_Distinctes < 10 then {_sq(K.REMARK_LOW_CARD_NUM)}
              else {_sq(K.REMARK_STANDARD_NUM)} end
       when Type_SQL in ({date_types}) then
         case when Pct_NULL > 50 then {_sq(K.REMARK_UNRELIABLE)}
              when Valeurs_Distinctes < 10 then {_sq(K.REMARK_FEW_DATES)}
              else replace({_sq(K.REMARK_DATE_SPAN)}, '{{n}}', cast(Valeurs_Distinctes as varchar)) end
       else
         case when Pct_NULL > 50 then {_sq(K.REMARK_UNRELIABLE)}
              when Valeurs_Distinctes = Valeurs_Remplies and Valeurs_Remplies > 1000 then {_sq(K.REMARK_UNIQUE_ID)}
              when Valeurs_Distinctes < 10 then replace({_sq(K.REMARK_LOW_CARD_TEXT)}, '{{n}}', cast(Valeurs_Distinctes as varchar))
              when Valeurs_Distinctes > 1000 then replace({_sq(K.REMARK_HIGH_CARD_TEXT)}, '{{n}}', format('{{:,}}', Valeurs_Distinctes))
              else {_sq(K.REMARK_STANDARD_TEXT)} end
  end as Interpretation_Auto
from p"""


PROFILE_SQL = _profile_sql()


def _subset_sql(cols: list[str], fields: str) -> str:
    names = ", ".join(_sq(c) for c in cols)
    return f"with prof as ({PROFILE_SQL}) select {fields} from prof where Colonne in ({names})"


NUM_FIELDS = ("Colonne, Valeurs_Remplies, Valeurs_Nulles, Pct_NULL, Valeurs_Distinctes, \"Min\", \"Max\", "
              "Moyenne, Ecart_Type")
DATE_FIELDS = "Colonne, Valeurs_Remplies, Valeurs_Nulles, Pct_NULL, Valeurs_Distinctes, \"Min\", \"Max\""
TEXT_FIELDS = "Colonne, Valeurs_Remplies, Valeurs_Nulles, Pct_NULL, Valeurs_Distinctes"


def _lineitem_profile(spark, d, cols=None):
    return PR.column_profile(read_table(spark, d, "lineitem"), primary_key=None, top_n=5, columns=cols)


def _select(df, fields: str):
    return df.select(*[f.strip().strip('"') for f in fields.split(",")])


register("profile_remarks", PROFILE_SQL)(lambda spark, d: _lineitem_profile(spark, d))
register("profile_numeric", _subset_sql(_cols("numeric"), NUM_FIELDS))(
    lambda spark, d: _select(_lineitem_profile(spark, d, _cols("numeric")), NUM_FIELDS))
register("profile_dates", _subset_sql(_cols("date"), DATE_FIELDS))(
    lambda spark, d: _select(_lineitem_profile(spark, d, _cols("date")), DATE_FIELDS))
register("profile_text", _subset_sql(_cols("text"), TEXT_FIELDS))(
    lambda spark, d: _select(_lineitem_profile(spark, d, _cols("text")), TEXT_FIELDS))
register("top_values", f"with prof as ({PROFILE_SQL}) select Colonne, Top_5_Valeurs from prof")(
    lambda spark, d: _lineitem_profile(spark, d).select("Colonne", "Top_5_Valeurs"))


@register("profile_summary", f"""with prof as ({PROFILE_SQL})
select Type_Logique, count(*) as nb_colonnes from prof group by Type_Logique""")
def q_profile_summary(spark, d):
    per_type, _ = PR.profile_summary(PR.column_fill(read_table(spark, d, "lineitem")))
    return per_type


def _dims_sql() -> str:
    parts = []
    for t in DIM_TABLES:
        cols = DIM_COLUMNS[t]
        stats = " union all ".join(
            f"select '{c}' as Colonne, count(*) as Total_Lignes, count({c}) as Valeurs_Remplies, "
            f"count(distinct {c}) as Valeurs_Distinctes from {t}" for c in cols)
        top = _top_sql(t, cols, 10, "format('{:,}', nb)")
        parts.append(f"select '{t}' as \"Table\", s.*, coalesce(x.top, {_sq(K.TOP_VALUES_EMPTY)}) as Top_10_Valeurs "
                     f"from ({stats}) s left join ({top}) x using (Colonne)")
    body = " union all ".join(parts)
    return f"""with d as ({body}), e as (
  select *, Total_Lignes - Valeurs_Remplies as Valeurs_Nulles,
    case when Total_Lignes > 0 then round(cast(Total_Lignes - Valeurs_Remplies as double) * 100.0 / Total_Lignes, 2)
         else 0.0 end as Pct_NULL from d)
select "Table", Colonne, Total_Lignes, Valeurs_Remplies, Valeurs_Nulles, Pct_NULL, Valeurs_Distinctes,
  Top_10_Valeurs,
  case when starts_with(Colonne, 'ID') then
         case when Valeurs_Distinctes = Valeurs_Remplies then {_sq(K.REMARK_DIM_PRIMARY)} else {_sq(K.REMARK_DIM_FOREIGN)} end
       when Pct_NULL > 50 then {_sq(K.REMARK_UNRELIABLE)}
       when Valeurs_Distinctes < 10 then replace({_sq(K.REMARK_LOW_CARD_TEXT)}, '{{n}}', cast(Valeurs_Distinctes as varchar))
       when Valeurs_Distinctes = Total_Lignes then {_sq(K.REMARK_DIM_UNIQUE)}
       else replace({_sq(K.REMARK_DIM_CATEGORICAL)}, '{{n}}', cast(Valeurs_Distinctes as varchar)) end
    as Interpretation_Auto,
  cast(null as varchar) as Erreur
from e"""


@register("profile_dims", _dims_sql())
def q_profile_dims(spark, d):
    tables = {t: read_table(spark, d, t) for t in DIM_TABLES}
    return PR.dimension_profile(tables, DIM_COLUMNS, top_n=10)


@register("profile_nulls", f"""with prof as ({PROFILE_SQL})
select Colonne, Pct_NULL from prof where Pct_NULL > 10""")
def q_profile_nulls(spark, d):
    """Columns with more than 10 % nulls, most null first."""
    _, nulls = PR.profile_summary(PR.column_fill(read_table(spark, d, "lineitem")))
    return nulls


_SALES_FILL = " union all ".join(
    f"select '{c}' as Colonne, count(*) as n, count(*) - count({c}) as nulls from sales"
    for c in ["Date", "Reception", "TypeVente", "CodeMag", "CodeArticle", "Famille", "ArFamille", "ArCouleur",
              "Saison", "Pays", "Prix", "Quantite", "Total"])


@register("profile_nulls_sales", f"""{WITH_SALES}, fill as ({_SALES_FILL})
select Colonne, round(nulls * 100.0 / n, 2) as Pct_NULL from fill where nulls * 100.0 / n > 10""")
def q_profile_nulls_sales(spark, d):
    """G25 on the sales view, which has null dates."""
    _, nulls = PR.profile_summary(PR.column_fill(sales(spark, d)))
    return nulls


@register("profile_median", " union all ".join(
    f"select '{c}' as Colonne, round(quantile_cont({c}, 0.5), 6) as Mediane from lineitem" for c in _cols("numeric")))
def q_profile_median(spark, d):
    """G17 with the median the reference skips: exact medians of lineitem's
    numeric columns by the distributed quantile."""
    from tillcast.plans.catalog import rounded
    prof = PR.column_profile(read_table(spark, d, "lineitem"), columns=_cols("numeric"), median=True)
    return rounded(prof.select("Colonne", "Mediane"))
