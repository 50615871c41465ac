"""Registered profiling, typing and role-detection queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.functions.expr import NUMBER_TEXT, to_number
from bizlens.operators import profile, rules
from bizlens.operators.roles import ROLE_KEYWORDS, normalize_name, filled_values, role_catalogue, schema_catalogue
from bizlens.operators.typing import coerce_date_columns
from bizlens.plans.oracle import with_views as W
from bizlens.plans.registry import register
from bizlens.sources import views

DIRTY_COLS = ["day", "user_id", "category", "revenue"]
MIX_NUMERIC = ["l_orderkey", "l_linenumber", "quantity", "amount", "gross", "discount", "constant_col", "tax"]
DESCRIBE_DIGITS = 4
CORR_DIGITS = 9


def _missing_expr(c: str) -> str:
    return f"{c} IS NULL"


@register("profile_shape", W("dirty") + """
SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns,
       CAST(""" + " + ".join(f"count(*) FILTER (WHERE {_missing_expr(c)})" for c in DIRTY_COLS) + """ AS BIGINT) AS missing_total
FROM dirty""")
def q_profile_shape(spark, sf):
    return profile.profile_shape(views.dirty(spark, sf))


@register("profile_missing", W("dirty") + "\nUNION ALL\n".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, count(*) FILTER (WHERE {_missing_expr(c)}) AS missing FROM dirty"
    for i, c in enumerate(DIRTY_COLS)))
def q_profile_missing(spark, sf):
    return profile.profile_missing(views.dirty(spark, sf))


@register("profile_duplicates", W("dirty") + """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS BIGINT) AS duplicates FROM dirty""")
def q_profile_duplicates(spark, sf):
    return profile.profile_duplicates(views.dirty(spark, sf))


def _describe_sql() -> str:
    d = DESCRIBE_DIGITS
    parts = []
    for c in MIX_NUMERIC:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({v}), {d}) AS mean, round(stddev_samp({v}), {d}) AS std, "
            f"round(min({v}), {d}) AS min, round(quantile_cont({v}, 0.25), {d}) AS q25, round(quantile_cont({v}, 0.5), {d}) AS q50, "
            f"round(quantile_cont({v}, 0.75), {d}) AS q75, round(max({v}), {d}) AS max FROM numeric_mix"
        )
    return W("numeric_mix") + "\nUNION ALL\n".join(parts)


@register("profile_describe", _describe_sql())
def q_profile_describe(spark, sf):
    return profile.profile_describe(views.numeric_mix(spark, sf), digits=DESCRIBE_DIGITS)


@register("top_value_share", W("dirty") + """,
c AS (SELECT coalesce(category, 'nan') AS value, count(*) AS n FROM dirty GROUP BY 1)
SELECT 0 AS ordinal, 'category' AS column_name, value, 100.0 * n / (SELECT sum(n) FROM c) AS share
FROM c ORDER BY n DESC, value LIMIT 1""")
def q_top_value_share(spark, sf):
    return profile.top_value_share(views.dirty(spark, sf))


@register("top_contributor_share", W("dirty") + """,
s AS (SELECT category AS key, coalesce(sum(revenue), 0) AS s FROM dirty WHERE category IS NOT NULL GROUP BY 1)
SELECT 0 AS pos, 'category' AS column_name, key AS top_value, CAST(s AS DOUBLE) / CAST((SELECT sum(s) FROM s) AS DOUBLE) * 100.0 AS share,
       'revenue' AS value_column
FROM s WHERE (SELECT sum(s) FROM s) <> 0 ORDER BY s DESC, key LIMIT 1""")
def q_top_contributor_share(spark, sf):
    return profile.top_contributor_share(views.dirty(spark, sf))


@register("skew_flags", W("dirty") + "\nUNION ALL\n".join(
    f"""SELECT * FROM (SELECT {i} AS ordinal, '{c}' AS column_name, count({c}) AS n, round(skewness(CAST({c} AS DOUBLE)), 9) AS skew,
       CASE WHEN skewness(CAST({c} AS DOUBLE)) > 1 THEN 'right' WHEN skewness(CAST({c} AS DOUBLE)) < -1 THEN 'left' END AS direction
       FROM dirty) WHERE n >= 3""" for i, c in enumerate(["user_id", "revenue"])))
def q_skew_flags(spark, sf):
    return profile.skew_flags(views.dirty(spark, sf)).withColumn("skew", F.round("skew", CORR_DIGITS))


def _corr_sql(upper_only_strong: bool = False) -> str:
    cols = MIX_NUMERIC
    sel = []
    for i, a in enumerate(cols):
        sel.append(f"stddev_samp(CAST({a} AS DOUBLE)) > 0 AS d{i}")
        for j, b in enumerate(cols):
            if j > i:
                sel.append(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c_{i}_{j}")
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                val = f"CASE WHEN coalesce(d{i}, false) THEN 1.0 END"
            else:
                lo, hi = min(i, j), max(i, j)
                val = f"c_{lo}_{hi}"
            rows.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS row_name, '{b}' AS col_name, CAST({val} AS DOUBLE) AS corr FROM w")
    body = W("numeric_mix") + ",\nw AS (SELECT " + ", ".join(sel) + " FROM numeric_mix),\nm AS (" + "\nUNION ALL\n".join(rows) + ")\n"
    if upper_only_strong:
        return body + f"SELECT i, j, row_name AS left, col_name AS right, round(abs(corr), {CORR_DIGITS}) AS corr FROM m WHERE i < j AND abs(corr) >= 0.8 AND NOT isnan(corr) ORDER BY i, j LIMIT 3"
    return body + f"SELECT i, j, row_name, col_name, round(CASE WHEN isnan(corr) THEN NULL ELSE corr END, {CORR_DIGITS}) AS corr FROM m"


@register("corr_matrix", _corr_sql())
def q_corr_matrix(spark, sf):
    m = profile.corr_matrix(views.numeric_mix(spark, sf))
    return m.withColumn("corr", F.round("corr", CORR_DIGITS))


@register("corr_strong_pairs", _corr_sql(upper_only_strong=True))
def q_corr_strong_pairs(spark, sf):
    return profile.corr_strong_pairs(views.numeric_mix(spark, sf)).withColumn("corr", F.round("corr", CORR_DIGITS))


INSIGHT_MISSING_SQL = """,
mc AS (""" + "\nUNION ALL\n".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, count(*) FILTER (WHERE {_missing_expr(c)}) AS missing FROM dirty"
    for i, c in enumerate(DIRTY_COLS)) + """),
tot AS (SELECT sum(missing) AS m, (SELECT count(*) FROM dirty) AS r FROM mc),
im AS (
  SELECT 0 AS line, printf('Обнаружено %d пропущенных значений (%.1f%% от всех ячеек).', m, m / greatest(r * 4, 1) * 100.0) AS text
  FROM tot WHERE m > 0
  UNION ALL
  SELECT 1 + ordinal, printf('В столбце «%s» пропущено %d значений (%.1f%%).', column_name, missing, missing / greatest((SELECT r FROM tot), 1) * 100.0)
  FROM (SELECT * FROM mc ORDER BY missing DESC, ordinal LIMIT 5) WHERE missing > 0)"""


@register("insight_missing", W("dirty") + INSIGHT_MISSING_SQL + "\nSELECT line, text FROM im")
def q_insight_missing(spark, sf):
    return profile.insight_missing(views.dirty(spark, sf))


@register("insights_all", W("dirty") + INSIGHT_MISSING_SQL + """,
dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS d FROM dirty),
vc AS (SELECT coalesce(category, 'nan') AS value, count(*) AS n FROM dirty GROUP BY 1),
tv AS (SELECT value, 100.0 * n / (SELECT sum(n) FROM vc) AS share FROM vc ORDER BY n DESC, value LIMIT 1),
cs AS (SELECT category AS key, coalesce(sum(revenue), 0) AS s FROM dirty WHERE category IS NOT NULL GROUP BY 1),
tc AS (SELECT key, CAST(s AS DOUBLE) / CAST((SELECT sum(s) FROM cs) AS DOUBLE) * 100.0 AS share FROM cs
       WHERE (SELECT sum(s) FROM cs) <> 0 ORDER BY s DESC, key LIMIT 1),
sk AS (SELECT * FROM (
        SELECT 0 AS ordinal, 'user_id' AS c, count(user_id) AS n, skewness(CAST(user_id AS DOUBLE)) AS g FROM dirty
        UNION ALL SELECT 1, 'revenue', count(revenue), skewness(revenue) FROM dirty) WHERE n >= 3),
lines AS (
  SELECT 1 AS section, line AS sub, text FROM im
  UNION ALL SELECT 2, 0, printf('Найдено %d полностью повторяющихся строк.', d) FROM dup WHERE d > 0
  UNION ALL SELECT 3, 0, printf('Самое частое значение в «%s» — «%s» (%.1f%% строк).', 'category', value, share) FROM tv
  UNION ALL SELECT 3, 1, printf('«%s» дает %.1f%% суммы по показателю «%s».', key, share, 'revenue') FROM tc
  UNION ALL SELECT 4, ordinal, CASE WHEN g > 1 THEN printf('Распределение «%s» смещено вправо: есть крупные значения или выбросы.', c)
                                    ELSE printf('Распределение «%s» смещено влево: есть необычно малые значения.', c) END
            FROM sk WHERE g > 1 OR g < -1),
allx AS (SELECT * FROM lines
         UNION ALL SELECT 9, 0, 'Критичных проблем не найдено: данные выглядят пригодными для дальнейшего анализа.'
         WHERE (SELECT count(*) FROM lines) = 0)
SELECT CAST(row_number() OVER (ORDER BY section, sub) AS INTEGER) AS line, text
FROM (SELECT * FROM allx ORDER BY section, sub LIMIT 12)""")
def q_insights_all(spark, sf):
    return profile.insights_all(views.dirty(spark, sf))


@register("rule_missing_share", W("dirty") + """
SELECT 1 AS rank, 'missing_share' AS rule,
       CASE WHEN m / greatest(r * 4, 1) > 0.1
            THEN 'Обнаружено значительное количество пропущенных данных. Перед принятием решений стоит проверить качество выгрузки.'
            ELSE 'В данных есть пропуски. Они не выглядят критичными, но могут влиять на точность расчетов.' END AS text
FROM (SELECT """ + " + ".join(f"count(*) FILTER (WHERE {_missing_expr(c)})" for c in DIRTY_COLS) + """ AS m, count(*) AS r FROM dirty)
WHERE m > 0""")
def q_rule_missing_share(spark, sf):
    return rules.rule_missing_share(views.dirty(spark, sf))


# ------------------------------------------------------------------ typing

@register("date_coercion", """
SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS order_date,
       o_totalprice AS amount FROM orders""")
def q_date_coercion(spark, sf):
    df = coerce_date_columns(views.orders_text_dates(spark, sf), min_share=0.5)
    return df.withColumn("order_date", F.to_date("order_date"))


def _number_texts_sql() -> str:
    return """
t AS (SELECT event_id, regexp_extract(props, '[0-9]+', 0) AS d, props FROM events),
x AS (SELECT event_id, d AS t1, props AS t2, d || '.' || d AS t3, d || ' 000' AS t4, '  ' || d || 'e-1 ' AS t5,
             d || 'd' AS t6, d || ',5' AS t7, '.' || d AS t8 FROM t)"""


def _number_sql(col: str) -> str:
    pat = NUMBER_TEXT.replace("'", "''")
    return f"CASE WHEN regexp_full_match({col}, '{pat}') THEN TRY_CAST(trim({col}) AS DOUBLE) END AS n_{col}"


@register("to_number_coerce", "WITH" + _number_texts_sql() + "\nSELECT event_id, "
          + ", ".join(_number_sql(f"t{i}") for i in range(1, 9)) + " FROM x")
def q_to_number_coerce(spark, sf):
    ev = views.table(spark, sf, "events")
    d = F.regexp_extract("props", "[0-9]+", 0)
    texts = ev.select(
        "event_id",
        d.alias("t1"),
        F.col("props").alias("t2"),
        F.concat(d, F.lit("."), d).alias("t3"),
        F.concat(d, F.lit(" 000")).alias("t4"),
        F.concat(F.lit("  "), d, F.lit("e-1 ")).alias("t5"),
        F.concat(d, F.lit("d")).alias("t6"),
        F.concat(d, F.lit(",5")).alias("t7"),
        F.concat(F.lit("."), d).alias("t8"),
    )
    return texts.select("event_id", *[to_number(texts, f"t{i}").alias(f"n_t{i}") for i in range(1, 9)])


def _role_map_sql() -> str:
    kws = ", ".join(
        f"('{role}', {rr}, {kr}, '{normalize_name(k)}')"
        for rr, (role, ks) in enumerate(ROLE_KEYWORDS)
        for kr, k in enumerate(ks)
    )
    tables = ", ".join(f"'{t}'" for t in views.TABLES)
    filled = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, column_name, filled FROM (UNPIVOT (SELECT COUNT(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE filled)"
        for t in views.TABLES
    )
    return f"""
WITH cat AS (SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name
             FROM information_schema.columns WHERE table_name IN ({tables})),
n AS (SELECT table_name, ordinal, column_name,
             regexp_replace(regexp_replace(lower(column_name), '[^a-zа-я0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS norm FROM cat),
pn AS (SELECT table_name, norm, min(ordinal) AS position, arg_max(column_name, ordinal) AS column_name FROM n GROUP BY 1, 2),
kw(role, role_rank, keyword_rank, keyword) AS (VALUES {kws}),
m AS (SELECT pn.table_name, kw.role, kw.role_rank, pn.column_name,
             row_number() OVER (PARTITION BY pn.table_name, kw.role
                                ORDER BY CASE WHEN pn.norm = kw.keyword THEN 0 ELSE 1 END, kw.keyword_rank, pn.position) AS rn
      FROM pn JOIN kw ON contains(pn.norm, kw.keyword)),
filled AS ({filled})
SELECT m.table_name, role, role_rank, m.column_name, filled.filled FROM m JOIN filled USING (table_name, column_name) WHERE rn = 1"""


@register("role_map", _role_map_sql())
def q_role_map(spark, sf):
    frames = {t: views.table(spark, sf, t) for t in views.TABLES}
    roles = role_catalogue(schema_catalogue(spark, frames))
    return roles.join(filled_values(frames), ["table_name", "column_name"])
