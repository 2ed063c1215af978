"""DuckDB SQL fragments that mirror the Column functions (oracle side only)."""

from __future__ import annotations

from hirelens.fixtures import AS_OF_SQL


def _clean(x: str) -> str:
    return f"trim(replace(replace({x}, '元', ''), ',', ''))"


def applicant(col: str = "applyDesc") -> tuple[str, str]:
    head = f"trim(split_part({col}, '人', 1))"
    parts = f"string_split({head}, '~')"
    a = f"TRY_CAST(trim({parts}[1]) AS BIGINT)"
    b = f"TRY_CAST(trim({parts}[2]) AS BIGINT)"
    single = f"TRY_CAST({head} AS BIGINT)"
    usable = f"({col} IS NOT NULL AND contains({col}, '人'))"
    rng = f"(contains({head}, '~') AND len({parts}) = 2 AND {a} IS NOT NULL AND {b} IS NOT NULL)"
    sgl = f"(NOT contains({head}, '~') AND {single} IS NOT NULL)"
    lo = f"CASE WHEN {usable} AND {rng} THEN {a} WHEN {usable} AND {sgl} THEN {single} ELSE CAST(0 AS BIGINT) END"
    hi = f"CASE WHEN {usable} AND {rng} THEN {b} WHEN {usable} AND {sgl} THEN {single} ELSE CAST(0 AS BIGINT) END"
    return lo, hi


def salary(col: str = "salaryDesc") -> tuple[str, str]:
    m = f"trim(string_split({col}, '月薪')[2])"
    mp = f"string_split({m}, '~')"
    ma = f"TRY_CAST({_clean(mp + '[1]')} AS BIGINT)"
    mb = f"TRY_CAST({_clean(mp + '[2]')} AS BIGINT)"
    ms = f"TRY_CAST({_clean(m)} AS BIGINT)"
    h = f"trim(string_split({col}, '時薪')[2])"
    hv = f"(TRY_CAST({_clean(h)} AS BIGINT) * 160)"
    rng = f"({m} IS NOT NULL AND contains({m}, '~') AND len({mp}) = 2 AND {ma} IS NOT NULL AND {mb} IS NOT NULL)"
    sgl = f"({m} IS NOT NULL AND NOT contains({m}, '~') AND {ms} IS NOT NULL)"
    lo = f"CASE WHEN {rng} THEN {ma} WHEN {sgl} THEN {ms} WHEN {hv} IS NOT NULL THEN {hv} ELSE CAST(0 AS BIGINT) END"
    hi = f"CASE WHEN {rng} THEN {mb} WHEN {sgl} THEN {ms} WHEN {hv} IS NOT NULL THEN {hv} ELSE CAST(0 AS BIGINT) END"
    return lo, hi


def competition(col: str = "applyDesc") -> str:
    return f"CASE WHEN {col} IN ('0~5人應徵') THEN '低' WHEN {col} IN ('大於30人應徵') THEN '高' ELSE '中等' END"


def growth_pct(first: str, growth: str) -> str:
    return f"CASE WHEN {first} <> 0 THEN round_even({growth} / {first} * 100.0, 2) END"


def growth_label(first: str, growth: str) -> str:
    return (f"CASE WHEN {first} = 0 THEN (CASE WHEN {growth} > 0 THEN '首次出現' ELSE '0%' END) "
            f"ELSE regexp_replace(printf('%.2f', {growth_pct(first, growth)}), '0$', '') || '%' END")


ANALYSIS = f""", an AS (
  SELECT jobNo AS job_no, jobName AS job_name, custName AS company_name, city, district,
         search_keyword AS keywords, coalesce(job, 'https://www.104.com.tw/job/' || jobNo) AS link,
         applyDesc AS apply_desc, salaryDesc AS salary_desc, periodDesc AS experience, optionEdu AS education,
         coIndustryDesc AS industry, status, delisted_date,
         CAST(strptime(appearDate, '%Y%m%d') AS DATE) AS appear_date,
         CAST(date_diff('day', CAST(strptime(appearDate, '%Y%m%d') AS DATE), {AS_OF_SQL}) AS INTEGER) AS shelf_days
  FROM jobs),
an2 AS (SELECT *, coalesce(shelf_days > 30, false) AS long_unfilled, coalesce(shelf_days < 30, false) AS recent FROM an)"""
