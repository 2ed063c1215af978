"""Column functions (F1–F17): pure Spark expressions, no Python UDFs."""

from hirelens.functions.parsing import (  # noqa: F401
    applicant_range,
    salary_range,
    competition_level,
    split_city,
    split_district,
    link_urls_from_string,
    link_urls_from_struct,
    ensure_https,
    parse_compact_date,
    parse_date_lenient,
    month_label,
    growth_label,
    search_url,
    shelf_days_before_delisting,
    posting_key,
    city_district_key,
    keywords_text,
    as_keyword_array,
    parse_keyword_list,
)
