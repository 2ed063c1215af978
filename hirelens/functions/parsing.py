"""F1–F17 as Column expressions.

All functions take and return ``pyspark.sql.Column`` objects, so they stay
inside whole-stage codegen (no Python UDF, no per-row serialisation).
Casts use ``try_cast``/``try_to_date`` because ANSI mode is on: a bad label
must become a default value, not a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelens import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _to_long(c: Column) -> Column:
    return F.trim(c).try_cast("bigint")


def _range_struct(lo: Column, hi: Column, with_avg: bool) -> Column:
    fields = [lo.alias("min"), hi.alias("max")]
    if with_avg:
        fields.append(((lo + hi) / F.lit(2.0)).alias("avg"))
    return F.struct(*fields)


# --------------------------------------------------------------------------
# F1 applicant band -> (min, max, avg)
# --------------------------------------------------------------------------
def applicant_range(desc, with_avg: bool = True, open_ended: bool = False) -> Column:
    """``'11~30人應徵'`` -> struct(min=11, max=30, avg=20.5).

    Text before the first ``人``; ``a~b`` gives both ends, a single number
    gives it twice; null, empty, no ``人`` or anything unparsable gives 0/0.
    The open band ``大於30人應徵`` therefore parses to 0 (parity);
    ``open_ended=True`` reads it as its bound (30).
    """
    d = _col(desc)
    head = F.trim(F.split(d, C.APPLY_PEOPLE_TOKEN).getItem(0))
    if open_ended:
        head = F.regexp_replace(head, "^" + C.OPEN_BAND_PREFIX + r"\s*", "")
    parts = F.split(head, C.RANGE_TOKEN)
    ranged = head.contains(C.RANGE_TOKEN)
    a = _to_long(parts.getItem(0))
    b = _to_long(F.get(parts, 1))
    single = _to_long(head)
    ok_range = ranged & (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    ok_single = (~ranged) & single.isNotNull()
    usable = d.isNotNull() & d.contains(C.APPLY_PEOPLE_TOKEN)
    lo = (F.when(usable & ok_range, a)
          .when(usable & ok_single, single)
          .otherwise(F.lit(0).cast("bigint")))
    hi = (F.when(usable & ok_range, b)
          .when(usable & ok_single, single)
          .otherwise(F.lit(0).cast("bigint")))
    return _range_struct(lo, hi, with_avg)


# --------------------------------------------------------------------------
# F2 salary label -> monthly (min, max, avg)
# --------------------------------------------------------------------------
def _strip_money(c: Column) -> Column:
    return F.trim(F.translate(c, C.SALARY_STRIP_CHARS, ""))


def salary_range(desc, with_avg: bool = True) -> Column:
    """Monthly salary range from a label.

    After ``月薪``: ``a~b`` (money signs and commas stripped) or a single
    value.  Otherwise, or when that fails, after ``時薪``: value x 160.
    Anything else (``面議``, ``以上`` ranges, ``至``) gives 0/0.
    """
    d = _col(desc)
    m = F.trim(F.get(F.split(d, C.SALARY_MONTHLY_TOKEN), 1))
    m_parts = F.split(m, C.RANGE_TOKEN)
    m_ranged = m.contains(C.RANGE_TOKEN)
    ma = _to_long(_strip_money(m_parts.getItem(0)))
    mb = _to_long(_strip_money(F.get(m_parts, 1)))
    ms = _to_long(_strip_money(m))
    m_range_ok = m_ranged & (F.size(m_parts) == 2) & ma.isNotNull() & mb.isNotNull()
    m_single_ok = (~m_ranged) & ms.isNotNull()
    h = F.trim(F.get(F.split(d, C.SALARY_HOURLY_TOKEN), 1))
    hv = _to_long(_strip_money(h)) * F.lit(C.HOURS_PER_MONTH)
    zero = F.lit(0).cast("bigint")
    lo = (F.when(m.isNotNull() & m_range_ok, ma)
          .when(m.isNotNull() & m_single_ok, ms)
          .when(hv.isNotNull(), hv)
          .otherwise(zero))
    hi = (F.when(m.isNotNull() & m_range_ok, mb)
          .when(m.isNotNull() & m_single_ok, ms)
          .when(hv.isNotNull(), hv)
          .otherwise(zero))
    return _range_struct(lo, hi, with_avg)


# --------------------------------------------------------------------------
# F3 competition level
# --------------------------------------------------------------------------
def competition_level(desc) -> Column:
    d = _col(desc)
    return (F.when(d.isin(*C.LOW_COMPETITION_BANDS), F.lit(C.COMPETITION_LOW))
            .when(d.isin(*C.HIGH_COMPETITION_BANDS), F.lit(C.COMPETITION_HIGH))
            .otherwise(F.lit(C.COMPETITION_MEDIUM)))


# --------------------------------------------------------------------------
# F4 address -> city, district
# --------------------------------------------------------------------------
def _addr_present(a: Column) -> Column:
    return a.isNotNull() & (a != "")


def split_city(addr) -> Column:
    a = _col(addr)
    return (F.when(~_addr_present(a), F.lit(None).cast("string"))
            .when(a.rlike(C.ADDR_CITY_DISTRICT), F.regexp_extract(a, C.ADDR_CITY_DISTRICT, 1))
            .when(a.rlike(C.ADDR_CITY_ONLY), F.regexp_extract(a, C.ADDR_CITY_ONLY, 1))
            .otherwise(F.lit("")))


def split_district(addr) -> Column:
    a = _col(addr)
    return (F.when(~_addr_present(a), F.lit(None).cast("string"))
            .when(a.rlike(C.ADDR_CITY_DISTRICT), F.regexp_extract(a, C.ADDR_CITY_DISTRICT, 2))
            .when(a.rlike(C.ADDR_CITY_ONLY), F.lit(""))
            .otherwise(a))


def with_city_district(df, addr: str = "jobAddrNoDesc", city: str = "city", district: str = "district"):
    """F4 on a DataFrame with three regex evaluations per row instead of six.

    The first capture group of either pattern cannot be empty, so a non-empty
    extraction means "matched"; the extractions run in their own projection
    and the city / district choice reads them as columns.
    """
    a = F.col(addr)
    staged = df.withColumns({
        "_cd_c1": F.regexp_extract(a, C.ADDR_CITY_DISTRICT, 1),
        "_cd_d1": F.regexp_extract(a, C.ADDR_CITY_DISTRICT, 2),
        "_cd_c2": F.regexp_extract(a, C.ADDR_CITY_ONLY, 1)})
    c1, d1, c2 = F.col("_cd_c1"), F.col("_cd_d1"), F.col("_cd_c2")
    absent = ~_addr_present(a)
    return staged.withColumns({
        city: F.when(absent, F.lit(None).cast("string")).when(c1 != "", c1).when(c2 != "", c2).otherwise(F.lit("")),
        district: F.when(absent, F.lit(None).cast("string")).when(c1 != "", d1).when(c2 != "", F.lit("")).otherwise(a),
    }).drop("_cd_c1", "_cd_d1", "_cd_c2")


# --------------------------------------------------------------------------
# F5–F7 links
# --------------------------------------------------------------------------
def ensure_https(url) -> Column:
    """Prefix ``https:`` when non-empty and not already http(s).

    One ``regexp_replace`` (the input is referenced once, so an expensive
    input expression such as a regex extraction is evaluated once).
    """
    return F.regexp_replace(_col(url), r"(?s)^(?!https?:)(.+)$", "https:$1")


def link_urls_from_string(link) -> Column:
    """Parse the string form ``{'applyAnalyze': //..., 'job': //..., 'cust': //...}``."""
    s = _col(link)
    present = s.isNotNull() & (s != "")

    def one(p):
        return F.when(present, ensure_https(F.regexp_extract(s, p, 1)))

    return F.struct(one(C.LINK_APPLY_PATTERN).alias("applyAnalyze"),
                    one(C.LINK_JOB_PATTERN).alias("job"),
                    one(C.LINK_CUST_PATTERN).alias("cust"))


def link_urls_from_struct(link) -> Column:
    """Struct form: each URL defaults to "" and gets the https prefix."""
    s = _col(link)

    def one(f):
        return F.when(s.isNotNull(), ensure_https(F.coalesce(s.getField(f), F.lit(""))))

    return F.struct(one("applyAnalyze").alias("applyAnalyze"),
                    one("job").alias("job"), one("cust").alias("cust"))


# --------------------------------------------------------------------------
# F8–F10 dates
# --------------------------------------------------------------------------
def parse_compact_date(s) -> Column:
    """Strict ``yyyyMMdd`` -> DATE (raises on bad input under ANSI)."""
    return F.to_date(_col(s), "yyyyMMdd")


def parse_date_lenient(s) -> Column:
    """``yyyy-MM-dd`` text or DATE -> DATE; bad text -> NULL."""
    return F.try_to_date(_col(s).cast("string"))


def month_label(d, fmt: str = C.MONTH_FORMAT) -> Column:
    return F.date_format(_col(d), fmt)


# --------------------------------------------------------------------------
# F11 growth label
# --------------------------------------------------------------------------
def growth_pct(first, growth) -> Column:
    """growth / first * 100 rounded half-even to 2 places (NULL when first = 0)."""
    f, g = _col(first), _col(growth)
    return F.when(f != 0, F.bround(g / f * F.lit(100.0), 2))


def growth_label(first, growth) -> Column:
    """``首次出現`` / ``0%`` when first is 0, else the percentage text.

    The text is the shortest decimal form of the 2-place value (``33.33%``,
    ``-100.0%``, ``12.5%``) — the same text Python prints for it — built
    with ``format_string`` so large values do not switch to E notation.
    """
    f, g = _col(first), _col(growth)
    txt = F.regexp_replace(F.format_string("%.2f", growth_pct(f, g)), "0$", "")
    return (F.when(f == 0, F.when(g > 0, F.lit(C.GROWTH_FIRST_SEEN)).otherwise(F.lit(C.GROWTH_ZERO)))
            .otherwise(F.concat(txt, F.lit("%"))))


# --------------------------------------------------------------------------
# F12 search URL
# --------------------------------------------------------------------------
def _form_encode(c: Column) -> Column:
    # Form encoding as Python's urlencode: keep '~', escape '*'.
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_url(keyword, page, area=None, industry=None, job_category=None,
               experience=None, education=None) -> Column:
    def v(c):
        if c is None:
            return F.lit("")
        return F.coalesce(_col(c).cast("string"), F.lit(""))

    params = [("keyword", v(keyword)), ("page", v(page)), ("area", v(area)),
              ("industry", v(industry)), ("jobCat", v(job_category)),
              ("exp", v(experience)), ("edu", v(education)),
              ("mode", F.lit(C.SEARCH_MODE)), ("jobsource", F.lit(C.SEARCH_JOBSOURCE))]
    pieces = []
    for i, (name, val) in enumerate(params):
        pieces.append(F.lit(("?" if i == 0 else "&") + name + "="))
        pieces.append(_form_encode(val))
    return F.concat(F.lit(C.SEARCH_API_URL), *pieces)


# --------------------------------------------------------------------------
# F13–F17
# --------------------------------------------------------------------------
def shelf_days_before_delisting(delisted, appear) -> Column:
    return F.datediff(_col(delisted), _col(appear))


def posting_key(name="jobName", company="custName") -> Column:
    """``name|company``; NULL when either side is NULL."""
    return F.concat(_col(name), F.lit("|"), _col(company))


def city_district_key(city="city", district="district") -> Column:
    return F.concat(_col(city), F.lit("-"), _col(district))


def keywords_text(keywords="search_keyword") -> Column:
    """Space-joined, lower-cased keyword list ('' for NULL)."""
    return F.lower(F.concat_ws(" ", _col(keywords)))


def as_keyword_array(kw, dtype: str = "array") -> Column:
    """String or array keyword column -> ARRAY<STRING> (never NULL)."""
    c = _col(kw)
    if dtype == "string":
        return F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(c, F.array().cast("array<string>"))


def parse_keyword_list(text) -> Column:
    """``'python, django,,'`` -> ['python', 'django']."""
    return F.filter(F.transform(F.split(_col(text), ","), lambda x: F.trim(x)),
                    lambda x: x != "")
