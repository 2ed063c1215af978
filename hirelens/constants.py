"""Fixed values.

Every value in this module must equal the one the original job-market
dashboard and crawler use, or results (labels, buckets, URLs, codes) differ.
They are stated plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must match the original application exactly.
# ---------------------------------------------------------------------------

# Posting status values.
STATUS_ACTIVE = "active"
STATUS_INACTIVE = "inactive"

# Posting and search URLs.
JOB_URL_BASE = "https://www.104.com.tw/job/"
SEARCH_API_URL = "https://www.104.com.tw/jobs/search/list"
# Fixed search parameters appended to every search URL, in order.
SEARCH_MODE = "s"
SEARCH_JOBSOURCE = "index"

# Address split patterns (city + district, city only).
ADDR_CITY_DISTRICT = r"^(.*?[市縣])(.*?[區鄉鎮市])$"
ADDR_CITY_ONLY = r"^(.*?[市縣])$"

# Link-string extraction patterns.
LINK_APPLY_PATTERN = r"'applyAnalyze':\s*(//[^,}]+)"
LINK_JOB_PATTERN = r"'job':\s*(//[^,}]+)"
LINK_CUST_PATTERN = r"'cust':\s*(//[^,}]+)"

# Applicant / salary label tokens.
APPLY_PEOPLE_TOKEN = "人"
OPEN_BAND_PREFIX = "大於"
RANGE_TOKEN = "~"
SALARY_MONTHLY_TOKEN = "月薪"
SALARY_HOURLY_TOKEN = "時薪"
SALARY_STRIP_CHARS = "元,"
HOURS_PER_MONTH = 160

# Competition level labels and the applicant bands that select them.
LOW_COMPETITION_BANDS = ["0~5人應徵"]
HIGH_COMPETITION_BANDS = ["大於30人應徵"]
COMPETITION_LOW = "低"
COMPETITION_MEDIUM = "中等"
COMPETITION_HIGH = "高"

# Shelf-day thresholds (long unfilled: > 30 days, recent: < 30 days).
LONG_UNFILLED_DAYS = 30
RECENT_DAYS = 30

# Shelf-time buckets for delisted postings: [0,7) [7,30) [30,90) [90,inf).
DURATION_EDGES = [0, 7, 30, 90]
DURATION_LABELS = ["少於7天", "7-30天", "30-90天", "超過90天"]

# Growth-rate labels.
GROWTH_FIRST_SEEN = "首次出現"
GROWTH_ZERO = "0%"

# Missing-value label used by the analysis projection.
UNKNOWN_LABEL = "未知"

# Relative date ranges of the dashboard, in days (None = all time).
DATE_RANGES = {"all": None, "last_7_days": 7, "last_30_days": 30, "last_90_days": 90}

# Month label formats.
MONTH_FORMAT = "yyyy-MM"
MONTH_LABEL_FORMAT = "yyyy年MM月"

# Target-city substrings for leaf area codes under the Taiwan root.
TAIWAN_AREA_ROOT = "6001000000"
TARGET_CITY_SUBSTRINGS = ["台北市", "新北市", "桃園", "新竹"]

# City map coordinates (city, lon, lat).
CITY_COORDINATES = [
    ("台北市", 121.5598, 25.0598),
    ("新北市", 121.4657, 25.0125),
    ("桃園市", 121.3010, 24.9936),
    ("台中市", 120.6839, 24.1377),
    ("台南市", 120.2141, 23.0008),
    ("高雄市", 120.3011, 22.6273),
    ("新竹市", 120.9647, 24.8138),
    ("新竹縣", 121.0165, 24.8390),
    ("基隆市", 121.7419, 25.1287),
]

# Built-in code dictionaries (code, name), used when no code-table file is given.
BUILTIN_AREA_CODES = [
    ("6001001000", "台北市"),
    ("6001002000", "新北市"),
    ("6001005000", "桃園市"),
    ("6001006000", "新竹市"),
    ("6001007000", "新竹縣"),
    ("6001008000", "台中市"),
    ("6001016000", "台南市"),
    ("6001017000", "高雄市"),
]
BUILTIN_JOB_CAT_CODES = [
    ("2007001000", "軟體工程師"),
    ("2007002000", "資料分析師"),
    ("2007003000", "網站開發工程師"),
    ("2007004000", "前端工程師"),
    ("2007005000", "後端工程師"),
    ("2007006000", "資料庫工程師"),
    ("2007007000", "AI工程師"),
]
BUILTIN_INDUSTRY_CODES = [
    ("1001000000", "資訊科技業"),
    ("1002000000", "金融業"),
    ("1003000000", "製造業"),
    ("1004000000", "服務業"),
    ("1005000000", "教育業"),
]

# Standard display columns (English names of the analysis projection), in order.
DISPLAY_COLUMNS = [
    "city", "district", "job_name", "company_name", "shelf_days", "appear_date",
    "link", "salary_desc", "apply_desc", "experience", "education", "keywords",
]

# Display headers of the original dashboard for the analysis projection.
DISPLAY_LABELS = {
    "job_no": "職缺編號",
    "job_name": "職稱",
    "company_name": "公司名稱",
    "city": "城市",
    "district": "地區",
    "keywords": "關鍵字",
    "link": "連結",
    "apply_desc": "應徵人數範圍",
    "salary_desc": "薪資範圍",
    "experience": "工作經驗",
    "education": "教育程度",
    "appear_date": "上架日期",
    "shelf_days": "在架天數",
    "long_unfilled": "是否長期未招滿",
    "recent": "近期發布的職缺",
    "delisted_label": "下架日期",
}

# Rows of the newest-postings export.
RECENT_EXPORT_ROWS = 50
