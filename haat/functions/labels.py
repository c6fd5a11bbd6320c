"""Label tables (J4) and report texts.

FIXED VALUES — these strings must equal the reference's user-facing texts
for results to match; they are listed here plainly and in natural order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Weekday names, Monday first (campaign planner).
WEEKDAYS_EN = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKDAYS_BN = ["সোমবার", "মঙ্গলবার", "বুধবার", "বৃহস্পতিবার", "শুক্রবার", "শনিবার", "রবিবার"]
# Month names with season notes (seasonal predictor), January first.
MONTHS_BN_SEASON = ["জানুয়ারি", "ফেব্রুয়ারি", "মার্চ (রমজান)", "এপ্রিল (ঈদ)", "মে", "জুন",
                    "জুলাই", "আগস্ট", "সেপ্টেম্বর", "অক্টোবর", "নভেম্বর (শীত)", "ডিসেম্বর (শীত)"]
# Plain month names (date labels), January first.
MONTHS_EN = ["January", "February", "March", "April", "May", "June", "July", "August",
             "September", "October", "November", "December"]
MONTHS_BN = ["জানুয়ারি", "ফেব্রুয়ারি", "মার্চ", "এপ্রিল", "মে", "জুন", "জুলাই", "আগস্ট",
             "সেপ্টেম্বর", "অক্টোবর", "নভেম্বর", "ডিসেম্বর"]
# Upcoming-season advice: Ramadan (months 2, 3), Eid (3, 4), winter (10, 11), else normal.
SEASON_RAMADAN = "রমজান আসছে - খাদ্য ও পোশাক স্টক বাড়ান"
SEASON_EID = "ঈদ আসছে - পোশাক, প্রসাধনী, খেলনা স্টক বাড়ান"
SEASON_WINTER = "শীত আসছে - ইলেকট্রনিক্স, পোশাক স্টক বাড়ান"
SEASON_NORMAL = "স্বাভাবিক মৌসুম - নিয়মিত স্টক বজায় রাখুন"
# Stock alert texts: "order N units" / "stock is fine"; badge per status.
STOCK_ORDER_PREFIX = "অর্ডার দিন "
STOCK_ORDER_SUFFIX = " ইউনিট"
STOCK_OK = "স্টক ভালো আছে"
BADGE_CRITICAL = "জরুরি"
BADGE_WARNING = "সতর্কতা"
BADGE_OK = "ভালো"
# Recommendation sentences (value is prefixed to each).
TRENDS_ADVICE = " তে বেশি প্রচার চালান - সবচেয়ে বেশি বিক্রয় হয়!"
CUSTOMERS_ADVICE = " জন ক্রেতা ঝুঁকিতে আছে - তাদের জন্য বিশেষ অফার দিন!"
PROFIT_ADVICE = " সবচেয়ে লাভজনক - এটি বেশি প্রচার করুন!"
CAMPAIGN_ADVICE_1 = " তে ক্যাম্পেইন চালান এবং "
CAMPAIGN_ADVICE_2 = " এ ডিসকাউন্ট দিন"
RECOMMENDED_DISCOUNT = "15-20%"
# Hint appended to very short answers (under 40 characters).
SHORT_ANSWER_HINT = "\n\nRecommendation: provide more context or ask for examples to get a fuller answer."
# ---------------------------------------------------------------------------


def pick(values: list[str], idx0: Column) -> Column:
    """Label lookup by a 0-based index column (a literal array, no join)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx0 + 1)


def weekday_num(dt: Column) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(dt)


def weekday_name(dt: Column) -> Column:
    """English weekday name."""
    return F.date_format(dt, "EEEE")


def upcoming_season(month: Column) -> Column:
    """first matching rule wins, so month 3 is Ramadan, not Eid."""
    return (F.when(month.isin(2, 3), F.lit(SEASON_RAMADAN))
            .when(month.isin(3, 4), F.lit(SEASON_EID))
            .when(month.isin(10, 11), F.lit(SEASON_WINTER))
            .otherwise(F.lit(SEASON_NORMAL)))


def status_badge(status: Column) -> Column:
    return (F.when(status == "critical", F.lit(BADGE_CRITICAL))
            .when(status == "warning", F.lit(BADGE_WARNING))
            .otherwise(F.lit(BADGE_OK)))


def date_text(dt: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """a date as text (the ingestion format by default)."""
    return F.date_format(dt, fmt)


def date_label(dt: Column, lang: str = "en") -> Column:
    """"weekday day month year" (e.g. ``Thursday 15 January 2026``)."""
    days = WEEKDAYS_BN if lang == "bn" else WEEKDAYS_EN
    months = MONTHS_BN if lang == "bn" else MONTHS_EN
    return F.concat_ws(" ", pick(days, F.weekday(dt)), F.dayofmonth(dt).cast("string"),
                       pick(months, F.month(dt) - 1), F.year(dt).cast("string"))
