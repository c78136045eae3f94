"""Labels, slot names, hour windows and thresholds.

Everything here must equal the values of the data deliveries and of the
published metric definitions, so it is kept in one place and passed around as
defaults that a caller may override.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# --- words in delivered files -------------------------------------------------
STATION_SUFFIX = "역"
LINE_SUFFIX = "호선"
DATE_WORD = "날짜"
BOARDING_WORD = "승차"
ALIGHTING_WORD = "하차"
TOTAL_WORD = "합계"
HOLIDAY_KIND = "공휴일구분"
EXTERNAL_STATION_CODE = "고유역번호(외부역코드)"
STATION_NUMBER = "역번호"

# role -> word searched for in a column name
KEY_WORDS = {
    "base_date": "날짜",
    "line": "호선",
    "station_no": "역번호",
    "station": "역명",
}

# words that keep a column from being an hour slot, per rule
NOT_A_SLOT = {
    "digit": ("역번호", "날짜", "역명", "구분", "합계", "연번", "호선"),
    "clock": ("합계", "날짜", "번호"),
}

# --- hour slots: before 06, eighteen clock hours, after 24 ----------------------
HOURS = tuple(range(5, 25))
SLOTS = (
    "06:00 이전",
    *(f"{h:02d}:00-{h + 1:02d}:00" for h in range(6, 24)),
    "24:00 이후",
)
SLOT_HOURS = dict(zip(SLOTS, HOURS))

# labels of the eleven two-hour bins
BIN_LABELS = (
    "06시 이전",
    *(f"{h:02d}-{h + 2:02d}시" for h in range(6, 24, 2)),
    "24시 이후",
)

# --- hour windows, inclusive; the four evenings differ on purpose ---------------
MORNING = (7, 9)
LUNCH = (11, 13)
EVENING_PEAK = (19, 23)
EVENING_PROFILE = (18, 21)
EVENING_SHORT = (18, 20)

# --- day labels -----------------------------------------------------------------
WEEKDAY = "평일"
WEEKEND = "주말"

# --- result labels ----------------------------------------------------------------
AREA_OFFICE, AREA_COMMERCIAL, AREA_MIXED = "오피스형", "상업/유흥형", "혼합형"
PROFILE_BIZ = {
    AREA_OFFICE: "샌드위치/커피",
    AREA_COMMERCIAL: "치킨/주점",
    AREA_MIXED: "일반식당/카페",
}
MONTHLY_BIZ = ("오피스/카페/조식테이크아웃", "주점/치킨/고깃집", "복합상권/일반음식점")
MATURITY = ("성장기", "성숙기", "정체/쇠퇴기")
DEFAULT_AREA = "복합 상권"
NO_BIZ = ("데이터 없음", "추천 업종 정보를 불러올 수 없습니다.")
OFFICE_REASON = "오피스 상권 중심 전략 추천"
EVENING_REASON = "저녁/주말 상권 특화 전략 추천"
DOWN, UP = "감소", "증가"
KEEP_STRATEGY = "기존 고객 유지 및 효율화 전략"
GROW_STRATEGY = "적극적인 마케팅 권장"
FLOW_TYPES = {
    "in": (
        "유입형 (상업/여가)",
        "퇴근 후 소비가 집중되는 핵심 상업지입니다.",
        ("음식점", "카페", "주점"),
    ),
    "out": (
        "유출형 (주거 중심)",
        "아침 출근 인구가 많은 주거 밀집 지역입니다.",
        ("편의점", "세탁소", "베이커리"),
    ),
    "mixed": (
        "복합형",
        "주거와 상업 기능이 혼재된 지역입니다.",
        ("브런치 카페", "피트니스", "드럭스토어"),
    ),
}

COLLATION = "UNICODE_CI_AI"


@dataclass(frozen=True)
class Thresholds:
    area_ratio: Decimal = Decimal("1.3")
    growth_above: Decimal = Decimal("1.05")
    mature_from: Decimal = Decimal("0.95")
    grade_s: float = 19.0
    grade_a: float = 16.5
    score_scale: float = 4.4
    traffic_divisor: int = 1_000_000
    recovery_band: float = 0.8
    heat_floor: float = 0.1


THRESHOLDS = Thresholds()
YEARS = (2017, 2018, 2019, 2020, 2021)
YEAR_WEIGHTS = {2018: 0.5}
