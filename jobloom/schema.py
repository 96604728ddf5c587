"""The canonical posting record and the small dimension tables.

Fixed values: names, codes, enums and limits that results depend on.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()
_REQUIRED = ("source_id", "source_job_id", "source_url", "title", "employer_name", "city", "province", "posted_at", "apply_url")

POSTING = T.StructType(
    [
        T.StructField(name, kind, name not in _REQUIRED)
        for name, kind in [
            ("source_id", _TEXT), ("source_job_id", _TEXT), ("source_url", _TEXT), ("title", _TEXT), ("employer_name", _TEXT),
            ("facility_name", _TEXT), ("description", _TEXT), ("city", _TEXT), ("province", _TEXT), ("posted_at", T.TimestampType()),
            ("closes_at", T.TimestampType()), ("employment_type", _TEXT), ("shift_type", _TEXT), ("salary_min", T.DecimalType(12, 2)),
            ("salary_max", T.DecimalType(12, 2)), ("salary_period", _TEXT), ("noc_code", _TEXT), ("apply_url", _TEXT),
        ]
    ]
)
REQUIRED = _REQUIRED

# Provinces.
PROVINCES = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador",
    "NS": "Nova Scotia", "NT": "Northwest Territories", "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island",
    "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}
# Categories, employment types, shifts and pay periods.
CATEGORIES = (
    "nursing", "physicians", "allied_health", "mental_health", "support_care", "paramedics", "diagnostics_lab", "pharmacy",
    "admin_clerical", "management", "research", "food_services", "environmental_services", "facilities_trades", "security",
)
EMPLOYMENT_TYPES = ("full_time", "part_time", "casual", "temporary", "contract")
SHIFTS = ("day", "evening", "night", "rotating", "weekend")
PERIODS = ("hour", "year")
# Source priority; sources not named come first.
AGGREGATORS = {"jobbank": 1, "adzuna": 2}
# Days and sizes.
EXPIRY_DAYS, UNSEEN_DAYS, RETENTION_DAYS, MAX_AGE_DAYS, CUTOFF_DAYS = 60, 7, 7, 60, 30
PAGE_SIZE, LAST_PAGE, LANDING_MINIMUM, PAY_MINIMUM, NOTIFY_CAP = 25, 400, 3, 5, 45
PROTECTED_SLUG = "rls-sentinel-inactive-do-not-delete"
