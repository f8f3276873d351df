"""Study parameters shared by every layer.

The defaults describe the driver-table binding (events from 2024-01-01, export cut part-way
through 2024-01-30).  ``StudyConfig.reference_study()`` gives the dates of the original
wearable export.  Thresholds are the published rule values and are the same for both.
"""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class StudyConfig:
    # first day of the study (week 1 starts here)
    study_start: date = date(2024, 1, 1)
    # first day that is removed as a partial export day (rule R5): keep dates < cutoff
    cutoff: date = date(2024, 1, 30)
    # R2 wear rule: steps > 0 AND tracked minutes >= min_wear_min
    min_wear_min: int = 600
    # R3 plausible heart-rate range (inclusive)
    bpm_low: int = 30
    bpm_high: int = 220
    # resting heart-rate estimate = this quantile of one day's readings
    resting_quantile: float = 0.05
    # bedtime clock: session starts before this hour belong to the previous evening
    bedtime_wrap_hour: int = 15
    # K-Means persona model
    persona_k: int = 4
    persona_n_init: int = 25
    elbow_max_k: int = 8
    elbow_n_init: int = 10
    seed: int = 42

    @property
    def last_full_day(self) -> date:
        from datetime import timedelta
        return self.cutoff - timedelta(days=1)

    @staticmethod
    def reference_study() -> "StudyConfig":
        return StudyConfig(study_start=date(2016, 4, 12), cutoff=date(2016, 5, 12))


# Fixed values of the published rules (must stay equal for equal results).
STEP_BANDS = [(5000, "1 Under 5k"), (7500, "2 5k-7.5k"), (10000, "3 7.5k-10k")]
STEP_BAND_TOP = "4 10k+"
SLEEP_BAND_ORDER = ["Short (< 6 h)", "Borderline (6-7 h)", "Healthy (7-9 h)", "Long (> 9 h)"]
WEEK_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# The published audit steps (step, rule, table, note).
AUDIT_STEPS = [
    ("01", "R5 partial last day removed", "daily_activity", "Export ended part-way through {cutoff}"),
    ("02", "R2 wear-time flag", "daily_activity", "Days with 0 steps or < 10 h tracked are flagged invalid"),
    ("03", "R1 duplicates removed", "sleep_day", "Exact duplicate nights removed"),
    ("04", "R1 duplicates removed", "minute_sleep", "Exact duplicate minutes removed"),
    ("05", "R5 partial last day removed", "hourly", "Steps, calories and intensity joined into one table"),
    ("06", "R3 impossible bpm removed", "heartrate", "Readings outside 30-220 bpm and the partial last day dropped"),
    ("07", "R4 Fat column dropped", "weight", "{missing} of {rows} Fat values were missing"),
]
# Columns of the published correlation matrices (nine on the dashboard, eleven in the study).
CORR_COLUMNS = ["steps", "distance_km", "very_active_min", "fairly_active_min", "lightly_active_min", "sedentary_min",
                "calories", "hours_asleep", "efficiency_pct"]
CORR_COLUMNS_ALL = [*CORR_COLUMNS, "minutes_in_bed", "bedtime_hour"]
# Columns of the published persona charts.
PERSONA_Z_FEATURES = ["avg_steps", "avg_calories", "avg_sedentary_min", "avg_light_min", "avg_mvpa_min", "valid_days"]
PAIR_COLUMNS = ["steps", "very_active_min", "sedentary_min", "hours_asleep", "bedtime_hour"]
PERSONA_FEATURES = ["avg_steps", "avg_sedentary_min", "avg_mvpa_min", "avg_light_min", "valid_days"]
