"""Tiny text-typed landing fixtures (all columns text, as exported) for the reference study dates."""
from __future__ import annotations

from strideframe.sources.landing import RAW_FILES, RawSources

U1, U2, U3 = "1001", "1002", "1003"


def _day(uid, date, steps, very, fairly, light, sed, cal=2000):
    return (uid, date, str(steps), "1.5", "1.5", "0.0", "0.5", "0.25", "0.75", "0.0",
            str(very), str(fairly), str(light), str(sed), str(cal))


DAILY = [
    _day(U1, "4/12/2016", 0, 0, 0, 0, 1440),            # steps 0 -> invalid
    _day(U1, "4/13/2016", 4999, 10, 10, 100, 479),      # tracked 599 -> invalid
    _day(U1, "04/14/2016", 5000, 10, 10, 100, 480),     # tracked 600 -> valid, band 2, mvpa 20
    _day(U1, "4/15/2016", 7499, 20, 10, 100, 570),      # valid, mvpa 30 -> met
    _day(U1, "4/16/2016", 7500, 5, 5, 100, 600),        # band 3
    _day(U1, "4/17/2016", 9999, 5, 5, 100, 600),        # band 3 (a Sunday)
    _day(U1, "4/18/2016", 10000, 40, 5, 100, 600),      # band 4
    _day(U1, "5/11/2016", 4999, 5, 5, 100, 600),        # last full day, band 1, valid
    _day(U1, "5/12/2016", 100, 0, 0, 10, 100),          # partial export day -> removed
    _day(U2, "4/20/2016", 300, 0, 0, 10, 90),           # user without any valid day
]
DAILY_STEPS = [(U1, "4/12/2016", "0"), (U1, "4/13/2016", "4998"), (U1, "4/15/2016", "7499"),
               (U2, "4/25/2016", "10")]                 # 4/13 differs; 4/25 only here
DAILY_CALORIES = [(U1, "4/12/2016", "2000"), (U1, "4/14/2016", "2000")]

SLEEP_DAY = [
    (U1, "4/13/2016 12:00:00 AM", "1", "359", "400"),
    (U1, "4/13/2016 12:00:00 AM", "1", "359", "400"),   # exact duplicate
    (U1, "4/14/2016 12:00:00 AM", "1", "360", "380"),
    (U1, "4/15/2016 12:00:00 AM", "1", "419", "430"),
    (U1, "4/16/2016 12:00:00 AM", "1", "420", "440"),
    (U1, "4/17/2016 12:00:00 AM", "2", "540", "560"),
    (U1, "4/18/2016 12:00:00 AM", "1", "541", "600"),
    (U1, "4/20/2016 12:00:00 AM", "1", "0", "0"),       # zero in bed -> efficiency NULL
    (U1, "5/12/2016 12:00:00 AM", "1", "300", "310"),   # partial day -> removed
]


def _minutes(uid, log, start_h, start_m, n, day, states):
    out = []
    for i in range(n):
        tot = start_h * 60 + start_m + i
        d = day + tot // 1440
        h, m = divmod(tot % 1440, 60)
        h12 = 12 if h % 12 == 0 else h % 12
        ampm = "AM" if h < 12 else "PM"
        out.append((uid, f"4/{d}/2016 {h12}:{m:02d}:00 {ampm}", str(states[i % len(states)]), str(log)))
    return out


MINUTE_SLEEP = (
    _minutes(U1, 1, 23, 30, 61, 12, [1, 1, 2, 1, 3])     # 11:30 PM -> 12:30 AM, across midnight
    + _minutes(U1, 1, 23, 30, 1, 12, [1])                # duplicated first minute
    + _minutes(U1, 2, 14, 59, 3, 14, [1])                # starts 2:59 PM -> counts as next night (38.98 h)
    + _minutes(U1, 3, 15, 0, 3, 14, [1])                 # starts 3:00 PM, same length, same wake date
)

HOURLY_STEPS = [(U1, "4/12/2016 12:00:00 AM", "10"), (U1, "4/12/2016 12:00:00 PM", "500"),
                (U1, "4/12/2016 1:00:00 PM", "700"), (U1, "5/12/2016 1:00:00 AM", "5")]
HOURLY_CAL = [(U1, "4/12/2016 12:00:00 AM", "60"), (U1, "4/12/2016 12:00:00 PM", "90"),
              (U1, "5/12/2016 1:00:00 AM", "61")]            # 1 PM missing here
HOURLY_INT = [(U1, "4/12/2016 12:00:00 AM", "0", "0.0"), (U1, "4/12/2016 12:00:00 PM", "30", "0.5"),
              (U1, "4/12/2016 1:00:00 PM", "40", "0.666667"), (U1, "5/12/2016 1:00:00 AM", "1", "0.016667")]

HEART = [(U3, "4/12/2016 7:00:00 AM", "29"), (U3, "4/12/2016 7:00:05 AM", "30"),
         (U3, "4/12/2016 7:00:10 AM", "220"), (U3, "4/12/2016 7:00:15 AM", "221"),
         (U3, "4/13/2016 8:00:00 AM", "75"),
         (U3, "4/14/2016 9:00:00 AM", "60"), (U3, "4/14/2016 9:00:05 AM", "62"),
         (U3, "4/14/2016 9:00:10 AM", "70"), (U3, "4/14/2016 9:00:15 AM", "90"),
         (U3, "5/12/2016 9:00:00 AM", "80")]
WEIGHT = [(U1, "4/12/2016 11:59:59 PM", "52.5", None, "22.5", "True"),
          (U1, "4/13/2016 8:00:00 AM", "53.0", "20.1", "22.7", "false"),
          (U3, "4/14/2016 8:00:00 AM", "80.0", None, "27.0", None)]


def raw_sources(spark) -> RawSources:
    def df(name, rows):
        cols = RAW_FILES[name]
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    return RawSources(df("dailyActivity", DAILY), df("dailySteps", DAILY_STEPS), df("dailyCalories", DAILY_CALORIES),
                      df("sleepDay", SLEEP_DAY), df("minuteSleep", MINUTE_SLEEP), df("hourlySteps", HOURLY_STEPS),
                      df("hourlyCalories", HOURLY_CAL), df("hourlyIntensities", HOURLY_INT),
                      df("heartrate_seconds", HEART), df("weightLogInfo", WEIGHT))
