from strideframe.functions.compat import (  # noqa: F401
    rnd, weekday_name, iso_dow, study_week, text_to_int, text_to_long, text_to_double,
    parse_date, parse_ts, clock_hhmm, safe_div, band,
)
