"""Column expressions (built-in Spark functions only, no Python UDFs)."""

from .codes import (analyzed_flag, event_code, game_timestamp, rating_parse,  # noqa: F401
                    result_code, site_id, termination_code, time_control)
from .dates import (date_parts, day_name, first_int, minute_of_day,  # noqa: F401
                    months_since_start, time_string, weekday0)
from .ratings import bracket_label, bracket_lower, bround_gain, start_band  # noqa: F401
