"""Crawl pacing: delay and concurrency of a host after its answers, as a fold of clamped lines.

An answer halves the concurrency and doubles the delay (throttled), or raises the one by a tenth and lowers
the other by a fifth (good), or changes nothing; a Retry-After raises the delay to what it asks for. Each of these
is a clamped straight line of the delay and one of the scale, and such lines compose, so hosts of any
number of answers are folded in pieces (functions.folds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlift.functions.folds import line, lines, on_line, ordered_fold

#: Answers that throttle, the least delay that is doubled, and the steps of delay and scale.
THROTTLED, LEAST_DELAY, SLOWER, FASTER, LEAST_SCALE, MORE = (429, 503), 0.25, 2.0, 0.8, 0.25, 0.1


def answer_step(base: float, top: float) -> Column:
    """status_code, bot_blocked, retry_after -> the step of one answer: lines of delay and scale, and whether it throttled.

    An answer without a status changes nothing; a Retry-After that is no number of seconds is not there. It counts after its answer.
    """
    status = F.col("status_code")
    slow = F.coalesce(F.col("bot_blocked"), F.lit(False)) | F.coalesce(status.isin(*THROTTLED), F.lit(False))
    good = F.coalesce(status < 400, F.lit(False))
    delay = F.when(slow, line(SLOWER, 0, SLOWER * max(base, LEAST_DELAY), top)).when(good, line(FASTER, 0, base)).otherwise(line())
    # Seconds as a plain decimal number; white space around it counts nothing.
    seconds = F.regexp_extract(F.coalesce(F.trim(F.col("retry_after").cast("string")), F.lit("")), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$", 0)
    floor = F.least(F.lit(float(top)), F.greatest(F.lit(0.0), F.nullif(seconds, F.lit("")).cast("double")))
    delay = F.when(floor.isNull(), delay).otherwise(lines(delay, line(lo=floor, hi=top)))
    scale = F.when(slow, line(0.5, 0, LEAST_SCALE)).when(good, line(1, MORE, float("-inf"), 1)).otherwise(line())
    return F.struct(delay.alias("delay"), scale.alias("scale"), slow.cast("bigint").alias("throttled"))


def both(first: Column, then: Column) -> Column:
    return F.struct(lines(first.delay, then.delay).alias("delay"), lines(first.scale, then.scale).alias("scale"), (first.throttled + then.throttled).alias("throttled"))


def host_steps(answers: DataFrame, base: float = 0.15, top: float = 30.0) -> DataFrame:
    """answers (host, ts, event_id, status_code, bot_blocked, retry_after) -> the step of each host over all its answers, by time and then id."""
    return ordered_fold(answers, ["host"], ["ts", "event_id"], answer_step(max(0.0, base), max(base, top)), both)


def paced(answers: DataFrame, base: float = 0.15, top: float = 30.0, configured: int = 8) -> DataFrame:
    """Per host the delay, the scale, the throttled answers and the requests at once after all its answers."""
    s = F.col("step")
    return shown(host_steps(answers, base, top).select("host", on_line(s.delay, F.lit(float(base))).alias("delay"), on_line(s.scale, F.lit(1.0)).alias("scale"), s.throttled.alias("throttled")), configured)


def shown(states: DataFrame, configured: int = 8) -> DataFrame:
    """States (host, delay, scale, throttled) with what the scale leaves of the configured requests at once, one at least."""
    scale = F.round("scale", 6)
    return states.select("host", F.round("delay", 6).alias("delay"), scale.alias("scale"), "throttled", F.greatest(F.lit(1), F.floor(F.round(scale * configured, 6))).cast("int").alias("concurrency"))


#: Answers of the sample hosts: each user is one of forty; errors are throttled, sign-ups not found; some answers are bot walls, some have a Retry-After.
ANSWERS_CTE = """answers AS (SELECT user_id % 40 AS host, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS i, CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 404 ELSE 200 END AS status, event_id % 31 = 0 AS bot,
 CASE WHEN event_id % 17 = 0 THEN CAST(event_id % 45 AS DOUBLE) WHEN event_id % 17 = 2 THEN 1.5 END AS after FROM events)"""


PACED_SQL = f"""WITH RECURSIVE {ANSWERS_CTE}, walk AS (SELECT DISTINCT host, CAST(0 AS BIGINT) AS i, CAST(0.15 AS DOUBLE) AS delay, CAST(1 AS DOUBLE) AS scale, CAST(0 AS BIGINT) AS throttled FROM answers
UNION ALL SELECT a.host, a.i, least(30, greatest(CASE WHEN bot OR status = 429 THEN least(30, greatest(delay, 0.25) * 2) WHEN status < 400 THEN greatest(0.15, delay * 0.8) ELSE delay END, coalesce(after, 0))),
 CASE WHEN bot OR status = 429 THEN greatest(0.25, scale / 2) WHEN status < 400 THEN least(1, scale + 0.1) ELSE scale END, throttled + CAST(bot OR status = 429 AS BIGINT) FROM walk w JOIN answers a ON a.host = w.host AND a.i = w.i + 1)
SELECT host, round(delay, 6) AS delay, round(scale, 6) AS scale, throttled, CAST(greatest(1, floor(round(scale * 8, 6))) AS INT) AS concurrency FROM walk QUALIFY row_number() OVER (PARTITION BY host ORDER BY i DESC) = 1"""
