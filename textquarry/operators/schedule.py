"""Cron rules (STM-09)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: names of the days, from Sunday.
DAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def field(text: str, low: int, high: int) -> list[int]:
    """The values that a field of a rule names: *, a number, a list, a range, steps of either."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first = low if span == "*" else int(a)
        last = high if span == "*" or (step and not b) else int(b or a)
        out |= set(range(first, last + 1, int(step or 1)))
    return sorted(x for x in out if low <= x <= high)


#: Shapes of a rule and what is said of them, the first that matches; names in braces are fields of the rule.
#: N is a number, * the star, ? anything, !* anything but the star, */n steps.
SHAPES = (
    ("* * * * *", "every minute"),
    ("*/n * * * *", "every {n} minutes"),
    ("0 */n * * *", "every {n} hours"),
    ("0 * * * *", "every hour"),
    ("N N * * *", "daily at {clock}"),
    ("? ? !* !* ?", "on day {day} of month {month} at {hour}:{minute}"),
    ("? ? ? ? N", "weekly on {weekday} at {hour}:{minute}"),
    ("? ? ? ? ?", "at {hour}:{minute}"),
)
_FIELDS = ("minute", "hour", "day", "month", "weekday")


def described(rule: Column) -> Column:
    """STM-09: rules of five fields in words; null for anything else."""
    fields = F.split(F.regexp_replace(rule, r"^\s+|\s+$", ""), r"\s+")
    value = {name: F.get(fields, F.lit(i)) for i, name in enumerate(_FIELDS)}
    hour = F.try_to_number(value["hour"], F.lit("99999")).cast("int")
    said = {
        **value,
        "clock": F.concat(F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12).cast("string"), F.lit(":"), F.lpad(F.regexp_replace(value["minute"], "^0+(?=.)", ""), 2, "0"), F.when(hour < 12, F.lit(" am")).otherwise(F.lit(" pm"))),
        "weekday": F.coalesce(F.get(F.array(*map(F.lit, DAYS)), F.try_to_number(value["weekday"], F.lit("99999")).cast("int")), value["weekday"]),
    }

    def fits(c: Column, kind: str) -> Column:
        tests = {"N": c.rlike("^[0-9]+$"), "?": F.lit(True), "!*": c != "*", "*/n": c.startswith("*/")}
        return tests[kind] if kind in tests else c == kind

    def phrase(text: str, steps: Column) -> Column:
        parts = re.split(r"\{(\w+)\}", text)
        return F.concat(*[F.lit(x) if i % 2 == 0 else said.get(x, steps) for i, x in enumerate(parts)])

    out = F.lit(None).cast("string")
    for shape, text in reversed(SHAPES):
        kinds = shape.split()
        steps = next((F.substr(value[_FIELDS[i]], F.lit(3)) for i, k in enumerate(kinds) if k == "*/n"), F.lit(""))
        ok = reduce(lambda x, y: x & y, [fits(value[name], k) for name, k in zip(_FIELDS, kinds, strict=True)])
        out = F.when(ok, phrase(text, steps)).otherwise(out)
    return F.when(F.size(fields) == len(_FIELDS), out)


def next_fire(ts: Column, rule: str, days: int = 365) -> Column:
    """STM-09: the first minute after ts's that the rule names, null if there is none within `days` days; 0 is Sunday
    (Q6). All five fields have to hold. Days are tried one by one, and of a day only the minutes that the rule names."""
    minute, hour, day, month, weekday = rule.split()
    times = [h * 60 + m for h in field(hour, 0, 23) for m in field(minute, 0, 59)]
    if not times:
        return F.lit(None).cast("timestamp_ntz")
    today, now = F.to_date(ts), F.hour(ts) * 60 + F.minute(ts)

    def named(d: Column) -> Column:
        ok = F.lit(True)
        for value, text, low, high in ((F.dayofmonth(d), day, 1, 31), (F.month(d), month, 1, 12), (F.dayofweek(d) - 1, weekday, 0, 6)):
            if text != "*":
                ok = ok & value.isin(field(text, low, high))
        return ok

    later = F.get(F.filter(F.lit(times), lambda t: t > now), F.lit(0))
    at = lambda d, t: (F.unix_date(d).cast("long") * 86_400 + t * 60)
    following = F.get(F.filter(F.sequence(F.date_add(today, 1), F.date_add(today, days)), named), F.lit(0))
    seconds = F.coalesce(F.when(named(today), at(today, later)), at(following, F.lit(times[0])))
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")
