"""Dates in free text, as expressions: a strict ISO pattern, and a grammar of written dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and their short forms.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def iso_date(text: Column) -> Column:
    """The date of a YYYY-MM-DD that no digit touches, in 1900 to 2199; texts with d/d have none."""
    found = F.regexp_extract(text, r"(?:\D|^)((?:19|20|21)\d\d-\d\d-\d\d)(?:\D|$)", 1)
    return F.when(~text.rlike(r"\d/\d"), F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd"))


#: The years before the first of each Japanese era, hours that zones are ahead of UTC, and bytes that are read at most.
ERAS = {"m": 1867, "t": 1911, "s": 1925, "h": 1988, "r": 2018}
ZONES = {"utc": 0, "gmt": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "bst": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3, "msk": 3, "ist": 5.5, "jst": 9}
MOST_BYTES = 128

_MON, _NUM, _SIGNED = "(" + "|".join(m[:3] for m in MONTHS) + ")", r"('?\d+)", r"('?[-+]?\d+)"
_AFTER, _ERA_WORD, _BC = r"[^-\d\s']*", r"(?:[bac]\.?[cde]\.?e?\.?)?", r"\bb\.?c(?:\.?e)?\b"
#: Forms of dates in the order in which they are tried: a pattern, and which groups are year, month, day, or w(eek), o(rdinal day), e(ra).
_GRAMMAR = (
    (rf"{_NUM}[^-\d\s]*\s*(?:of\s+)?{_MON}{_AFTER}(?:\s*{_ERA_WORD}\s*('?-?\d+))?", "dmy"),
    (rf"\b{_MON}{_AFTER}\s*{_NUM}{_AFTER}(?:\s*,?\s*{_ERA_WORD}\s*('?-?\d+))?", "mdy"),
    (rf"{_SIGNED}-(\d+)-('?-?\d+)", "ymd"),
    (r"\b(\d{4}|\d{2})-?w(\d{2})(?:-?([1-7]))?\b", "ywd"),
    (r"\b(\d{4}|\d{2})-(\d{3})\b", "yo"),
    (r"--(\d{2})-?(\d{2})\b", "md"),
    (r"\b([mtshr])(\d+)\.(\d+)\.(\d+)", "eymd"),
    (rf"('?-?\d+)-{_MON}[^-/.]*-('?-?\d+)", "dmy"),
    (rf"\b{_MON}[^-/.\d]*-('?-?\d+)-('?-?\d+)", "mdy"),
    (r"('?-?\d+)/\s*('?\d+)(?:\D\s*('?-?\d+))?", "ymd"),
    (r"('?-?\d+)\.\s*('?\d+)\.\s*('?-?\d+)", "ymd"),
    (r"\b(\d{4})(\d{2})(\d{2})(?:t?\d{2,6})?\b", "ymd"),
    (r"\b(\d{4})(\d{3})\b", "yo"),
    (r"\b(\d{2})(\d{2})(\d{2})\b", "ymd"),
    (r"\b(\d{2})(\d{3})\b", "yo"),
    (r"\b(\d{2})(\d{2})\b", "md"),
    (r"\b(\d{3})\b", "o"),
    (rf"\b{_MON}\S*", "m"),
    (r"(?:^|\D)(\d{1,2})(?:st|nd|rd|th)\b", "d"),
    (r"'(\d+)\b", "y"),
    (r"\b(\d{2})\b", "d"),
)
_TIME = r"(?<!\d)(\d{1,2})\s*(?:(?::\s*(\d{2})(?:\s*:\s*(\d{2})(?:[,.](\d+))?)?|h(?:\s*(\d{1,2})m?)?)\s*(?:([ap])\.?m\b\.?)?|([ap])\.?m\b\.?)"
_ZONE = r"\s*((?:gmt|utc)?[-+]\d{1,2}(?::?\d{2})?\b|(?:" + "|".join(ZONES) + r")\b)?"


def _month_number(text: Column) -> Column:
    return F.when(text.rlike("^'?[0-9]+$"), F.regexp_replace(text, "'", "").try_cast("int")).otherwise(((F.position(F.left(text, F.lit(3)), F.lit("".join(m[:3] for m in MONTHS))) + 2) / 3).cast("int"))


def _looks_like_year(text: Column) -> Column:
    return text.rlike(r"^('.*|[-+]?\d{3,}|-\d+)$")


def _part_of(text: Column, pattern: str, roles: str) -> Column:
    """struct(year, month, day, ordinal, week, era) as text of a form, null where the text hasn't the form."""
    got = {r: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i, r in enumerate(roles, 1)}
    none = F.lit(None).cast("string")
    return F.when(text.rlike(pattern), F.struct(*[got.get(r, none).alias(n) for r, n in (("y", "year"), ("m", "month"), ("d", "day"), ("o", "ordinal"), ("w", "week"), ("e", "era"))]))


def parsed_date(text: Column) -> Column:
    """struct(year, month, day, hour, minute, second, offset) of a date and time in free text, as far as they are there; offset in minutes from UTC. Null without any, or beyond MOST_BYTES.

    Forms (_GRAMMAR), the first that is there: day and month name, month name and day, ISO, ISO weeks and ordinal days, Japanese eras, dates with dashes and names, with slashes and dots, runs of digits, and single
    parts. Where a form's year can't be one and its day can (a mark before it, or three digits and more), they change places. Years of two digits are 1969 to 2068; BC counts
    back from 0. Parts are as written: whether a day exists isn't asked, but weeks and ordinal days are turned into months and days. JVM expressions only.
    """
    clean = F.lower(F.regexp_replace(text, r"[^-+',./:@A-Za-z0-9\[\]]+", " "))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def of(clean: Column) -> Column:
        timed = clean.rlike(_TIME)
        at = lambda i: F.nullif(F.regexp_extract(clean, _TIME + _ZONE, i), F.lit(""))
        half, hour = F.coalesce(at(6), at(7)), at(1).try_cast("int")
        hour = F.when(half.isNull(), hour).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
        zone = at(8)
        sign = F.when(F.contains(zone, F.lit("-")), -1).otherwise(1)
        digits = F.regexp_replace(F.regexp_extract(zone, r"[-+](.*)$", 1), ":", "")
        number = digits.try_cast("int")
        minutes = sign * F.when(F.length(digits) <= 2, number * 60).otherwise(F.floor(number / 100) * 60 + number % 100)
        named = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, int(v * 60))])
        offset = F.when(zone.rlike("[-+]"), minutes).otherwise(F.try_element_at(named, zone)).cast("int")
        minute = F.coalesce(at(2), at(5)).try_cast("int")
        rest = F.when(timed, F.regexp_replace(clean, _TIME + _ZONE, " ")).otherwise(clean)

        def parts(rest: Column) -> Column:
            found = F.coalesce(*[_part_of(rest, p, r) for p, r in _GRAMMAR])

            def made(p: Column) -> Column:
                swap = p["week"].isNull() & p["day"].isNotNull() & (p["year"].isNull() | ~_looks_like_year(p["year"])) & _looks_like_year(p["day"])
                y, d = F.when(swap, p["day"]).otherwise(p["year"]), F.when(swap, p["year"]).otherwise(p["day"])
                number = F.regexp_replace(y, "['+]", "").try_cast("int")
                era = F.create_map(*[F.lit(x) for k, v in ERAS.items() for x in (k, v)])
                year = F.when(p["era"].isNotNull(), number + F.try_element_at(era, p["era"])).when(rest.rlike(_BC), 1 - number)
                year = year.when((F.length(F.regexp_replace(y, "'", "")) <= 2) & (number >= 0), number + F.when(number >= 69, 1900).otherwise(2000)).otherwise(number)
                day = F.regexp_replace(d, "'", "").try_cast("int")
                first = F.make_date(year, F.lit(1), F.lit(4))  # is in the first week
                of_week = F.date_add(F.trunc(first, "week"), (p["week"].try_cast("int") - 1) * 7 + F.coalesce(day, F.lit(1)) - 1)
                of_year = F.date_add(F.make_date(F.coalesce(year, F.lit(2001)), F.lit(1), F.lit(1)), p["ordinal"].try_cast("int") - 1)
                whole = F.when(p["week"].isNotNull(), of_week).when(p["ordinal"].isNotNull(), of_year)
                return F.struct(
                    F.when(whole.isNotNull() & year.isNotNull(), F.year(whole)).otherwise(year).alias("year"),
                    F.coalesce(F.month(whole), _month_number(p["month"])).alias("month"),
                    F.coalesce(F.day(whole), day).alias("day"),
                    F.when(timed, hour).alias("hour"), F.when(timed, minute).alias("minute"), F.when(timed, at(3).try_cast("int")).alias("second"), F.when(timed, offset).alias("offset"),
                )

            empty = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("year", "month", "day", "ordinal", "week", "era")])
            return F.when(found.isNotNull() | timed, once(F.coalesce(found, empty), made))

        return once(rest, parts)

    return F.when(F.octet_length(text) <= MOST_BYTES, once(clean, of))


def found_date(text: Column, year: Column | None = None) -> Column:
    """The date that a text holds: a strict ISO one, else one by `parsed_date` with a month and a day, of which the year (its last two digits at least) and the day are numbers of the text.

    `year` stands in for a missing one. Texts without a digit, or with a digit on either side of a slash (day and month can't be told apart), have none; neither has a day that the calendar doesn't know.
    """
    text = F.trim(text)
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    has = lambda value: F.array_contains(numbers, value)

    def of(p: Column) -> Column:
        written = p["year"].cast("string")
        known = F.when(p["year"].isNotNull(), F.when(has(written) | has(F.right(written, F.lit(2))), p["year"]))
        known = known.otherwise(year) if year is not None else known
        day = F.when(has(p["day"].cast("string")) | has(F.lpad(p["day"].cast("string"), 2, "0")), p["day"])
        return F.try_to_date(F.concat_ws("-", F.lpad(known.cast("string"), 4, "0"), F.lpad(p["month"].cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")

    loose = F.get(F.transform(F.array(parsed_date(text)), of), F.lit(0))
    return F.when(text.rlike(r"\d") & ~text.rlike(r"\d/\d"), F.coalesce(iso_date(text), loose))
