"""Titles, slugs, labels and other text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as trimmed at the ends of titles.
_SPACE = r"[\t\n\x0b\f\r \x85   -     　]+"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^" + _SPACE, ""), _SPACE + r"\z", "")


def normalized_title(title: Column) -> Column:
    """Trimmed, non-breaking spaces and line breaks as spaces, runs of spaces as one."""
    out = F.replace(_stripped(title), F.lit(" "), F.lit(" "))
    return _stripped(F.regexp_replace(F.regexp_replace(out, r"\r\n|\r|\n", " "), " +", " "))


def equalized_title(title: Column) -> Column:
    """Lower case, with plain quotes, dots for an ellipsis and a space for a hair space; equal for titles that count as equal."""
    out = F.translate(title, "’‘”“ ", "''\"\" ")
    return F.lower(F.replace(out, F.lit("…"), F.lit("...")))


def post_slug(title: Column, most_words: int = 10, most_chars: int = 100) -> Column:
    """The first words of a title with hyphens; words are dropped from the end while it is too long, and a single word is cut."""
    tokens = F.slice(F.regexp_extract_all(F.lower(title), F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), 1, most_words)
    longer = lambda acc, t: F.when(acc == "", t).otherwise(F.concat(acc, F.lit("-"), t))
    fits = F.aggregate(
        tokens,
        F.struct(F.lit("").alias("slug"), F.lit(True).alias("open")),
        lambda acc, t: F.when(
            acc["open"] & ((acc["slug"] == "") | (F.length(longer(acc["slug"], t)) <= most_chars)),
            F.struct(longer(acc["slug"], t).alias("slug"), F.lit(True).alias("open")),
        ).otherwise(F.struct(acc["slug"].alias("slug"), F.lit(False).alias("open"))),
        lambda acc: acc["slug"],
    )
    return F.substring(fits, 1, most_chars)


def guid(text: Column) -> Column:
    return F.sha2(text, 256)


def ordinal_suffix(number: Column) -> Column:
    rest = F.pmod(number, F.lit(100))
    return (
        F.when(rest.isin(11, 12, 13), "th")
        .when(F.pmod(rest, F.lit(10)) == 1, "st")
        .when(F.pmod(rest, F.lit(10)) == 2, "nd")
        .when(F.pmod(rest, F.lit(10)) == 3, "rd")
        .otherwise("th")
    )


def redacted_ip(ip: Column) -> Column:
    """The last two numbers of an address become 0.1."""
    return F.regexp_replace(ip, r".\d+.\d+$", ".0.1")


def rss_client(agent: Column) -> Column:
    return F.when(agent.startswith("Feedly/"), "Feedly").when(agent.contains("inoreader.com;"), "Inoreader").otherwise(agent)


#: Marks of user agents, tried in order; (kind, name, pattern with the version).
AGENTS = [
    ("bot", "Googlebot", r"Googlebot/?([0-9.]*)"),
    ("bot", "Bingbot", r"bingbot/?([0-9.]*)"),
    ("bot", "other", r"(?i)(?:bot|crawler|spider)[/ ;]?([0-9.]*)"),
    ("browser", "Edge", r"Edg(?:e|A|iOS)?/([0-9.]+)"),
    ("browser", "Opera", r"OPR/([0-9.]+)"),
    ("browser", "Firefox", r"Firefox/([0-9.]+)"),
    ("browser", "Chrome", r"(?:Chrome|CriOS)/([0-9.]+)"),
    ("browser", "Safari", r"Version/([0-9.]+).*Safari/"),
]
SYSTEMS = [
    ("Android", r"Android ([0-9.]+)"),
    ("iOS", r"(?:iPhone )?OS ([0-9_]+) like Mac"),
    ("Windows", r"Windows NT ([0-9.]+)"),
    ("macOS", r"Mac OS X ([0-9_.]+)"),
    ("Linux", r"Linux()"),
]


def user_platform(agent: Column) -> Column:
    """struct(browser, os_name, os_version, bot_name); for bots the first three are "Crawler"."""
    bot, browser = F.lit(None).cast("string"), F.lit("")
    for kind, name, pattern in reversed(AGENTS):
        if kind == "bot":
            bot = F.when(agent.rlike(pattern), F.lit(name)).otherwise(bot)
        else:
            browser = F.when(agent.rlike(pattern), F.lit(name)).otherwise(browser)
    system, version = F.lit(""), F.lit("")
    for name, pattern in reversed(SYSTEMS):
        system = F.when(agent.rlike(pattern), F.lit(name)).otherwise(system)
        version = F.when(agent.rlike(pattern), F.replace(F.regexp_extract(agent, pattern, 1), F.lit("_"), F.lit("."))).otherwise(version)
    of = lambda c: F.when(bot.isNotNull(), F.lit("Crawler")).otherwise(c)
    return F.struct(of(browser).alias("browser"), of(system).alias("os_name"), of(version).alias("os_version"), bot.alias("bot_name"))


def random_id(seed: Column) -> Column:
    """A URL-safe id that depends on the seed alone."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.substring(F.sha2(seed, 256), 1, 32))), "+/=", "-_ "))


def series(text: Column) -> Column:
    """Numbers of a ;-joined string; an empty string has none."""
    return F.transform(F.filter(F.split(text, ";"), lambda x: x != ""), lambda x: x.try_cast("double"))


def rms_deviation(a: Column, b: Column) -> Column:
    """Root of the mean square difference of two series of equal length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size(a))


def nice_maximum(x: Column) -> Column:
    """The least of 1, 2 and 5 times a power of ten that isn't under x."""
    ten = F.pow(F.lit(10.0), F.ceil(F.log10(x)))
    return F.when(ten / x >= 5, ten / 5).when(ten / x >= 2, ten / 2).otherwise(ten)


def escaped_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def truncated_payload(payload: Column, most: int = 4000) -> Column:
    """struct(payload, refetch): a payload of more bytes is dropped and its reader has to fetch it."""
    long = F.octet_length(payload) > most
    return F.struct(F.when(~long, payload).alias("payload"), long.alias("refetch"))


def archives_threshold(length: Column) -> Column:
    """How many of a feed's entries a list must have to be almost a match."""
    return F.when(length <= 3, length).when(length <= 7, length - 1).when(length <= 25, length - 2).when(length <= 62, length - 3).otherwise(length - 7)


def categories_threshold(length: Column) -> Column:
    return F.when(length <= 9, length).when(length <= 19, length - 1).otherwise(length - 2)


def normalized_classes(classes: Column) -> Column:
    """Class names in lower case, sorted and joined; names of single posts (post-N) are dropped."""
    names = F.filter(F.split(F.lower(classes), r"\s+"), lambda c: (c != "") & ~c.rlike(r"^post-\d+$"))
    return F.array_join(F.array_sort(names), " ")


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix; of a set of strings it is that of the least and the greatest."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.substring(a, F.lit(1), F.array_max(same))


def one_of(value: Column, allowed: Sequence[str]) -> Column:
    """The value if it is allowed, else null (enumerations are strings with a set of allowed values)."""
    return F.when(value.isin(*allowed), value)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, with one decimal, rounded half up in whole numbers; null for a whole of 0."""
    tenths = F.floor((2000 * part + whole) / F.nullif(2 * whole, F.lit(0)))
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
