"""URL canonicalisation as column expressions.

A link is resolved against its page, accepted if it is http(s) without user info, and stripped of default
ports, doubled slashes and its fragment. A canonical URI keeps host, a non-default port, the path and ten query
keys, and so makes links comparable; `uri_key` turns a configurable equality into a string that joins can use.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query keys that tell pages apart.
QUERY_KEYS = ("page", "year", "m", "start", "offset", "skip", "updated-max", "sort", "order", "format")

#: Blanks, plain and percent-encoded.
_BLANK = r"(?i)(?: |\t|\n|\x00|\x0b|\f|\r|%20|%09|%0a|%00|%0b|%0c|%0d)+"


def bare_host(url: Column) -> Column:
    """Host and port of an absolute URL, without a leading www."""
    return F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1), r"^www\.", "")


def short_url(url: Column) -> Column:
    """The URL without scheme and leading www."""
    return F.regexp_replace(url, r"^[a-z]+://(www\.)?", "")


def cleaned(url: Column) -> Column:
    """Without blanks at either end (plain or percent-encoded) and without line feeds."""
    url = F.regexp_replace(F.regexp_replace(url, "^" + _BLANK, ""), _BLANK + r"\z", "")
    return F.replace(url, F.lit("\n"), F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(url: Column) -> Column:
    """struct(scheme, net, authority, path, query) of an address, with one mark before the authority in `net` and before the query in `query`."""
    pattern = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
    # one match: its groups with a character between them that no address has after cleaning
    marked = F.split(F.regexp_replace(url, pattern, "$1\uffff$2\uffff$3\uffff$4\uffff$5"), "\uffff")
    names = ("scheme", "net", "authority", "path", "query")
    return _let(marked, lambda m: F.struct(*[F.coalesce(F.get(m, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]))


def _dots_removed(path: Column) -> Column:
    """A path without "." and ".." segments; ".." drops the segment before it."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.filter(parts, lambda p: p != "."),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.array_join(kept, "/")
    return F.when(last.isin(".", "..") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def canonical_link(url: Column, base: Column | None = None) -> Column:
    """The absolute URL of a link on the page `base`, or null if it is rejected.

    Rejected: other schemes, user info, schemes without "//", ports that aren't numbers, blanks in the host, broken percent escapes in the host.
    """
    base = F.lit(None).cast("string") if base is None else base

    def made(two: Column) -> Column:
        own, page = two["own"], two["page"]
        scheme, authority, path, query = F.lower(own["scheme"]), own["authority"], own["path"], own["query"]
        has_authority = own["net"] != ""
        base_dir = F.regexp_replace(page["path"], r"[^/]*$", "")
        base_dir = F.when(base_dir == "", F.lit("/")).otherwise(base_dir)
        relative = (scheme == "") & two["based"]
        resolved_path = F.when((path == "") & ~has_authority, page["path"]).otherwise(
            _dots_removed(F.when(has_authority | path.startswith("/"), path).otherwise(F.concat(base_dir, path)))
        )
        opaque = (scheme != "") & ~has_authority & ~path.startswith("/")
        whole = F.struct(
            F.when(relative, F.lower(page["scheme"])).otherwise(scheme).alias("scheme"),
            F.when(relative & ~has_authority, page["authority"]).otherwise(authority).alias("authority"),
            F.replace(F.when(relative, resolved_path).otherwise(path), F.lit("//"), F.lit("/")).alias("path"),
            F.when(relative & ~has_authority & (path == "") & (query == ""), page["query"]).otherwise(query).alias("query"),
            (~opaque & ((scheme == "") | (authority != "") | (path != ""))).alias("fits"),
        )

        def rendered(w: Column) -> Column:
            host = F.when(w["scheme"] == "http", F.regexp_replace(w["authority"], r":80$", "")).otherwise(F.regexp_replace(w["authority"], r":443$", ""))
            good = w["fits"] & w["scheme"].isin("http", "https") & ~w["authority"].contains("@") & w["authority"].rlike(r"^[^:\s%<>\"]*(?::[0-9]*)?$")
            return F.when(good, F.concat(w["scheme"], F.lit("://"), host, w["path"], w["query"]))

        return _let(whole, rendered)

    link = cleaned(url)
    return F.when(link.isNotNull(), _let(F.struct(_parts(link).alias("own"), _parts(base).alias("page"), base.isNotNull().alias("based")), made))


def canonical_uri(link: Column) -> Column:
    """struct(host, port, path, trimmed_path, query) of a canonical link; null for null.

    The port is empty where it is the scheme's own. The path of a bare root is empty.
    Of the query, known keys with their first values stay, sorted by key.
    """

    def made(own: Column) -> Column:
        scheme, authority, query = own["scheme"], own["authority"], F.substring(own["query"], 2, 2**31 - 1)
        host = F.regexp_replace(authority, r":[0-9]*$", "")
        port = F.regexp_extract(authority, r"(:[0-9]+)$", 1)
        port = F.when(((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), F.lit("")).otherwise(port)
        path = F.when((own["path"] == "/") & (query == ""), F.lit("")).otherwise(own["path"])
        # the first token of each known key that there is, by key
        firsts = _let(
            F.split(query, "&"),
            lambda tokens: F.filter(
                F.transform(F.array(*[F.lit(k) for k in sorted(QUERY_KEYS)]), lambda k: F.get(F.filter(tokens, lambda t: F.substring_index(t, "=", 1) == k), F.lit(0))),
                lambda t: t.isNotNull(),
            ),
        )
        rendered = F.array_join(F.transform(firsts, lambda t: F.when(t.contains("="), t).otherwise(F.concat(t, F.lit("=")))), "&")
        rendered = F.when(rendered == "", F.lit("")).otherwise(F.concat(F.lit("?"), rendered))
        return F.struct(host.alias("host"), port.alias("port"), path.alias("path"), F.regexp_replace(path, r"/+$", "").alias("trimmed_path"), rendered.alias("query"))

    return F.when(link.isNotNull(), _let(_parts(link), made))


def canonical_string(curi: Column) -> Column:
    return F.concat(curi["host"], curi["port"], curi["path"], curi["query"])


def uri_key(curi: Column, same_hosts: Sequence[str] = (), expect_post_paths: bool = False) -> Column:
    """A string that is equal for URIs that count as equal.

    Hosts of the set `same_hosts` are one; paths are compared without slashes at their end; with
    expect_post_paths, paths like /post/123/any-title are equal if their numbers are.
    """
    server = F.concat(curi["host"], curi["port"])
    server = F.when(server.isin(*same_hosts), F.lit("__same_hosts")).otherwise(server) if same_hosts else server
    path = curi["trimmed_path"]
    if expect_post_paths:
        post = F.regexp_extract(path, r"^(/post/\d+)(?:/[^/]+)?$", 1)
        path = F.when(post != "", post).otherwise(path)
    return F.concat(server, path, curi["query"])


def path_ladder(url: Column) -> Column:
    """The URL without its query, and then each parent path down to the root, as an array; a slash at the end is dropped first."""
    base = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*", 0), r"/+$", "")
    head = F.regexp_extract(base, r"^[a-z]+://", 0)
    parts = F.split(F.regexp_replace(base, r"^[a-z]+://", ""), "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat(head, F.array_join(F.slice(parts, 1, n), "/")))


def path_class(path: Column) -> Column:
    """archives, main, post or other, by the end of the path. The patterns are fixed values."""
    return (
        F.when(path.rlike(r"/(?:[a-z-]*archives?|posts?|all(?:-[a-z]+)?)(?:\.[a-z]+)?$"), "archives")
        .when(path.rlike(r"/(?:(?:blog|articles|writing|journal|essays)(?:\.[a-z]+)?|index)$"), "main")
        .when(path.rlike(r"/\d{4}(/\d{2})?(/\d{2})?$"), "post")
        .otherwise("other")
    )


def url_date(url: Column) -> Column:
    """The date in /YYYY/MM/DD/, if month and day are possible numbers and the date exists."""
    pattern = r"/(\d{4})/(\d{2})/(\d{2})/"
    y, m, d = (F.regexp_extract(url, pattern, i).try_cast("int") for i in (1, 2, 3))
    return F.when(m.between(1, 12) & d.between(1, 31), F.try_to_date(F.regexp_replace(F.regexp_extract(url, pattern, 0), r"^/|/$", ""), "yyyy/MM/dd"))


def collapsed_referrer(referrer: Column, own_hosts: Sequence[str], label: str) -> Column:
    """null for none, one label for the site's own hosts, else the referrer itself."""
    host = F.regexp_extract(referrer, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(referrer == "", None).when(host.isin(*own_hosts), F.lit(label)).otherwise(referrer)


def preferred_feed(found: Column) -> Column:
    """Of the feeds found on the way up to the root (an array, nulls where there is none) the one that counts.

    A later one replaces an earlier one, unless that is below /blog/ or /posts/ and the later one isn't.
    """
    leaves = lambda a, b, part: a.contains(part) & ~b.contains(part)
    keeps = lambda a, b: b.isNull() | F.coalesce(leaves(a, b, "/blog/") | leaves(a, b, "/posts/"), F.lit(False))
    return F.aggregate(found, F.lit(None).cast("string"), lambda acc, f: F.when(keeps(acc, f), acc).otherwise(f))


def discovery_results(starts: DataFrame, fetched: DataFrame, links: DataFrame) -> DataFrame:
    """starts (url, ...) with `result`: not_a_url, unreachable, single, multiple, none, or bad.

    fetched: url, is_feed, is_whole, of what could be fetched; is_whole: the feed could be read (`sources.feeds.read_feeds` gives no error). links: url, link, the feed links of those that are pages; links that repeat
    count once. A feed that can't be read is bad.
    """
    counts = links.distinct().groupBy("url").agg(F.count("*").alias("_n"))
    known = fetched.select("url", "is_feed", F.col("is_whole").alias("_whole"))
    met = starts.join(known, "url", "left").join(counts, "url", "left")
    result = (
        F.when(canonical_link(F.col("url")).isNull(), "not_a_url")
        .when(F.col("is_feed").isNull(), "unreachable")
        .when(F.col("is_feed"), F.when(F.col("_whole"), "single").otherwise("bad"))
        .when(F.coalesce("_n", F.lit(0)) == 0, "none")
        .when(F.col("_n") == 1, "single")
        .otherwise("multiple")
    )
    return met.select(*starts.columns, result.alias("result"))
