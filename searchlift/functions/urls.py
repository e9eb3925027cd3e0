"""URL algebra as expressions: keys, resolution of references, normalisation of links."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that are no pages, and parameters that only track.
SKIPPED = tuple(
    ".7z .avi .avif .css .csv .doc .docx .eot .epub .gif .gz .ico .jpeg .jpg .js .json .m4a .m4v .mov .mp3 .mp4 .mpeg .pdf .png "
    ".ppt .pptx .rar .rss .svg .tar .tgz .tif .tiff .ttf .txt .wav .webm .webp .woff .woff2 .xls .xlsx .xml .zip".split()
)
TRACKING = frozenset("fbclid gclid dclid msclkid mc_cid mc_eid ref_src igshid yclid vero_conv vero_id".split())


def host_key(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"\.$", ""), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/"))


def path_key(url: Column) -> Column:
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.concat(path_of(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def page_url_key(url: Column) -> Column:
    """Host key, path without a trailing slash and query: the same for http and https."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.substring(F.concat(host_key(url), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), 1, 2100)


def covers(prop: Column, host: Column) -> Column:
    """Whether a property (sc-domain:... or a root URL) covers a host."""
    domain = F.regexp_extract(prop, "^sc-domain:(.+)$", 1)
    return F.when(domain != "", (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))).otherwise((host_key(prop) == host) & (path_of(prop) == "/"))


def normalised(raw: str | None, base: str, site: str) -> str | None:
    """The page a link leads to, in one spelling; None if it leads off the site or to no page."""
    value = (raw or "").strip()
    if not value or re.match(r"#|(?:mailto|tel|javascript|data):", value):
        return None
    try:
        parts = urlsplit(urljoin(base, value))
        port = parts.port
    except ValueError:
        return None
    bare = lambda h: (h or "").lower().rstrip(".").removeprefix("www.")
    if parts.scheme not in ("http", "https") or not parts.hostname or bare(parts.hostname) != bare(site) or parts.username or parts.password:
        return None
    path = re.sub("/{2,}", "/", parts.path or "/")
    clean = "/" + posixpath.normpath(path).lstrip("/")
    clean += "/" if path.endswith("/") and clean != "/" else ""
    if clean.lower().endswith(SKIPPED):
        return None
    query = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in TRACKING)
    default = {"http": 80, "https": 443}[parts.scheme]
    netloc = parts.hostname.lower() + (f":{port}" if port and port != default else "")
    return urlunsplit((parts.scheme, netloc, clean, urlencode(query), ""))


#: Scheme, mark of an authority, authority, path, mark of a query, query, fragment with its mark.
REFERENCE = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//)?((?<=//)[^/?#]*)?([^?#]*)(\?)?((?<=\?)[^#]*)?(#.*)?$"
PARTS = ("scheme", "rooted", "authority", "path", "asked", "query", "fragment")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _parts(url: Column) -> Column:
    return F.struct(*[F.regexp_extract(url, REFERENCE, i + 1).alias(name) for i, name in enumerate(PARTS)])


def without_dots(path: Column) -> Column:
    """A rooted path without its . and .. segments; a path that ends in one ends in a slash."""

    def steps(segments: Column) -> Column:
        up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        walked = F.reduce(F.slice(segments, F.lit(2), F.size(segments)), F.array().cast("array<string>"), lambda done, s: F.when(s == "..", up(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
        return F.concat(F.lit("/"), F.array_join(F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked), "/"))

    return F.when(F.contains(path, F.lit("/.")), let(F.split(path, "/"), steps)).otherwise(path)


def resolved(base: Column, reference: Column) -> Column:
    """The URL that a reference on the page `base` stands for (RFC 3986, 5.2): relative, rooted, without a scheme, or a query or fragment alone.

    A reference of the base's scheme without an authority is relative, as browsers have it; so is an
    empty authority. Marks of a query or fragment that is empty, and white space around a reference, count nothing.
    Empty segments of a relative path are left out; a reference with an authority keeps its path.
    """

    def join(b: Column, r: Column) -> Column:
        asked = F.when(r.query != "", F.concat(F.lit("?"), r.query)).otherwise("")
        fragment = F.when(F.length(r.fragment) > 1, r.fragment).otherwise("")
        relative = (r.authority == "") & ((r.scheme == "") | (F.lower(r.scheme) == F.lower(b.scheme)))
        merged = F.when(b.path == "", F.concat(F.lit("/"), r.path)).otherwise(F.concat(F.regexp_extract(b.path, "^(.*/)?", 0), r.path))
        rooted = F.when(F.startswith(r.path, F.lit("/")), r.path).otherwise(F.regexp_replace(merged, "/{2,}", "/"))
        path = F.when(r.path == "", b.path).otherwise(without_dots(rooted))
        query = F.when((r.path == "") & (asked == "") & (b.query != ""), F.concat(F.lit("?"), b.query)).otherwise(asked)
        own = F.concat(F.when(r.scheme == "", b.scheme).otherwise(F.lower(r.scheme)), F.lit(":"), r.rooted, r.authority, r.path, asked, fragment)
        return F.when(relative, F.concat(b.scheme, F.lit("://"), b.authority, path, query, fragment)).otherwise(own)

    return let(F.struct(_parts(base).alias("b"), _parts(F.trim(reference)).alias("r")), lambda x: join(x.b, x.r))


def _query_pairs(query: Column) -> Column:
    """The pairs of a query that don't track, in order and encoded anew."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(plain(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), plain(F.regexp_extract(x, "^[^=]*=?(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.startswith(F.lower(p.k), F.lit("utm_")) & ~F.lower(p.k).isin(*sorted(TRACKING)))
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(coded(p.k), F.lit("="), coded(p.v))), "&")


NO_PAGE = "^(?:#|mailto:|tel:|javascript:|data:)"


def page_link(base: Column, raw: Column, site: Column) -> Column:
    """`normalised` as an expression: the page a link leads to, in one spelling; null if it leads off the site or to no page."""
    bare = lambda h: F.regexp_replace(F.regexp_replace(F.lower(h), r"\.+$", ""), r"^www\.", "")

    def spelled(u: Column) -> Column:
        host, port = F.lower(F.regexp_extract(u.authority, r"^([^:@]+)(?::\d*)?$", 1)), F.regexp_extract(u.authority, r":(\d+)$", 1)
        path = F.when(u.path == "", "/").otherwise(F.regexp_replace(u.path, "/{2,}", "/"))
        walked = F.regexp_replace(without_dots(path), "/{2,}", "/")
        clean = F.when(F.endswith(path, F.lit("/")) | (walked == "/"), walked).otherwise(F.regexp_replace(walked, "/$", ""))
        usual = F.when(F.lower(u.scheme) == "http", "80").otherwise("443")
        shown_port = F.when((port != "") & (F.ltrim(port, F.lit("0")) != usual), F.concat(F.lit(":"), F.ltrim(port, F.lit("0")))).otherwise("")
        query = _query_pairs(u.query)
        whole = F.concat(F.lower(u.scheme), F.lit("://"), host, shown_port, clean, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
        skipped = F.lower(F.regexp_extract(clean, r"(\.[^./]*)$", 1)).isin(*SKIPPED)
        fits = F.lower(u.scheme).isin("http", "https") & (host != "") & (bare(host) == bare(site)) & ((port == "") | (port.cast("int") < 65536)) & ~skipped
        return F.when(fits, whole)

    value = F.trim(raw)
    return F.when((value != "") & ~F.rlike(value, F.lit(NO_PAGE)), let(_parts(resolved(base, value)), spelled))


def external(base: Column, raw: Column) -> Column:
    """Whether a link leads to a web address at all."""
    return F.rlike(resolved(base, raw), F.lit("^https?://[^/?#@:]|^https?://[^/?#@]*@[^/?#:]"))


def normalise_links(links: Column, base: Column, site: Column) -> Column:
    """The normalised links of a page; what leads off the site is null."""
    return F.transform(links, lambda x: page_link(base, x, site))


def citation_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, at most 2048 characters; null unless http(s)."""
    head = F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1)
    rest = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^#]*)", 1)
    return F.when(F.rlike(F.lower(head), F.lit("^https?://")), F.substring(F.concat(F.lower(head), rest), 1, 2048))


def origin(url: Column) -> Column:
    """Scheme and authority in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)), F.lit(""))


def absolute_target(site: Column, target: Column) -> Column:
    """The URL of a target: a path on the site, or a web address without its fragment; null for anything else."""
    base = F.when(F.contains(site, F.lit("://")), F.regexp_extract(site, "^([^/]*//[^/]*)", 1)).otherwise(F.concat(F.lit("https://"), site))
    bare = F.regexp_extract(target, "^([^#]*)", 1)
    rooted = F.regexp_replace(bare, r"^(https?://[^/?]+)(?=\?|$)", "$1/")
    return F.when(F.startswith(target, F.lit("/")), F.concat(base, bare)).when(F.rlike(target, F.lit("^https?://[^/?#]+")), rooted)


def inspection_url(site: Column, value: Column) -> Column:
    """struct(url, error): the URL to inspect, or why there is none: empty, relative_scheme, credentials, other_site, too_long."""
    raw = F.trim(value)
    whole = F.rlike(raw, F.lit("^([a-zA-Z][a-zA-Z0-9+.-]*:|//)"))
    path = F.regexp_extract(raw, "^([^#]*)", 1)
    url = F.when(whole, path).otherwise(F.concat(F.lit("https://"), site, F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))))
    head = F.regexp_extract(url, "^([a-zA-Z]+://[^/?]+)", 1)
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    normal = F.concat(F.lower(head), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))
    error = (
        F.when(F.coalesce(raw, F.lit("")) == "", "empty")
        .when(~F.rlike(url, F.lit("^(?i)https?://[^/?]+")), "not_http")
        .when(F.contains(head, F.lit("@")), "credentials")
        .when(host_key(F.concat(head, F.lit("/"))) != F.regexp_replace(F.lower(site), r"^www\.", ""), "other_site")
        .when(F.length(normal) > 2048, "too_long")
    )
    return F.struct(F.when(error.isNull(), normal).alias("url"), error.alias("error"))
