"""URL functions as Column expressions.

URLs are split with one regex rather than ``parse_url``: ``try_parse_url``
returns NULL for URLs containing spaces, while the behaviour reproduced here
(Python ``urlparse``) still yields a host and a path for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .text import col_of, nz

# scheme://netloc path ?query #fragment
_NETLOC = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"

# FIXED VALUES — path fragments never crawled (substring of the lower-cased path)
SKIP_PATH_PARTS = ["/assets/", "/images/", "/css/", "/js/", "/api/", "/admin/", "/login/", "/logout/",
                   ".pdf", ".jpg", ".png", ".gif", ".css", ".js"]


def netloc(url) -> Column:
    return F.regexp_extract(nz(url), _NETLOC, 1)


def path(url) -> Column:
    return F.regexp_extract(nz(url), _PATH, 1)


def site_name(url) -> Column:
    """Netloc with every 'www.' removed."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def same_host(url, base) -> Column:
    """Exact netloc equality (case-sensitive, port included)."""
    return netloc(url) == netloc(base)


def valid_path(url) -> Column:
    """The lower-cased path contains none of the skipped parts."""
    p = F.lower(path(url))
    out = F.lit(True)
    for part in SKIP_PATH_PARTS:
        out = out & ~p.contains(part)
    return out


def normalize_url(url) -> Column:
    """Drop the fragment, strip every trailing '/'; '' becomes NULL."""
    u = F.regexp_replace(F.regexp_replace(nz(url), r"#.*$", ""), r"/+$", "")
    return F.when(u == "", F.lit(None).cast("string")).otherwise(u)


def in_scope(url, start) -> Column:
    """Same netloc and path starting with the start path (right-stripped of '/')."""
    base_path = F.regexp_replace(path(start), r"/+$", "")
    return same_host(url, start) & ((base_path == "") | F.startswith(path(url), base_path))


def file_name(title, url) -> Column:
    """File name of a rewritten page from its URL path, else from its title."""
    p = F.regexp_replace(path(url), r"^/+|/+$", "")
    from_path = F.regexp_replace(F.lower(F.replace(p, F.lit("/"), F.lit("-"))), r"\.(html?|php|aspx?)$", "")
    from_path = F.when(from_path.endswith(".md"), from_path).otherwise(F.concat(from_path, F.lit(".md")))
    t = F.regexp_replace(F.lower(nz(title)), r"(?U)[^\w\s-]", "")
    t = F.regexp_replace(t, r"(?U)[-\s]+", "-")
    return F.when(p != "", from_path).otherwise(F.concat(t, F.lit(".md")))


def origin(url) -> Column:
    """scheme://netloc of a URL."""
    return F.regexp_extract(nz(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def _without_dots(p: Column) -> Column:
    """Path with its '.' and '..' segments resolved."""
    segments = F.split(p, "/", -1)
    last = F.element_at(segments, -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda out, s: F.when(s == ".", out).when(
        s == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(s))))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def base_parts(base) -> Column:
    """What ``resolve_url`` needs of a base URL: bind it once where many links of one page are resolved."""
    b = nz(base)
    base_path = path(b)
    folder = F.regexp_replace(F.when((base_path == "") & (netloc(b) != ""), "/").otherwise(base_path), r"[^/]*$", "")
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    root = F.when(b.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*://"), origin(b)).otherwise(scheme)
    return F.struct(b.alias("url"), scheme.alias("scheme"), origin(b).alias("origin"), base_path.alias("path"), folder.alias("folder"), root.alias("root"))


def resolve_from(parts: Column, href) -> Column:
    """X6 against ``base_parts``."""
    h = col_of(href)

    def on_path(own_path: Column) -> Column:
        absolute = F.when(own_path.startswith("/"), own_path).otherwise(F.concat(parts["folder"], own_path))
        dotted = own_path.contains("./") | own_path.endswith(".") | parts["path"].contains("./")
        resolved = F.when(dotted, F.concat(parts["origin"], _without_dots(absolute))).otherwise(F.concat(parts["root"], absolute))
        return F.concat(resolved, F.substring(h, F.length(own_path) + 1, F.length(h)))

    relative = F.when(h.rlike("[?#]"), let(F.regexp_extract(h, r"^([^?#]*)", 1), on_path)).otherwise(on_path(h))
    return (F.when(h == "", parts["url"]).when(h.startswith("//"), F.concat(parts["scheme"], h))
            .when(h.startswith("/"), relative).when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("#"), F.concat(F.regexp_replace(parts["url"], "#.*$", ""), h))
            .when(h.startswith("?"), F.concat(parts["origin"], parts["path"], h))
            .otherwise(relative))


def resolve_url(base, href) -> Column:
    """Href against the base URL (absolute, '//host', '/path', '?query', '#fragment' and relative forms)."""
    return let(base_parts(base), lambda parts: resolve_from(parts, href))
