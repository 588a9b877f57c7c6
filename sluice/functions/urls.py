"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V
from .text import col, first_group, matches_any


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url) -> Column:
    """All between ``://`` and the path, as it is written."""
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(url) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def fragment(url) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), r"#(.*)$", 1)


def domain(url) -> Column:
    """The host without ``www.``."""
    return F.replace(host(url), F.lit("www."), F.lit(""))


def _plus(c: Column) -> Column:
    """Form encoding of a decoded string."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _name(pair: Column) -> Column:
    return _decoded(F.regexp_extract(pair, "^([^=]*)", 1))


def canonical(url) -> Column:
    """Without fragment and tracking parameters, scheme and host in lower case, no slash at the end; what is no URL stays."""
    raw = F.trim(F.coalesce(col(url), F.lit("")))
    pairs = F.filter(F.split(query(raw), "&"), lambda p: (p != "") & ~F.lower(_name(p)).isin(*V.TRACKING_PARAMS))
    kept = F.array_join(F.transform(pairs, lambda p: F.concat(_plus(_name(p)), F.lit("="), _plus(_decoded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1))))), "&")
    whole = F.regexp_replace(path(raw), r";[^/]*$", "")
    bare = F.regexp_replace(whole, "/+$", "")
    place = F.when(bare == "", whole).otherwise(bare)
    lower_host = F.lower(host(raw))
    job = F.regexp_extract(place, r"/(?:id/)?job/(\d+)", 1)
    is_job = (F.contains(lower_host, F.lit("jobstreet.co.id")) | F.contains(lower_host, F.lit("jobstreet.com"))) & (job != "")
    built = F.concat(scheme(raw), F.lit("://"), lower_host, place, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when((scheme(raw) == "") | (host(raw) == ""), raw).when(is_job, F.concat(F.lit("https://www.jobstreet.co.id/job/"), job)).otherwise(built)


def has_tracking(url) -> Column:
    return (fragment(url) != "") | F.exists(F.split(query(url), "&"), lambda p: F.lower(_name(p)).isin(*V.TRACKING_PARAMS))


def is_binary(url) -> Column:
    return F.lower(path(url)).rlike(r"\.(?:" + "|".join(V.BINARY_ENDINGS) + ")$")


def platform(url, platforms=V.PLATFORMS, default: str = "generic") -> Column:
    """The platform of the first host part that the host contains."""
    return first_group(F.lower(domain(url)), [(p, (part,)) for part, p in platforms], default)


def is_listing(url, patterns=V.LISTING_PATHS) -> Column:
    return matches_any(F.regexp_replace(path(url), "/+$", ""), patterns)


def is_listing_title(title, patterns=V.LISTING_TITLES, plain: Column | None = None) -> Column:
    """``plain``, for long titles: their ``plain_lower``, computed before."""
    return matches_any(F.lower(col(title)), patterns, plain)


def page_type(url, title) -> Column:
    return F.when(is_listing(url) | is_listing_title(title), "listing").otherwise("detail")


def is_detail(url) -> Column:
    return F.coalesce(col(url) != "", F.lit(False)) & ~is_listing(url) & matches_any(url, V.DETAIL_URLS)


def is_bad(url, platforms=V.PLATFORMS) -> Column:
    """No page to look for: no web address, an article or course, or a listing that can not be followed."""
    follow = platform(url, platforms).isin(*V.FOLLOWABLE) & is_listing(url)
    broken = F.coalesce(col(url) == "", F.lit(True)) | ~scheme(url).startswith("http") | (host(url) == "")
    return F.when(broken, True).when(matches_any(url, V.BAD_PATHS), True).when(follow, False).otherwise(matches_any(url, V.SEARCH_LISTING_URLS))
