"""URL functions as native column expressions. Two identities exist on purpose: one for merging items, one for evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udfs import vectorized

#: Query parameters that only track, besides those that begin with ``utm_``.
TRACKERS = ("_ga", "dclid", "fbclid", "gclid", "igshid", "li_fat_id", "mc_cid", "mc_eid", "msclkid", "ttclid", "twclid", "vero_id")

_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
_NETLOC = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = "^[^?#]*\\?([^#]*)"


def _or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(_or_empty(F.regexp_extract(url, _SCHEME, 1)))


def netloc(url: Column) -> Column:
    return _or_empty(F.regexp_extract(url, _NETLOC, 1))


def userinfo(url: Column) -> Column:
    """What stands before the authority's last ``@``."""
    return F.regexp_extract(netloc(url), "^(.*)@", 1)


def host(url: Column) -> Column:
    """Lower-case host without port or brackets."""
    return F.lower(F.regexp_replace(F.regexp_extract(netloc(url), "^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)", 1), "[\\[\\]]", ""))


def port(url: Column) -> Column:
    """The port; null where there is none or it is the scheme's own."""
    digits = F.regexp_extract(netloc(url), ":([0-9]+)$", 1)
    number = F.when(digits != "", digits.cast("int"))
    return F.when(~(((scheme(url) == "http") & (number == 80)) | ((scheme(url) == "https") & (number == 443))), number)


def path(url: Column) -> Column:
    return _or_empty(F.regexp_extract(url, _PATH, 1))


def query(url: Column) -> Column:
    return _or_empty(F.regexp_extract(url, _QUERY, 1))


def _is_tracker(part: Column) -> Column:
    raw = F.split_part(part, F.lit("="), F.lit(1))
    name = F.lower(F.coalesce(F.try_url_decode(raw), raw))
    return name.startswith("utm_") | name.isin(*TRACKERS)


def merge_key(url: Column) -> Column:
    """Identity for merging items from several sources.

    Scheme and host lower-case, the scheme's own port dropped, no slash at the path's end, no trackers,
    the order of parameters kept, no fragment; user and password kept. Of null, null.
    """
    info = userinfo(url)
    slashless = F.regexp_replace(path(url), "/+$", "")
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: ~_is_tracker(p)), "&")
    parts = [scheme(url), F.split_part(info, F.lit(":"), F.lit(1)), F.regexp_extract(info, "^[^:]*:(.*)$", 1), host(url), F.coalesce(port(url).cast("string"), F.lit("")), F.when(slashless == "", F.lit("/")).otherwise(slashless), F.when(query(url) == "", F.lit("")).otherwise(kept)]
    return F.when(url.isNotNull(), F.concat_ws("|", *parts))


@vectorized("string")
def _idna(host: pd.Series) -> pd.Series:
    def one(h):
        try:
            return h.encode("idna").decode("ascii")
        except (UnicodeError, AttributeError):
            return h

    return host.map(one)


def evidence_url(url: Column, *, ascii_hosts: bool = False) -> Column:
    """Identity for evidence: no user, no fragment, the scheme's own port dropped, trackers and slashes kept.

    Hosts outside ASCII are IDNA-encoded, by a vectorized function; ``ascii_hosts`` leaves it out of the
    plan where all hosts are known to be ASCII.
    """
    name = F.regexp_replace(host(url), "\\.+$", "")
    if not ascii_hosts:
        name = F.when(name.rlike("[^\\x00-\\x7F]"), _idna(name)).otherwise(name)
    name = F.when(F.contains(name, F.lit(":")), F.concat(F.lit("["), name, F.lit("]"))).otherwise(name)
    place = F.when(port(url).isNotNull(), F.concat(name, F.lit(":"), port(url).cast("string"))).otherwise(name)
    tail = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    asked = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit(""))
    return F.when(url.isNotNull(), F.concat(scheme(url), F.lit("://"), place, tail, asked))


def site(url: Column) -> Column:
    """The authority without ``www.`` at its front; port and user stay."""
    return F.regexp_replace(netloc(url), "^www\\.", "")


def without_secrets(url: Column) -> Column:
    """For logs: user, query, fragment and a chat bot's token in the path gone; what has no scheme or host is not shown at all."""
    shown = F.regexp_replace(path(url), "/bot[0-9]+:(?U:[\\w-]+)", "/bot<redacted>")
    return F.when((scheme(url) == "") | (netloc(url) == ""), F.lit("<redacted-url>")).otherwise(F.concat(scheme(url), F.lit("://"), F.regexp_replace(netloc(url), "^.*@", ""), shown))


def is_safe_link(url: Column) -> Column:
    """An http or https URL with a host and without white space, control or markup characters."""
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) != "") & ~url.rlike("[\\x00-\\x20\\x7F<>\"'`\\\\]"), F.lit(False))


#: What a link in an attribute keeps; everything else is percent-encoded.
_KEPT = r"A-Za-z0-9_.\-~:/?#\[\]@!$&'*,;=%+"


def html_link(url: Column) -> Column:
    """A web address percent-encoded and escaped for an attribute; empty for what isn't one or holds control characters."""
    from .text import strip

    raw = strip(url)
    place = F.regexp_extract(netloc(raw), "^(?:.*@)?(?:\\[[^\\]]*\\]|[^:]*):(.*)$", 1)
    port_ = (place == "") | (place.rlike("^[0-9]+$") & F.coalesce(place.try_cast("int") <= 65535, F.lit(False)))
    good = scheme(raw).isin("http", "https") & (netloc(raw) != "") & port_ & ~raw.rlike("[\\x00-\\x1f\\x7f]")
    coded = F.transform(F.regexp_extract_all(raw, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.when(c.rlike(f"[^{_KEPT}]"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    whole = F.when(raw.rlike(f"[^{_KEPT}]"), F.array_join(coded, "")).otherwise(raw)
    return F.when(F.coalesce(good, F.lit(False)), F.replace(F.replace(whole, F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#x27;"))).otherwise(F.lit(""))


def is_markdown_link(url: Column) -> Column:
    """A safe link whose parentheses are balanced in number."""
    count = lambda c: F.length(url) - F.length(F.replace(url, F.lit(c), F.lit("")))
    return is_safe_link(url) & (count("(") == count(")"))


def public_link(url: Column, keep_query: dict[str, str] | None = None) -> Column:
    """User, query and fragment dropped, the host in lower case; null if it isn't http or https or has no host.

    ``keep_query``: parts of hosts whose pages are named by their query, with what such a query holds.
    """
    digits = F.regexp_extract(netloc(url), ":([0-9]+)$", 1)
    bare = F.concat(scheme(url), F.lit("://"), host(url), F.when(digits != "", F.concat(F.lit(":"), digits)).otherwise(F.lit("")), path(url))
    keep = F.lit(False)
    for name, word in (keep_query or {}).items():
        keep = keep | (F.contains(host(url), F.lit(name)) & F.contains(query(url), F.lit(word)))
    return F.when(scheme(url).isin("http", "https") & (host(url) != ""), F.when(keep, F.concat(bare, F.lit("?"), query(url))).otherwise(bare))


def video_id(url: Column) -> Column:
    """An 11-character id after ``v=``, ``youtu.be/``, ``/shorts/`` or ``/live/``, else what follows the last slash that isn't at the end."""
    found = F.regexp_extract(url, "(?:v=|youtu\\.be/|/shorts/|/live/)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1))


def slug(text: Column) -> Column:
    """Letters, digits, ``_`` and ``-``; every other run becomes one ``-``."""
    return F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", "")


def anchor(profile: Column, index: Column) -> Column:
    """An item's anchor in an issue."""
    name = slug(profile)
    return F.concat(F.lit("item-"), F.when(name == "", F.lit("unclassified")).otherwise(name), F.lit("-"), index.cast("string"))


def is_public_address(address: pd.Series) -> pd.Series:
    import ipaddress

    def one(a):
        try:
            return ipaddress.ip_address(a).is_global
        except ValueError:
            return False

    return address.map(one).astype(bool)


def is_fetchable(url: Column, addresses: Column) -> Column:
    """May a fetcher go there: http or https, no user, a usual port, no local name, and every resolved address public."""
    local = host(url).isin("localhost", "localhost.localdomain") | host(url).endswith(".localhost") | host(url).endswith(".local")
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) != "") & (userinfo(url) == "") & port(url).isNull() & ~local & _all_public(addresses), F.lit(False))


@vectorized("boolean")
def _all_public(addresses: pd.Series) -> pd.Series:
    return addresses.map(lambda xs: xs is not None and len(xs) > 0 and bool(is_public_address(pd.Series(list(xs))).all()))
