"""Text functions. Lengths and cuts are in code points; regular expressions that need letters beyond ASCII say so."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udfs import vectorized

#: What divides a body from its discussion, and what marks cuts.
COMMENTS = "--- Top Comments ---"
OPENING, MIDDLE, CLOSING = "[Opening excerpt]\n", "\n\n[Middle excerpt]\n", "\n\n[Closing excerpt]\n"
#: White space as Python's ``strip`` sees it.
GAPS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as the inside of a character class.
GAP_CLASS = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(GAPS))


def content_parts(content: Column, marker: str = COMMENTS) -> Column:
    """``main`` and ``comments``, each stripped; without the marker no comments."""
    at = F.instr(content, F.lit(marker))
    return F.struct(strip(F.when(at > 0, F.substring(content, F.lit(1), at - 1)).otherwise(content)).alias("main"), F.when(at > 0, strip(F.substring(content, at + len(marker), F.length(content)))).otherwise(F.lit("")).alias("comments"))


def selected_content(content: Column, limit: int, sampling: str = "prefix") -> Column:
    """The stripped text, at most ``limit`` characters of it: the beginning, or excerpts from its beginning (40 % of the
    room), middle (30 %) and ending, each with a heading and without white space at its cuts. Limits too small for
    the headings give the beginning.
    """
    text = strip(content)
    n, gaps = F.length(text), F.lit(GAPS)
    room = limit - len(OPENING) - len(MIDDLE) - len(CLOSING)
    if sampling == "prefix" or room < 4:
        return F.when(n <= limit, text).otherwise(F.rtrim(F.substring(text, 1, limit), gaps))
    first, middle = int(room * 0.4), int(room * 0.3)
    last = room - first - middle
    at = F.floor(n / 2).cast("int") - middle // 2
    cut = F.concat(F.lit(OPENING), F.rtrim(F.substring(text, 1, first), gaps), F.lit(MIDDLE), strip(F.substring(text, at + 1, F.lit(middle))), F.lit(CLOSING), F.ltrim(F.substring(text, n - last + 1, F.lit(last)), gaps))
    return F.when(n <= limit, text).otherwise(cut)


@vectorized("string")
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities resolved."""
    return text.map(lambda t: None if t is None else html.unescape(t))


@vectorized("string")
def folded(text: pd.Series) -> pd.Series:
    """NFKC and case-folded."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def untagged(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def ellipsis(text: Column, limit: int, dots: str = "...") -> Column:
    """Texts over ``limit`` cut so that they have it with the dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(dots)), F.lit(dots))).otherwise(text)


def escaped_markdown(text: Column) -> Column:
    """Text that Markdown shows as it is: markup as entities, its own characters escaped, and so what begins a list at
    the start of a line (after up to three spaces). Line breaks stay; quotes, ``+``, ``|``, ``~`` and ``-`` within a line too.
    """
    plain = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    inline = F.regexp_replace(plain, "[\\\\`*_{}\\[\\]()#!]", "\\\\$0")
    return F.regexp_replace(inline, "(?md)^( {0,3})(?=[-+] |\\p{Nd}+[.] )", "$1\\\\")


def spaced_scripts(text: Column) -> Column:
    """A space between Han characters and Latin letters or digits."""
    han = "[\\u4e00-\\u9fff\\u3400-\\u4dbf]"
    return F.regexp_replace(F.regexp_replace(text, f"({han})([A-Za-z0-9])", "$1 $2"), f"([A-Za-z0-9])({han})", "$1 $2")


def has_cjk_leak(text: Column, language: str) -> Column:
    """Kana, Han or Hangul in a text of another language; null holds none."""
    leak = F.coalesce(text.rlike("[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff]"), F.lit(False))
    return F.lit(False) if language.lower() in ("zh", "zh-cn", "zh-tw", "ja") else leak


def spoken_words(text: Column) -> Column:
    """Lower-case words of letters, digits, ``_`` and ``-``; ``ё`` counts as ``е``."""
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е")), F.lit("(?U)([\\w-]+)"), F.lit(1))


def message_title(text: Column, limit: int = 80) -> Column:
    """The first paragraph, cut at a sentence's end in it or at the limit."""
    first = strip(F.split_part(strip(text), F.lit("\n"), F.lit(1)))
    stop = F.regexp_extract(F.substring(first, 1, limit), "^(.*?[。！？])", 1)
    return F.when(F.length(first) <= limit, first).when(stop != "", stop).otherwise(F.substring(first, 1, limit))


def search_text(text: Column, limit: int = 200, least: int = 2) -> Column:
    """Spaces collapsed, cut; null if too short to search for."""
    plain = F.substring(strip(F.regexp_replace(text, "(?U)\\s+", " ")), 1, limit)
    return F.when(F.length(plain) >= least, plain)


def score_tier(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 6, "mid").when(score.isNotNull(), "low")


def score_fill(score: Column) -> Column:
    """How full a score's bar is, from 0.04 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.04), (score - 4) / 6))


def balanced_highlights(text: Column, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Highlights closed where a snippet's cut left one open, and stray ends dropped."""
    parts = F.split(F.regexp_replace(text, f"({opening}|{closing})", "\x00$1\x00"), "\x00")
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("open"))

    def step(acc: Column, p: Column) -> Column:
        skip = ((p == opening) & acc["open"]) | ((p == closing) & ~acc["open"])
        now = F.when(p == opening, F.lit(True)).when(p == closing, F.lit(False)).otherwise(acc["open"])
        return F.struct(F.when(skip, acc["s"]).otherwise(F.concat(acc["s"], p)).alias("s"), now.alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"], F.concat(acc["s"], F.lit(closing))).otherwise(acc["s"]))


def normalized_lines(text: Column, limit: int = 100_000) -> Column:
    """Line ends unified, runs of blanks made one, empty lines dropped, cut; null if nothing is left."""
    lines = F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n")
    plain = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, "[\\t\\f\\x0B ]+", " "))), lambda x: x != "")
    return F.nullif(F.substring(F.array_join(plain, "\n"), 1, limit), F.lit(""))


def headers(text: Column) -> Column:
    """``Name: value`` lines as a map, the last of a name winning (by the session's policy for maps, see :mod:`tidemill.session`)."""
    lines = F.filter(F.split(text, "\\r?\\n"), lambda x: x.rlike("^\\s*[^:\\s][^:]*:"))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), strip(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    return F.map_from_entries(pairs)


def plural_index(n: Column) -> Column:
    """0, 1 or 2: which Russian plural a number takes."""
    ten, hundred = F.abs(n) % 10, F.abs(n) % 100
    return F.when((ten == 1) & (hundred != 11), 0).when(ten.between(2, 4) & ~hundred.between(12, 14), 1).otherwise(2)


_DETAILS = re.compile(r"<details>\s*<summary>(.*?)</summary>\s*(.*?)\s*</details>", re.I | re.S)
_ANCHOR = re.compile(r"<a\s+[^>]*id=[\"'][^\"']+[\"'][^>]*>\s*</a>", re.I)
_POINT = re.compile(r"<li>\s*(.*?)\s*</li>", re.I | re.S)
_POINTED = re.compile(r"\s*<a\s+[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>\s*", re.I | re.S)
_SCHEMES = ("http", "https", "mailto")


def _shown(markup: str) -> str:
    """What a piece of HTML says, for Markdown."""
    said = " ".join(html.unescape(re.sub("<[^>]+>", "", markup)).split())
    return re.sub(r"[\\`*_{}\[\]<>()#+!|]", r"\\\g<0>", said)


def _is_link(url: str) -> bool:
    """A link that Markdown can hold: of a known scheme, with a place, its parentheses in pairs, nothing that breaks out."""
    if re.search(r"[\x00-\x1f\x7f\s<>\[\]\\]", url) or url.count("(") != url.count(")"):
        return False
    try:
        parts = urlsplit(url)
    except ValueError:
        return False
    return parts.scheme in _SCHEMES and bool(parts.path if parts.scheme == "mailto" else parts.netloc)


def _pointed(point: str) -> str:
    m = _POINTED.fullmatch(point)
    if m is None:
        return _shown(point)
    url, label = html.unescape(m[1]).strip(), _shown(m[2])
    return f"[{label}]({url})" if label and _is_link(url) else label


def _section(m: re.Match) -> str:
    points = [f"- {x}" for x in map(_pointed, _POINT.findall(m[2])) if x]
    inside = "\n".join(points) or _shown(m[2])
    return f"**{_shown(m[1]) or 'References'}**" + (f"\n\n{inside}" if inside else "")


@vectorized("string")
def details_to_markdown(text: pd.Series) -> pd.Series:
    """Folded sections made headings with their points, empty anchors dropped; other HTML stays, whoever shows it knows what is safe."""
    return text.map(lambda t: None if t is None else _DETAILS.sub(_section, _ANCHOR.sub("", t)))


def without_tool_tokens(text: Column) -> Column:
    """References to tool results that a model left in its text, such as ``[tool-2-1]``, gone with the blanks before them."""
    return F.regexp_replace(text, "[ \\t]*(?:\\\\?\\[tool-[0-9]+-[0-9]+\\\\?\\])+", "")
