"""Text for Russian speech: numbers, dates, units and signs as words.

A text is stripped of markup line by line and then read once, token by token: each token is recognized by
one pattern, and what it is decides how it is said.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd

from .udfs import vectorized

# How months, signs, shorthand, units, letters and numbers are said.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
COMPARISONS = {">=": "не ниже", "<=": "не выше", "=>": "не ниже", "=<": "не выше", ">": "больше", "<": "меньше"}
SHORTHAND = {"т. е.": "то есть", "т.е.": "то есть", "т. д.": "так далее", "т.д.": "так далее", "т. п.": "тому подобное", "т.п.": "тому подобное", "гг.": "годов", "др.": "другие"}
SAID_AS_WORDS = {"JSON": "джейсон", "YAML": "ямл", "KEDA": "кеда", "QEMU": "кему", "CUDA": "куда", "REST": "рест", "SAAS": "саас"}
LETTERS = {
    "A": "эй", "B": "би", "C": "си", "D": "ди", "E": "и", "F": "эф", "G": "джи", "H": "эйч", "I": "ай", "J": "джей", "K": "кей", "L": "эл", "M": "эм",
    "N": "эн", "O": "оу", "P": "пи", "Q": "кью", "R": "ар", "S": "эс", "T": "ти", "U": "ю", "V": "ви", "W": "дабл-ю", "X": "икс", "Y": "уай", "Z": "зед",
}
UNITS = {"млрд": ("миллиард", "миллиарда", "миллиардов"), "млн": ("миллион", "миллиона", "миллионов"), "тыс": ("тысяча", "тысячи", "тысяч"), "%": ("процент", "процента", "процентов")}
DOLLARS = ("доллар", "доллара", "долларов")
PRERELEASES = {"rc": "эр-си", "a": "альфа", "b": "бета"}
CARDINALS = {
    900: "девятьсот", 800: "восемьсот", 700: "семьсот", 600: "шестьсот", 500: "пятьсот", 400: "четыреста", 300: "триста", 200: "двести", 100: "сто",
    90: "девяносто", 80: "восемьдесят", 70: "семьдесят", 60: "шестьдесят", 50: "пятьдесят", 40: "сорок", 30: "тридцать", 20: "двадцать",
    19: "девятнадцать", 18: "восемнадцать", 17: "семнадцать", 16: "шестнадцать", 15: "пятнадцать", 14: "четырнадцать", 13: "тринадцать", 12: "двенадцать", 11: "одиннадцать",
    10: "десять", 9: "девять", 8: "восемь", 7: "семь", 6: "шесть", 5: "пять", 4: "четыре", 3: "три", 2: "два", 1: "один",
}
ZERO, FEMININE = "ноль", {1: "одна", 2: "две"}
SCALES = {10**12: ("триллион", "триллиона", "триллионов"), 10**9: ("миллиард", "миллиарда", "миллиардов"), 10**6: ("миллион", "миллиона", "миллионов"), 10**3: ("тысяча", "тысячи", "тысяч")}
ORDINALS = {
    0: "нулевой", 1: "первый", 2: "второй", 3: "третий", 4: "четвёртый", 5: "пятый", 6: "шестой", 7: "седьмой", 8: "восьмой", 9: "девятый",
    10: "десятый", 11: "одиннадцатый", 12: "двенадцатый", 13: "тринадцатый", 14: "четырнадцатый", 15: "пятнадцатый", 16: "шестнадцатый", 17: "семнадцатый", 18: "восемнадцатый", 19: "девятнадцатый",
    20: "двадцатый", 30: "тридцатый", 40: "сороковой", 50: "пятидесятый", 60: "шестидесятый", 70: "семидесятый", 80: "восьмидесятый", 90: "девяностый",
    100: "сотый", 200: "двухсотый", 300: "трёхсотый", 400: "четырёхсотый", 500: "пятисотый", 600: "шестисотый", 700: "семисотый", 800: "восьмисотый", 900: "девятисотый",
    1000: "тысячный", 2000: "двухтысячный", 3000: "трёхтысячный", 4000: "четырёхтысячный", 5000: "пятитысячный", 6000: "шеститысячный", 7000: "семитысячный", 8000: "восьмитысячный", 9000: "девятитысячный",
}
GENITIVE_ENDINGS = {"ий": "ьего", "ый": "ого", "ой": "ого"}


def agreeing(n: int) -> int:
    """Which of three forms agrees with a number: of one, of two to four, of more."""
    last = n % 100
    last = last if 10 < last < 20 else last % 10
    return 0 if last == 1 else 1 if 1 < last < 5 else 2


def _summands(n: int) -> Iterator[int]:
    """The named numbers below a thousand that a number is said by, downwards."""
    for value in CARDINALS:
        if value <= n:
            n -= value
            yield value


def number(n: int) -> str:
    """A number in words, nominative; from a thousand trillions on its digits."""
    if n >= 1000 * max(SCALES):
        return str(n)
    said = []
    for scale, forms in (*SCALES.items(), (1, None)):
        count, n = divmod(n, scale)
        said += [FEMININE.get(v, CARDINALS[v]) if scale == 1000 else CARDINALS[v] for v in _summands(count)]
        if count and forms:
            said.append(forms[agreeing(count)])
    return " ".join(said) or ZERO


def ordinal(n: int) -> str:
    """Nominative masculine: the last named number as an ordinal, what is before it as a number."""
    if n in ORDINALS:
        return ORDINALS[n]
    if n % 1000 == 0:
        return number(n // 1000) + ORDINALS[1000]
    last = list(_summands(n % 1000))[-1]
    return f"{number(n - last)} {ORDINALS[last]}"


def genitive(adjective: str) -> str:
    ending = GENITIVE_ENDINGS.get(adjective[-2:])
    return adjective if ending is None else adjective[:-2] + ending


def spoken_date(day: int, month: str, year: int) -> str:
    return f"{genitive(ordinal(day))} {month} {genitive(ordinal(year))} года"


#: What isn't read: links with what stands against them, notes in brackets, references to tools, and parentheses that are left with nothing.
_LINK = re.compile(r"\(?https?://\S+\)?")
_NOTE = re.compile(r"[ \t]*(?:\[[^\]]*\])+|(?<!\w)tool(?:-\d+){2,}(?!\w)", re.IGNORECASE)
_HOLLOW = re.compile(r"\([\s,]*\)")
_TOKEN = re.compile(
    "|".join(
        (
            rf"(?<!\d)(?P<day>\d{{1,2}})\s+(?P<month>{'|'.join(MONTHS)})\s+(?P<year>\d{{4}})\s+года",
            rf"(?<!\w)(?P<short>{'|'.join(map(re.escape, SHORTHAND))})",
            rf"(?P<sign>{'|'.join(map(re.escape, COMPARISONS))})",
            r"(?<![A-Za-z0-9])(?P<letters>[A-Z]{2,6})(?![A-Za-z0-9])",
            rf"(?P<run>\$?\d(?:[ \u00a0\u202f]\d{{3}}(?![\w])|[A-Za-z0-9_]|[.,-](?=\w))*)(?:\s*(?P<unit>{'|'.join(UNITS)})(?!\w)(?P<dot>(?<=тыс)\.)?)?",
        )
    )
)
_AMOUNT = re.compile(r"(?P<money>\$)?(?P<whole>\d+)(?:[.,](?P<part>\d+)(?:(?P<pre>rc|a|b)(?P<of>\d+))?)?", re.IGNORECASE)
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


def _amount(m: re.Match) -> str:
    """A run of digits and what belongs to it; as it is where it is a name, a version with more parts or a range."""
    before, after = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
    a = _AMOUNT.fullmatch(re.sub(r"[ \u00a0\u202f]", "", m["run"]))
    glued = before.isalpha()
    if a is None or before in {"-", ".", ",", "_"} - {""} or after.isalnum() or after == "-" or (glued and not a["part"]) or len(a["whole"]) > 12:
        return m[0]
    whole, unit = int(a["whole"]), UNITS.get(m["unit"] or "")
    said = number(whole)
    form = agreeing(whole)
    if a["part"]:
        said += f" точка {number(int(a['part']))}"
        form = 1  # a broken number governs the singular genitive
    if a["pre"]:
        said += f" {PRERELEASES[a['pre'].lower()]} {number(int(a['of']))}"
    if unit:
        said += f" {unit[form]}"
    if a["money"]:
        said += f" {DOLLARS[2 if unit else form]}"
    return f" {said}" if glued else said


def _said(m: re.Match) -> str:
    if m["month"]:
        return spoken_date(int(m["day"]), m["month"], int(m["year"]))
    if m["short"]:
        return SHORTHAND[m["short"]]
    if m["sign"]:
        return f" {COMPARISONS[m['sign']]} "
    if m["letters"]:
        return SAID_AS_WORDS.get(m["letters"]) or "-".join(LETTERS[c] for c in m["letters"])
    return _amount(m)


def _is_read(line: str) -> bool:
    """Neither a heading nor a rule."""
    line = line.strip()
    signs = len(line) - len(line.lstrip("#"))
    heading = 0 < signs <= 6 and line[signs : signs + 1].isspace()
    return not heading and not (len(line) >= 3 and set(line) == {"-"})


def _speakable(text: str) -> str:
    lines = "\n".join(filter(_is_read, text.splitlines()))
    plain = html.unescape(_ESCAPED.sub(r"\1", _LINK.sub(" ", lines)))
    plain = _HOLLOW.sub("", _NOTE.sub("", plain))
    read = "\n".join(" ".join(line.split()) for line in _TOKEN.sub(_said, plain).split("\n"))
    return re.sub(r"\s+(?=[.,;:!?])", "", read).strip()


@vectorized("string")
def speakable(text: pd.Series) -> pd.Series:
    """A passage without markup, references and links, its numbers, dates, units and signs as words."""
    return text.map(lambda t: None if t is None else _speakable(t))


def with_lexicon(text, lexicon: dict[str, str]):
    """Names said as the lexicon has them, longest first, whatever their case; whole words only."""
    known = {k.lower(): v for k, v in lexicon.items()}
    pattern = re.compile("|".join(rf"(?<!\w){re.escape(k)}(?!\w)" for k in sorted(known, key=len, reverse=True)) or r"(?!)", re.IGNORECASE)

    @vectorized("string")
    def said(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else pattern.sub(lambda m: known[m[0].lower()], t))

    return said(text)


def script(title, lede, blocks, date=None):
    """The whole reading: title and date, lede, then each block with a text, its heading joined to it."""
    from pyspark.sql import functions as F

    day = F.lit("") if date is None else _opening(date)
    body = F.transform(F.filter(blocks, lambda b: F.coalesce(b["content"], F.lit("")) != ""), lambda b: F.concat(b["title"], F.lit(". "), b["content"]))
    every = F.concat(F.array(F.concat(title, F.lit(".")), lede), body)
    return F.concat(day, speakable(F.array_join(every, "\n\n")), F.lit("\n"))


@vectorized("string")
def _opening(date: pd.Series) -> pd.Series:
    def one(d):
        if not d:
            return ""
        _, month, day = str(d).split("-")
        return f"{genitive(ordinal(int(day)))} {MONTHS[int(month) - 1]}. "

    return date.map(one)


_PIECE = re.compile(r"[A-Za-z0-9]+(?:[._/+:-][A-Za-z0-9]+)*")


@vectorized("array<string>")
def latin_tokens(text: pd.Series) -> pd.Series:
    """What a Russian voice would still read in Latin letters: names with a letter, their inner signs included."""
    return text.map(lambda t: [x for x in _PIECE.findall(t or "") if any(c.isalpha() for c in x)])


#: Longest written and spoken forms of a suggested reading, and how many of a text's are taken.
MOST_WRITTEN, MOST_SPOKEN, MOST_READINGS = 100, 160, 40


def accepted_readings(rows, sources, *, id_col: str = "doc_id", limit: int = MOST_READINGS):
    """Suggested readings ``rows(doc_id, ord, written, spoken)`` that may reach speech, of each text of ``sources(doc_id, text)``.

    A reading is of a name in Latin letters that stands in the text as a whole word, whatever its case, and is said in Cyrillic
    letters without Latin ones; neither has markup or line breaks. Of one name the first that holds stays, and of a text the first ``limit``.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from .text import folded, strip

    written, spoken = F.col("written"), F.col("spoken")
    whole = F.concat(F.lit("(?i)(?<![A-Za-z0-9])\\Q"), F.replace(written, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9])"))
    ascii_only = written.rlike(r"\A[\x00-\x7F]*\z")
    key = F.coalesce(folded(F.when(~ascii_only, written)), F.lower(written))  # of ASCII, folding is lower case
    between_spaces = F.contains("text", F.concat(F.lit(" "), written, F.lit(" ")))  # the usual case, for which no text is decoded
    given = rows.select(id_col, "ord", strip(F.coalesce("written", F.lit(""))).alias("written"), strip(F.coalesce("spoken", F.lit(""))).alias("spoken"))
    is_name = written.rlike(rf"\A(?=[^A-Za-z]*[A-Za-z])[^<>{{}}\n\r]{{1,{MOST_WRITTEN}}}\z")
    is_said = spoken.rlike(rf"\A(?=[^А-Яа-яЁё]*[А-Яа-яЁё])[^A-Za-z<>{{}}\n\r]{{1,{MOST_SPOKEN}}}\z")
    plain = given.where(is_name & is_said)
    # keys come before the join: Python would hide how rows were dealt out by text, and each window would deal them out again
    there = plain.withColumn("__key", key).join(sources.select(id_col, "text"), id_col).where(between_spaces | F.rlike(F.col("text"), whole)).drop("text")
    first = there.withColumn("__n", F.row_number().over(Window.partitionBy(id_col, "__key").orderBy("ord"))).where("__n = 1")
    return first.withColumn("__r", F.row_number().over(Window.partitionBy(id_col).orderBy("ord"))).where(F.col("__r") <= limit).drop("__n", "__r", "__key")
