"""Configuration trees of any depth, as VARIANT: references to the environment put in, secrets taken out, files read and saved.

A tree is rewritten as its JSON text, token by token: a string before a colon is a name, other strings are leaves, and brackets tell
how deep a token lies. So no schema and no recursion is needed, and nothing but column expressions runs for a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import urls
from .udfs import let

#: What stands for a secret, and names that tell one.
REDACTED = "<redacted>"
SENSITIVE = r"(?i)(?:^|[-_])(authorization|cookie|credential|key|password|secret|signature|token|api[-_]?key)(?:$|[-_])"
_TOKEN = r'("(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^{}\[\],:"]+)'
_REFERENCE = r"(?U)\$\{(\w+)\}"


class ConfigError(ValueError):
    """A configuration that isn't JSON."""


def _tokens(tree: Column) -> Column:
    return F.regexp_extract_all(F.to_json(tree), F.lit(_TOKEN), F.lit(1))


def _said(token: Column) -> Column:
    """The text of a string token; only one with escapes needs to be parsed."""
    bare = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(token.startswith('"') & ~F.contains(token, F.lit("\\")), bare).otherwise(F.try_variant_get(F.parse_json(token), "$", "string"))


def _quoted(text: Column) -> Column:
    """A string token of a text; only one with what JSON escapes needs to be written by ``to_json``."""
    escaped = let(F.to_json(F.array(text)), lambda whole: F.substring(whole, F.lit(2), F.length(whole) - 2))
    return F.when(text.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def _at(tokens: Column, i: Column) -> Column:
    return F.coalesce(F.get(tokens, i), F.lit(""))


def expanded_text(text: Column, env: Column, strip: bool = False) -> Column:
    """``${NAME}`` replaced by ``env``'s value of the name; names that it doesn't have stay as they are. A value is never looked through again."""
    between = F.split(text, _REFERENCE, -1)
    names = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1))
    value = lambda n: F.try_element_at(env, n)
    known = F.transform(names, lambda n: F.coalesce(F.btrim(value(n)) if strip else value(n), F.concat(F.lit("${"), n, F.lit("}"))))
    return F.array_join(F.zip_with(between, known, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def _leaves(tree: Column, rewrite: Callable[[Column], Column], sign: str) -> Column:
    """The tree with every string that isn't a name rewritten; ``rewrite`` leaves a text without ``sign`` as it is."""

    def over(tokens: Column) -> Column:
        return F.array_join(F.transform(tokens, lambda t, i: F.when(t.startswith('"') & F.contains(t, F.lit(sign)) & (_at(tokens, i + 1) != ":"), let(let(_said(t), rewrite), _quoted)).otherwise(t)), "")

    return F.parse_json(let(_tokens(tree), over))


def expanded(tree: Column, env: Column) -> Column:
    """A tree with references to ``env`` (a map) in its strings replaced; names of members stay."""
    return _leaves(tree, lambda text: expanded_text(text, env), "${")


def _query_pair(pair: Column) -> Column:
    """A name and value of a query, read and written as forms are; a secret's value is hidden."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    form = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    value = plain(F.when(F.contains(pair, F.lit("=")), F.substring(pair, F.instr(pair, F.lit("=")) + 1, F.length(pair))).otherwise(""))
    return let(plain(F.split_part(pair, F.lit("="), F.lit(1))), lambda name: F.concat(form(name), F.lit("="), form(F.when(name.rlike(SENSITIVE), REDACTED).otherwise(value))))


def redacted_url(url: Column) -> Column:
    """Of a web address, the user and the values of secrets in the query hidden; anything else as it is."""
    return F.when(urls.scheme(url).isin("http", "https"), let(urls.netloc(url), lambda place: _redacted_place(url, place))).otherwise(url)


def _redacted_place(url: Column, place: Column) -> Column:
    digits = F.regexp_extract(place, ":([0-9]+)$", 1)
    host = F.when(F.contains(place, F.lit("@")), F.concat(F.lit(REDACTED + "@"), urls.host(url), F.when(digits != "", F.concat(F.lit(":"), digits.try_cast("int").cast("string"))).otherwise(""))).otherwise(place)
    pairs = F.transform(F.filter(F.split(urls.query(url), "&"), lambda p: p != ""), _query_pair)
    led = lambda text, sign: let(text, lambda x: F.when(x != "", F.concat(F.lit(sign), x)).otherwise(""))
    made = F.concat(urls.scheme(url), F.lit("://"), host, urls.path(url), led(F.array_join(pairs, "&"), "?"), led(F.regexp_extract(url, "#(.+)$", 1), "#"))
    return F.when(place != "", F.coalesce(made, url)).otherwise(url)


def _redacted_line(line: Column) -> Column:
    at = F.instr(line, F.lit(":"))
    name = F.substring(line, F.lit(1), at - 1)
    gap = F.when(F.substring(line, at + 1, F.lit(1)) == " ", " ").otherwise("")
    return F.when((at > 0) & F.btrim(name).rlike(SENSITIVE), F.concat(name, F.lit(":"), gap, F.lit(REDACTED))).otherwise(line)


def redacted_text(text: Column) -> Column:
    """A string of a tree: header lines that name a secret lose its value, and web addresses what :func:`redacted_url` hides."""
    kept = lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    headers = F.array_join(F.transform(let(F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n"), kept), _redacted_line), "\n")
    return F.when(F.contains(text, F.lit(":")), let(headers, redacted_url)).otherwise(text)


def redacted(tree: Column) -> Column:
    """A tree without its secrets: what a sensitive name holds is hidden as a whole, names that end in ``_env`` keep what they hold."""
    return F.parse_json(let(_tokens(tree), _redacted))


def _redacted(tokens: Column) -> Column:
    state = lambda out, depth, mode, until: F.struct(out.alias("out"), depth.alias("depth"), mode.alias("mode"), until.alias("until"))
    start = state(F.array().cast("array<string>"), F.lit(0), F.lit("read"), F.lit(-1))

    def step(s: Column, i: Column) -> Column:
        t = F.get(tokens, i)
        depth = s["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        add = lambda x: F.concat(s["out"], F.array(x))
        opens = t.isin("{", "[")
        leaf = t.startswith('"') & F.contains(t, F.lit(":")) & (_at(tokens, i + 1) != ":")  # texts without a colon stay
        done = depth <= s["until"]  # the bracket that ends what is kept or hidden
        mode = F.when(done, "read").otherwise(s["mode"])
        plain = F.when(leaf, state(add(let(let(_said(t), redacted_text), _quoted)), depth, F.lit("read"), s["until"])).otherwise(state(add(t), depth, F.lit("read"), s["until"]))

        def member(name: Column) -> Column:
            return (
                F.when(F.lower(name).endswith("_env"), state(add(t), depth, F.when(opens, "keep").otherwise("read"), F.when(opens, s["depth"]).otherwise(s["until"])))
                .when(name.rlike(SENSITIVE), state(add(F.lit(f'"{REDACTED}"')), depth, F.when(opens, "hide").otherwise("read"), F.when(opens, s["depth"]).otherwise(s["until"])))
                .otherwise(plain)
            )

        return (
            F.when(s["mode"] == "hide", state(s["out"], depth, mode, s["until"]))
            .when(s["mode"] == "keep", state(add(t), depth, mode, s["until"]))
            .when(_at(tokens, i - 1) == ":", let(_said(_at(tokens, i - 2)), member))
            .otherwise(plain)
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, step, lambda s: F.array_join(s["out"], ""))


def load(spark: SparkSession, path: str, env: dict[str, str]) -> Column:
    """The configuration at a path, references to ``env`` replaced, as a VARIANT literal that any query can read from."""
    try:
        text = spark.read.text(path, wholetext=True).first().value
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(path) from None
    known = F.create_map(*[F.lit(x) for pair in env.items() for x in pair]) if env else F.create_map().cast("map<string,string>")
    made = spark.range(1).select(F.to_json(expanded(F.try_parse_json(F.lit(text)), known))).first()[0]
    if made is None:
        raise ConfigError(f"{path} isn't JSON")
    return F.parse_json(F.lit(made))


def save(spark: SparkSession, path: str, text: str, backup: bool = True) -> None:
    """Writes a file at once; what was there is kept beside it with ``.bak`` at its end."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, to, new = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".bak", ".new"))
    files = at.getFileSystem(conf)
    if backup and files.exists(at):
        jvm.org.apache.hadoop.fs.FileUtil.copy(files, at, files, to, False, True, conf)
    out = files.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(at, False)
    if not files.rename(new, at):
        raise OSError(f"{path} can't be written")
