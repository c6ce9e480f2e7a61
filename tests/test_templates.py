import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import templates as tp
from tidemill.functions.text import details_to_markdown


@pytest.fixture(scope="module")
def say(spark):
    def run(template, /, **values):
        df = spark.createDataFrame([tuple(None if v is None else str(v) for v in values.values()) or ("",)], ", ".join(f"{k} string" for k in values) or "x string")
        column = tp.compiled(template, {k: F.col(k) for k in values}) if isinstance(template, str) else tp.compiled_json(template, {k: F.col(k) for k in values})
        return df.select(column.alias("v")).first().v

    return run


def test_texts(say):
    assert say("Hello #{name}, it is #{date}", name="you", date="2026-04-24") == "Hello you, it is 2026-04-24"
    assert say("#{unknown} #{name}", name="#{date}", date="x") == "#{unknown} #{date}"
    assert say("", a=1) == "" and say("plain") == "plain" and say("#{a}#{a}", a=7) == "77"
    assert say("#{a} and #{a?limit=3}", a=None) == "#{a} and #{a?limit=3}"
    assert say("#{a-b} #{} #{ a }", a="x") == "#{a-b} #{} #{ a }"
    assert say("#{a}", a="lines\n\n\"quoted\" \\ $1") == "lines\n\n\"quoted\" \\ $1"


def test_segments(say):
    assert say("#{a?limit=7&split=|}", a="aaa|bbb|c") == "aaa|bbb"
    assert say("#{a?limit=6&split=|}", a="aaa|bbb|c") == "aaa"
    assert say("#{a?limit=2&split=|}", a="aaaa|b") == "aaaa"
    assert say("#{a?limit=5}", a="one---two") == "one" and say("#{a?limit=9}", a="one---two") == "one---two"
    assert say("#{a?limit=3&split=|}", a="") == "" and say("#{a?split=|}", a="x|y") == "x|y" and say("#{a?limit=3&split=}", a="abcdef") == "abcdef"
    assert say("#{a?limit=4&split=.*}!", a="ab.*c.*d") == "ab!" and say("#{a?limit=5&split=.*}!", a="ab.*c.*d") == "ab.*c!"
    with pytest.raises(ValueError):
        say("#{a?limit=x}", a="1")


def test_trees(say):
    tree = {"msg": "#{title}: #{n}", "deep": {"list": ["#{text}", 1, None, True, {"k #{title}": "#{no}"}], "empty": {}, "none": []}, "é": 1.5}
    got = json.loads(say(tree, title='a "quoted" \\ title', n=3, text="line\n\ttab\u0001 é #{title}"))
    assert got == {"msg": 'a "quoted" \\ title: 3', "deep": {"list": ["line\n\ttab\u0001 é #{title}", 1, None, True, {"k #{title}": "#{no}"}], "empty": {}, "none": []}, "é": 1.5}
    assert json.loads(say(["#{a?limit=3&split=|}"], a='"x|y|z')) == ['"x'] and say([], a="x") == "[]"


def test_bodies(spark):
    df = spark.createDataFrame([("<details><summary>References</summary><ul><li>Plain item</li></ul></details>", "t")], "summary string, t string")
    values = {"summary": F.col("summary"), "t": F.col("t")}
    bodies = [None, "", "  ", {"text": "#{summary}"}, '{"text": "#{t}"}', '{"text": #{t}}', "text=#{t}", ["#{t}"]]
    got = [tuple(r[0]) for b in bodies for r in df.select(tp.body(b, values)).collect()]
    assert got == [(None, tp.FORM)] * 3 + [('{"text": "**References**\\n\\n- Plain item"}', tp.JSON), ('{"text": "t"}', tp.JSON), ('{"text": t}', tp.FORM), ("text=t", tp.FORM), ('["t"]', tp.JSON)]


def test_no_python_runs_for_a_row(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("a"))
    plan = df.select(tp.compiled_json({"x": ["#{a?limit=3&split=.}"]}, {"a": F.col("a")}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_folded_sections(spark):
    block = lambda inside, title="References": f"## Item\n\n<details><summary>{title}</summary>\n<ul>\n{inside}\n</ul>\n</details>\n"
    cases = {
        '<a id="item-1"></a>\n' + block('<li><a href="https://example.com/a">Example A</a></li>\n<li><a class="x" href=\'https://example.com/b?x=1&amp;y=2\'>B &lt;b&gt;</a></li>', "参考"): "\n## Item\n\n**参考**\n\n- [Example A](https://example.com/a)\n- [B \\<b\\>](https://example.com/b?x=1&y=2)\n",
        block('<li><a href="javascript:alert(1)">click [me](https://evil.example)</a></li>'): "## Item\n\n**References**\n\n- click \\[me\\]\\(https://evil.example\\)\n",
        block('<li><a href="https://safe.example/) [bad](javascript:alert(1))">click</a></li>'): "## Item\n\n**References**\n\n- click\n",
        block('<li><a href="https://x.org/wiki/C_(s)">C</a></li><li></li><li><b>bold</b>\n text</li><li><a href="mailto:a@b.c">m</a></li><li><a href="https:///p">p</a></li>'): "## Item\n\n**References**\n\n- [C](https://x.org/wiki/C_(s))\n- bold text\n- [m](mailto:a@b.c)\n- p\n",
        "<details><summary> </summary> only <i>text</i> </details><b>stays</b>": "**References**\n\nonly text<b>stays</b>",
        "<details><summary>t*</summary></details>": "**t\\***",
        "no html": "no html",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, t string")
    assert [r.v for r in rows.orderBy("i").select(details_to_markdown("t").alias("v")).collect()] == [*cases.values(), None]
