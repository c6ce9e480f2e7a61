import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.functions import jsons, narration, times
from tidemill.functions import text as tx
from tidemill.operators import render, text_packing
from tidemill.sources import archive


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_sampling(spark):
    text = "A" * 1000 + "MIDDLE-MARKER" + "B" * 1000 + "ENDING-MARKER"
    got = one(spark, tx.selected_content(F.lit(text), 600, "head-middle-tail"))
    assert len(got) <= 600 and got.startswith("[Opening excerpt]\nA") and got.endswith("ENDING-MARKER")
    assert "A\n\n[Middle excerpt]\nA" in got and "MIDDLE-MARKER" in got and "B\n\n[Closing excerpt]\nB" in got
    assert one(spark, tx.selected_content(F.lit("0123456789" * 100), 500)) == "0123456789" * 50
    assert one(spark, tx.selected_content(F.lit("  short\u3000\n"), 500, "head-middle-tail")) == "short"
    assert one(spark, tx.selected_content(F.lit("ab " * 9), 6)) == "ab ab"
    assert one(spark, tx.selected_content(F.lit(None).cast("string"), 6)) is None


def test_interests(spark):
    source = lambda kind, description, tags, **config: (kind, description, tags, config)
    presets = [(0, "code", ["python", "rust", "go", "zig"], [source("rss", "Weekly python news", ["ml"], url="https://a.b/x"), source("github_repo", "x", None, owner="o", repo="r")]), (1, "other", [], [source("rss", "again", ["python"], url="https://a.b/x")])]
    domains = spark.createDataFrame(presets, "ord int, domain string, keywords array<string>, sources array<struct<type:string,description:string,tags:array<string>,config:map<string,string>>>")
    rows = spark.createDataFrame([(1, "I like Python"), (2, "machine learning"), (3, None), (4, "")], "id int, text string")
    got = {(r.id, r.domain): round(r.score, 9) for r in archive.interest_scores(rows, domains).collect()}
    assert got == {(1, "code"): 0.25, (1, "other"): 0.3}
    found = {(r.id, r.source): round(r.score, 9) for r in archive.source_scores(rows, domains, {"ML": ["machine learning"]}).collect()}
    assert found == {(1, "rss:https://a.b/x"): round(1.3 / 3, 9), (1, "github_repo:o/r"): round(1 / 3, 9), (2, "rss:https://a.b/x"): 0.25}


def test_parts(spark):
    got = one(spark, tx.content_parts(F.lit(" body \n\n--- Top Comments ---\n[a]: b ")))
    assert (got.main, got.comments) == ("body", "[a]: b")
    assert one(spark, tx.content_parts(F.lit("only"))).comments == ""


def test_escapes(spark):
    assert one(spark, tx.escaped_markdown(F.lit("a*b_[c](d) <x> & \n#1"))) == "a\\*b\\_\\[c\\]\\(d\\) &lt;x&gt; &amp; \n\\#1"
    assert one(spark, tx.escaped_markdown(F.lit("1. one\n- two - 2\n   + three\n    - code\n2) x\na|b~c's"))) == "\\1. one\n\\- two - 2\n   \\+ three\n    - code\n2\\) x\na|b~c's"
    assert one(spark, tx.balanced_highlights(F.lit("a <mark>b</mark> </mark> <mark>c"))) == "a <mark>b</mark>  <mark>c</mark>"
    assert one(spark, tx.spaced_scripts(F.lit("中文abc中"))) == "中文 abc 中"
    assert one(spark, tx.ellipsis(F.lit("é" * 10), 8)) == "ééééé..."
    assert one(spark, tx.has_cjk_leak(F.lit("текст 中"), "ru")) and not one(spark, tx.has_cjk_leak(F.lit("中"), "zh-CN"))
    assert one(spark, tx.normalized_lines(F.lit("a \t b\r\n\r\n\rc "))) == "a b\nc"
    assert one(spark, tx.headers(F.lit("A: 1\nbad\nA: 2\nB:x:y"))) == {"A": "2", "B": "x:y"}


def test_titles(spark):
    assert one(spark, tx.message_title(F.lit("first line\nsecond"))) == "first line"
    assert one(spark, tx.message_title(F.lit("句子。" + "x" * 100))) == "句子。"
    assert one(spark, tx.message_title(F.lit("x" * 100))) == "x" * 80


@pytest.mark.parametrize(("text", "want"), [("Tue, 06 Aug 2024 10:00:00 +0300", dt.datetime(2024, 8, 6, 7)), ("6 Aug 2024 10:00:00 GMT", dt.datetime(2024, 8, 6, 10)), ("2024-08-06T10:00:00Z", dt.datetime(2024, 8, 6, 10)), ("yesterday", None), (None, None)])
def test_feed_times(spark, text, want):
    assert one(spark, times.feed_time(F.lit(text).cast("string"))) == want


def test_more_times(spark):
    now = F.lit(dt.datetime(2024, 8, 6, 22))
    at = lambda s: one(spark, times.forum_time(F.lit(s), now))
    assert at("Сегодня, 10:05") == dt.datetime(2024, 8, 7, 7, 5) and at("Вчера, 01:00") == dt.datetime(2024, 8, 5, 22)
    assert at("06.08.24, 10:05") == dt.datetime(2024, 8, 6, 7, 5) and at("?") is None
    assert one(spark, times.tweet_time(F.lit("Tue Aug 06 10:00:00 +0000 2024"))) == dt.datetime(2024, 8, 6, 10)
    assert one(spark, times.compact(F.lit("20240806T100000Z"))) == dt.datetime(2024, 8, 6, 10)
    assert one(spark, times.stamp(F.lit(dt.datetime(2024, 8, 6, 10)))) == "2024-08-06T10:00:00Z"
    assert one(spark, times.stamp(F.lit(dt.datetime(2024, 8, 6, 10, 0, 0, 120)))) == "2024-08-06T10:00:00.000120Z"
    assert one(spark, times.window_operator(F.lit(23.2), now)) == "when:24h" and one(spark, times.window_operator(F.lit(200.0), now)) == "after:2024-08-06"


def test_json_salvage(spark):
    texts = ['{"a":1}', 'x ```json\n{"a": 1}\n``` y', 'so {bad} then {"a":1} end', "nothing", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(jsons.salvaged(F.col("t"))).collect()]
    assert [g and json.loads(g) for g in got] == [{"a": 1}, {"a": 1}, {"a": 1}, None, None]
    assert one(spark, jsons.canonical(F.lit('{"b": 1, "a": [1.5, "é"]}'))) == '{"a":[1.5,"é"],"b":1}'
    assert one(spark, jsons.incident_id(F.lit("p"), F.lit("ＡB, straße"))) == one(spark, jsons.incident_id(F.lit("p"), F.lit("ab STRASSE")))


def test_packing(spark):
    lines = F.array(*[F.lit(x) for x in ("aaaa", "bb", "c", "dddddddddd", "e")])
    assert one(spark, text_packing.packed_lines(lines, 8)) == ["aaaa\nbb", "c", "dddddddddd", "e"]
    assert one(spark, text_packing.packed_lines(F.array().cast("array<string>"), 8)) == []
    assert one(spark, text_packing.truncated_segments(F.lit("aaaa|bb|c"), 7, "|")) == "aaaa|bb"
    assert one(spark, text_packing.sampled_frames(F.array(*[F.lit(i) for i in range(10)]), 4)) == [0, 3, 6, 9]


def test_spoken_chunks():
    made = text_packing._spoken_chunks(" ".join(f"Предложение номер {i}, довольно длинное." for i in range(60)))
    assert all(text_packing.MIN_CHUNK <= len(c) <= text_packing.MAX_CHUNK for c in made)
    assert text_packing._spoken_chunks("") == [] and text_packing._spoken_chunks("a.\n\nb.") == ["a. b."]


def test_chunks_are_whole_even_and_within_bounds():
    made = lambda t: text_packing._spoken_chunks(t)
    sentences = lambda n, w="слово": " ".join(f"{w.capitalize()} номер {i} стоит тут." for i in range(n))
    sizes = [len(p) for p in made(sentences(200))]
    assert len(sizes) > 3 and max(sizes) <= 400 and min(sizes) >= 120 and max(sizes) - min(sizes) < 200
    assert " ".join(made(sentences(200))).split() == sentences(200).split()
    assert made("Коротко.\n\n" + sentences(6)) == ["Коротко. " + sentences(6)]
    assert all("\r" not in p and p.endswith(".") for p in made("\r\n\r\n".join([sentences(30)] * 3)))
    assert len(made("слово " * 400)) == 1 and made("\n\n   \n\n") == []
    shape = "Короткий заголовок.\n\nЛид. " + "Слово всякое разное тут. " * 30 + "\n\nБлок. " + "Текст. " * 100
    assert max(map(len, made(shape))) <= 400 and min(map(len, made(shape))) >= 120


def chunks_by_rule(text):
    """The rule of spoken chunks word for word, on strings."""
    paragraphs, lines = [], []
    for line in text.splitlines() + [""]:
        if line.strip():
            lines.append(line.strip())
        elif lines:
            paragraphs.append(" ".join(lines))
            lines = []
    sentences = [x for p in paragraphs for x in re.split(r"(?<=[.!?…])\s+", p) if x]

    def fill(limit):
        groups = []
        for s in sentences:
            now = groups[-1] if groups else None
            size = len(" ".join([*now, s])) if now else 0
            if now and size <= 400 and (size <= limit or len(" ".join(now)) < 120):
                now.append(s)
            else:
                groups.append([s])
        return groups

    if not sentences:
        return []
    whole, groups = len(" ".join(sentences)), fill(400)
    for _ in range(3):
        again = fill(whole / len(groups))
        same, groups = len(again) == len(groups), again
        if same:
            break
    made = [" ".join(g) for g in groups]
    if len(made) > 1 and len(made[-1]) < 120:
        *made, giver, tail = made
        if len(f"{giver} {tail}") <= 400:
            return [*made, f"{giver} {tail}"]
        gives = re.split(r"(?<=[.!?…])\s+", giver)
        while len(tail) < 120 and len(gives) > 1 and len(" ".join(gives[:-1])) >= 120:
            tail = f"{gives.pop()} {tail}"
        made += [" ".join(gives), tail]
    return made


def test_spoken_chunks_are_those_of_the_rule(spark):
    r = random.Random(8)
    sentence = lambda: "слово " * r.choice([0, 1, 3, 12, 40, 90]) + r.choice(["да.", "нет!", "что?", "так…", "без точки", "x"])
    texts = ["".join(sentence() + r.choice([" ", " ", "\n", "\n\n", "\r\n\r\n", "  "]) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += [t.text for t in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect()]
    for t in texts:
        assert text_packing._spoken_chunks(t) == chunks_by_rule(t)


def test_the_query_of_spoken_chunks(spark):
    from tidemill.plans import registry

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = [tuple(x) for x in registry.QUERIES["spoken"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted((d.doc_id, i, c) for d in docs for i, c in enumerate(chunks_by_rule(d.text or "")))


def test_captions(spark):
    seg = lambda *t: [(float(i), i + 1.0, x) for i, x in enumerate(t)]
    cases = [seg("hello", "hello", "hello world", "world again", "again"), seg("hello world", "hello world this is a test", "unrelated"), seg("abc def", "def ghi"), seg("abc", "xyz"), seg("long abcdefgh", "abcdefghij"), seg("x abc", "abcd"), [], None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<struct<start:double,end:double,text:string>>")
    got = [r[0] and [tuple(x) for x in r[0]] for r in rows.orderBy("i").select(text_packing.rolled_captions(F.col("s"))).collect()]
    assert got[0] == [(0.0, 3.0, "hello world"), (3.0, 5.0, "again")]
    assert [x[2] for x in got[1]] == ["hello world this is a test", "unrelated"]
    assert [[x[2] for x in g] for g in got[2:6]] == [["abc def", "ghi"], ["abc", "xyz"], ["long abcdefgh", "ij"], ["x abc", "abcd"]]
    assert got[6:] == [[], None]


def test_narration():
    say = narration._speakable
    assert say("6 августа 2026 года") == "шестого августа две тысячи двадцать шестого года"
    assert say("стоит $567 млн, 21 % и 11 тыс. т.е. 3.5 API") == "стоит пятьсот шестьдесят семь миллионов долларов, двадцать один процент и одиннадцать тысяч то есть три точка пять эй-пи-ай"
    assert say("§ 30-8-1 v1.36, x>=2") == "§ 30-8-1 v один точка тридцать шесть, x не ниже два"
    assert say("## Заголовок\nтекст https://a.b/c [1]") == "текст"
    cases = {
        "вышел 6 августа 2026 года.": "вышел шестого августа две тысячи двадцать шестого года.",
        "занятие длится 90 минут": "занятие длится девяносто минут",
        "подтверждается релизами \\[tool-2-1\\]\\[tool-2-2\\].": "подтверждается релизами.",
        "подробнее https://example.com/a/b тут": "подробнее тут",
        r"проверено \(tool-2-2, tool-2-3\), готово": "проверено, готово",
        "тест [tool-2-1] конец tool-1-2": "тест конец",
        "(https://a.b/c) x": "x",
        "текст [см. выше] дальше": "текст дальше",
        "https://example.com/a/b. тут": "тут",
        "см. [заметку](https://a.b/c), да": "см. да",
        "пусто ( , ) и (), tool-7 и TOOL-2-1-3": "пусто и, tool-7 и",
        r"число \[1\] тут": "число тут",
        "роботы, IoT и т.д.": "роботы, IoT и так далее",
        "Последняя мысль.\n\n## Блоги": "Последняя мысль.",
        "тег #Тема тут": "тег #Тема тут",
        "целые GPU и CLI": "целые джи-пи-ю и си-эл-ай",
        "протокол MCP и JSON": "протокол эм-си-пи и джейсон",
        "Kubernetes и Docker": "Kubernetes и Docker",
        "на MI300X через AWS": "на MI300X через эй-дабл-ю-эс",
        "1.2.3 и 1-2 и A-100": "1.2.3 и 1-2 и A-100",
        "10 000 строк, 1.5rc2": "десять тысяч строк, один точка пять эр-си два",
        "a &lt; 5": "a меньше пять",
        "$2 и $1,5 млн": "два доллара и один точка пять миллиона долларов",
    }
    assert {k: say(k) for k in cases} == cases
    assert [narration.number(n) for n in (0, 21, 1000, 2002, 10**6 + 12, 10**15)] == ["ноль", "двадцать один", "одна тысяча", "две тысячи два", "один миллион двенадцать", "1000000000000000"]
    assert [narration.ordinal(n) for n in (3, 21, 100, 1990, 2000, 2013, 11000)] == ["третий", "двадцать первый", "сотый", "одна тысяча девятьсот девяностый", "двухтысячный", "две тысячи тринадцатый", "одиннадцатьтысячный"]


def rows_for_issue(spark):
    schema = "profile_id string, ord int, title string, url string, score double, summary string, tags array<string>, metadata map<string,string>, source_type string, author string, published_at timestamp, artifact struct<language:string,title:string,blocks:array<struct<id:string,type:string,title:string,content:string,source_refs:array<string>,primary:boolean>>,sources:array<struct<id:string,title:string,url:string>>>"
    t = dt.datetime(2024, 8, 6, 9, 5)
    art = ("en", "Made <title>", [("p", "text", "P", "lead *x*", [], True), ("q", "text", "Why", "because", [], False)], [("s1", "A & B", "https://s.x/?a=1&b=2"), ("s2", "bad", "javascript:x")])
    return spark.createDataFrame([("tech", 0, "raw", "https://a.b/1", 9.0, "sum", ["x y"], {"discussion_url": "https://n.y/2"}, "rss", None, t, art), ("news", 1, "[t](javascript:1)", "javascript:alert(1)", None, "s<b>", [], {}, "reddit", "me", t, None), ("tech", 2, "third", "https://a.b/3", 7.0, "", None, {}, "rss", "me", t, None)], schema)


def test_issue(spark):
    md = render.issue(rows_for_issue(spark), "2024-08-06", 10, names={"tech": "Technology"}).first().markdown
    assert md.startswith("# Digest - 2024-08-06\n\n> From 10 items, 3 important content pieces were selected")
    assert "**Technology**\n1. [Made &lt;title&gt;](#item-tech-1) ⭐️ 9.0/10\n2. [third](#item-tech-2)" in md and "**News**" in md
    assert "### [Made &lt;title&gt;](https://a.b/1) ⭐️ 9.0/10\n\nlead \\*x\\*" in md and "**「Why」** because" in md
    assert '<li><a href="https://s.x/?a=1&amp;b=2">A &amp; B</a></li>\n<li>bad</li>' in md
    assert "[Discussion](https://n.y/2)" in md and "](javascript" not in md and "<b>" not in md and "?/10" in md
    assert "none met" in render.issue(rows_for_issue(spark).where("false"), "2024-08-06", 4).first().markdown


def test_pages_and_search(spark):
    pages = render.article_pages(rows_for_issue(spark), "2024-08-06", "en", "https://site/").orderBy("url").collect()
    assert [p.slug for p in pages] == ["news-1", "tech-1", "tech-2"] and {p.slug: p.next for p in pages}["tech-2"].endswith("/news-1/")
    docs = render.search_documents(rows_for_issue(spark), "2024-08-06", "en", "https://site")
    assert [r.id for r in render.search(docs, "because third").collect()] == ["2024-08-06-en-tech-2", "2024-08-06-en-tech-1"]
    assert render.search(docs, "...").collect() == []
    assert render.headline_messages(rows_for_issue(spark), "https://site", "2024-08-06").count() == 1
