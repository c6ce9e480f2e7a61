from tidemill.plans import registry

BYLINES = ["Aug 6, 00:00", "Aug 7, 00:00", "Aug 8, 00:00"]


def test_merge_fold_takes_whole_texts(spark, tmp_path):
    long = "word " * 60
    docs = [(1, long + "End", "en", "a"), (2, long + "end", "en", "b"), (3, long + "  END", "en", "a"), (4, long + "another end", "en", "c"), (5, long + "end", "fr", "b"), (6, long + "End", "en", "b"), (7, "short", "en", "a"), (8, "", "en", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    groups = {}
    for d in docs:
        groups.setdefault((" ".join(d[1].lower().split()), d[2]), []).append(d)
    want = []
    for g in groups.values():
        best = max(g, key=lambda d: len(d[1]))  # the first at ties
        content = best[1]
        for d in g:
            if d is not best and content and d[1] not in content:
                content += f"\n\n--- From {d[3]} ---\n{d[1]}"
        want.append((f"doc:{best[0]}", g[0][0], content, ",".join(dict.fromkeys(d[3] for d in g)) if len(g) > 1 else None, ",".join(f"doc:{d[0]}" for d in g)))
    got = [tuple(r) for r in registry.QUERIES["merge_fold"](spark, str(tmp_path)).select("id", "ord", "content", "sources", "members").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(want) == 5


def test_daily_issue_renders_every_good_document_whole(spark, tmp_path):
    docs = [(i, f"w{i} " * 150 + f"end{i}", "en", f"s{i % 3}") for i in (*range(150), *range(230, 240))]
    good = {i for i, *_ in docs if i % 5 and i < 200}
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in good), 0) for i, *_ in docs if i != 7], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good.discard(7)
    want = {}
    for day, date in enumerate(("2024-08-06", "2024-08-07", "2024-08-08")):
        own = [d for d in docs if d[0] // 100 == day]
        picked = [d for d in own if d[0] in good]
        if not picked:
            want[date] = f"# Digest - {date}\n\n> Analyzed {len(own)} items, but none met the importance threshold.\n"
            continue
        toc, body = "", []
        for source in dict.fromkeys(d[3] for d in picked):
            for n, d in enumerate((d for d in picked if d[3] == source), 1):
                toc += (f"\n\n**{source.title()}**\n" if n == 1 else "\n") + f"{n}. [Document {d[0]}](#item-{source}-{n}) ⭐️ 1/10"
                item = f'<a id="item-{source}-{n}"></a>\n### [Document {d[0]}](https://example.org/{d[0]}) ⭐️ 1/10\n\n{d[1]}\n\nrss · desk · {BYLINES[day]}\n\n**Tags**: `#en`\n\n---'
                body.append((f"## {source.title()}\n\n" if n == 1 else "") + item)
        want[date] = f"# Digest - {date}\n\n> From {len(own)} items, {len(picked)} important content pieces were selected\n\n---{toc}\n\n---\n\n" + "\n\n".join(body) + "\n"
    got = {r.date: r.markdown for r in registry.QUERIES["daily_issue"](spark, str(tmp_path)).collect()}
    assert got == want
