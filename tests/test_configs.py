import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import configs


@pytest.fixture(scope="module")
def run(spark):
    def over(rewrite, *trees):
        df = spark.createDataFrame([(i, json.dumps(t, ensure_ascii=False)) for i, t in enumerate(trees)], "i int, t string")
        got = [json.loads(r[0]) for r in df.orderBy("i").select(F.to_json(rewrite(F.parse_json("t")))).collect()]
        return got if len(trees) > 1 else got[0]

    return over


ENV = {"TOKEN": 'a"b\\c', "URL": "https://x/", "NEST": "${TOKEN}", "EMPTY": ""}


def env():
    return F.create_map(*[F.lit(x) for p in ENV.items() for x in p])


def test_references_are_put_in_at_any_depth(run):
    tree = {"a": "${URL}p?t=${TOKEN}", "${URL}": "name stays", "deep": [[{"b": ["${NEST}", {"c": {"d": "x${EMPTY}y"}}]}]], "n": [1, 2.5, True, None, ""], "no": "${MISSING} ${} $URL ${a-b}", "same": "${URL}${URL}", "text": 'é "q" \n:{}[],', "e": {}, "l": []}
    want = {"a": 'https://x/p?t=a"b\\c', "${URL}": "name stays", "deep": [[{"b": ["${TOKEN}", {"c": {"d": "xy"}}]}]], "n": [1, 2.5, True, None, ""], "no": "${MISSING} ${} $URL ${a-b}", "same": "https://x/https://x/", "text": 'é "q" \n:{}[],', "e": {}, "l": []}
    assert run(lambda t: configs.expanded(t, env()), tree) == want
    assert run(lambda t: configs.expanded(t, env()), "${URL}", ["${URL}"], 5, None) == ["https://x/", ["https://x/"], 5, None]
    deep = "${URL}"
    for _ in range(60):
        deep = {"k": [deep]}
    assert json.dumps(run(lambda t: configs.expanded(t, env()), deep)).count("https://x/") == 1


def test_secrets_are_taken_out(run):
    tree = {
        "api_key": "s3cret", "api_key_env": "MY_KEY", "TOKEN": {"a": ["x", {"b": "y"}]}, "secrets": "stays", "x-token-y": [1, 2], "auth_env": {"password": "kept"},
        "list": [{"password": None}, {"name": "n", "deep": {"client-secret": 5, "after": "ok"}}], "monkey": "fine", "cookie": True,
        "headers": "Authorization: Bearer x\nX-Trace: 1\nApi-Key:abc", "url": "https://me:pw@Host.org:8443/p/a?token=1&q=a+b&q=%C3%A9*~&flag#frag", "plain": "http://h/p?x=1", "ftp": "ftp://u:p@h/", "last": "end",
    }
    want = {
        "api_key": "<redacted>", "api_key_env": "MY_KEY", "TOKEN": "<redacted>", "secrets": "stays", "x-token-y": "<redacted>", "auth_env": {"password": "kept"},
        "list": [{"password": "<redacted>"}, {"name": "n", "deep": {"client-secret": "<redacted>", "after": "ok"}}], "monkey": "fine", "cookie": "<redacted>",
        "headers": "Authorization: <redacted>\nX-Trace: 1\nApi-Key:<redacted>", "url": "https://<redacted>@host.org:8443/p/a?token=%3Credacted%3E&q=a+b&q=%C3%A9%2A~&flag=#frag", "plain": "http://h/p?x=1", "ftp": "ftp://u:p@h/", "last": "end",
    }
    assert run(configs.redacted, tree) == want
    assert run(configs.redacted, [], {}, "token: x", [["https://u@h/"]]) == [[], {}, "token: <redacted>", [["https://<redacted>@h/"]]]


def test_null_trees_stay_null(spark):
    none = F.lit(None).cast("variant")
    assert spark.range(1).select(configs.redacted(none).isNull(), configs.expanded(none, env()).isNull()).first()[:] == (True, True)


def test_feed_addresses(spark):
    text = F.lit("https://x/?k=${K}&l=${L}")
    assert spark.range(1).select(configs.expanded_text(text, F.create_map(F.lit("K"), F.lit(" v ")), strip=True)).first()[0] == "https://x/?k=v&l=${L}"


def test_files(spark, tmp_path):
    path = f"{tmp_path}/config.json"
    with pytest.raises(FileNotFoundError):
        configs.load(spark, path, {})
    configs.save(spark, path, "{not json")
    with pytest.raises(configs.ConfigError):
        configs.load(spark, path, {})
    configs.save(spark, path, json.dumps({"url": "${URL}", "n": [1]}))
    assert (tmp_path / "config.json.bak").read_text() == "{not json"
    tree = configs.load(spark, path, ENV)
    assert spark.range(1).select(F.variant_get(tree, "$.url", "string"), F.variant_get(tree, "$.n[0]", "int")).first()[:] == ("https://x/", 1)
    configs.save(spark, path, "{}", backup=False)
    assert (tmp_path / "config.json.bak").read_text() == "{not json" and (tmp_path / "config.json").read_text() == "{}"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["config.json", "config.json.bak"]


def test_long_strings_and_escapes(run):
    long = "x" * 40_000
    tree = {"a": long + "${EMPTY}", "b": [f'{long} "q" \\ \n é', "a:\tb\\"], "k\\": "x:y", '"password"': "kept", "k": "a${TOKEN}\u0001"}
    assert run(lambda t: configs.expanded(t, env()), tree) == tree | {"a": long, "k": 'aa"b\\c\u0001'}
    assert run(configs.redacted, tree) == tree


def test_every_core_has_rows(spark, tmp_path):
    from tidemill.plans import registry

    spark.range(400).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "id % 25 AS c_nationkey", "'M' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("config_trees", "request_headers"):
        made = registry.QUERIES[name](spark, str(tmp_path))
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism
