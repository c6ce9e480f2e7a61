"""Sinks: issues, site pages, messages, search documents, subscribers. Writes go by Spark's commit protocol; sending is idempotent by key."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_issues(issues: DataFrame, path: str) -> None:
    """``issues(date, language, markdown)``: a folder for each day and language; days that are written replace what was there."""
    issues.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "language").parquet(path)


def site_index(pages: DataFrame, limit: int = 60) -> DataFrame:
    """``pages(issue, name)`` -> the newest issues with how many pages they have besides the index."""
    return pages.groupBy("issue").agg(F.count_if(F.col("name") != "index").alias("articles")).orderBy(F.desc("issue")).limit(limit)


#: A name that can't leave its folder.
_NAME = "^[A-Za-z0-9][A-Za-z0-9._-]*$"


def front_matter(title: Column) -> Column:
    """What stands before a site's page: its title, if there is one, as a quoted scalar; search leaves the page out."""
    quoted = F.to_json(F.array(title))
    return F.concat(F.lit("---\n"), F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("title: "), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("\n"))).otherwise(""), F.lit("search:\n  exclude: true\n---\n\n"))


def _put(root: str, rows: Iterable) -> None:
    """Writes each row's file whole: under another name first, then in place. It may be called again for the same rows."""
    import uuid

    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    for r in rows:
        files.create_dir(f"{base}/{r.issue}", recursive=True)
        new = f"{base}/{r.issue}/.{r.slug}-{uuid.uuid4().hex}"
        with files.open_output_stream(new) as f:
            f.write(r.text.encode())
        files.move(new, f"{base}/{r.issue}/{r.slug}.md")


def write_site_pages(pages: DataFrame, root: str) -> None:
    """``pages(issue, slug, title, markdown)`` as ``root/issue/slug.md``, files that are there replaced; then the list of issues anew.

    ``root`` is a folder that the driver and all executors share, by a path or address that pyarrow knows. A name that could lead out
    of the folder is an error before anything is written.
    """
    bad = pages.where(~F.coalesce(F.col("issue").rlike(_NAME) & F.col("slug").rlike(_NAME), F.lit(False))).select("issue", "slug").limit(1).collect()
    if bad:
        raise ValueError(f"not a page's name: {bad[0].issue!r}/{bad[0].slug!r}")
    made = pages.select("issue", "slug", F.concat(front_matter(F.col("title")), F.coalesce("markdown", F.lit(""))).alias("text"))
    made.foreachPartition(lambda rows: _put(root, rows))
    write_site_index(root)


def write_site_index(root: str, limit: int = 60, heading: str = "Archive") -> None:
    """``root/index.md``: the newest issues with the number of their pages."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    inside = lambda at: files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    issues = sorted((x.base_name for x in inside(base) if x.type == fs.FileType.Directory), reverse=True)[:limit]
    lines = [f"# {heading}", "", '<ul class="archive">']
    for name in issues:
        n = sum(x.base_name.endswith(".md") and x.base_name != "index.md" and x.base_name[0] != "." for x in inside(f"{base}/{name}"))
        lines.append(f'<li><a href="{name}/"><span>{name.rpartition("-")[0] or name}</span><span>{n}</span></a></li>')
    with files.open_output_stream(f"{base}/.index") as f:
        f.write(("---\nsearch:\n  exclude: true\n---\n\n" + "\n".join([*lines, "</ul>"]) + "\n").encode())
    files.move(f"{base}/.index", f"{base}/index.md")


def messages(items: DataFrame, overview: str, *, overview_last: bool = False) -> DataFrame:
    """``(seq, kind, text)``: the overview first, or last after the items in reverse."""
    order = F.desc("ord") if overview_last else F.asc("ord")
    from pyspark.sql import Window

    body = items.select(F.row_number().over(Window.orderBy(order)).alias("seq"), F.lit("item").alias("kind"), F.col("markdown").alias("text"))  # one digest's items
    top = items.sparkSession.createDataFrame([(0 if not overview_last else 1 << 30, "overview", overview)], "seq int, kind string, text string")
    return body.unionByName(top).orderBy("seq")


def send(rows: DataFrame, deliver: Callable[[Iterable], None]) -> None:
    """Calls ``deliver`` with the rows of each partition; it must bear being called again for the same rows."""
    rows.foreachPartition(deliver)


def upserted(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with their key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def bulk_lines(docs: DataFrame, index: str) -> DataFrame:
    """Lines of a bulk request: an action and a document each."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col("id").alias("_id")).alias("index")))
    return docs.select(F.concat(action, F.lit("\n"), F.to_json(F.struct(*docs.columns))).alias("value"))


def subscribed(current: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Subscribers ``(email, ord)`` after additions and removals, each once, as they came."""
    from ..operators.dedup import keep_first

    both = current.select("email", F.struct(F.lit(0).alias("new"), "ord").alias("__o")).unionByName(add.select("email", F.struct(F.lit(1).alias("new"), "ord").alias("__o")))
    kept = keep_first(both.withColumn("email", F.lower(F.btrim("email"))), "email", order="__o").join(remove.select(F.lower(F.btrim("email")).alias("email")), "email", "left_anti")
    return kept.select("email", (F.col("__o.new").cast("long") * (1 << 40) + F.col("__o.ord")).alias("ord"))


def subscription_requests(mails: DataFrame, subject: str) -> DataFrame:
    """``mails(ord, sender, subject)`` with exactly that subject, from people."""
    low = F.lower(F.btrim("sender"))
    return mails.where((F.lower(F.btrim("subject")) == subject.lower()) & ~low.rlike("no-?reply|mailer-daemon|postmaster")).select(low.alias("email"), "ord")


def response_error(platform: str, body) -> object:
    """The error that a chat platform reports inside a successful answer, else null."""
    code = lambda k: F.try_variant_get(F.try_parse_json(body), f"$.{k}", "long")
    known = {"feishu": ("code", "StatusCode"), "dingtalk": ("errcode",), "slack": (), "generic": ("code", "StatusCode", "errcode")}[platform]
    found = F.lit(None).cast("string")
    for k in known:
        found = F.coalesce(found, F.when(code(k) != 0, F.concat(F.lit(f"{k}="), code(k).cast("string"))))
    return found
