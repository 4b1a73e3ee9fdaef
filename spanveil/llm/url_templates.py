"""Filtering of URLs by rules and, where none fits, by path templates.

Paths of each host form a tree of segments, as deep as the paths are unless a depth is given. From
the top down, a node that has many different children turns them into one wildcard; templates are
what is left. Below a node of few paths no node has many children, so that these are done at once
and the levels end with the last node of many paths. The
branches of a host whose share of blocked pages doesn't differ from the host's by more than
chance are merged. A template is rejected if its labelled purity, the
share of blocked pages among those that a rule decides, reaches a bound. Shares are
smoothed: towards the same template over all hosts, and that towards all pages, so
that hosts without any labelled page are judged by what their paths look like elsewhere.

Only DataFrame functions are used. Pages are counted by host and path first; all that
follows works on distinct paths, so a host with very many pages is no hot group, and every
grouping has partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import settle

#: Depth that a caller may ask for: so many segments of a path are looked at one by one, and what
#: follows is one last wildcard. Without a depth there is no such bound.
DEPTH = 3
#: Different children that make a node's children variable.
VARIETY = 8
#: Labelled pages that a smoothed share is worth before any are seen.
PRIOR = 4.0
#: Standard deviations by which a branch differs.
APART = 2.0
#: Smoothed share of blocked pages from which a template is rejected.
PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of the rules (host, path, verdict) that fits, as struct of rule and verdict.

    A rule fits its host and all subdomains, if the path starts with the rule's. Null
    if none fits. Rules of the same length go by their text.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r), reverse=False):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        hit = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit).otherwise(out)
    return out


def path_templates(paths: DataFrame, depth: int | None = None, variety: int = VARIETY) -> DataFrame:
    """The distinct paths (host, path, ...) with the template of each."""
    parts = F.split("path", "/")
    longer = F.lit("")
    if depth is not None:
        longer = F.when(F.size(parts) > depth + 1, F.lit("/**")).otherwise(longer)
    columns = [*paths.columns, "template"]
    active, finished, level = paths.withColumn("template", F.lit("")), [], 1
    while depth is None or level <= depth:
        part = F.get(parts, F.lit(level))
        frame = active.withColumn(
            "segment", F.when(part.isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), part))
        )
        children = (
            frame.groupBy("host", "template", "segment")
            .agg(F.count("*").alias("own_paths"))
            .groupBy("host", "template")
            .agg(
                (F.count("*") >= variety).alias("variable"),
                (F.sum("own_paths") < variety).alias("few"),
            )
        )
        own = F.when(F.col("variable") & (F.col("segment") != ""), F.lit("/*")).otherwise(
            F.col("segment")
        )
        count = F.size(parts) if depth is None else F.lit(depth - level + 1)
        rest = F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(level + 1), count), "/"))
        rest = F.when(F.size(parts) > level, F.concat(rest, longer)).otherwise(F.lit(""))
        ended = F.col("segment") == ""
        done = F.col("few") | ended
        if level == depth:
            own, done = F.concat(own, longer), F.lit(True)
        placed = frame.join(children, ["host", "template"]).select(
            *paths.columns,
            F.concat("template", F.when(F.col("few"), rest).otherwise(own)).alias("template"),
            done.alias("_done"),
        )
        placed = settle(placed, "url-level")
        finished.append(placed.where("_done").select(*columns))
        active = placed.where("not _done").select(*columns)
        level += 1
        if active.isEmpty():
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.union(more)
    return out


def template_verdicts(templates: DataFrame) -> DataFrame:
    """Smoothed purity of each (host, template) from labelled pages.

    `templates` has host, template, blocked and allowed (pages that rules decide).
    """

    def counted(frame: DataFrame, keys: list[str], name: str) -> DataFrame:
        return frame.groupBy(*keys).agg(
            F.sum("blocked").alias(f"b_{name}"),
            F.sum(F.col("blocked") + F.col("allowed")).alias(f"n_{name}"),
        )

    def share(blocked: str, labelled: str, before: Column) -> Column:
        return (F.col(blocked) + F.lit(PRIOR) * before) / (F.col(labelled) + F.lit(PRIOR))

    whole = counted(templates, [], "all").select(share("b_all", "n_all", F.lit(0.5)).alias("p"))
    overall = F.coalesce(F.lit(whole.first()["p"]), F.lit(0.5))
    everywhere = counted(templates, ["template"], "any").select(
        "template", share("b_any", "n_any", overall).alias("p_any")
    )
    branch = counted(templates, ["host", "template"], "own")
    host = counted(templates, ["host"], "host")
    mean = F.col("b_host") / F.greatest("n_host", F.lit(1))
    deviation = F.sqrt(F.col("n_own") * mean * (F.lit(1.0) - mean))
    off = F.col("b_own") - F.col("n_own") * mean
    group = (
        F.when(off > F.lit(APART) * deviation, F.lit("more"))
        .when(off < F.lit(-APART) * deviation, F.lit("less"))
        .otherwise(F.lit("alike"))
    )
    grouped = branch.join(host, "host").withColumn("branch", group).join(everywhere, "template")
    # Branches alike are one; the template over all hosts still tells them apart before labels do.
    merged = grouped.groupBy("host", "branch").agg(
        F.sum("b_own").alias("b_branch"), F.sum("n_own").alias("n_branch")
    )
    return grouped.join(merged, ["host", "branch"]).select(
        "host",
        "template",
        "branch",
        share("b_branch", "n_branch", F.col("p_any")).alias("purity"),
    )


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    depth: int | None = None,
    variety: int = VARIETY,
) -> DataFrame:
    """A verdict, allow or block, for each page's URL.

    `pages` has `page_id` and `url`; other columns are not looked at. Rules are (host,
    path, verdict). Pages that a rule fits take the verdict of the longest; they label
    the templates, which decide the rest. A null URL, or one without `://`,
    has empty host and path, and is judged as any other page of that empty host.
    Repeated rows and null ids give a row each. Without any label everything has purity
    one half and is blocked; an empty table gives an empty result.

    Returns page_id, host, path, rule (null if none fits), verdict, template, purity.
    """
    host, path = host_and_path(F.col("url"))
    judged = (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("given"))
    )
    count = lambda verdict: F.sum((F.col("given").eqNullSafe(verdict)).cast("long"))
    paths = judged.groupBy("host", "path").agg(
        count("block").alias("blocked"), count("allow").alias("allowed")
    )
    templates = settle(path_templates(settle(paths, "url-paths"), depth, variety), "url-templates")
    verdicts = template_verdicts(templates)
    decided = templates.select("host", "path", "template").join(verdicts, ["host", "template"])
    own = F.when(F.col("purity") >= PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(decided, ["host", "path"]).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("given", own).alias("verdict"),
        "template",
        "purity",
    )
