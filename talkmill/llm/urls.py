"""URL filter: host and path rules first, then a tree of path templates judged by smoothed labelled purity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, with_groups

#: (verdict, rule); a rule is a host, then a path's beginning.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ://, both empty without one."""
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.coalesce(F.regexp_extract(url, found, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, found, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are a fixed, short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def hidden(url: Column, hide: int) -> Column:
    """Whether a url's label is kept back: every hide-th by crc32, none for 0."""
    return F.coalesce(F.crc32(F.encode(url, "utf-8")) % hide == 0, F.lit(False)) if hide else F.lit(False)


#: Kinds of a path's next segment: none, number, number with an ending, long hex, word.
KINDS = 5


def _kind(segment: Column) -> Column:
    return F.when(segment.isNull(), 0).when(segment.rlike("^[0-9]+$"), 1).when(segment.rlike(r"^[0-9]+\.[a-z]+$"), 2).when(segment.rlike("[0-9a-f]{8}"), 3).otherwise(4)


def _unlike() -> Column:
    """Chi-square of two samples: the kinds below a branch (d0, ..) and below its siblings (e0, .. less these)."""
    own, other = F.col("n"), F.col("visits") - F.col("n")
    terms = []
    for k in range(KINDS):
        d, e = F.col(f"d{k}"), F.col(f"e{k}") - F.col(f"d{k}")
        gap = d * F.sqrt(F.try_divide(other, own)) - e * F.sqrt(F.try_divide(own, other))
        terms.append(F.when(d + e > 0, gap * gap / (d + e)).otherwise(0.0))
    return reduce(lambda a, b: a + b, terms)


def _with_heads(named: DataFrame, margin: float, z: float) -> DataFrame:
    """named (host, template, segment, paths, labels, bad, name) without labels and bad, and with a first character in the names * that need one."""
    head = F.when(F.col("name") == "*", F.left("segment", F.lit(1)))
    rows = named.withColumn("head", head)
    each = rows.where("head is not null and labels > 0").groupBy("host", "template", "head").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    each = cut(each)
    node = each.groupBy("host", "template").agg(F.sum("labels").alias("all_labels"), F.sum("bad").alias("all_bad"), F.count("*").alias("heads")).where("heads > 1")
    rest, own = F.col("all_labels") - F.col("labels"), (F.col("bad") + 1) / (F.col("labels") + 2)
    other = (F.col("all_bad") - F.col("bad") + 1) / (rest + 2)
    error = F.sqrt(own * (1 - own) / (F.col("labels") + 2) + other * (1 - other) / (rest + 2))
    apart = with_groups(each, cut(node), ["host", "template"], "heads").where(F.abs(own - other) - z * error > margin).select("host", "template", "head", F.lit(1).cast("long").alias("apart"))
    told = with_groups(rows, cut(apart), ["host", "template", "head"], "apart")
    return told.select("host", "template", "segment", "paths", F.when(F.col("apart").isNotNull(), F.concat("head", F.lit("*"))).otherwise(F.col("name")).alias("name"))


def judge_urls(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, depth: int | None = None, variable: float = 0.5, least: int = 8, z: float = 1.96, smooth: float = 4.0, reject: float = 0.7, margin: float = 0.3, shapes: float | None = 13.28, heads: bool = True, hide: int = 0
) -> DataFrame:
    """One row per page: page_id, host, path, rule, template, purity, predicted, verdict.

    The rules label the pages that they fit: 1 blocked, 0 allowed. The tree of each host is built level by level.
    A segment becomes the wildcard * if it is a number (or holds eight hex digits), or if its node has at least `least`
    visits and `variable` of them are different segments. Of these, the ones with a first character whose labels are unlike those
    of the node's others (shares more than `margin` apart, `z` standard errors left out) get that character before the *, unless
    `heads` is off. Other segments are branches: those that are like their
    siblings share the wildcard ?, which no path holds. Where both sides have `least` labels, these say so: the difference of
    their shares of blocked labels lies within `margin`, `z` standard errors included. Else what stands below them does: both
    sides have `least` visits, and the numbers of next segments by kind (none, number, number with an ending, hex, word)
    differ by a chi-square of `shapes` or less (13.28: 1 % of equal ones with five kinds); None turns that off. So labelled
    branches lend their labels to unlabelled ones of the same form, while branches of a form of their own stay apart.
    What lies below `depth` levels, if given, is one wildcard **; else the tree is as deep as the paths.
    A template's purity is its share of blocked labels, smoothed by `smooth` labels of its host, the
    host's by as many of all pages. predicted blocks templates with a purity of `reject` or more, if the
    template's own labels alone say at `z` deviations that half of it is to be blocked: no template is rejected for its host.
    verdict is the rule's where one fits, else what is predicted. With `hide`, every hide-th url by crc32 keeps its label back
    from the tree (measure_urls() compares these).
    A null url, or one without ://, has an empty host and path; urls of any length are read whole; a null page_id is a
    page like any other. Repeated pages are judged alike and all returned; an empty table gives no rows; other columns
    play no part. No host, template or path gathers its rows in one task: tables of them go to the rows (with_groups()).
    """
    host, path = url_parts(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), hidden(F.col(url), hide).alias("hidden"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "ruled": ruled})

    told = F.when(~F.col("hidden"), F.col("ruled"))
    paths = parsed.groupBy("host", "path").agg(F.count("*").alias("n"), F.count(told).alias("labels"), F.count_if(told == "block").alias("bad"))
    tree = cut(paths.withColumns({"segments": F.filter(F.split("path", "/"), lambda s: s != ""), "template": F.lit("")}))
    sums = [F.sum(c).alias(c) for c in ("n", "labels", "bad")]
    longest = tree.agg(F.max(F.size("segments")).alias("n")).first().n or 0
    ended = []
    for level in range(longest if depth is None else min(depth, longest)):
        if level and level % 4 == 0:
            tree = cut(tree)
            ended.append(tree.where(F.size("segments") <= level))
            tree = tree.where(F.size("segments") > level)
        here = tree.withColumn("segment", F.get("segments", F.lit(level)))
        kind = _kind(F.get("segments", F.lit(level + 1)))
        below = [F.sum(F.when(kind == k, F.col("n")).otherwise(0)).alias(f"d{k}") for k in range(KINDS)]
        child = cut(here.where("segment is not null").groupBy("host", "template", "segment").agg(*sums, *below, F.count("*").alias("paths")))
        node = cut(
            child.groupBy("host", "template").agg(
                F.count("*").alias("children"), F.sum("n").alias("visits"), F.sum("labels").alias("all_labels"), F.sum("bad").alias("all_bad"),
                *(F.sum(f"d{k}").alias(f"e{k}") for k in range(KINDS)),
            )
        )
        rest = F.expr("all_labels - labels")
        own, other = F.expr("(bad + 1) / (labels + 2)"), (F.expr("all_bad - bad") + 1) / (rest + 2)
        error = F.sqrt(own * (1 - own) / (F.col("labels") + 2) + other * (1 - other) / (rest + 2))
        both = (F.col("labels") >= least) & (rest >= least)
        formed = (F.col("n") >= least) & (F.col("visits") - F.col("n") >= least) & (_unlike() <= shapes) if shapes is not None else F.lit(False)
        alike = F.when(both, F.abs(own - other) + z * error <= margin).otherwise(formed)
        number = F.col("segment").rlike(r"^[0-9]+(\.[a-z]+)?$|[0-9a-f]{8}")
        wide = (F.col("visits") >= least) & (F.col("children") >= variable * F.col("visits"))
        name = F.when(number | wide, "*").when(alike, "?").otherwise(F.col("segment"))
        named = with_groups(child, node, ["host", "template"], "children").select("host", "template", "segment", "paths", "labels", "bad", name.alias("name"))
        named = cut(_with_heads(cut(named), margin, z) if heads else named.drop("labels", "bad"))
        more = F.size("segments") > level
        tree = with_groups(here, named, ["host", "template", "segment"], "paths").select(
            "host", "path", "n", "labels", "bad", "segments", F.when(more, F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*")))).otherwise(F.col("template")).alias("template")
        )
    tree = reduce(DataFrame.unionByName, ended, tree)
    below = F.size("segments") > (longest if depth is None else depth)
    tree = cut(tree.withColumn("template", F.when(below, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))))
    templates = cut(tree.groupBy("host", "template").agg(*sums, F.count("*").alias("paths")))
    hosts = cut(templates.groupBy("host").agg(F.sum("labels").alias("host_labels"), F.sum("bad").alias("host_bad"), F.count("*").alias("templates")))
    total = hosts.agg(F.sum("host_bad").alias("b"), F.sum("host_labels").alias("l")).first()
    share = (total.b or 0) / total.l if total.l else 0.0
    host_share = (F.col("host_bad") + smooth * share) / (F.col("host_labels") + smooth)
    purity = (F.col("bad") + smooth * host_share) / (F.col("labels") + smooth)
    # The least share of blocked pages that a template's own labels allow for (Wilson's bound): the host's share alone rejects nothing.
    own = F.try_divide("bad", "labels")
    bound = (own + z * z / (2 * F.col("labels")) - z * F.sqrt(own * (1 - own) / F.col("labels") + z * z / (4 * F.col("labels") * F.col("labels")))) / (1 + z * z / F.col("labels"))
    sure = F.when(F.col("labels") > 0, bound >= 0.5).otherwise(False)
    judged = cut(with_groups(templates, hosts, "host", "templates").select("host", "template", "paths", purity.alias("purity"), (sure & (purity >= reject)).alias("bad")))
    by_path = cut(with_groups(tree.select("host", "path", "n", "template"), judged, ["host", "template"], "paths").select("host", "path", "n", "template", "purity", "bad"))
    predicted = F.when(F.col("bad"), "block").otherwise("allow")
    return with_groups(parsed, by_path, ["host", "path"]).select(
        "page_id", "host", "path", "rule", "template", "purity", predicted.alias("predicted"), F.coalesce("ruled", predicted).alias("verdict"), "hidden"
    ).drop(*([] if hide else ["hidden"]))


def measure_urls(pages: DataFrame, hide: int = 4, **more) -> DataFrame:
    """One row: held_out (urls that a rule fits whose labels were kept back), blocked (of these, by rule), predicted (by the tree), right (both),
    precision, recall (null without any), and unruled and unruled_blocked, pages that no rule fits and those of them that the tree blocks. more: as for judge_urls()."""
    judged = judge_urls(pages, hide=hide, **more)
    held, bad, said = F.col("hidden") & F.col("rule").isNotNull(), F.col("verdict") == "block", F.col("predicted") == "block"
    counts = judged.agg(
        F.count_if(held).alias("held_out"), F.count_if(held & bad).alias("blocked"), F.count_if(held & said).alias("predicted"), F.count_if(held & bad & said).alias("right"),
        F.count_if(F.col("rule").isNull()).alias("unruled"), F.count_if(F.col("rule").isNull() & said).alias("unruled_blocked"),
    )
    return counts.withColumns({"precision": F.try_divide("right", "predicted"), "recall": F.try_divide("right", "blocked")})
