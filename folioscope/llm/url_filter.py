"""URL filters by a path-template tree, in DataFrame operations only.

Per host, the segments of a path are the levels of a tree, however deep. Level
by level, children that too few of their parent's urls take, or that have no
labels, are pooled in a wildcard. The branches of a parent, in order of their
smoothed share of bad urls, are merged one after the other: a branch that does
not differ from the branches merged so far (two-proportion test on their sums)
joins them, else it begins the next group. Groups of several branches are
wildcards of their own. A leaf is a template; it is rejected when the smoothed
share of bad ones among its labelled urls is above a limit.

A parent has at most 1 / LEAST_SHARE branches and the pool, so the merge folds a
short array. Under a node of fewer than LEAST_URLS urls every further segment is
a wildcard, so it is finished at once; the levels end when no node is open. All
statistics are sums over (host, shape of the path) that are aggregated before any
other step, so a host with a third of all urls is a few rows after the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, stored, table

#: Fixed rules, (host and path, verdict); the longest that fits wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: A branch needs this many urls and this share of its parent's.
LEAST_URLS, LEAST_SHARE = 20, 0.02
#: Two branches differ when |z| is above this.
DIFFERENT = 2.58
#: Weight of the prior, and the smoothed share of bad urls from which a template is rejected.
PRIOR_WEIGHT, MOST_BAD = 10.0, 0.5
WILD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z in lower case;
    path: from there to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain of it, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def path_shape(path: Column) -> Column:
    """The path without its first slash, with runs of digits as ``#`` and long hexadecimal names as ``~``."""
    shape = F.regexp_replace(F.regexp_replace(path, r"(?<=/)[0-9a-fA-F-]{16,}(?=/|\.|$)", "~"), r"[0-9]+", "#")
    return F.regexp_replace(shape, "^/", "")


def merged_branches(branches: DataFrame) -> DataFrame:
    """Adds ``step``, the template's next part, to branches (node, branch, n, known, bad).

    The fold's state is the list of groups; its last one is open.
    """
    node_rate = F.sum("bad") / F.sum("known")
    rates = branches.where("branch <> ''").groupBy("node").agg(F.coalesce(node_rate, F.lit(0.0)).alias("rate"), F.collect_list(F.struct("branch", "known", "bad")).alias("all"))
    share = lambda x: (x["bad"] + PRIOR_WEIGHT * F.col("rate")) / (x["known"] + PRIOR_WEIGHT)
    order = F.array_sort(F.transform("all", lambda x: F.struct(share(x).alias("share"), x["branch"].alias("branch"), x["known"].cast("double").alias("known"), x["bad"].cast("double").alias("bad"))))

    def differs(x, y):
        both = (x["bad"] + y["bad"]) / (x["known"] + y["known"])
        error = F.sqrt(both * (1 - both) * (1 / x["known"] + 1 / y["known"]))
        z = F.abs(x["bad"] / x["known"] - y["bad"] / y["known"]) / error
        return F.when((x["known"] > 0) & (y["known"] > 0), F.when(both * (1 - both) > 0, z > DIFFERENT).otherwise(F.lit(False))).otherwise(F.lit(False))

    def alone(x):
        return F.struct(x["known"].alias("known"), x["bad"].alias("bad"), F.array(x["branch"]).alias("members"))

    def put(groups, x):
        last = F.element_at(groups, -1)
        wider = F.struct((last["known"] + x["known"]).alias("known"), (last["bad"] + x["bad"]).alias("bad"), F.concat(last["members"], F.array(x["branch"])).alias("members"))
        return F.when(differs(last, x), F.concat(groups, F.array(alone(x)))).otherwise(F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(wider)))

    rest = F.slice("order", 2, F.size("order"))
    folded = rates.withColumn("order", order).withColumn("groups", F.aggregate(rest, F.array(alone(F.element_at("order", 1))), put))
    group = folded.select("node", F.size("groups").alias("k"), F.explode("groups").alias("g")).select("node", "k", F.col("g.members").alias("members"))
    wild = F.array_contains("members", WILD) | ((F.col("k") == 1) & (F.size("members") > 1))
    step = F.when(wild, F.lit("/" + WILD)).when(F.size("members") == 1, F.concat(F.lit("/"), F.element_at("members", 1))).otherwise(F.concat(F.lit("/["), F.array_min("members"), F.lit(",*]")))
    named = group.select("node", F.explode("members").alias("branch"), step.alias("step"))
    ends = branches.where("branch = ''").select("node", "branch", F.lit("").alias("step"))
    return named.unionByName(ends)


def template_tree(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, known, bad, template) for a table (host, shape, n, known, bad) of distinct shapes."""
    columns = ["host", "shape", "n", "known", "bad", "template"]
    rows = shapes.withColumn("template", F.lit("")).withColumn("parts", F.split("shape", "/"))
    done = []
    level = 0
    while True:
        node = F.concat("host", F.lit("/"), "template")
        rows = rows.withColumn("node", node)
        totals = stored(rows.groupBy("node").agg(F.sum("n").alias("pn"), F.count("*").alias("rows")), f"nodes-{level}")
        rows = stored(join_hot(rows, totals, "node", "rows"), f"open-{level}")
        # A segment that is there but empty is written as a slash, which no segment holds; a path that has ended has none.
        at = F.coalesce(F.try_element_at("parts", F.lit(level + 1)), F.lit(""))
        more = F.size("parts") - level
        small = F.col("pn") < LEAST_URLS
        tail = F.concat("template", F.when(more > 0, F.repeat(F.lit("/" + WILD), more)).otherwise(F.lit("")))
        done.append(rows.where(small).withColumn("template", tail).select(*columns))
        seg = F.when(F.size("parts") <= level, F.lit("")).when(at == "", F.lit("/")).otherwise(at)
        rows = rows.where(~small).withColumn("seg", seg)
        children = rows.groupBy("node", "seg").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"), F.first("pn").alias("pn"), F.count("*").alias("rows"))
        kids = children.groupBy("node").agg(F.count("*").alias("kids"))
        rare = (F.col("n") < LEAST_URLS) | (F.col("n") < F.col("pn") * LEAST_SHARE) | ((F.col("known") == 0) & (F.col("kids") > 1))
        branch = F.when(F.col("seg") == "", F.lit("")).when(rare, F.lit(WILD)).otherwise(F.col("seg"))
        children = stored(children.join(kids, "node").withColumn("branch", branch), f"children-{level}")
        branches = children.groupBy("node", "branch").agg(*[F.sum(c).alias(c) for c in ("n", "known", "bad")])
        steps = children.join(merged_branches(branches), ["node", "branch"])
        child = F.concat_ws("\n", "node", "seg")
        steps = stored(steps.select(child.alias("child"), "step", "rows"), f"steps-{level}")
        rows = join_hot(rows.withColumn("child", child), steps, "child", "rows").withColumn("template", F.concat("template", "step"))
        ended = F.size("parts") <= level + 1
        rows = stored(rows.select(*columns, "parts"), f"tree-{level}")
        done.append(rows.where(ended).select(*columns))
        rows = rows.where(~ended)
        if rows.isEmpty():
            break
        level += 1
    out = done[0]
    for more_rows in done[1:]:
        out = out.unionByName(more_rows)
    return out


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template for every row of ``pages``.

    ``labels`` has page_id and bad (0 or 1; several labels of an id count once,
    as the worst). A fitting rule decides; else the template does. Null urls have
    an empty host and path and take part like others; rows without an id have no
    label; repeated rows give repeated rows; paths may be of any length and depth;
    other columns are left out; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("shape", path_shape(F.col("path")))
    worst = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    marked = urls.join(worst, "page_id", "left")
    shapes = marked.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = stored(template_tree(stored(shapes, "shapes")), "tree")
    # One row for the whole corpus: the prior.
    total = tree.agg(F.sum("known"), F.sum("bad")).first()
    prior = float(total[1] or 0) / float(total[0]) if total[0] else 0.0
    purity = (F.sum("bad") + PRIOR_WEIGHT * prior) / (F.sum("known") + PRIOR_WEIGHT)
    name = F.concat("host", "template")
    judged = tree.groupBy(name.alias("name")).agg(purity.alias("bad_share"), F.count("*").alias("rows")).withColumn("method", F.when(F.col("bad_share") > MOST_BAD, "block").otherwise("allow"))
    where = F.concat("host", F.lit("/"), "shape")
    verdicts = join_hot(tree.select(where.alias("where"), name.alias("name"), "n"), stored(judged, "judged"), "name", "rows")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = join_hot(urls.withColumn("where", where), stored(verdicts.select("where", "method", F.col("name").alias("template"), "n"), "verdicts"), "where", "n")
    out = out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.col("method")))
    return out.select("page_id", "host", "path", "rule", "verdict", "template")


def page_labels(labels: DataFrame) -> DataFrame:
    """A page is bad when the label of its number has low quality or is toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), page_labels(table(spark, sf_dir, "labels")))
