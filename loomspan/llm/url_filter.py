"""URL filter by a path-template tree with labelled purity.

1. Each host has a tree of paths. Inside a segment, runs of digits and long hexadecimal ids become wildcards;
   then, level by level from the root, a node with more than ``MAX_KIDS`` different kids has one wildcard kid for all that do not
   differ: of its labelled kids, those with a share of allowed urls above the node's or below it, whichever are more, are the
   usual ones, and a kid that the test of 3. tells apart from these together keeps its name, whatever the number of kids. What
   comes below ``DEPTH`` segments is one open tail.
2. Labels: urls that a rule decides are labelled by its verdict; other labels may be given.
3. Branches: at each level the labelled kids of a node are put in order of their share of allowed urls, counted over
   all that is below them; one after the other joins the branch before it, unless a two-proportion z test of
   both counts tells them apart. A joined branch is one node, so what stands below its parts comes together too.
   Kids without labels stay by themselves.
4. Purity: every node's share of allowed labels, over all that is below it, smoothed by the purity of its parent;
   the host's root is smoothed by the share of all labels. A template whose purity is below
   ``LEAST_PURITY`` is rejected, and its urls are blocked.

All of it is aggregation and joins of DataFrames. Urls are counted by host and shape before anything is
shuffled; later tables have one row a template. The number of levels is the deepest path's, DEPTH at most.

Cases: a null url or one without ``://`` has an empty host and path and its template is that host's root; a rule
without a path end fits as a prefix; equally long rules can't both fit but if equal, where the first stands;
without labels everything is allowed; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, host_of, path_of, staged, table

#: (host and path prefix, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DEPTH, MAX_KIDS, Z, SMOOTHING, LEAST_PURITY = 8, 20, 1.96, 5.0, 0.5


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape_of(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments with wildcards for ids; at most ``depth``, then ``**``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    named = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, "(?i)[0-9a-f]{8}-?[0-9a-f-]{8,}", "{h}"), "[0-9]+", "{n}"))
    return F.when(F.size(named) > depth, F.concat(F.slice(named, 1, depth), F.array(F.lit("**")))).otherwise(named)


def apart(a: Column, b: Column) -> Column:
    """Whether two (allowed, labelled) counts have different shares, by a two-proportion z test."""
    share = (a["allowed"] + b["allowed"]) / (a["labelled"] + b["labelled"])
    error = share * (1 - share) * (1 / a["labelled"] + 1 / b["labelled"])
    return F.pow(a["allowed"] / a["labelled"] - b["allowed"] / b["labelled"], F.lit(2)) > Z * Z * error


def branches(kids: DataFrame) -> DataFrame:
    """(host, template, kid, branch) of (host, template, kid, allowed, labelled), MAX_KIDS kids a node at most."""
    kid = F.struct((F.col("allowed") / F.col("labelled")).alias("share"), F.col("kid"), "allowed", "labelled")
    kids = kids.where("labelled > 0").groupBy("host", "template").agg(F.array_sort(F.collect_list(kid)).alias("kids"))
    own = lambda k: F.struct(k["allowed"].alias("allowed"), k["labelled"].alias("labelled"), F.array(k["kid"]).alias("names"))

    def step(found: Column, k: Column) -> Column:
        last = F.element_at(found, -1)
        both = F.struct((last["allowed"] + k["allowed"]).alias("allowed"), (last["labelled"] + k["labelled"]).alias("labelled"), F.concat(last["names"], F.array(k["kid"])).alias("names"))
        return F.when(apart(last, k), F.concat(found, F.array(own(k)))).otherwise(F.concat(F.slice(found, 1, F.size(found) - 1), F.array(both)))

    found = F.aggregate(F.slice("kids", 2, MAX_KIDS), F.array(own(F.get("kids", F.lit(0)))), step)
    each = kids.select("host", "template", F.explode(F.transform(found, lambda x: F.array_sort(x["names"]))).alias("names")).where("size(names) > 1")
    return each.select("host", "template", F.explode("names").alias("kid"), F.concat(F.lit("("), F.concat_ws("|", "names"), F.lit(")")).alias("branch"))


def wildcards(kids: DataFrame, max_kids: int) -> DataFrame:
    """(host, template, kid, named): the kids of nodes with more than ``max_kids``, by their own name or as ``*``."""
    node = ["host", "template"]
    crowded = kids.groupBy(*node).agg(F.count("*").alias("kids"), F.sum("allowed").alias("all_allowed"), F.sum("labelled").alias("all_labelled")).where(F.col("kids") > max_kids)
    own = kids.join(crowded.drop("kids"), node)
    above = F.col("allowed") * F.col("all_labelled") >= F.col("all_allowed") * F.col("labelled")
    sides = own.where("labelled > 0").groupBy(*node, above.alias("above")).agg(F.count("*").alias("n"), F.sum("allowed").alias("allowed"), F.sum("labelled").alias("labelled"))
    usual = sides.groupBy(*node).agg(F.max_by(F.struct("allowed", "labelled"), F.struct("n", "above")).alias("usual"))
    differs = F.when(F.col("labelled") > 0, apart(F.struct("allowed", "labelled"), F.col("usual")))
    return own.join(usual, node, "left").select(*node, "kid", F.when(F.coalesce(differs, F.lit(False)), F.col("kid")).otherwise("*").alias("named"))


def templates(shapes: DataFrame, max_kids: int = MAX_KIDS) -> DataFrame:
    """Adds ``template`` to (host, shape, n, allowed, labelled): the shape with wildcards for crowded levels and joined branches."""
    levels = shapes.agg(F.coalesce(F.max(F.size("shape")), F.lit(0))).first()[0]
    out = shapes.withColumn("template", F.array().cast("array<string>"))
    for d in range(1, levels + 1):
        out = out.withColumn("kid", F.get("shape", F.lit(d - 1)))
        kids = out.where("kid is not null").groupBy("host", "template", "kid").agg(F.sum("allowed").alias("allowed"), F.sum("labelled").alias("labelled"))
        crowded = wildcards(kids, max_kids)
        joined = branches(kids.join(crowded.select("host", "template").distinct(), ["host", "template"], "left_anti"))
        names = crowded.unionByName(joined.withColumnRenamed("branch", "named"))
        out = out.join(names, ["host", "template", "kid"], "left")
        named = F.coalesce("named", "kid")
        out = out.withColumn("template", F.when(F.col("kid").isNull(), F.col("template")).otherwise(F.concat("template", F.array(named)))).drop("kid", "named")
        out = staged(out, "templates")
    return out


def purities(counted: DataFrame) -> DataFrame:
    """(host, template, purity) from (host, template, allowed, labelled)."""
    own = counted.groupBy("host", "template").agg(F.sum("allowed").alias("allowed"), F.sum("labelled").alias("labelled"))
    level = F.explode(F.sequence(F.lit(0), F.size("template"))).alias("level")
    above = own.select("host", "template", "allowed", "labelled", level).withColumn("node", F.slice("template", 1, F.col("level")))
    nodes = above.groupBy("host", "node").agg(F.sum("allowed").alias("allowed"), F.sum("labelled").alias("labelled"))
    path = above.select("host", "template", "node", "level").join(nodes, ["host", "node"])
    path = path.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "allowed", "labelled"))).alias("path"))
    total = own.agg(F.sum("allowed"), F.sum("labelled")).first()  # two numbers
    prior = total[0] / total[1] if total[1] else 1.0
    purity = F.aggregate("path", F.lit(float(prior)), lambda p, x: (x["allowed"] + SMOOTHING * p) / (x["labelled"] + SMOOTHING))
    return path.select("host", "template", purity.alias("purity"))


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of (page_id, url).

    labels: further (host, shape, allowed, labelled) counts.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    allowed = F.sum(F.when(F.col("fit.verdict") == "allow", 1).otherwise(0)).alias("allowed")
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), allowed, F.count("fit.verdict").alias("labelled"))
    if labels is not None:
        more = labels.select("host", "shape", F.lit(0).cast("bigint").alias("n"), "allowed", "labelled")
        shapes = shapes.unionByName(more).groupBy("host", "shape").agg(*(F.sum(c).alias(c) for c in ("n", "allowed", "labelled")))
    shapes = staged(templates(staged(shapes, "shapes")), "templates")
    known = staged(shapes.join(purities(shapes), ["host", "template"]).select("host", "shape", "template", "purity"), "purities")
    judged = rows.join(checked_broadcast(known, known.count(), 100_000), ["host", "shape"], "left")
    own = F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), F.round("purity", 9).alias("purity"))


def op2_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
