"""URL filters: host and path rules, and a path-template tree per host.

Rules decide first; the longest rule that fits wins.  Rules are joined to the distinct hosts by the
hosts' suffixes, so a list may be long.  All other urls are judged by their template.
Segments of a path that look variable (numbers, hexadecimal ids, UUIDs, dates) become wildcards
at once.  Then the tree is walked down level by level: under each node, segments with many
siblings and little support become a wildcard, and so do branches whose share of bad labels does
not differ significantly from that of their siblings, so that they pool their labels.  The walk ends
where a node holds a single shape, whose other segments have no siblings; paths of any depth are
judged whole.  A template is rejected if its smoothed share of bad labels (its purity) reaches a
threshold on enough labels.

Counts are aggregated per host and path shape before anything is shuffled, so a hot host costs
what its distinct shapes cost; the tree is never collected.  Defined results: a url that is null
or has no ``://`` has an empty host and path and fits no rule; empty tables give empty results;
repeated pages are judged alike; several labels of an id count as bad if one is; pages whose
template has no labels are allowed; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import forget, keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shapes of variable segments, tried in order; what follows the first dot of a file name stays.
SHAPES = (
    ("<uuid>", r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    ("<date>", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("<num>", r"[0-9]+"),
    ("<hex>", r"(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{8,}"),
    ("<slug>", r"[^.]*[0-9]{3,}[^.]*"),
)


@dataclass(frozen=True)
class TemplateRules:
    many_children: int = 16
    least_support: int = 4
    similar_z: float = 1.96
    smoothing: float = 4.0
    least_labels: int = 4
    purity: float = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a scheme."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: the rules (length, rule, path, verdict) on each host or a domain above it, longest first."""
    slash = F.locate("/", F.concat("rule", F.lit("/")))
    named = rules.select(
        F.substr("rule", F.lit(1), slash - 1).alias("domain"),
        F.struct(F.char_length("rule").alias("length"), F.col("rule"), F.substr("rule", slash).alias("path"), F.col("verdict")).alias("fits"),
    )
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return (
        hosts.select("host").distinct().withColumn("domain", F.explode(F.array_distinct(above)))
        .join(named, "domain").groupBy("host").agg(F.sort_array(F.collect_set("fits"), asc=False).alias("rules"))
    )


def shape(path: Column) -> Column:
    """Segments of the path with variable ones replaced by their kind."""

    def one(segment: Column) -> Column:
        stem, extension = F.regexp_extract(segment, r"^([^.]*)", 1), F.regexp_extract(segment, r"^[^.]*(.*)$", 1)
        out = segment
        for name, pattern in reversed(SHAPES):
            out = F.when(stem.rlike(f"^({pattern})$"), F.concat(F.lit(name), extension)).otherwise(out)
        return out

    return F.transform(F.split(F.regexp_replace(path, "^/|/$", ""), "/"), one)


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]


def template_tree(shapes: DataFrame, rules: TemplateRules) -> DataFrame:
    """host, shape -> template, for shapes given with n, labelled, bad."""
    columns = ["host", "shape", "n", "labelled", "bad", "template"]
    rows = keep(shapes.withColumn("template", F.array().cast("array<string>")).select(*columns), "shapes", 12)
    done, level = [], 0
    while True:
        here = F.get("shape", F.lit(level))
        shared = rows.where(here.isNotNull()).groupBy("host", "template").agg(F.count("*").alias("_shapes"))
        seen = keep(rows.join(shared, ["host", "template"], "left"), "nodes", 12)
        ends = here.isNull() | (F.col("_shapes") == 1)
        rest = F.slice("shape", F.lit(level + 1), F.size("shape"))
        done.append(seen.where(ends).withColumn("template", F.concat("template", rest)).select(*columns))
        going = seen.where(~ends)
        forget(rows)
        if going.isEmpty():
            break
        # Branches of a node, those of shapes that end the walk included.
        nodes = seen.where(here.isNotNull()).groupBy("host", "template", here.alias("segment")).agg(*_sums())
        parents = nodes.groupBy("host", "template").agg(
            F.count("*").alias("children"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
        )
        other = F.col("all_labelled") - F.col("labelled")
        share = F.try_divide("all_bad", "all_labelled")
        gap = F.abs(F.try_divide("bad", "labelled") - F.try_divide(F.col("all_bad") - F.col("bad"), other))
        error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), other)))
        variable = (F.col("children") > rules.many_children) & (F.col("n") < rules.least_support)
        # Without labels on either side nothing tells the branches apart.
        similar = F.coalesce(gap <= rules.similar_z * error, F.lit(True))
        step = nodes.join(parents, ["host", "template"]).select(
            "host", "template", "segment", F.when((F.col("children") > 1) & (variable | similar), "*").otherwise(F.col("segment")).alias("step")
        )
        grown = going.withColumn("segment", here).join(step, ["host", "template", "segment"])
        rows = keep(grown.withColumn("template", F.concat("template", F.array("step"))).select(*columns), "templates", 12)
        level += 1
    return reduce(DataFrame.unionByName, done)


def filter_urls(
    pages: DataFrame,
    rules: dict[str, str] | DataFrame,
    labels: DataFrame,
    template_rules: TemplateRules | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """id, host, path, rule, verdict, template, purity.

    ``rules`` are verdicts by rule, or a table of (rule, verdict).  ``labels`` has ``id`` and ``bad``:
    pages known to be good or bad.
    """
    how = template_rules or TemplateRules()
    host, path = split_url(F.col(url_column))
    df = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    df = df.withColumn("shape", shape(F.col("path")))
    known = labels.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counted = df.join(known, "id", "left").groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    tree = template_tree(counted, how)
    totals = tree.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    prior = (totals["bad"] or 0) / totals["labelled"] if totals["labelled"] else 0.5
    pooled = tree.groupBy("host", "template").agg(*_sums())
    purity = (F.col("bad") + how.smoothing * prior) / (F.col("labelled") + how.smoothing)
    judged = pooled.withColumn("purity", purity).withColumn("rejected", (F.col("purity") >= how.purity) & (F.col("labelled") >= how.least_labels))
    by_shape = tree.select("host", "shape", "template").join(judged.select("host", "template", "purity", "rejected"), ["host", "template"])
    if isinstance(rules, dict):
        rules = pages.sparkSession.createDataFrame(list(rules.items()), "rule string, verdict string")
    fitting = rules_of_hosts(df, rules)
    out = df.join(by_shape, ["host", "shape"], "left").join(fitting, "host", "left")
    longest = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return out.select(
        F.col("id").alias(id_column),
        "host",
        "path",
        longest["rule"].alias("rule"),
        F.coalesce(longest["verdict"], method).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        "purity",
    )
