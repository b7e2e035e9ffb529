"""URL rules, and a tree of path templates for URLs that no rule fits.

Per host, the path is a way down a tree of segments. Segments that look variable (numbers, identifiers)
are wildcards from the start; below a parent with many children, those that are rare become one wildcard,
and siblings whose labelled share of blocked URLs is statistically alike are merged into one branch (those
without labels among themselves). A template is blocked if its labelled purity, smoothed towards a prior,
reaches a limit and enough of its URLs are labelled. One without labels takes the purity of the branches beside
it or, if they have no labels either, beside the nearest one above: each labelled branch counts once, however
many URLs it has, and is smoothed towards the prior, so one blocked branch tells nothing of its siblings, and
several that agree do. Otherwise a template is allowed. The labels are the verdicts of the rules.

Only one aggregate by (host, template) leaves the URLs; the tree is built from it, level by level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD = "*"
#: Tasks that the children of one parent are dealt to where they meet what is known of it.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class TreeRule:
    """depth: levels of one segment each; what a path has below them is one segment, so no two paths are
    pooled by their depth. max_children and rare: of a parent with more children than that, those that hold
    fewer URLs than rare are one wildcard; the others keep their branches. alike: siblings merge if their
    blocked shares lie within so many standard errors. prior and strength: the purity without labels, and its
    weight in labelled URLs; beside: its weight in labelled branches. limit: purity that blocks, if
    least_labelled of the template's URLs are labelled or none is."""

    depth: int = 8
    max_children: int = 8
    rare: float = 20.0
    alike: float = 2.0
    strength: float = 4.0
    beside: float = 1.0
    limit: float = 0.8
    least_labelled: float = 0.5
    prior: float = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls. Of equally long ones, the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        hit = fits(r, host, path)
        name, verdict = F.when(hit, r.name).otherwise(name), F.when(hit, r.verdict).otherwise(verdict)
    return name, verdict


def _generalised(segment: Column) -> Column:
    """Digits, and long runs of hexadecimal digits, become wildcards; endings such as .html stay."""
    s = F.regexp_replace(segment, r"(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b|\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}\b", WILD)
    return F.regexp_replace(s, r"[0-9]+", WILD)


def template_of(path: Column, depth: int) -> Column:
    segments = F.split(path, "/")
    head = F.transform(F.slice(segments, 2, depth), _generalised)
    rest = F.transform(F.slice(segments, depth + 2, F.size(segments)), _generalised)
    return F.concat(head, F.when(F.size(rest) > 0, F.array(F.array_join(rest, "/"))).otherwise(F.array().cast("array<string>")))


def _meet(many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """many with the columns of few, which has one row for each of its keys. A key's rows of many are dealt to
    SALTS tasks by their segment."""
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.hash("_seg"), F.lit(SALTS))).join(salted, [*on, "_salt"], "left").drop("_salt")


def _branches(children: DataFrame, at: list[str], rule: TreeRule) -> DataFrame:
    """The names of the branches (_name) that the children (at, _seg, n, labelled, blocked) go on with."""
    crowded = children.groupBy(*at).agg(F.count("*").alias("_count")).where(F.col("_count") > rule.max_children)
    marked = _meet(children, crowded, at).withColumn("_rare", F.col("_count").isNotNull() & (F.col("n") < rule.rare))
    # children with the same counts have the same share, so branches are found among their distinct counts
    kinds = marked.where("NOT _rare AND labelled > 0").groupBy(*at, "labelled", "blocked").agg(F.count("*").alias("_many"))
    share = (F.col("blocked") + rule.prior) / (F.col("labelled") + 2 * rule.prior)
    kinds = kinds.withColumn("_share", share).withColumn("_error", F.sqrt(F.col("_share") * (1 - F.col("_share")) / (F.col("labelled") + 2 * rule.prior)))
    beside = Window.partitionBy(*at).orderBy("_share", "labelled")
    apart = (F.col("_share") - F.lag("_share").over(beside)) > rule.alike * F.sqrt(F.col("_error") ** 2 + F.lag("_error").over(beside) ** 2)
    kinds = kinds.withColumn("_apart", F.when(apart, 1).otherwise(0)).withColumn("_branch", F.sum("_apart").over(beside.rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.sum("_many").over(Window.partitionBy(*at, "_branch")) == 1
    kinds = kinds.withColumn("_joint", F.when(~alone, F.format_string("{%d}", "_branch"))).select(*at, "labelled", "blocked", "_joint")
    silent = marked.where("NOT _rare AND labelled = 0").groupBy(*at).agg(F.when(F.count("*") > 1, "{?}").alias("_silent"))
    named = _meet(_meet(marked, kinds, [*at, "labelled", "blocked"]), silent, at)
    name = F.when(F.col("_rare"), WILD).when(F.col("labelled") > 0, F.coalesce("_joint", "_seg")).otherwise(F.coalesce("_silent", "_seg"))
    return named.select(*at, "_seg", name.alias("_name"))


def learn(templates: DataFrame, rule: TreeRule) -> DataFrame:
    """Verdicts of templates (host, t array<string>, n, labelled, blocked): adds template (merged, as
    text), purity and method_verdict."""
    nodes = stored(templates.withColumns({"_node": F.lit(""), "_beside": F.lit(None).cast("double")}), "templates")
    levels = nodes.agg(F.max(F.size("t"))).first()[0] or 0
    for level in range(levels):
        # children of each node of this level, with their counts; a node is (host, merged way down)
        at = ["host", "_node"]
        before, nodes = nodes, nodes.withColumn("_seg", F.get("t", F.lit(level)))
        children = nodes.where("_seg IS NOT NULL").groupBy(*at, "_seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        children = stored(children, "children")
        names = _branches(children, at, rule)
        # the purity of the labelled branches of each node, for those of its children that have no labels
        told = (F.sum(F.col("blocked") / F.col("labelled")) + rule.beside * rule.prior) / (F.count("*") + rule.beside)
        told = children.where("labelled > 0").groupBy(*at).agg(told.alias("_told"))
        beside = F.when(F.col("_seg").isNotNull(), F.coalesce("_told", "_beside")).otherwise(F.col("_beside"))
        way = F.concat("_node", F.coalesce(F.concat(F.lit("/"), "_name"), F.lit("")))
        on = _meet(nodes, told, at).withColumn("_beside", beside).drop("_told")
        nodes = stored(on.join(names, [*at, "_seg"], "left").withColumn("_node", way).drop("_name", "_seg"), "templates")
        forget(before, children)
    own = (F.sum("blocked") + rule.strength * rule.prior) / (F.sum("labelled") + rule.strength)
    purity = F.when(F.sum("labelled") == 0, F.coalesce(F.max("_beside"), F.lit(rule.prior))).otherwise(own)
    scored = nodes.groupBy("host", "_node").agg(purity.alias("purity"), (F.sum("labelled") / F.sum("n")).alias("_known"))
    out = nodes.join(scored, ["host", "_node"])
    bad = (F.col("purity") >= rule.limit) & ((F.col("_known") >= rule.least_labelled) | (F.col("_known") == 0))
    return out.select("host", "t", F.col("_node").alias("template"), "purity", F.when(bad, "block").otherwise("allow").alias("method_verdict"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, tree: TreeRule = TreeRule()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of pages (page_id, url).

    A null url and one without :// have empty host and path and no rule; they share one template. A rule
    fits its host and all subdomains if the path begins with its path, and the longest wins. Repeated
    rows are labelled and judged each. Other columns, whatever their names, are not read; an empty table has no
    rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    ruled = urls.withColumns({"rule": name, "_verdict": verdict, "t": template_of(F.col("path"), tree.depth)})
    counts = ruled.groupBy("host", "t").agg(F.count("*").alias("n"), F.count("_verdict").alias("labelled"), F.count_if(F.col("_verdict") == "block").alias("blocked"))
    learnt = learn(counts, tree)
    out = ruled.join(learnt, ["host", "t"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", "method_verdict").alias("verdict"), "template", "purity")
