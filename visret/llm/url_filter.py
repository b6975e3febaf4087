"""URL filter: rules first, then a path-template tree learned from what the rules label.

Every host has a tree of path segments. Segments with digits are generalised by their form; a node
whose children are many and thinly used gets a wildcard in their place; at every level sibling
branches that a statistical test of how they go on cannot tell apart are merged, labelled or not.
Each template of the resulting tree has a purity, the share of blocked among its rule-labelled urls
smoothed towards that of its parent and host, and is rejected from ``REJECT`` on; a template
without any label is never rejected. The tree is made of counts of distinct (host, path form), so a
host with many rows is no larger than its forms. It grows branching by branching over all hosts at
once: segments that all paths below a node share are passed in one step, however many.
"""

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visret.llm.common import cut

# Fixed values: (host, path, verdict) of each rule.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A node's children become a wildcard if there are MANY and they have under THIN urls on average.
MANY, THIN = 16, 4.0
#: Weight of the prior in a purity, and the purity from which a template is rejected.
PRIOR, REJECT = 4.0, 0.8
#: Chance that branches of one kind are told apart; labels that both need for a comparison of rates.
ALPHA, LABELS = 0.05, 8
#: Forms of paths are broadcast up to this size, beyond it rows and forms are shuffled.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, *, url: str = "url") -> DataFrame:
    """page_id, host and path; a null url or one without ``://`` has neither."""
    part = lambda p: F.coalesce(F.regexp_extract(url, p, 1), F.lit(""))
    return pages.select("page_id", F.translate(part(r"(?s)^.*?://([^/?#]*)"), UPPER, LOWER).alias("host"),
                        part(r"(?s)^.*?://[^/?#]*([^?#]*)").alias("path"))


def ruled(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def form(path: Column) -> Column:
    """The path's segments with runs of digits as {n} and long hexadecimal ids as {x}."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9a-fA-F-]{16,}$", "{x}"), "[0-9]+", "{n}"))


def bound(a: Column, b: Column) -> Column:
    """How far shares among ``a`` and among ``b`` cases differ by chance (Hoeffding)."""
    return F.lit(sqrt(log(2 / ALPHA) / 2)) * (1 / F.sqrt(a) + 1 / F.sqrt(b))


def alike(spread: DataFrame) -> DataFrame:
    """(host, made, s, step) for ``spread(host, made, s, next, n, blocked, allowed)``: the name of
    each branch ``s`` below a node, one for all that are merged.

    Branches that mostly go on alike are compared with the largest of them: by the total variation
    between the shares of how they go on, and by their share of blocked urls where both have
    ``LABELS`` labels. Branches without labels merge by their structure alone."""
    node, sums = ["host", "made", "s"], [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
    wide = spread.groupBy(node).agg((F.count("*") >= MANY) & (F.sum("n") < THIN * F.count("*")))
    ways = cut(spread.join(wide.toDF(*node, "wide"), node).groupBy(*node, F.when(F.col("wide"), F.lit("*")).otherwise(F.col("next")).alias("next")).agg(*sums))
    whole = ways.groupBy(node).agg(F.max_by("next", F.struct("n", "next")).alias("most"), *sums)
    labels = F.col("blocked") + F.col("allowed")
    whole = cut(whole.select(*node, "most", F.col("n").alias("all"), "blocked", labels.alias("labels")))
    heads = (whole.groupBy("host", "made", "most").agg(F.max(F.struct("all", "s", "blocked", "labels")).alias("h"))
             .select("host", "made", "most", *[F.col("h." + c).alias("head_" + c) for c in ("all", "s", "blocked", "labels")]))
    pairs = whole.join(heads, ["host", "made", "most"])
    of_head = ways.select("host", "made", F.col("s").alias("head_s"), "next", F.col("n").alias("head_n"))
    apart = (ways.select(*node, "next", "n").join(pairs, node).join(of_head, ["host", "made", "head_s", "next"], "left").groupBy(node)
             .agg(F.sum(F.greatest(F.lit(0.0), F.col("n") / F.col("all") - F.coalesce("head_n", F.lit(0)) / F.col("head_all"))).alias("apart")))
    rates = F.abs(F.col("blocked") / F.col("labels") - F.col("head_blocked") / F.col("head_labels"))
    known = (F.col("labels") >= LABELS) & (F.col("head_labels") >= LABELS)
    same = (F.col("apart") <= bound(F.col("all"), F.col("head_all"))) & (~known | (rates <= bound(F.col("labels"), F.col("head_labels"))))
    put = cut(pairs.join(apart, node).select(*node, F.when(same, F.col("head_s")).otherwise(F.col("s")).alias("head")))
    named = put.groupBy("host", "made", "head").agg(F.min("s").alias("step"), F.count("*").alias("merged"))
    step = F.when(F.col("merged") > 1, F.concat("step", F.lit("|"), F.col("merged"))).otherwise(F.col("step"))
    return put.join(named.select("host", "made", "head", step.alias("step")), ["host", "made", "head"]).select(*node, "step")


def passed(live: DataFrame) -> DataFrame:
    """``live`` beyond the segments that all paths of a node have in common."""
    lo, hi = F.col("lo"), F.col("hi")
    same = F.zip_with(lo, hi, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    node = live.groupBy("host", "made").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    node = node.select("host", "made", F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int").alias("shared"))
    return live.join(node, ["host", "made"]).withColumns({
        "made": F.concat("made", F.slice("rest", F.lit(1), F.col("shared"))),
        "rest": F.slice("rest", F.col("shared") + 1, F.size("rest"))}).drop("shared")


def templates(forms: DataFrame) -> DataFrame:
    """``forms(host, form, n, blocked, allowed)`` -> host, form, template, purity and labels, the
    number of labelled urls of the template.

    A purity is smoothed towards that of the branch above, up to the host and from there to the
    share of blocked in all labels."""
    blocked, labels = forms.agg(F.sum("blocked"), F.sum("blocked") + F.sum("allowed")).first()
    pure = lambda prior: (F.sum("blocked") + PRIOR * prior) / (F.sum("blocked") + F.sum("allowed") + PRIOR)
    hosts = forms.groupBy("host").agg(pure(F.lit((blocked or 0) / max(1, labels or 0))).alias("purity"))
    live = cut(passed(forms.join(hosts, "host").withColumns({"made": F.array().cast("array<string>"), "rest": F.col("form"), "above": F.col("purity")})))
    ended = []
    while True:
        ended.append(live.where(F.size("rest") == 0).drop("rest"))
        live = live.where(F.size("rest") > 0)
        if live.isEmpty():
            break
        here, after = (F.try_element_at("rest", F.lit(i)) for i in (1, 2))
        node = (live.groupBy("host", "made", here.alias("s")).agg(F.sum("n").alias("n"))
                .groupBy("host", "made").agg(F.count("*").alias("children"), F.sum("n").alias("total")))
        wide = (F.col("children") >= MANY) & (F.col("total") < THIN * F.col("children"))
        live = cut(live.join(node, ["host", "made"]).withColumn("s", F.when(wide, F.lit("*")).otherwise(here)).drop("children", "total"))
        spread = (live.groupBy("host", "made", "s", F.coalesce(F.concat(F.lit("/"), after), F.lit("")).alias("next"))
                  .agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]))
        live = cut(live.join(alike(spread), ["host", "made", "s"])
                   .withColumns({"made": F.concat("made", F.array("step")), "rest": F.slice("rest", F.lit(2), F.size("rest"))}).drop("s", "step"))
        below = live.groupBy("host", "made").agg(pure(F.first("purity")).alias("p"))
        branch = live.join(below, ["host", "made"]).withColumns({"above": F.col("purity"), "purity": F.col("p")}).drop("p")
        going = F.size("rest") > 0
        live = cut(branch.where(~going).unionByName(passed(branch.where(going))))
    tree = ended[0]
    for e in ended[1:]:
        tree = tree.unionByName(e)
    placed = tree.withColumn("template", F.concat(F.lit("/"), F.array_join("made", "/"))).drop("purity")
    own = placed.groupBy("host", "template").agg(pure(F.first("above")).alias("purity"), (F.sum("blocked") + F.sum("allowed")).alias("labels"))
    return placed.join(own, ["host", "template"]).select("host", "form", "template", "purity", "labels")


def judge(pages: DataFrame, *, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity and labels of every row of ``pages``.

    The verdict is the rule's, else ``block`` where the template has labels and is rejected, else
    ``allow``. Repeated rows and null ids are judged each; a null url has an empty host and path
    and is allowed. Urls of any length and depth are judged whole; other columns, whatever their
    names, are not read.
    """
    name, verdict = ruled(rules)
    rows = parsed(pages).withColumns({"rule": name, "label": verdict, "form": form(F.col("path"))})
    forms = cut(rows.groupBy("host", "form").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("blocked"), F.count_if(F.col("label") == "allow").alias("allowed")))
    made = cut(templates(forms))
    size = made.agg(F.sum(64 + F.length("host") + F.length(F.array_join("form", "/")) + F.length("template"))).first()[0] or 0
    found = F.broadcast(made) if size <= BROADCAST_BYTES else made
    own = F.when((F.col("labels") > 0) & (F.col("purity") >= REJECT), "block").otherwise("allow")
    return rows.join(found, ["host", "form"]).select(
        "page_id", "host", "path", "rule", F.coalesce("label", own).alias("verdict"), "template", "purity", "labels")
