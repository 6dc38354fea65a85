"""URL verdicts: fixed rules first, then a tree of path templates per host.

Rules name a host and a path; a rule fits its host and all subdomains if the URL's path starts with the rule's, and
the longest rule wins. They are joined to the suffixes of the distinct hosts, so a list of any length works.

The tree grows from the root, a level a round, over all URLs. A node is a host and a template; its branches are the next
path segments. A segment that holds at least `min_share` of its node's URLs, and `min_urls`, stays as it is, so a
node has a bounded number of such branches; all rarer segments are variable and become one wildcard. Literal branches of
a node that are statistically similar, in their labelled bad share and in how many segments follow, are merged into one
template. When no URL has a further segment, each leaf's labelled bad share is shrunk towards the corpus's, as if `prior`
labelled URLs of that share had been seen in addition; a template is rejected where its purity, the shrunk share of good
ones, isn't above `purity`.

Counts are sums with partial aggregation. A host of a third of all URLs is spread by its segments, and its few literal
branches are joined by broadcast up to BROADCAST_BYTES in all, else by a shuffle join whose large side can be split.

Defined results: a null URL, or one without `://`, has an empty host and path and belongs to the empty host's root; a
URL without segments belongs to its host's root; segments `*` and `**` count as wildcards; segments beyond `depth` count as one wildcard tail; repeated rows count
repeatedly; null ids are kept; an empty table gives an empty result; a table without labels rejects no template. Columns that
have the name of a result are replaced, all others are carried along.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.llm.common import free_name, written

#: Bytes up to which literal branches, hosts' rules and templates are broadcast.
BROADCAST_BYTES = 16_000_000
WILDCARD, TAIL = "*", "**"
RESULTS = ["host", "path", "rule", "verdict", "template", "purity"]
#: How many further segments are told apart in a branch's profile.
PROFILE = 4


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_rows(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, host, prefix, verdict) of pairs (verdict, host and path in one)."""
    rows = [(rule, rule.partition("/")[0].lower(), "/" + rule.partition("/")[2] if "/" in rule else "", verdict) for verdict, rule in rules]
    return spark.createDataFrame(rows, "rule string, host string, prefix string, verdict string")


def _small(df: DataFrame) -> DataFrame:
    """df, a written table, to be broadcast if its measured size allows it."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64).alias("size")).first()["size"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): those that fit a host, longest first, as structs of prefix, rule, verdict; hosts without any are left out."""
    labels = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 0
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    suffixes = hosts.select("host", F.explode(ends).alias("end"))
    fit = suffixes.join(rules.withColumnRenamed("host", "end"), "end")
    # a host in many lists has as many rules as those lists give it; ties of length by the rule's text
    ordered = F.sort_array(F.collect_list(F.struct((-F.length("rule")).alias("k"), "rule", "prefix", "verdict")))
    return fit.groupBy("host").agg(ordered.alias("rules"))


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with host and path) and the struct `ruled` (rule, verdict), null where none fits."""
    fitting = written(host_rules(rows.select("host").distinct(), rules), "host-rules")
    joined = rows.join(_small(fitting), "host", "left")
    first = F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"]))
    return joined.withColumn("ruled", F.get(first, F.lit(0))).drop("rules")


def similar(a, b, z: float) -> bool:
    """Whether two branches, lists of [URLs, labelled, bad, profile], could be draws of one: the bad shares by a test of two
    proportions, the profiles by a chi-square test with its normal approximation."""
    if a[1] and b[1]:
        share = (a[2] + b[2]) / (a[1] + b[1])
        spread = (share * (1 - share) * (1 / a[1] + 1 / b[1])) ** 0.5
        if abs(a[2] / a[1] - b[2] / b[1]) > z * spread:
            return False
    elif a[1] or b[1]:
        return False  # labels of one say nothing about the other
    n, chi, cells = a[0] + b[0], 0.0, 0
    for x, y in zip(a[3], b[3], strict=True):
        if x + y:
            cells += 1
            for seen, whole in ((x, a[0]), (y, b[0])):
                want = (x + y) * whole / n
                chi += (seen - want) ** 2 / want
    free = max(cells - 1, 1)
    return chi <= free + z * (2 * free) ** 0.5


def merge_branches(rows: list[tuple], z: float) -> list[str]:
    """The template segment of each literal branch (segment, urls, labelled, bad, profile): branches in order of their
    usual profile and bad share join the class before them if similar to it as a whole."""
    order = sorted(range(len(rows)), key=lambda k: (max(range(PROFILE), key=lambda c: rows[k][4][c]), rows[k][2] > 0, rows[k][3] / max(rows[k][2], 1), rows[k][0]))
    classes: list[tuple[list[int], list]] = []
    for k in order:
        _, urls, labelled, bad, profile = rows[k]
        one = [urls, labelled, bad, profile]
        if classes and similar(classes[-1][1], one, z):
            members, both = classes[-1]
            members.append(k)
            classes[-1] = (members, [both[0] + urls, both[1] + labelled, both[2] + bad, [x + y for x, y in zip(both[3], profile, strict=True)]])
        else:
            classes.append(([k], one))
    names = [""] * len(rows)
    for members, _ in classes:
        words = sorted(rows[k][0] for k in members)
        for k in members:
            names[k] = words[0] if len(words) == 1 else "(" + "|".join(words) + ")"
    return names


def _merged(literal: DataFrame, z: float) -> DataFrame:
    """(host, template, segment, name): at most 1 / min_share branches a node, so a group is bounded."""

    def merge(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("segment", "urls", "labelled", "bad", "profile")), strict=True))
        return group.select(["host", "template", "segment"]).append_column("name", pa.array(merge_branches(rows, z), pa.string()))

    return literal.groupBy("host", "template").applyInArrow(merge, "host string, template string, segment string, name string")


def templates(urls: DataFrame, min_share: float = 0.01, min_urls: int = 20, depth: int = 12, z: float = 2.0) -> DataFrame:
    """urls with columns host, path and bad (1, 0 or null for unlabelled), with `template` for the whole path."""
    own = free_name(urls.columns, "_row")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rest = F.when(F.size(segments) > depth, F.concat(F.slice(segments, 1, depth), F.array(F.lit(TAIL)))).otherwise(segments)
    state = urls.select(F.struct(*urls.columns).alias(own), "host", rest.alias("rest"), "bad", F.lit("").alias("template"))
    for level in range(depth + 1):
        state = written(state, "template-level")
        segment = F.get("rest", F.lit(level))
        deeper = state.filter(F.size("rest") > level).withColumn("segment", segment)
        if deeper.isEmpty():
            break
        after = F.least(F.size("rest") - level - 1, F.lit(PROFILE - 1))
        profile = [F.sum((after == k).cast("long")).alias(f"p{k}") for k in range(PROFILE)]
        branches = deeper.groupBy("host", "template", "segment").agg(F.count(F.lit(1)).alias("urls"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"), *profile)
        branches = branches.filter((F.col("urls") >= min_urls) & (F.col("segment") != TAIL))
        nodes = deeper.groupBy("host", "template").agg(F.count(F.lit(1)).alias("of"))
        literal = branches.join(nodes, ["host", "template"]).filter(F.col("urls") >= min_share * F.col("of"))
        literal = literal.select("host", "template", "segment", "urls", "labelled", "bad", F.array(*[f"p{k}" for k in range(PROFILE)]).alias("profile"))
        names = written(_merged(literal, z), "branches")
        joined = state.withColumn("segment", segment).join(_small(names), ["host", "template", "segment"], "left")
        step = F.when(F.col("segment").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.when(F.col("segment") == TAIL, F.lit(TAIL)).otherwise(F.coalesce("name", F.lit(WILDCARD)))))
        state = joined.select(own, "host", "rest", "bad", F.concat("template", step).alias("template"))
    return state.select(f"{own}.*", "template")


def purities(found: DataFrame, prior: float) -> DataFrame:
    """(host, template, urls, labelled, purity): the share of good ones among a template's labelled URLs, shrunk towards the corpus's."""
    sums = written(found.groupBy("host", "template").agg(F.count(F.lit(1)).alias("urls"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")), "templates")
    whole = sums.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()  # one row
    base = whole["bad"] / whole["labelled"] if whole["labelled"] else 0.0
    return sums.withColumn("purity", 1 - (F.col("bad") + prior * base) / (F.col("labelled") + prior)).drop("bad")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = (), url: str = "url", bad: Column | None = None, purity: float = 0.5, prior: float = 10.0, **tree) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), template and purity. rules: pairs (verdict, rule), or rows like
    those of `rule_rows`; bad: 1 for URLs labelled bad, 0 for good ones, null for the others."""
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else rule_rows(spark, list(rules))
    carried = [c for c in pages.columns if c not in RESULTS]
    rows = pages.select(F.struct(*carried).alias("row") if carried else F.struct(F.lit(0)).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), (F.lit(None) if bad is None else bad).cast("int").alias("bad"))
    ruled = with_rules(rows, rules)
    found = written(templates(ruled, **tree), "templated")
    poor = written(purities(found, prior).select("host", "template", "purity"), "purities")
    joined = found.join(_small(poor), ["host", "template"])
    verdict = F.coalesce("ruled.verdict", F.when(F.col("purity") <= purity, "block").otherwise("allow"))
    return joined.select(*(["row.*"] if carried else []), "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def digests(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")
