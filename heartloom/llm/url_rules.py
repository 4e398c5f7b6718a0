"""URL filtering by fixed host rules and by association rules mined from them.

Urls that a fixed rule decides are the labelled rows. FP-growth mines combinations of their host and path tokens with
a verdict; rules of enough confidence and support, and not implied by a shorter one, judge the other urls through an
inverted index from token to rule.

The growth is bounded in depth, so that one url of very many tokens can't make 2 ** n sets: a set is grown from its
rarest token by its conditional pattern base (the paths of more frequent tokens before it, equal ones merged and
counted), pruned to what is frequent there, up to three tokens. Each base is a table on Spark keyed by its suffix; the
steps are the same for all widths. Before it, of tokens that always stand together one is grown for all, so each of them
makes the rule fit, and those of too little support go.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartloom.llm.common import SALT, cut, dealt, hot_keys, small, spread

#: (rule, verdict): host, then the beginning of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@dataclass(frozen=True)
class MineParams:
    """support (a share of the labelled rows, and ``least`` rows at least) and confidence prune the mined rules; tokens
    is the longest antecedent; default judges what no rule fits."""

    support: float = 0.01
    least: int = 20
    confidence: float = 0.9
    tokens: int = 3
    default: str = "allow"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null urls and those without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(h: Column, p: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0]))

    def fits(rule: str) -> Column:
        domain, _, rest = rule.partition("/")
        return ((h == domain) | F.endswith(h, F.lit("." + domain))) & F.startswith(p, F.lit("/" + rest))

    name = reduce(lambda out, r: out.when(fits(r[0]), F.lit(r[0])), ordered, F).otherwise(F.lit(None).cast("string"))
    verdict = reduce(lambda out, r: out.when(fits(r[0]), F.lit(r[1])), ordered, F).otherwise(F.lit(None).cast("string"))
    return name, verdict


def tokens(h: Column, p: Column) -> Column:
    """Distinct tokens of a url: host labels, path segments with digits made alike, and the kind of ending."""
    labels = F.transform(F.filter(F.split(h, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(F.filter(F.split(p, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d+", "#")))
    ending = F.array(F.concat(F.lit("end:"), F.when(F.endswith(p, F.lit("/")), "/").otherwise(F.regexp_extract(p, r"(\.[A-Za-z]+)$", 1))))
    return F.array_distinct(F.concat(labels, words, ending))


COUNTS = ("n", "block", "allow")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTS))


def _alike(baskets: DataFrame, least: int) -> DataFrame:
    """(token, kept, n) of the frequent tokens of baskets (items, n, ...): tokens that always stand together have the same
    rows, so the same count and the same hashes, and one of them, ``kept``, stands for all in the growth. There are at
    most (tokens of a row) / support, however many rows."""
    each = baskets.select("n", F.xxhash64("items").alias("a"), F.xxhash64(F.lit(1), "items").alias("b"), F.explode("items").alias("token"))
    frequent = cut(each.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).filter(F.col("n") >= least))
    kept = frequent.groupBy("n", "a", "b").agg(F.min("token").alias("kept"))
    return cut(frequent.join(kept, ["n", "a", "b"]).select("token", "kept", "n"))


def _grown(baskets: DataFrame, useful: list[str], least: int, total: int, p: MineParams) -> DataFrame:
    """(antecedent, verdict, confidence, support) by growth of patterns from their rarest token.

    A base holds the paths (items from frequent to rare) before a suffix. A token that is frequent in it makes the next
    larger set. A token with all of the suffix's rows, or all of whose rows are the suffix's, adds nothing: a smaller set
    has the same rows, and makes the same rule; it isn't grown on.
    """
    order = F.lit(useful).cast("array<string>")  # the intersection keeps the first array's order
    paths = _summed(baskets.select(F.array_intersect(order, F.col("items")).alias("path"), *COUNTS).filter(F.size("path") > 0), "path")
    alone = cut(_summed(paths.select(F.explode("path").alias("token"), *COUNTS), "token"))
    levels = [alone.select(F.array("token").alias("antecedent"), *COUNTS)]
    bases = paths.withColumn("suffix", F.array().cast("array<string>"))
    whole = alone.select(F.array("token").alias("suffix"), F.col("n").alias("rows"))  # the rows of each suffix
    for _ in range(1, p.tokens):
        step = bases.select("suffix", "path", *COUNTS, F.posexplode("path").alias("at", "token"))
        step = step.filter("at > 0").select(F.array_append("suffix", F.col("token")).alias("suffix"), F.expr("slice(path, 1, at)").alias("path"), *COUNTS)
        bases = cut(_summed(step.join(small(whole.select("suffix")), "suffix"), "suffix", "path"))
        found = _summed(bases.select("suffix", F.explode("path").alias("token"), *COUNTS), "suffix", "token").filter(F.col("n") >= least)
        found = found.join(small(whole), "suffix").join(small(alone.select("token", F.col("n").alias("own"))), "token")
        found = cut(found.filter("n < rows and n < own").select("suffix", "token", *COUNTS))
        sets = found.select(F.array_append("suffix", F.col("token")).alias("suffix"), *COUNTS)
        levels.append(sets.select(F.array_sort("suffix").alias("antecedent"), *COUNTS))
        whole = sets.select("suffix", F.col("n").alias("rows"))
        frequent = found.groupBy("suffix").agg(F.collect_list("token").alias("here"))  # no more than the useful tokens
        bases = bases.join(small(cut(frequent)), "suffix").withColumn("path", F.array_intersect("path", "here")).drop("here")
    found = reduce(DataFrame.unionAll, levels).select("antecedent", F.explode(F.array(*(F.struct(F.lit(v).alias("verdict"), F.col(v).alias("c")) for v in ("block", "allow")))).alias("v"), "n")
    found = found.select("antecedent", "v.verdict", (F.col("v.c") / F.col("n")).alias("confidence"), (F.col("v.c") / total).alias("support"), "v.c")
    return found.filter((F.col("confidence") >= p.confidence) & (F.col("c") >= least)).drop("c")


def mine(labelled: DataFrame, p: MineParams = MineParams()) -> DataFrame:
    """The rules of ``mined``."""
    return mined(labelled, p)[0]


def mined(labelled: DataFrame, p: MineParams = MineParams()) -> tuple[DataFrame, DataFrame]:
    """(rule_id, antecedent, verdict, confidence, support) from rows of (items, verdict), and (token, kept) of the tokens
    that a rule's own stand for; verdicts are block and allow.

    Of tokens that always stand together in the rows an antecedent names one, and the rule holds for each of them as
    well: whoever applies rules replaces tokens by their ``kept`` first. So one url of many tokens makes no more rules,
    and none is lost. Support is the share of rows with the antecedent and the verdict. Rows that are equal are counted, not gathered.
    Null or empty items make no rule; without enough rows there are none.
    """
    baskets = labelled.filter("items is not null").groupBy(F.array_sort(F.array_distinct("items")).alias("items"))
    baskets = cut(baskets.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("block"), F.count_if(F.col("verdict") == "allow").alias("allow")))
    total = baskets.agg(F.sum("n")).first()[0] or 0
    least = max(p.least, math.ceil(p.support * total))
    if total < least:
        spark = labelled.sparkSession
        return spark.createDataFrame([], "rule_id long, antecedent array<string>, verdict string, confidence double, support double"), spark.createDataFrame([], "token string, kept string")
    alike = _alike(baskets, least)
    useful = [r.token for r in sorted(alike.filter("token = kept").collect(), key=lambda r: (-r.n, r.token))]  # most frequent first
    rules = _grown(baskets, useful, least, total, p)
    rules = cut(rules.withColumn("rule_id", F.xxhash64(F.array_join("antecedent", "\u0001"), "verdict")))
    # a rule is dropped if a shorter one with a part of its tokens says the same with no less confidence
    parts = rules.select("rule_id", "verdict", "confidence", F.size("antecedent").alias("n"), F.explode("antecedent").alias("token"))
    a, b = parts.alias("a"), parts.alias("b")
    inside = a.join(b, F.expr("a.token = b.token and a.verdict = b.verdict and a.n < b.n and a.confidence >= b.confidence"))
    implied = inside.groupBy("a.rule_id", "b.rule_id", "a.n").agg(F.count("*").alias("c")).filter("c = n").select(F.col("b.rule_id").alias("rule_id")).distinct()
    return rules.join(implied, "rule_id", "left_anti").select("rule_id", "antecedent", "verdict", "confidence", "support"), alike.select("token", "kept")


def judge(pages: DataFrame, p: MineParams = MineParams(), rules: tuple = RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    A null or empty url, or one without ://, has an empty host and path, no rule and the default verdict. Very long urls
    are judged whole. Of mined rules that fit, the one of highest confidence decides, then support, length, verdict and
    rule_id. Equal urls get equal verdicts; repeated rows are kept; a null page_id stays null; extra columns are
    ignored, whatever their names; an empty table gives an empty table.
    """
    held = pages.select(F.col("page_id").cast("long"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    held = held.withColumn("rule", name).withColumn("given", verdict)
    items = tokens(F.col("host"), F.col("path"))
    found, alike = mined(held.filter("given is not null and host <> ''").select(items.alias("items"), F.col("given").alias("verdict")), p)
    index = cut(found).select("rule_id", "verdict", "confidence", "support", F.size("antecedent").alias("n"), F.explode("antecedent").alias("token"))
    # only urls that no fixed rule decides are looked up, once for each distinct set of tokens; hosts with many pages
    # are one question
    open_ = held.filter("given is null and host <> ''").withColumn("items", items)
    kinds = cut(open_.groupBy("items").agg(F.count("*").alias("n")))
    hot = hot_keys(kinds, "items", kinds.agg(F.sum("n")).first()[0] or 0)
    asked = kinds.select("items", F.explode("items").alias("token")).join(small(alike), "token").select("items", F.col("kept").alias("token")).distinct()
    asked = asked.join(small(index), "token")
    hits = asked.groupBy("items", "rule_id", "verdict", "confidence", "support", "n").agg(F.count("*").alias("c")).filter("c = n")
    best = hits.groupBy("items").agg(F.max(F.struct("confidence", "support", "n", "verdict", "rule_id")).alias("best")).select("items", "best.verdict")
    looked = dealt(open_, hot, "items", "page_id", "host", "path").join(spread(best, hot, "items"), ["items", SALT], "left")
    settled = held.filter("given is not null or host = ''")
    out = settled.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit(p.default)).alias("verdict"))
    return out.unionAll(looked.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(p.default)).alias("verdict")))
