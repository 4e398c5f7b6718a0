"""Heuristic quality rules as a short-circuit cascade of native expressions.

Each rule's cost and rejection rate are estimated on a uniform sample, given the rules before it; rules then run in
descending order of rejection per cost, and a document that one rule rejects is not shown to the rest. The order changes
the time only: a document is kept if and only if no rule rejects it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
SPACE = BLANK + "+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
UPPER = "[A-Z]"
#: Words of a window whose repetition counts.
WINDOW = 8
#: Rows of the sample on which rules are ordered.
SAMPLE = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, and only where the expression around it is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for null or blank text."""
    held = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(held == "", F.array().cast("array<string>")).otherwise(F.split(held, SPACE))


def having(text: Column, chars: str) -> Column:
    """Characters of the text that are in a character class."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(chars)).cast("long")


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def repeated_words(ws: Column, k: int = WINDOW) -> Column:
    """Words that lie in a k-word window found twice or more in the text.

    Window hashes decide whether any window repeats; only then are the windows themselves sorted, so the count is
    exact. Memory and time are near-linear in one text.
    """
    starts = F.sequence(F.lit(1), F.size(ws) - k + 1)
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, k)))
    ordered = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(ws, i, k), " ").alias("g"), i.alias("i"))))

    def covered(at: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last"))
        step = lambda s, i: F.struct((s["n"] + F.least(F.lit(k), i - s["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, first, step, lambda s: s["n"])

    def count(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (x["g"] == F.get(s, j + 1)["g"]) | F.coalesce(x["g"] == F.get(s, F.greatest(j - 1, F.lit(0)))["g"], F.lit(False)) & (j > 0))
        return covered(F.array_sort(F.transform(twice, lambda x: x["i"])))

    any_twice = let(hashed, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(ws) <= k, F.lit(0)).when(~any_twice, F.lit(0)).otherwise(let(ordered, count)).cast("long")


def stutters(ws: Column) -> Column:
    """Words equal to the word before."""
    return F.size(F.filter(ws, lambda w, i: (i > 0) & (w == F.get(ws, F.greatest(i - 1, F.lit(0)))))).cast("long")


def measures(text: Column, ws: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.coalesce(text, F.lit(""))) - having(text, BLANK),
        "n_symbols": having(text, SYMBOLS),
        "n_dup_lines": let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(ws),
        "n_lines": F.size(lines(text)).cast("long"),
        "n_upper": having(text, UPPER),
        "n_stutters": stutters(ws),
    }


#: The measures that the rules report of each document.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE = ("short", "repeats")


def rules(m: Mapping[str, Column]) -> dict[str, Column]:
    """Each rule as the condition on which it rejects a document."""
    return {
        "short": m["n_words"] < 20,
        "repeats": 100 * m["n_repeat_words"] > 30 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "duplicate_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
        "shouting": 10 * m["n_upper"] > 4 * m["word_chars"],
        "stutter": 10 * m["n_stutters"] > 3 * m["n_words"],
    }


@dataclass(frozen=True)
class RuleCost:
    """A rule, the characters it evaluates for a row that reaches it, and the share of those rows that it rejects."""

    name: str
    cost: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.cost


def work(text: Column, ws: Column) -> dict[str, Column]:
    """The characters that each rule evaluates, beyond the split into words that all share.

    Counted, not timed, so that an order can be repeated. Windows of repeated words take every word WINDOW times over;
    lines are split, trimmed and compared; words are compared with the one before.
    """
    n = F.length(F.coalesce(text, F.lit(""))).cast("double")
    return {
        "short": F.lit(1.0), "repeats": WINDOW * n + F.size(ws), "symbols": n, "duplicate_lines": 3 * n, "word_length": n, "shouting": 2 * n, "stutter": 2 * n + F.size(ws),
    }


def calibrate(docs: DataFrame, sample: int = SAMPLE, given: tuple[str, ...] = ()) -> list[RuleCost]:
    """Rules in cascade order, from a sample of about that many rows drawn by a hash of id and text.

    Greedy: next comes the rule with most rejections per evaluated character among the sampled rows that the rules
    before it (and those ``given``, which are run in any case) let pass; ties and rules that reject nothing more go by
    cost and then as listed. One job counts the rows and the characters of each combination of rejecting rules. The
    sample bounds the cost of planning, not the rows judged. Without rows the rules keep their listed order.
    """
    text = F.col("text").cast("string")
    total = docs.count()
    share = min(1.0, sample / max(total, 1))
    picked = docs.filter(F.pmod(F.xxhash64(F.lit(7), F.col("doc_id"), text), F.lit(1_000_003)) < F.lit(share * 1_000_003)).select(text.alias("text"), words(text).alias("words"))
    tests, costs = rules(measures(F.col("text"), F.col("words"))), work(F.col("text"), F.col("words"))
    names = list(tests)
    flagged = picked.select(*(F.coalesce(tests[x], F.lit(False)).alias(x) for x in names), *(costs[x].alias(f"{x}_work") for x in names))
    groups = flagged.groupBy(*names).agg(F.count("*").alias("rows"), *(F.sum(f"{x}_work").alias(f"{x}_work") for x in names)).collect()
    left = [g for g in groups if not any(g[x] for x in given)]
    order, open_ = [], [x for x in names if x not in given]
    while open_:
        rows = sum(g["rows"] for g in left)
        each = []
        for x in open_:
            cost = sum(g[f"{x}_work"] for g in left) / rows if rows else 1.0
            each.append(RuleCost(x, max(cost, 1.0), sum(g["rows"] for g in left if g[x]) / rows if rows else 0.0))
        order.append(max(each, key=lambda c: (c.gain, -c.cost)))
        open_.remove(order[-1].name)
        left = [g for g in left if not g[order[-1].name]]
    return order


def cascade(tests: Mapping[str, Column], order: list[RuleCost]) -> Column:
    """The first rule in order that rejects, null if none does; later rules aren't evaluated."""
    out = F
    for cost in order:
        out = out.when(tests[cost.name], F.lit(cost.name))
    return out.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, order: list[RuleCost] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, the reported measures, base_failed, kept.

    The reported measures are computed for all rows. Those of the other rules stand inside the cascade, behind the base
    rules: no rule runs on a row that one before it rejects. Null, empty and blank texts have no words, so they fail
    the base rules; very long texts are judged whole. Repeated rows are judged alone; a null doc_id stays null; extra
    columns are ignored, whatever their names; an empty table gives an empty table.
    """
    order = order or calibrate(docs, given=BASE)
    held = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("words", words(F.col("text")))
    named = measures(F.col("text"), F.col("words"))
    held = held.select("doc_id", "text", "words", *(named[k].alias(k) for k in REPORTED))
    tests = rules(named | {k: F.col(k) for k in REPORTED})
    failed = tests["short"] | tests["repeats"]
    verdict = F.when(failed, F.lit("base")).otherwise(cascade(tests, [c for c in order if c.name not in BASE]))
    return held.select("doc_id", *REPORTED, failed.alias("base_failed"), verdict.isNull().alias("kept"))


def keep_passing(docs: DataFrame, order: list[RuleCost] | None = None) -> DataFrame:
    """docs without the rows that a rule rejects; columns unchanged. No rule runs on a row already rejected.

    Nulls, empty and very long texts, repeated rows, extra columns and empty tables are as in ``judge``.
    """
    order = order or calibrate(docs)
    text = F.col("text").cast("string")
    return docs.filter(let(words(text), lambda ws: cascade(rules(measures(text, ws)), order)).isNull())


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS bare FROM t
),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(8) AS x(o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
    (length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    length(bare) - length(regexp_replace(bare, '[A-Z]', '', 'g')) AS n_upper,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutters
  FROM w LEFT JOIN v USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_upper > 4 * word_chars OR 10 * n_stutters > 3 * n_words) AS kept
FROM m
"""
