"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects documents whose measure exceeds a cutoff. Labelled documents show how often a cutoff rejects good ones; an
exact binomial test per stratum decides which cutoffs are safe. Rules and strata share the error probability evenly
(Bonferroni), and within one rule and stratum cutoffs are tested from lenient to strict and the first failure ends
the sequence, so that all cutoffs passed before it hold together with the stated confidence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.shared import stored

#: Share of good documents that one stratum may lose to a rule.
RISK = 0.05
#: Probability that the bound fails for any rule, stratum or cutoff.
ERROR = 0.05
#: How many bad documents must be caught for each good one lost, or a cutoff isn't worth it.
PRICE = 10
#: Cutoffs of each rule, from lenient to strict: a first value and how often it shrinks by a factor.
GRIDS = {"symbol_share": (0.5, 0.8, 16), "dup_line_share": (0.9, 0.85, 12), "repeat_share": (0.5, 0.9, 12)}

BLANKS = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the list.

    Positions are sorted by a hash of their window, packed with the position into one number. Neighbours with equal hashes
    are compared again by their full text, so a collision of the short hash changes nothing.
    """

    def count(w: Column) -> Column:
        n = F.size(w) - 2
        bits = F.ceil(F.log2(n + F.lit(1))).cast("int")

        def packed(b: Column) -> Column:
            hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), b).bitwiseOR(i.cast("long")))
            return _let(F.sort_array(hashes), lambda s: suspects(s, b))

        def suspects(s: Column, b: Column) -> Column:
            high = lambda x: F.call_function("shiftright", x, b)
            twin = F.filter(F.transform(s, lambda x, i: F.when(
                ((i > 0) & (high(F.get(s, i - 1)) == high(x))) | ((i < n - 1) & (high(F.get(s, i + 1)) == high(x))),
                x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1).cast("int"))), lambda x: x.isNotNull())
            return _let(twin, lambda t: F.when(F.size(t) == 0, F.lit(0)).otherwise(verified(t)))

        def verified(t: Column) -> Column:
            full = F.sort_array(F.transform(t, lambda p: F.struct(F.concat_ws(" ", w[p], w[p + 1], w[p + 2]).alias("gram"), p.alias("at"))))
            m = F.size(t)
            return _let(full, lambda s: covered(F.array_sort(F.filter(F.transform(s, lambda x, i: F.when(
                ((i > 0) & (F.get(s, i - 1)["gram"] == x["gram"])) | ((i < m - 1) & (F.get(s, i + 1)["gram"] == x["gram"])), x["at"])),
                lambda x: x.isNotNull()))))

        def covered(starts: Column) -> Column:
            return _let(starts, lambda p: F.coalesce(F.aggregate(
                F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1)))), F.lit(0), lambda a, x: a + x), F.lit(0)))

        return F.when(n < 2, F.lit(0)).otherwise(_let(bits, packed))

    return _let(words, count).cast("long")


def base_measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a whole text; null counts as empty.

    Words are runs without blank, tab and line end characters. A duplicated line has a word and equals an earlier line.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    return {
        "_counts": _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))),
        "_lines": _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
    }


def with_measures(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and the base measures of each row's text, with base_failed."""
    found = df.select(*keep, *[c.alias(name) for name, c in base_measures(F.col(text)).items()])
    n, repeat = F.col("n_words"), F.col("n_repeat_words")
    return found.select(
        *keep, "_counts.n_words", "_counts.word_chars", "n_symbols", "_lines.n_dup_lines", "_counts.n_repeat_words", "_lines.n_lines"
    ).withColumn("base_failed", (n < 50) | (100 * repeat > 50 * n))


def shares() -> dict[str, Column]:
    """The rules' measures: shares of symbols, duplicated lines and repeated words; 0 where there is nothing to share."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {"symbol_share": part("n_symbols", "word_chars"), "dup_line_share": part("n_dup_lines", "n_lines"), "repeat_share": part("n_repeat_words", "n_words")}


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series above x + 9."""
    shift = reduce(lambda a, k: a + F.log(x + k), range(1, 9), F.log(x))
    y = x + 9
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * F.log(F.lit(2 * 3.141592653589793)) + series - shift


def binomial_below(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial with n trials of probability p: the exact sum, from its largest term down.

    Terms that are below the sum by more than 1e-17 in all are left out: each is at most the one before times the first ratio.
    For k above the mean the answer is given as 1, which only makes a test harder.
    """
    nd, kd = n.cast("double"), k.cast("double")
    top = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(60 * F.sqrt(nd * p * (1 - p)) + 60).cast("long"))
    summed = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, j: _let(a["term"] * (kd - j + 1) * (1 - p) / ((nd - kd + j) * p), lambda t: F.struct((a["sum"] + t).alias("sum"), t.alias("term"))),
        lambda a: a["sum"],
    )
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * summed))


def select_cutoffs(labelled: DataFrame, stratum: str, good: str, risk: float = RISK, error: float = ERROR, price: float = PRICE, grids: dict | None = None) -> DataFrame:
    """Per stratum and rule the cutoff that gains most among the safe ones: stratum, rule, cutoff, and its counts.

    `labelled` has the measures, a stratum column and `good` (1 or 0, other rows don't count), and no row that the base
    rules reject. A cutoff is safe if P(X <= rejected good ones) under the allowed risk, split evenly over the rules, is at most the
    error probability split evenly over strata and rules, and so are all more lenient cutoffs. Strata with too few good rows
    have no safe cutoff and no row here. All labelled rows count.
    """
    grids = grids or GRIDS
    rows = labelled.where(F.col(good).isin(0, 1)).select(F.col(stratum).alias("stratum"), F.col(good).cast("int").alias("good"), *[c.alias(r) for r, c in shares().items() if r in grids])
    def passes(rule: str) -> Column:
        """How many cutoffs of the grid let a row pass."""
        first, ratio, n = grids[rule]
        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0), lambda a, i: a + (F.col(rule) <= first * F.pow(F.lit(ratio), i)).cast("int"))

    long = rows.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(n).alias("steps"), passes(r).alias("step")) for r, (_, _, n) in grids.items()])).alias("x"))
    counted = long.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.steps").alias("steps"), F.col("x.step").alias("step")).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    groups = counted.groupBy("stratum", "rule", "steps").agg(F.map_from_entries(F.collect_list(F.struct("step", F.struct("good", "bad")))).alias("at"), F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    at_step = lambda name: F.coalesce(F.try_element_at(F.col("at"), F.col("i"))[name], F.lit(0))
    each = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("i")).withColumns({"g": at_step("good"), "b": at_step("bad")})
    order = Window.partitionBy("stratum", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    tested = each.withColumns({"rejected_good": F.sum("g").over(order), "rejected_bad": F.sum("b").over(order)})
    n_strata = rows.select(F.coalesce(F.count_distinct("stratum"), F.lit(0)) + F.max(F.col("stratum").isNull().cast("int"))).first()[0] or 1
    level = error / (n_strata * len(grids))
    safe = tested.withColumn("p", binomial_below(F.col("rejected_good"), F.col("n_good"), risk / len(grids))).withColumn("unsafe", F.max((F.col("p") > level).cast("int")).over(order))
    first_of = F.element_at(F.create_map(*[F.lit(x) for r, (a, _, _) in grids.items() for x in (r, float(a))]), F.col("rule"))
    ratio_of = F.element_at(F.create_map(*[F.lit(x) for r, (_, b, _) in grids.items() for x in (r, float(b))]), F.col("rule"))
    gained = safe.where("unsafe = 0").withColumns({"gain": F.col("rejected_bad") - price * F.col("rejected_good"), "cutoff": first_of * F.pow(ratio_of, F.col("i"))})
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "i")
    return gained.where("gain > 0").withColumn("rank", F.row_number().over(best)).where("rank = 1").select("stratum", "rule", "cutoff", "p", "n_good", "n_bad", "rejected_good", "rejected_bad")


def apply_cutoffs(measured: DataFrame, stratum: str, cutoffs: DataFrame) -> DataFrame:
    """Adds kept: false where a base rule fails or a measure exceeds its stratum's cutoff; strata without cutoffs keep the rest."""
    rules = list(GRIDS)
    wide = cutoffs.groupBy(F.xxhash64("stratum").alias("_h2"), F.col("stratum").alias("_stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in rules])
    hit = lambda r, c: F.coalesce(c > F.col(f"_{r}"), F.lit(False))
    joined = measured.withColumn("_h", F.xxhash64(stratum)).join(wide, (F.col("_h") == F.col("_h2")) & F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    rejected = reduce(lambda a, b: a | b, [hit(r, c) for r, c in shares().items()])
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_h", "_h2", "_stratum", *[f"_{r}" for r in rules])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", good: str = "quality", keep_digest: bool = False) -> DataFrame:
    """Base measures, base_failed and kept of every row of `docs`, with cutoffs learned from all labelled rows.

    Null and empty texts have no words and fail the base rules. A label counts once for each row that has its key; keys
    with two labels count with each, null labels not at all. Without labels only the base rules reject. Repeated rows get equal answers.
    keep_digest adds _digest, a hash of the text by which rows of equal keys can be told apart.
    """
    keep = [key, stratum, *["_digest"] * keep_digest]
    own = docs.withColumn("_digest", F.xxhash64(F.coalesce(F.col(text), F.lit("")))) if keep_digest else docs
    measured = stored(with_measures(own, text, keep), "measures")
    known = labels.select(F.col(key).alias("_key"), F.col(good).alias("_good"))
    labelled = measured.where(~F.col("base_failed")).join(known, F.col(key) == F.col("_key"))
    cutoffs = stored(select_cutoffs(labelled, stratum, "_good"), "cutoffs")
    return apply_cutoffs(measured, stratum, cutoffs)
