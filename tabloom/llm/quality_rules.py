"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a text when one measured share exceeds a cutoff. Labelled rows are the holdout:
nothing is fitted on them, they only test a fixed grid of cutoffs. For a stratum, a rule and a
cutoff the null hypothesis is "the rule rejects more than ``risk / rules`` of the good texts of the
stratum"; its exact binomial p-value is P(Bin(n, risk / rules) <= rejected good texts). Cutoffs are
tested from the most lenient to the strictest and the first one that is not significant ends the
sequence, so within a rule no further correction is due; strata and rules share ``delta`` evenly
(Bonferroni). With probability 1 - delta, every stratum loses at most ``risk`` of its good texts.
A stratum with too few labels gets no cutoff and loses nothing to these rules.

Only DataFrame functions run here; no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.text import fresh_names
from tabloom.session import cut_lineage

SPACE = r"[ \t\n\x0B\f\r]"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8  # words; the hashes of measure() double three times


@dataclass(frozen=True)
class Rule:
    """Reject when ``value`` (an expression over the measures) exceeds a cutoff; cutoffs fall."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / n_words", (8.0, 4.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
    Rule("shouting", "n_shouts / n_words", (4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1)),
    Rule("same_lines", "n_dup_lines / n_lines", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5)),
)
RISK = 0.02
DELTA = 0.05
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


def measure(docs: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """``docs`` and a struct column ``into`` with the counts of MEASURES and ``base_failed``.

    A null text counts as a text without words: all counts 0 and ``base_failed`` true. Other columns
    pass through, whatever their names are; work happens inside one row, so copies, ties and
    repeated rows are measured each on its own.
    """
    # the columns of ``docs`` travel under numbers, so that none is called like one of these
    t, own = "__text", [F.col(f"own{i}") for i in range(len(docs.columns))]
    one = docs.select(*[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(docs.columns)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t))
    two = one.select(
        *own,
        F.array_remove(F.split(t, SPACE + "+"), "").alias("__words"),
        F.filter(F.split(t, "\n"), lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0).alias("__lines"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("__symbols"),
        F.length(F.regexp_replace(t, "[^!]+", "")).cast("long").alias("__shouts"),
    )
    # a window's hash is the hash of its halves' hashes: three passes over the words instead of eight
    three = two.withColumn("__windows", F.transform("__words", lambda w: F.xxhash64(w)))
    for width in (1, 2, 4):
        later = F.slice("__windows", width + 1, F.greatest(F.size("__windows") - width, F.lit(0)))
        three = three.withColumn(
            "__windows",
            F.slice(
                F.zip_with("__windows", later, lambda a, b: F.xxhash64(a, b)),
                1,
                F.greatest(F.size("__windows") - width, F.lit(0)),
            ),
        )
    # sorted (hash, position) only where some window occurs twice
    four = three.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    again = F.filter(
        "__sorted",
        lambda x, i: (x["h"] == F.get("__sorted", i + 1)["h"]) | (x["h"] == F.get("__sorted", i - 1)["h"]),
    )
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    five = four.withColumn("__repeat", F.coalesce(covered, F.lit(0)).cast("long"))
    n_words = F.size("__words").cast("long")
    return five.select(
        *[o.alias(c) for o, c in zip(own, docs.columns, strict=True)],
        F.struct(
            n_words.alias("n_words"),
            F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            F.col("__symbols").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            F.col("__repeat").alias("n_repeat_words"),
            F.size("__lines").cast("long").alias("n_lines"),
            F.col("__shouts").alias("n_shouts"),
            ((n_words < 20) | (100 * F.col("__repeat") > 30 * n_words)).alias("base_failed"),
        ).alias(into),
    )


def value_of(rule: Rule, measures: str = "measures") -> Column:
    """The rule's value; 0 where its denominator is 0."""
    above, below = rule.value.split(" / ")
    return F.when(F.col(f"{measures}.{below}") > 0, F.col(f"{measures}.{above}") / F.col(f"{measures}.{below}")).otherwise(0.0)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by the Stirling series, shifted up by 8 (error below 1e-12)."""
    y = x + F.lit(8.0)
    shift = F.log(x * (x + 1.0) * (x + 2.0) * (x + 3.0)) + F.log((x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0))
    tail = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * F.log(y) - y + 0.5 * F.log(F.lit(6.283185307179586)) + tail - shift


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k), summed downward from the largest term; the terms left out are below 1e-15
    of the sum for k < n p, where the test can be significant at all."""
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(p) + (n - k) * F.log1p(-p)
    steps = F.least(k, F.ceil(60 * F.sqrt(n * p + 1)) + 200).cast("long")
    ratio_sum = F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, j: F.struct(
            (a["sum"] + a["term"]).alias("sum"),
            (a["term"] * (k - j) / (n - k + j + 1) * (1 - p) / p).alias("term"),
        ),
        lambda a: a["sum"],
    )
    return F.when(k >= n, 1.0).when(k >= n * p, 1.0).otherwise(F.exp(top + F.log(ratio_sum)))


def calibrate(
    measured: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    stratum: str = "lang",
    quality: str = "quality",
    rules: Sequence[Rule] = RULES,
    risk: float = RISK,
    delta: float = DELTA,
    measures: str = "measures",
) -> DataFrame:
    """One row per stratum and rule with a safe cutoff: (stratum, rule, cutoff, n_good, n_lost).

    A text counts as good when a label row says so; texts that the base rule rejects, rows without
    label and null ids are no evidence. Each labelled id counts once.
    """
    good = labels.filter(F.col(quality) == 1).select(F.col(id_col).alias("__id")).distinct()
    seen = measured.filter(~F.col(f"{measures}.base_failed")).select(
        F.col(f"`{id_col}`").alias("__id"),
        F.col(f"`{stratum}`").alias("stratum"),
        *[value_of(r, measures).alias(f"__v{i}") for i, r in enumerate(rules)],
    )
    held = seen.join(good, "__id").groupBy("__id", "stratum").agg(*[F.max(f"__v{i}").alias(f"__v{i}") for i in range(len(rules))])
    counts = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_good"),
        *[
            F.array(*[F.count_if(F.col(f"__v{i}") > c) for c in r.cutoffs]).alias(f"__lost{i}")
            for i, r in enumerate(rules)
        ],
    )
    counts = counts.withColumn("__strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # a row per stratum
    grid = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.array(*[F.lit(float(c)) for c in r.cutoffs]).alias("cutoffs"),
                F.col(f"__lost{i}").alias("lost"),
            )
            for i, r in enumerate(rules)
        ]
    )
    tests = counts.select("stratum", "__strata", "n_good", F.explode(grid).alias("g")).select(
        "stratum", "__strata", "n_good", "g.rule", F.posexplode(F.arrays_zip("g.cutoffs", "g.lost")).alias("step", "c")
    )
    p_value = binomial_cdf(F.col("n_lost"), F.col("n_good"), F.lit(risk / len(rules)))
    tests = tests.select(
        "stratum", "__strata", "rule", "step", "n_good", F.col("c.cutoffs").alias("cutoff"), F.col("c.lost").alias("n_lost")
    ).withColumn("p_value", p_value)
    level = F.lit(delta / len(rules)) / F.col("__strata")
    return (
        tests.withColumn("__ok", F.col("p_value") <= level)
        .groupBy("stratum", "rule", "n_good")
        .agg(
            F.min(F.when(~F.col("__ok"), F.col("step"))).alias("__stop"),
            F.collect_list(F.struct("step", "cutoff", "n_lost")).alias("__steps"),
        )
        .withColumn(
            "__best",
            F.array_max(F.filter("__steps", lambda s: F.col("__stop").isNull() | (s["step"] < F.col("__stop")))),
        )
        .filter(F.col("__best").isNotNull())
        .select("stratum", "rule", F.col("__best.cutoff").alias("cutoff"), "n_good", F.col("__best.n_lost").alias("n_lost"))
    )


def decide(
    measured: DataFrame,
    cutoffs: DataFrame,
    stratum: str = "lang",
    rules: Sequence[Rule] = RULES,
    into: str = "kept",
    measures: str = "measures",
) -> DataFrame:
    """``measured`` with a boolean ``into``: neither the base rule nor a cutoff of its stratum rejects.

    A stratum without cutoffs keeps all that the base rule keeps; a null stratum is one of its own.
    The cutoffs are one row per stratum, written first, so the session's broadcast limit decides
    by their true size how they are joined.
    """
    group, *cuts = fresh_names(measured, "stratum", *[f"cut{i}" for i in range(len(rules))])
    table = cut_lineage(
        cutoffs.groupBy(F.col("stratum").alias(group)).agg(
            *[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(cuts[i]) for i, r in enumerate(rules)]
        )
    )
    rejected = F.col(f"{measures}.base_failed")
    for i, r in enumerate(rules):
        rejected = rejected | F.coalesce(value_of(r, measures) > F.col(cuts[i]), F.lit(False))
    own = [measured[f"`{c}`"] for c in measured.columns]
    joined = measured.join(table, F.col(f"`{stratum}`").eqNullSafe(F.col(group)), "left")
    return joined.select(*own, (~rejected).alias(into))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    keep: Sequence[str] = (),
    rules: Sequence[Rule] = RULES,
    risk: float = RISK,
    delta: float = DELTA,
    measures: str = "measures",
    into: str = "kept",
) -> DataFrame:
    """Id, stratum, the columns of ``keep``, ``measures`` and ``into`` for every row of ``docs``.

    The texts are read once: measures (with ``keep``) are written to the scratch folder and both
    the calibration and the decision read them there. An empty table gives an empty result, empty
    labels give no cutoffs.
    """
    columns = list(dict.fromkeys([id_col, stratum, *keep]))
    narrow = measure(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text])]), text, measures)
    measured = cut_lineage(narrow.select(*[F.col(f"`{c}`") for c in columns], measures))
    cutoffs = calibrate(measured, labels, id_col, stratum, rules=rules, risk=risk, delta=delta, measures=measures)
    return decide(measured, cutoffs, stratum, rules, into, measures)
