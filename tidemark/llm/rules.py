"""Quality rules: a threshold table compiled into one projection of built-in functions.

A rule is a metric with a lower and an upper bound (either may be open). Metrics are counts
of one document; ratios are compared by cross-multiplication, so a document without words,
lines or characters has defined verdicts and nothing is divided by zero.

Defined results: NULL and blank texts have zero counts and fail ``min_words``; a NULL language
uses the stop words of all languages; equal rows get equal verdicts; an empty table stays
empty; other columns of the input pass through ``apply_rules`` untouched, and an input column
whose name is that of a measure is replaced by the measure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, private, words

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Reject when ``100 * part < low * whole`` or ``100 * part > high * whole``, asked only of
    documents with at least ``least`` words. ``whole`` None compares ``part`` itself."""

    name: str
    part: str
    whole: str | None = None
    low: float | None = None
    high: float | None = None
    least: int = 0


#: Every threshold of the production run, in one place.
THRESHOLDS = (
    Rule("mean_word_length", "word_chars", "n_words", low=150, high=1500, least=20),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("upper_case", "n_upper", "word_chars", high=60),
    Rule("shout_marks", "n_shouts", "n_words", high=30),
    Rule("letters", "n_letters", "word_chars", low=50, least=20),
    Rule("stop_words", "n_stop", "n_words", low=2, least=50),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=50, least=50),
    Rule("word_twice", "n_twice", "n_words", high=20),
    Rule("long_words", "n_long_words", "n_words", high=20),
)

#: Frequent function words per language (fixed values).
STOP_WORDS = {
    "en": "the of and to in a is that for it as was on be with by at from this are or an not which",
    "de": "der die und das in zu den von mit ist des im für auf dem ein eine als auch an es nicht sich",
    "fr": "de la le et les des en un une du dans que au pour par sur est avec il elle qui ne pas ce",
    "es": "de la el en y los las un una del que por con para se su al lo como es no más",
}
ALL_STOP_WORDS = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
LONGEST_STOP = max(map(len, ALL_STOP_WORDS))


def _repeat_words(h: Column) -> Column:
    """Words inside windows of 8 words that occur twice or more in the text, from the word
    hashes. Windows are compared by a 64-bit hash; the sort runs only if some window repeats."""

    def covered(v: Column) -> Column:
        s = F.array_sort(F.transform(v, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda i, j: s[i]["h"].eqNullSafe(F.get(s, j)["h"])
            hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            return F.array_sort(F.transform(hit, lambda i: s[i]["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(
                p,
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
                lambda a: a["n"],
            )

        return let(s, lambda s: let(starts(s), total))

    # hashes of 2, 4 and 8 words, each from two of half the length
    double = lambda v, by: F.zip_with(v, F.slice(v, by + 1, F.greatest(F.lit(0), F.size(v) - by)), lambda a, b: F.xxhash64(a, b))
    eight = let(let(double(h, 1), lambda v: double(v, 2)), lambda v: double(v, 4))
    windows = F.slice(eight, 1, F.greatest(F.lit(0), F.size(h) - (WINDOW - 1)))
    found = let(windows, lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), covered(v)).otherwise(0))
    return F.when(F.size(h) > WINDOW, found).otherwise(0)


def measure(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with one column per measure. All of them are expressions of built-in functions
    on the row itself: no shuffle, no join."""
    t = F.coalesce(F.col(text), F.lit(""))
    language = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    stop = lambda v: F.array(*[F.lit(x) for x in v])
    lists = F.coalesce(*[F.when(language == k, stop(v.split())) for k, v in STOP_WORDS.items()], stop(ALL_STOP_WORDS))

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def facts(w: Column, ln: Column) -> Column:
        long = lambda c: c.cast("long")
        short = lambda s: F.size(F.filter(w, lambda x: (F.length(x) <= LONGEST_STOP) & F.array_contains(s, F.lower(x))))
        hashed = lambda h: F.struct(
            long(_repeat_words(h)).alias("n_repeat_words"),
            long(F.size(F.filter(h, lambda x, i: x == F.get(h, i - 1)))).alias("n_twice"),
        )
        return F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))).alias("word_chars"),
            long(F.size(F.filter(w, lambda x: F.length(x) > 30))).alias("n_long_words"),
            long(F.size(ln)).alias("n_lines"),
            long(F.size(ln) - F.size(F.array_distinct(ln))).alias("n_dup_lines"),
            let(F.transform(w, lambda x: F.xxhash64(x)), hashed).alias("h"),
            long(let(lists, short)).alias("n_stop"),
        )

    # exploded from an array of one: a later filter on a measure then reads the value, and is not pushed
    # below it, where the optimizer would repeat the whole computation for each measure it names
    own = private("_facts", docs)
    f = docs.withColumn(own, F.explode(F.array(let(words(t), lambda w: let(lines(t), lambda ln: facts(w, ln))))))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    return f.withColumns(
        {
            **{k: F.col(f"{own}.{k}") for k in ("n_words", "word_chars", "n_dup_lines", "n_lines", "n_long_words", "n_stop")},
            **{k: F.col(f"{own}.h.{k}") for k in ("n_repeat_words", "n_twice")},
            "n_symbols": count(r"[#*$%&|<>]"),
            "n_upper": count(r"\p{Lu}"),
            "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long"),
            "n_shouts": count(r"!!"),
        }
    ).drop(own)


def passes(rule: Rule) -> Column:
    part = F.col(rule.part) * (1 if rule.whole is None else 100)
    whole = F.lit(1) if rule.whole is None else F.col(rule.whole)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (part >= F.lit(rule.low) * whole)
    if rule.high is not None:
        ok = ok & (part <= F.lit(rule.high) * whole)
    return ok if not rule.least else ok | (F.col("n_words") < rule.least)


def apply_rules(docs: DataFrame, thresholds: tuple[Rule, ...] = THRESHOLDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """Measures, ``base_failed`` (too short, or over 30 % of words in repeated windows), the
    names of the failed rules, and ``kept``."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in thresholds]), lambda x: x.isNotNull())
    return (
        measure(docs, text, lang)
        .withColumns({"base_failed": base, "failed_rules": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )
