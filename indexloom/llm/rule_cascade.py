"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's cost and selectivity are estimated on a sample; rules then run by
rejections per cost, and a row that one has rejected costs the others nothing.
"""

from __future__ import annotations

import math
import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, scratch, written

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Rows, at most about, on which costs and selectivities are estimated; times each is evaluated in a timed run, and runs.
SAMPLE_ROWS, TIMES, RUNS = 2_000, 8, 3
#: Seconds below which a cost is not told apart.
LEAST_COST = 0.004


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition, in SQL, over the measures; null counts as not rejected."""

    name: str
    rejects: str


BASE_RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words"),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", "10 * n_symbols > word_chars"),
    Rule("capitals", "2 * n_capitals > word_chars"),
    Rule("shouts", "2 * n_shouts > n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("dup_lines", "10 * n_dup_lines > 3 * n_lines AND n_lines > 3"),
)
#: Measures that only a rule needs: taken from ``__text`` where the rule is evaluated, and so only of rows that reach it.
LATE = {"n_capitals": "CAST(regexp_count(__text, '[A-Z]') AS BIGINT)", "n_shouts": "CAST(regexp_count(__text, '!') AS BIGINT)"}


def _from(array: Column | str, by: int) -> Column:
    """``array`` without its first ``by`` elements."""
    return F.slice(array, by + 1, F.greatest(F.size(array), F.lit(1)))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Of each whole text (null: empty). n_repeat_words: words in windows of 8
    words that the text has twice or more. Windows are first compared by hash;
    those whose hash the text has again are compared as strings. Write
    the result before filtering by it: Spark would copy these expressions into
    the filter, and what it infers from one. Columns of these names are replaced; other columns stay.
    """
    n, words, lines = F.size("__words"), F.col("__words"), F.col("__lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumns({"__t": text, "__words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0))})
    counts = {"n_words": n, "word_chars": F.length(F.array_join(words, "")), "n_symbols": F.regexp_count("__t", F.lit(SYMBOLS))}
    d = d.withColumns({k: v.cast("long") for k, v in counts.items()})
    d = d.withColumn("__lines", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumns({"n_lines": F.size(lines).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")})
    d = d.withColumn("__h", F.when(n > WINDOW, F.transform(words, lambda w: F.xxhash64(w))))
    for by in (1, 2, 4):
        d = d.withColumn("__h", F.zip_with("__h", _from("__h", by), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("__h", F.slice("__h", 1, F.greatest(n - (WINDOW - 1), F.lit(1))))
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    d = d.withColumn("__s", F.when(again, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("w"), i.alias("i"))))))
    d = d.withColumn("__s", F.sort_array(F.transform(_twins("__s"), lambda x: F.struct(F.array_join(F.slice("__words", x["i"] + 1, WINDOW), " ").alias("w"), x["i"].alias("i")))))
    d = d.withColumn("__at", F.sort_array(F.transform(_twins("__s"), lambda x: x["i"])))
    spans = F.zip_with("__at", _from("__at", 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(spans, F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long"))
    return d.drop("__t", "__words", "__lines", "__h", "__s", "__at")


def _twins(name: str) -> Column:
    """Those of the sorted structs (w, i) in column ``name`` whose w a neighbour has too."""
    s = F.col(name)
    return F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"]))


def _rejects(rule: Rule) -> Column:
    """The rule's condition; late measures in it are taken from ``__text``."""
    return F.coalesce(F.expr(re.sub(r"\w+", lambda m: LATE.get(m[0], m[0]), rule.rejects)), F.lit(False))


def _seconds(sample: DataFrame, condition: Column) -> tuple[float, int]:
    """The shortest of RUNS evaluations of ``condition``, TIMES for each row; and how many rows it holds for."""
    many = sample.withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))
    best, hits = math.inf, 0
    for _ in range(RUNS):
        began = time.perf_counter()
        hits = many.agg(F.count_if(condition)).first()[0] // TIMES
        best = min(best, time.perf_counter() - began)
    return best, hits


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """``rules`` by rejections per second, most first, as a sample of whole texts of ``docs`` shows them.

    A rule's cost is what its evaluation on the sample takes beyond that of no
    rule, the measures of ``measured`` being there; costs count as powers of
    four, so that noise hardly ever changes the order, and equal rules stay as
    given. The order bears on speed alone: a verdict is the same in any order.
    An empty table leaves them as given.
    """
    rows = docs.count()
    if not rows:
        return list(rules)
    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text")).sample(min(1.0, sample_rows / rows), seed)
    with scratch():
        sample = written(measured(sample, "__text").coalesce(1), "sample")
        fixed = min(_seconds(sample, F.length("__text") < 0)[0] for _ in range(2))
        gains = []
        for rule in rules:
            took, hits = _seconds(sample, _rejects(rule))
            gains.append((hits / 4.0 ** round(math.log(max(took - fixed, LEAST_COST), 4)), rule))
    return [rule for _, rule in sorted(gains, key=lambda x: -x[0])]


def survivors(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that no rule rejects: rule after rule in cascade order, each measuring only what is left.

    A rejected row's text is null for the rules after it, so it costs them nothing.
    """
    d = docs.select(F.struct("*").alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.lit(True).alias("__alive"))
    for rule in ordered(docs, rules, text_col):
        d = measured(d, "__text").withColumn("__alive", F.col("__alive") & ~_rejects(rule))
        d = d.select("__doc", "__alive", F.when(F.col("__alive"), F.col("__text")).alias("__text"))
    return written(d.select("__doc", "__alive"), "survivors").where("__alive").select("__doc.*")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), order: list[Rule] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the measures of each text, base_failed (some rule of ``base`` rejects), kept and n_rules.

    kept: no rule of ``rules`` rejects the text. They run one after the other in
    cascade order (``order``, by default as a sample gives it; rules of ``base``
    first, as their verdict is asked for), each only on rows that those before
    it left; n_rules of them were evaluated on the row. A written table, texts
    apart. Null and empty texts have no words and fail; repeated rows each get
    a verdict; other columns are not read; an empty table gives none.
    """
    order = ordered(docs, rules, text_col) if order is None else order
    order = [r for r in order if r in base] + [r for r in order if r not in base]
    at = F.lit(len(order) + 1)  # one more than the place of the rule that rejects
    for k in range(len(order), 0, -1):
        at = F.when(_rejects(order[k - 1]), k).otherwise(at)
    failed = F.lit(False)
    for rule in base:
        failed = failed | _rejects(rule)
    d = measured(docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text")), "__text")
    d = d.withColumn("base_failed", failed).withColumn("n_rules", at).drop("__text")
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("n_rules") > len(order)))
    return written(d.withColumn("n_rules", F.least("n_rules", F.lit(len(order)))), "verdicts")
