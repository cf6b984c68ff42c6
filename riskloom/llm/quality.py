"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule is a boolean expression that is true for a text to reject.  A sample
gives the seconds and the rejections of every rule; the rules then run in the
order of rejections per second, as branches of one CASE, so a text that an
early rule rejects costs nothing in the later ones.  The order never changes a
verdict.

Defined results: a null or blank text has no words and is rejected; texts of
any length are judged whole; each row is judged on its own, so repeated rows
agree; other columns pass unchanged.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import word_array
from riskloom.session import shared_dir

REPEAT_WINDOW = 8
SAMPLE_ROWS = 2000
SAMPLE_FILES = 8
TIMINGS = 3


@dataclass(frozen=True)
class Rule:
    """``reject`` maps the counts of a text to a condition; ``base`` marks the two fixed rules."""

    name: str
    reject: "callable"
    base: bool = False


def n_words(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def word_chars(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"), 0)).cast("long")


def _lines_with_word(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)


def n_dup_lines(text: Column) -> Column:
    lines = _lines_with_word(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words inside runs of eight words that occur twice or more in the text.

    Runs are compared by digest.  Only a text with an equal pair goes on to
    sort its digests, mark the runs next to an equal one and merge the words
    they cover.
    """
    words = word_array(text)

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - F.lit(REPEAT_WINDOW))
        digests = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(REPEAT_WINDOW)]))
        return _with(digests, lambda d: F.when(F.size(F.array_distinct(d)) == F.size(d), F.lit(0)).otherwise(_covered(d)))

    return _with(words, lambda w: F.when(F.size(w) < REPEAT_WINDOW, F.lit(0)).otherwise(count(w))).cast("long")


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(digests: Column) -> Column:
    """Words covered by the repeated runs: each run adds the words since the previous repeated run, eight at most."""
    pairs = F.array_sort(F.transform(digests, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(p: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            before, after = F.get(p, k - 1)["h"], F.get(p, k + 1)["h"]
            return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

        marked = F.transform(p, lambda x, k: F.when(repeated(x, k), x["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def total(s: Column) -> Column:
        gap = F.transform(s, lambda x, k: F.when(k == 0, F.lit(REPEAT_WINDOW)).otherwise(F.least(F.lit(REPEAT_WINDOW), x - F.get(s, k - 1))))
        return F.aggregate(gap, F.lit(0), lambda a, b: a + b)

    return _with(pairs, lambda p: _with(starts(p), total))


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", ""))


COUNTS = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
          "n_lines": lambda t: F.size(_lines_with_word(t)), "letters": _letters}


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Counts:
    """What rules read: each name of ``COUNTS`` as a column of the table if it is among ``known``, else computed from the text."""

    def __init__(self, text: Column, known: tuple[str, ...] = ()):
        self.text, self.known = text, known

    def __getattr__(self, name: str) -> Column:
        if name not in COUNTS:
            raise AttributeError(name)
        return F.col(name) if name in self.known else COUNTS[name](self.text)


RULES = (
    Rule("few_words", lambda c: c.n_words < 20, base=True),
    Rule("repeated_words", lambda c: 100 * c.n_repeat_words > 30 * c.n_words, base=True),
    Rule("word_length", lambda c: (c.word_chars < 2 * c.n_words) | (c.word_chars > 15 * c.n_words)),
    Rule("symbols", lambda c: 10 * c.n_symbols > c.n_words),
    Rule("repeated_lines", lambda c: 100 * c.n_dup_lines > 30 * c.n_lines),
    Rule("few_letters", lambda c: 2 * c.letters < c.word_chars),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def order_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Rules with their cost and selectivity on a sample of about ``sample_rows`` rows, best first.

    The sample only sets the order.  It is written once, so the table is read once
    for it however many rules there are; each rule then runs ``TIMINGS`` times over
    the written rows, and its fastest run counts.  An empty table keeps the given
    order.
    """
    spark = docs.sparkSession
    total = docs.count()
    if not total:
        return [Measured(rule, 0.0, 0.0) for rule in rules]
    path = shared_dir(spark, "quality-sample")
    drawn = docs.select(F.col(text_col).alias("text")).sample(min(1.0, sample_rows / total), seed=7)
    drawn.repartition(SAMPLE_FILES).write.parquet(path)
    sample = spark.read.schema("text string").parquet(path)

    def run(condition: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(TIMINGS):
            start = time.perf_counter()
            share = sample.agg(F.avg(condition.cast("double"))).first()[0] or 0.0
            best = min(best, time.perf_counter() - start)
        return best, share

    idle, _ = run(F.length("text") < 0)
    measured = []
    for rule in rules:
        seconds, rejected = run(F.coalesce(rule.reject(Counts(F.col("text"))), F.lit(False)))
        measured.append(Measured(rule, max(seconds - idle, 1e-3), rejected))
    return sorted(measured, key=lambda m: -m.gain)


def cascade(text: Column, measured: list[Measured], known: tuple[str, ...] = ()) -> Column:
    """Name of the first rule that rejects the text, null if none does; counts in ``known`` are read from columns of that name."""
    counts = Counts(text, known)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for m in measured:
        chain = chain.when(m.rule.reject(counts), F.lit(m.rule.name))
    return chain.otherwise(F.lit(None).cast("string"))


def quality_filter(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects."""
    return docs.where(cascade(F.col(text_col), order_rules(docs, text_col, sample_rows=sample_rows)).isNull())


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every text, the verdict of the fixed rules, and that of the whole cascade.

    The counts are reported for every row, so all rules read them there; the
    cascade then runs only its further rules, on the rows that are left, and
    computes from the text only what is not reported.
    """
    measured = [m for m in order_rules(docs, text_col) if not m.rule.base]
    text = F.col("text")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = named.select("doc_id", "text", *[COUNTS[name](text).alias(name) for name in REPORTED])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = F.when(failed, F.lit(False)).otherwise(cascade(text, measured, REPORTED).isNull())
    return counted.select("doc_id", *REPORTED, failed.alias("base_failed"), verdict.alias("kept"))
