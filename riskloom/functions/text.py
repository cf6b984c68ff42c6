"""Text expressions: cleaning, splitting, counting."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.fixed_values import LANGUAGE_WORDS, TOP_KEYWORDS
from riskloom.functions.arrays import let, ranked_terms

# Every character that counts as white space, ASCII controls included.
WS = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
NON_WORD = r"[^\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(strip(text)) == 0)


def clean_text(text: Column) -> Column:
    kept = F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{WS}.,!?;:'-]", " ")
    return strip(F.regexp_replace(kept, f"[{WS}]+", " "))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), NON_WORD), lambda t: t != "")


def sentences(text: Column) -> Column:
    parts = F.split(text, rf"(?<=[.!?])[{WS}]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def truncate(text: Column, limit: int) -> Column:
    """Cut at the last blank before ``limit`` and mark the cut."""
    head = F.substring(text, 1, limit)
    last_blank = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    shortened = F.when(
        (F.locate(" ", F.reverse(head)) > 0) & (last_blank > 1), F.substring(head, F.lit(1), last_blank - 1)
    ).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(shortened, F.lit("...")))


def snippet(text: Column, limit: int = 80) -> Column:
    flat = F.regexp_replace(strip(text), "\n", " ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def keyword_tokens(text: Column) -> Column:
    """Tokens made of four or more ASCII letters."""
    return F.filter(tokens(text), lambda t: t.rlike("^[a-z]{4,}$"))


def top_keywords(text: Column, k: int = TOP_KEYWORDS) -> Column:
    return ranked_terms(keyword_tokens(text), k)


def _accent_table() -> tuple[str, str]:
    """Letters that decompose to one base letter, derived from Unicode, then combining marks to drop."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code):
            source.append(chr(code))
            target.append(base[0])
    marks = [chr(code) for code in range(0x300, 0x370) if unicodedata.combining(chr(code))]
    return "".join(source + marks), "".join(target)


ACCENTS = _accent_table()


def strip_accents(text: Column) -> Column:
    return F.translate(text, *ACCENTS)


def vector_tokens(text: Column, accents: bool = True) -> Column:
    """Tokens of at least two word characters, as a bag-of-words vectoriser sees them."""
    base = strip_accents(F.lower(text)) if accents else F.lower(text)
    return F.filter(F.split(base, NON_WORD), lambda t: F.length(t) >= 2)


def message_features(text: Column, w: Column) -> list[Column]:
    """Length, word, capital and vocabulary features of one message; ``w`` holds its words."""
    caps = F.exists(w, lambda x: (F.length(x) > 1) & x.rlike(r"\p{Lu}") & ~x.rlike(r"[\p{Ll}\p{Lt}]"))
    letters = F.length(F.array_join(w, "")).cast("long")
    kinds = F.size(F.array_distinct(F.transform(w, lambda x: F.lower(x))))
    return [
        F.length(text).cast("long").alias("msg_len"),
        F.size(w).cast("long").alias("word_count"),
        (letters / F.nullif(F.size(w), F.lit(0))).alias("avg_word_len"),
        text.contains("!").cast("long").alias("has_exclamation"),
        caps.cast("long").alias("has_caps_word"),
        (kinds / F.greatest(F.size(w), F.lit(1))).alias("unique_word_ratio"),
    ]


def punctuation_counts(text: Column) -> list[Column]:
    marks = {"exclamation_count": "!", "question_count": "?", "period_count": ".", "comma_count": ","}
    return [
        (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("long").alias(name)
        for name, mark in marks.items()
    ]


def language_hits(text: Column, profiles: dict[str, list[str]] | None = None) -> Column:
    """``array<struct<neg_hits, lang>>`` of function-word hits, best first."""
    profiles = profiles or LANGUAGE_WORDS

    def hits(ts: Column, lang: str) -> Column:
        found = F.filter(ts, lambda t: t.isin(profiles[lang]))
        return F.struct((-F.size(found)).alias("neg_hits"), F.lit(lang).alias("lang"))

    return let(tokens(text), lambda ts: F.sort_array(F.array(*[hits(ts, lang) for lang in profiles])))


def detect_language(text: Column, profiles: dict[str, list[str]] | None = None) -> Column:
    best = F.get(language_hits(text, profiles), F.lit(0))
    return F.when(best["neg_hits"] < 0, best["lang"]).otherwise(F.lit("unknown"))


def highlight(text: Column, keywords: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Mark every case-insensitive occurrence of any keyword; earlier keywords win at one position."""
    escaped = F.transform(keywords, lambda k: F.regexp_replace(k, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    pattern = F.concat(F.lit("(?iu)("), F.array_join(escaped, "|"), F.lit(")"))
    return F.when(F.size(keywords) > 0, F.regexp_replace(text, pattern, F.lit(f"{before}$1{after}"))).otherwise(text)


def split_list(text: Column) -> Column:
    """Comma separated entries, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")
