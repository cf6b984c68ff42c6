"""Score, level and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.fixed_values import LEVEL_CUTS, LEVELS, THREAT_LABELS, THREAT_TOKENS

TIE = 1e-9


def round_tie_up(value: Column, digits: int = 4) -> Column:
    """Round a computed mean; the tiny offset keeps exact ties on one side in every engine."""
    return F.round(value + F.lit(TIE), digits)


def normalize_score(raw: Column) -> Column:
    """Any raw score to 0..1: percentages are scaled, bad values become 0, the rest is clamped."""
    number = raw.try_cast("double")
    return (
        F.when(number.isNull() | F.isnan(number) | (number < 0.0), F.lit(0.0))
        .when(number > 100.0, F.lit(1.0))
        .when(number > 1.0, F.round(number / 100.0, 4))
        .otherwise(F.round(number, 4) + F.lit(0.0))
    )


def level_of(score: Column) -> Column:
    expr = None
    for name, cut in LEVEL_CUTS:
        expr = F.when(score >= cut, name) if expr is None else expr.when(score >= cut, name)
    return expr.otherwise("low")


def normalize_level(level: Column) -> Column:
    lowered = F.lower(level)
    return F.when(lowered.isin(*LEVELS), lowered).otherwise(F.lit("low"))


def is_threat_label(label: Column, exact=THREAT_LABELS, tokens=THREAT_TOKENS) -> Column:
    lowered = F.lower(label)
    return lowered.isin(*exact) | lowered.rlike("|".join(tokens))


def threat_from_labels(scores: Column) -> Column:
    """Largest score among threat labels, 0 when there is none."""
    kept = F.map_values(F.map_filter(scores, lambda k, _: is_threat_label(k)))
    return F.coalesce(F.array_max(kept), F.lit(0.0))


def model_scores_or_fallback(own: Column, per_model: Column, model: Column, score: Column) -> Column:
    """Own model map, else the detail map, else one entry for the named model, else null."""

    def numeric(m: Column) -> Column:
        kept = F.map_filter(F.transform_values(m, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)

    number = score.try_cast("double")
    single = F.when((F.length(model) > 0) & number.isNotNull(), F.create_map(model, number))
    return F.coalesce(numeric(own), numeric(per_model), single)


def ensemble_mean(scores: Column, weights: dict[str, float] | None = None) -> Column:
    """Unrounded mean over the models that ran; equal weights unless a map is given."""
    if weights:
        w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        weighted = F.transform_values(scores, lambda k, v: v * F.coalesce(F.get(F.array(w[k]), F.lit(0)), F.lit(0.0)))
        mass = F.transform_values(scores, lambda k, v: F.coalesce(w[k], F.lit(0.0)))
        total = F.aggregate(F.map_values(mass), F.lit(0.0), lambda a, x: a + x)
    else:
        weighted = scores
        total = F.size(scores).cast("double")
    summed = F.aggregate(F.map_values(weighted), F.lit(0.0), lambda a, x: a + x)
    return summed / F.nullif(total, F.lit(0.0))


def percent_text(score: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(score * 100 + TIE, digits)), F.lit("%"))


def summary_text(level: Column, score: Column, top_label: Column) -> Column:
    base = F.concat(
        F.lit("Threat level: "), F.upper(level),
        F.lit(" (score: "), F.format_string("%.2f", F.round(score + TIE, 2)), F.lit("). Top label: "),
        F.coalesce(F.when(F.length(top_label) > 0, top_label), F.lit("n/a")), F.lit("."),
    )
    return F.when(level.isin("high", "critical"), F.concat(base, F.lit(" Recommended: human review before action."))).otherwise(base)


def report_subject(level: Column, score: Column) -> Column:
    return F.concat(F.lit("Scan report - "), F.upper(F.coalesce(level, F.lit("low"))), F.lit(" threat ("), percent_text(score), F.lit(")"))


def report_body(user: Column, kind: Column, source: Column, level: Column, score: Column, summary: Column, keywords: Column, model: Column) -> Column:
    """Plain text of a scan report; the model line is left out when there is no model name."""
    lines = [
        F.concat(F.lit("Hello "), user, F.lit(",\n")),
        F.concat(F.lit("Your "), kind, F.lit(" scan has completed.\n")),
        F.concat(F.lit("Source: "), source),
        F.concat(F.lit("Threat level: "), F.upper(F.coalesce(level, F.lit("low")))),
        F.concat(F.lit("Threat score: "), percent_text(F.coalesce(score, F.lit(0.0)))),
        F.when(F.length(model) > 0, F.concat(F.lit("Model: "), model)),
        F.concat(F.lit("\nSummary:\n"), F.coalesce(summary, F.lit("—")), F.lit("\n")),
        F.concat(F.lit("Top keywords: "), report_keywords(keywords)),
    ]
    return F.concat_ws("\n", *lines)


def report_keywords(keywords: Column, k: int = 10) -> Column:
    return F.when(F.size(keywords) > 0, F.array_join(F.slice(keywords, 1, k), ", ")).otherwise(F.lit("—"))
