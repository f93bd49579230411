"""Explainable loan scorecard as column expressions.

Four factors add points (0 is best). Each factor is a table of bands read top down; the
first band whose test holds gives the points and the note.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.schemas import RISK_MODEL_VERSION

# ---- fixed values: score thresholds of the recommendation ----
APPROVE_MAX = 35
DECLINE_MIN = 65
AUTO_APPROVE_MAX = 20
MAX_PRINCIPAL_REASONS = 4


def number_text(value: Column) -> Column:
    """A double of at most three decimals as shortest text with at least one decimal."""
    return F.regexp_replace(value.cast("decimal(38,3)").cast("string"), r"(\.[0-9]+?)0+$", "$1")


@dataclass(frozen=True)
class Factor:
    code: str
    label: str
    text: Column
    max_points: int
    bands: tuple  # (test or None, points, note as text or Column), read top down

    def pick(self, index: int) -> Column:
        picked = None
        for band in reversed(self.bands):
            result = band[index] if isinstance(band[index], Column) else F.lit(band[index])
            picked = result if band[0] is None else F.when(band[0], result).otherwise(picked)
        return picked


def _noted(words: str, text: Column) -> Column:
    return F.concat(F.lit(f"{words} ("), text, F.lit(")"))


def _factors() -> tuple[Factor, ...]:
    """The four factors over the columns ``score_loans`` prepares, in scorecard order."""
    score, dti, events, size = (F.col(f"_{name}") for name in ("score", "dti", "events", "size"))
    score_text, dti_text, events_text, size_text = (
        F.col(f"_{name}_text") for name in ("score", "dti", "events", "size")
    )
    # ---- fixed values: bands, points and notes of each factor ----
    return (
        Factor("CREDIT", "Credit score", score_text, 40, (
            (score >= 760, 0, _noted("excellent credit", score_text)),
            (score >= 700, 10, _noted("good credit", score_text)),
            (score >= 640, 22, _noted("fair credit", score_text)),
            (None, 40, _noted("poor credit", score_text)),
        )),
        Factor("DTI", "Debt-to-income", dti_text, 30, (
            (dti <= 0.28, 0, _noted("healthy DTI", dti_text)),
            (dti <= 0.43, 15, _noted("elevated DTI", dti_text)),
            (None, 30, _noted("high DTI", dti_text)),
        )),
        Factor("OVERDRAFT", "Overdraft history", events_text, 20, (
            (events == 0, 0, "no overdraft history"),
            (events <= 2, 10, F.concat(events_text, F.lit(" overdraft event(s)"))),
            (None, 20, _noted("frequent overdrafts", events_text)),
        )),
        Factor("LOAN_SIZE", "Loan amount", size_text, 10, (
            (size > 50_000, 10, "large loan amount"),
            (size > 20_000, 5, "moderate loan amount"),
            (None, 0, "modest loan amount"),
        )),
    )


def dti_ratio(annual_income: Column, existing_debt: Column, amount: Column, term_months: Column) -> Column:
    """Monthly debt with the new loan over monthly income, to three decimals."""
    debt = existing_debt.cast("double") / 12.0
    new_debt = amount.cast("double") / F.greatest(term_months, F.lit(1))
    income = F.greatest(annual_income.cast("double") / 12.0, F.lit(1.0))
    return F.round((debt + new_debt) / income, 3)


def recommendation(risk_score: Column) -> Column:
    return (
        F.when(risk_score <= APPROVE_MAX, "APPROVE")
        .when(risk_score >= DECLINE_MIN, "DECLINE")
        .otherwise("REVIEW")
    )


def score_loans(loans: DataFrame) -> DataFrame:
    """Add factors, score, recommendation, reasons and principal reasons to each loan.

    Needs ``credit_score``, ``dti_ratio``, ``overdraft_events`` and ``amount``. The steps are
    separate projections of plain expressions, so they compile into one loop.
    """
    score, dti = F.col("credit_score").cast("long"), F.col("dti_ratio").cast("double")
    events, size = F.col("overdraft_events").cast("long"), F.col("amount").cast("double")
    inputs = {
        "_score": score,
        "_score_text": score.cast("string"),
        "_dti": dti,
        "_dti_text": number_text(dti),
        "_events": events,
        "_events_text": events.cast("string"),
        "_size": size,
        "_size_text": number_text(size),
    }
    table = _factors()
    picked = loans.withColumns(inputs).withColumns(
        {f"_points{i}": f.pick(1) for i, f in enumerate(table)}
        | {f"_note{i}": f.pick(2) for i, f in enumerate(table)}
    )
    points = [F.col(f"_points{i}") for i in range(len(table))]
    notes = [F.col(f"_note{i}") for i in range(len(table))]
    factor_structs = [
        F.struct(
            F.lit(f.code).alias("code"),
            F.lit(f.label).alias("label"),
            f.text.alias("value"),
            p.alias("points"),
            F.lit(f.max_points).alias("max_points"),
            note.alias("note"),
            F.when(p > 0, "increases risk").otherwise("favorable").alias("impact"),
        )
        for f, p, note in zip(table, points, notes, strict=True)
    ]
    # Highest points first, ties in scorecard order; factors without points sort last as nulls.
    ranked = F.sort_array(
        F.array(
            *[
                F.when(
                    p > 0,
                    F.struct(p.alias("p"), F.lit(-i).alias("place"), F.concat(F.lit(f"{f.code}: "), note).alias("text")),
                )
                for i, (f, p, note) in enumerate(zip(table, points, notes, strict=True))
            ]
        ),
        asc=False,
    )
    raising = sum(((p > 0).cast("int") for p in points), F.lit(0))
    total = sum(points, F.lit(0))
    return (
        picked.withColumns(
            {
                "factors": F.array(*factor_structs),
                "risk_score": F.least(F.lit(100), F.greatest(F.lit(0), total)).cast("long"),
                "reasons": F.array(*notes),
                "principal_reasons": F.slice(ranked, 1, F.least(raising, F.lit(MAX_PRINCIPAL_REASONS)))["text"],
                "model_version": F.lit(RISK_MODEL_VERSION),
            }
        )
        .withColumn("recommendation", recommendation(F.col("risk_score")))
        .drop(*inputs, *[f"_points{i}" for i in range(len(table))], *[f"_note{i}" for i in range(len(table))])
    )


def assessment_rows(scored: DataFrame) -> DataFrame:
    """Scored loans with reasons and factors as the JSON text the history table keeps."""
    return scored.withColumn("reasons", F.to_json("reasons")).withColumn("factors", F.to_json("factors"))
