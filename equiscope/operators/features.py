"""Row-level feature derivation, normalisation and validation.

Everything here is a projection: narrow, codegen'd, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rnd, col, cut, dlit, in_flag, js_round, log1p_guarded, map_values
from ..roles import (COMPANY_SIZE_ORDINAL, COMPANY_SIZES, DEFAULT_EMPLOYMENT_TYPE,
                     DEFAULT_INTERVIEW_SCORE, EDUCATION_ORDINAL, EMPLOYMENT_TYPES,
                     EXP_BUCKET_EDGES, EXP_BUCKET_LABELS, FALLBACK_CONFIDENCE, FALLBACK_RMSE,
                     FALLBACK_Z, HIGH_COST_LOCATIONS, LEVEL_TO_SERVICE_EDUCATION,
                     PREVIOUS_SALARY_BASE, PREVIOUS_SALARY_FLOOR, PREVIOUS_SALARY_PER_YEAR,
                     PROFILE_INDUSTRY, PROFILE_SOURCE_SEED, SERVICE_EDUCATION_TO_LEVEL,
                     SERVICE_EDUCATIONS, FeatureRoles)


# ---------------------------------------------------------------- P1 / P2
def select_features(df: DataFrame, roles: FeatureRoles, extra: Sequence[str] = ()) -> DataFrame:
    """Model features only; protected columns can never be selected as features."""
    bad = set(extra) & set(roles.protected)
    if bad:
        raise ValueError(f"protected columns may not be features: {sorted(bad)}")
    return df.select(*roles.features, *extra)


def split_features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


# ------------------------------------------------------------- P3-P7, P12
def engineer(df: DataFrame, interactions: bool = True,
             education_ordinal: Mapping[str, int] = EDUCATION_ORDINAL,
             company_size_ordinal: Mapping[str, int] = COMPANY_SIZE_ORDINAL,
             high_cost_locations: Sequence[str] = HIGH_COST_LOCATIONS) -> DataFrame:
    """All engineered features in the reference's order (interactions optional)."""
    out = (df.withColumn("exp_bucket", cut("years_experience", EXP_BUCKET_EDGES, EXP_BUCKET_LABELS))
             .withColumn("log_experience", log1p_guarded("years_experience"))
             .withColumn("education_ordinal", map_values("education_level", education_ordinal))
             .withColumn("high_col_location", in_flag("location", high_cost_locations))
             .withColumn("company_size_ordinal", map_values("company_size", company_size_ordinal)))
    if interactions:
        out = (out.withColumn("exp_x_edu", F.col("years_experience") * F.col("education_ordinal"))
                  .withColumn("exp_x_skills", F.col("years_experience") * F.col("skills_count")))
    return out


# ----------------------------------------------------------------------- P8
def normalize_request(df: DataFrame) -> DataFrame:
    """Service request rows → model feature rows.

    education mapped to the 4-value vocabulary (unknown passes through),
    skills_count = size(skills) (a non-array / NULL list counts as 0 here),
    experience NULL → 0, previous salary default max(30000, 40000+12000·exp),
    interview score default 7.0.
    """
    exp = F.coalesce(F.col("experience_years").cast("double"), dlit(0.0))
    prev_default = F.greatest(dlit(PREVIOUS_SALARY_FLOOR),
                              dlit(PREVIOUS_SALARY_BASE) + exp * dlit(PREVIOUS_SALARY_PER_YEAR))
    return df.select(
        exp.alias("years_experience"),
        F.coalesce(F.size(F.col("skills")), F.lit(0)).cast("double").alias("skills_count"),
        F.coalesce(F.col("previous_salary").cast("double"), prev_default).alias("previous_salary"),
        F.coalesce(F.col("interview_score").cast("double"), dlit(DEFAULT_INTERVIEW_SCORE)).alias("interview_score"),
        map_values(F.coalesce(F.col("education"), F.lit("")), SERVICE_EDUCATION_TO_LEVEL,
                   passthrough=True).alias("education_level"),
        F.coalesce(F.col("job_role"), F.lit("")).alias("job_role"),
        F.coalesce(F.col("location"), F.lit("")).alias("location"),
        F.coalesce(F.col("company_size"), F.lit("")).alias("company_size"),
    )


# ----------------------------------------------------------------------- P9
def skill_array(n: Column) -> Column:
    """['skill0', …, 'skill{n-1}'], empty for n ≤ 0 or NULL."""
    k = F.coalesce(n, F.lit(0))
    return F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1),
                                     lambda i: F.concat(F.lit("skill"), i.cast("string")))) \
            .otherwise(F.array().cast("array<string>"))


def normalize_profile(df: DataFrame, source: str = PROFILE_SOURCE_SEED) -> DataFrame:
    """Raw candidate rows → profile-table rows (reverse education map, skills
    array from the count, fixed industry/employment type, truncating int casts)."""
    return df.select(
        F.col("years_experience").cast("double").alias("experience_years"),
        map_values("education_level", LEVEL_TO_SERVICE_EDUCATION, passthrough=True).alias("education"),
        "job_role", "location",
        skill_array(F.col("skills_count").cast("double").cast("int")).alias("skills"),
        F.lit(PROFILE_INDUSTRY).alias("industry"),
        "company_size",
        F.lit(DEFAULT_EMPLOYMENT_TYPE).alias("employment_type"),
        F.col("salary").cast("double").cast("int").alias("salary"),
        "gender",
        F.col("age").cast("double").cast("int").alias("age"),
        F.lit(source).alias("source"),
    )


# ---------------------------------------------------------------------- P10
@dataclass(frozen=True)
class Rule:
    name: str
    ok: Column  # TRUE when the row passes; NULL counts as a violation unless nullable


def request_rules(vocab_check: bool = True) -> list[Rule]:
    """The request schema's rules (ranges, lengths, list sizes, vocabularies)."""
    def strlen(c):
        return F.length(F.col(c)).between(1, 100)
    rules = [
        Rule("experience_years_range", F.col("experience_years").between(0, 50)),
        Rule("job_role_length", strlen("job_role")),
        Rule("location_length", strlen("location")),
        Rule("industry_length", strlen("industry")),
        Rule("skills_count", F.size(F.col("skills")).between(1, 50)),
        Rule("previous_salary_min", F.col("previous_salary").isNull() | (F.col("previous_salary") >= 0)),
        Rule("interview_score_range", F.col("interview_score").isNull()
             | F.col("interview_score").between(0, 10)),
        Rule("education_present", F.col("education").isNotNull()),
        Rule("company_size_present", F.col("company_size").isNotNull()),
    ]
    if vocab_check:
        rules += [
            Rule("education_vocab", F.col("education").isin(list(SERVICE_EDUCATIONS))),
            Rule("company_size_vocab", F.col("company_size").isin(list(COMPANY_SIZES))),
            Rule("employment_type_vocab",
                 F.coalesce(F.col("employment_type"), F.lit(DEFAULT_EMPLOYMENT_TYPE))
                  .isin(list(EMPLOYMENT_TYPES))),
        ]
    return rules


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``violations array<string>`` (names of failed rules, in rule order)
    and defaults ``employment_type``; callers split on ``size(violations) = 0``."""
    checks = [F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules]
    out = df.withColumn("violations", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    if "employment_type" in df.columns:
        out = out.withColumn("employment_type",
                             F.coalesce(F.col("employment_type"), F.lit(DEFAULT_EMPLOYMENT_TYPE)))
    return out


# ---------------------------------------------------------------------- P11
def parse_skill_list(c: str | Column) -> Column:
    """'a, b,,c ' → ['a','b','c']: split on commas, trim, drop empties."""
    return F.filter(F.transform(F.split(col(c), ","), lambda x: F.trim(x)), lambda x: x != "")


# ---------------------------------------------------------------- P13 / P14
def with_interval(df: DataFrame, p: str, q_hat: float | Column | None = None,
                  alpha: float = 0.1, clamp: bool = True, rmse: float = FALLBACK_RMSE,
                  z: float = FALLBACK_Z, fallback_confidence: float = FALLBACK_CONFIDENCE,
                  lo: str = "min_salary", hi: str = "max_salary") -> DataFrame:
    """Prediction interval p ± q_hat (confidence 1-α), lower bound clamped at 0
    when serving; without a quantile, p ± z·rmse with the fallback confidence."""
    if q_hat is None:
        half, conf = dlit(z * rmse), dlit(fallback_confidence)
    else:
        half = q_hat if isinstance(q_hat, Column) else dlit(q_hat)
        conf = dlit(1.0 - alpha)
    low = F.col(p) - half
    if clamp:
        low = F.greatest(dlit(0.0), low)
    return (df.withColumn(lo, low).withColumn(hi, F.col(p) + half)
              .withColumn("confidence", conf))


def round_amount(c: str | Column, digits: int = 0) -> Column:
    """Half-even rounding of an amount (Python ``round``), e.g. digits=-3 for thousands."""
    return F.bround(col(c), digits)


# ---------------------------------------------------------------------- P18
def residual_columns(df: DataFrame, y: str, p: str, lo: str | None = None,
                     hi: str | None = None) -> DataFrame:
    out = df.withColumn("residual", F.col(y) - F.col(p)) \
            .withColumn("abs_error", F.abs(F.col(y) - F.col(p)))
    if lo and hi:
        out = out.withColumn("covered", F.col(y).between(F.col(lo), F.col(hi))) \
                 .withColumn("interval_width", F.col(hi) - F.col(lo))
    return out


# ---------------------------------------------------------------------- P19
def compact_amount(c: str | Column) -> Column:
    """≥1e7 → '₹x.y Cr', ≥1e5 → '₹x.y L', else grouped integer ('₹' + #,###).

    ``toFixed(1)`` rounds half away from zero on the decimal expansion; Spark's
    ``format_number`` is half-even, so the value is rounded with ``round`` first.
    """
    x = col(c)
    return (F.when(x >= dlit(1e7), F.concat(F.lit("₹"), F.format_number(rnd(x / dlit(1e7), 1), 1), F.lit(" Cr")))
             .when(x >= dlit(1e5), F.concat(F.lit("₹"), F.format_number(rnd(x / dlit(1e5), 1), 1), F.lit(" L")))
             .otherwise(F.concat(F.lit("₹"), F.format_number(rnd(x, 0), 0))))


def truncate_label(c: str | Column, n: int = 25) -> Column:
    x = col(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


# ---------------------------------------------------------------------- P20
def direction(c: str | Column) -> Column:
    return F.when(col(c) > 0, F.lit("positive")).otherwise(F.lit("negative"))


def percent_label(c: str | Column) -> Column:
    """``Math.round(conf*100) + '%'``."""
    return F.concat(js_round(col(c) * dlit(100.0)).cast("bigint").cast("string"), F.lit("%"))
