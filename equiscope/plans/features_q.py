"""Registered queries: projections, derived columns, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import map_values, round_doubles
from ..operators import features as FE
from ..roles import LEVEL_TO_SERVICE_EDUCATION, FixtureVocab
from ..sources.tables import cand, table, with_cand
from .registry import register

VOCAB = FixtureVocab()

ENGINEER_SQL = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN years_experience > -1 AND years_experience <= 0 THEN '0'
            WHEN years_experience > 0 AND years_experience <= 2 THEN '0-2'
            WHEN years_experience > 2 AND years_experience <= 5 THEN '2-5'
            WHEN years_experience > 5 AND years_experience <= 10 THEN '5-10'
            WHEN years_experience > 10 AND years_experience <= 15 THEN '10-15'
            WHEN years_experience > 15 AND years_experience <= 30 THEN '15+' END AS exp_bucket,
       round(CASE WHEN years_experience > -1 THEN ln(1 + years_experience) END, 4) AS log_experience,
       CASE education_level WHEN 'High School' THEN 0 WHEN 'Bachelor' THEN 1
            WHEN 'Master' THEN 2 WHEN 'PhD' THEN 3 END AS education_ordinal,
       CASE WHEN location IN ('AMERICA', 'EUROPE') THEN 1 ELSE 0 END AS high_col_location,
       CASE company_size WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
            WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 3 END AS company_size_ordinal,
       round(years_experience * CASE education_level WHEN 'High School' THEN 0 WHEN 'Bachelor' THEN 1
            WHEN 'Master' THEN 2 WHEN 'PhD' THEN 3 END, 4) AS exp_x_edu,
       round(years_experience * skills_count, 4) AS exp_x_skills
FROM cand"""


@register("engineered_features", with_cand(ENGINEER_SQL), ops=("P3", "P4", "P5", "P6", "P7", "P12"))
def engineered_features(spark, sf):
    df = FE.engineer(cand(spark, sf), company_size_ordinal=VOCAB.company_size_ordinal,
                     high_cost_locations=VOCAB.high_cost_locations)
    return round_doubles(df.select("l_orderkey", "l_linenumber", "exp_bucket", "log_experience",
                                   "education_ordinal", "high_col_location", "company_size_ordinal",
                                   "exp_x_edu", "exp_x_skills"))


@register("feature_selection", with_cand("""
SELECT job_role, count(*) AS n, round(avg(years_experience), 4) AS years_experience,
       round(avg(skills_count), 4) AS skills_count, round(avg(previous_salary), 4) AS previous_salary,
       round(avg(interview_score), 4) AS interview_score,
       count(DISTINCT education_level) AS education_levels, count(DISTINCT location) AS locations,
       count(DISTINCT company_size) AS company_sizes
FROM cand GROUP BY job_role"""), ops=("P1", "P2"))
def feature_selection(spark, sf):
    from ..roles import CANDIDATE_ROLES
    x, _y = FE.split_features_target(
        FE.select_features(cand(spark, sf), CANDIDATE_ROLES, extra=("salary",)), "salary")
    return round_doubles(x.groupBy("job_role").agg(
        F.count(F.lit(1)).alias("n"), F.avg("years_experience").alias("years_experience"),
        F.avg("skills_count").alias("skills_count"), F.avg("previous_salary").alias("previous_salary"),
        F.avg("interview_score").alias("interview_score"),
        F.countDistinct("education_level").alias("education_levels"),
        F.countDistinct("location").alias("locations"),
        F.countDistinct("company_size").alias("company_sizes")))


# --- request fixture: service-shaped rows derived from every candidate row ---
FIXTURE_COMPANY = {"AUTOMOBILE": "Startup (1-50)", "BUILDING": "Small (51-200)",
                   "FURNITURE": "Medium (201-1000)", "MACHINERY": "Large (1000+)"}


def requests(spark, sf):
    c = cand(spark, sf)
    return c.select(
        "l_orderkey", "l_linenumber",
        (F.col("years_experience") * 2.0 - 5.0).alias("experience_years"),
        map_values("education_level", LEVEL_TO_SERVICE_EDUCATION, passthrough=True).alias("education"),
        "job_role", "location",
        FE.skill_array(F.col("skills_count") - 1).alias("skills"),
        F.lit("Technology").alias("industry"),
        map_values("company_size", FIXTURE_COMPANY, passthrough=True).alias("company_size"),
        F.when(F.col("l_linenumber") == 2, F.lit(None).cast("string"))
         .otherwise(F.lit("Full-time")).alias("employment_type"),
        "previous_salary",
        F.when(F.col("l_linenumber") == 3, F.lit(None).cast("double"))
         .otherwise((F.col("interview_score") - 1.0) * 1.2).alias("interview_score"))


REQUESTS_CTE = """req AS (
  SELECT l_orderkey, l_linenumber, years_experience * 2.0 - 5.0 AS experience_years,
         CASE education_level WHEN 'High School' THEN 'High School' WHEN 'Bachelor' THEN 'Bachelor''s Degree'
              WHEN 'Master' THEN 'Master''s Degree' WHEN 'PhD' THEN 'PhD'
              WHEN 'Associate' THEN 'Associate Degree' ELSE education_level END AS education,
         job_role, location,
         CASE WHEN skills_count - 1 > 0 THEN list_transform(range(0, skills_count - 1), lambda i: 'skill' || CAST(i AS VARCHAR))
              ELSE []::VARCHAR[] END AS skills,
         'Technology' AS industry,
         CASE company_size WHEN 'AUTOMOBILE' THEN 'Startup (1-50)' WHEN 'BUILDING' THEN 'Small (51-200)'
              WHEN 'FURNITURE' THEN 'Medium (201-1000)' WHEN 'MACHINERY' THEN 'Large (1000+)'
              ELSE company_size END AS company_size,
         CASE WHEN l_linenumber = 2 THEN NULL ELSE 'Full-time' END AS employment_type,
         previous_salary,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE (interview_score - 1.0) * 1.2 END AS interview_score
  FROM cand)"""


@register("normalize_request", with_cand("""
SELECT round(coalesce(experience_years, 0.0), 4) AS years_experience,
       CAST(coalesce(len(skills), 0) AS DOUBLE) AS skills_count,
       round(coalesce(previous_salary, greatest(30000.0, 40000.0 + coalesce(experience_years, 0.0) * 12000.0)), 4)
         AS previous_salary,
       round(coalesce(interview_score, 7.0), 4) AS interview_score,
       CASE education WHEN 'High School' THEN 'High School' WHEN 'Associate Degree' THEN 'Bachelor'
            WHEN 'Bachelor''s Degree' THEN 'Bachelor' WHEN 'Master''s Degree' THEN 'Master'
            WHEN 'PhD' THEN 'PhD' ELSE coalesce(education, '') END AS education_level,
       job_role, location, company_size
FROM req""", REQUESTS_CTE), ops=("P8",))
def normalize_request(spark, sf):
    return round_doubles(FE.normalize_request(requests(spark, sf)))


@register("validate_requests", with_cand("""
SELECT l_orderkey, l_linenumber,
       list_filter([
         CASE WHEN NOT coalesce(experience_years BETWEEN 0 AND 50, false) THEN 'experience_years_range' END,
         CASE WHEN NOT coalesce(length(job_role) BETWEEN 1 AND 100, false) THEN 'job_role_length' END,
         CASE WHEN NOT coalesce(length(location) BETWEEN 1 AND 100, false) THEN 'location_length' END,
         CASE WHEN NOT coalesce(length(industry) BETWEEN 1 AND 100, false) THEN 'industry_length' END,
         CASE WHEN NOT coalesce(len(skills) BETWEEN 1 AND 50, false) THEN 'skills_count' END,
         CASE WHEN NOT coalesce(previous_salary IS NULL OR previous_salary >= 0, false) THEN 'previous_salary_min' END,
         CASE WHEN NOT coalesce(interview_score IS NULL OR interview_score BETWEEN 0 AND 10, false) THEN 'interview_score_range' END,
         CASE WHEN education IS NULL THEN 'education_present' END,
         CASE WHEN company_size IS NULL THEN 'company_size_present' END,
         CASE WHEN NOT coalesce(education IN ('High School', 'Associate Degree', 'Bachelor''s Degree', 'Master''s Degree', 'PhD'), false) THEN 'education_vocab' END,
         CASE WHEN NOT coalesce(company_size IN ('Startup (1-50)', 'Small (51-200)', 'Medium (201-1000)', 'Large (1000+)'), false) THEN 'company_size_vocab' END,
         CASE WHEN NOT coalesce(coalesce(employment_type, 'Full-time') IN ('Full-time', 'Part-time', 'Contract', 'Internship', 'Freelance'), false) THEN 'employment_type_vocab' END
       ], lambda x: x IS NOT NULL) AS violations,
       coalesce(employment_type, 'Full-time') AS employment_type
FROM req""", REQUESTS_CTE), ops=("P10",))
def validate_requests(spark, sf):
    v = FE.validate(requests(spark, sf), FE.request_rules())
    return v.select("l_orderkey", "l_linenumber", "violations", "employment_type")


@register("normalize_profile", with_cand("""
SELECT round(years_experience, 4) AS experience_years,
       CASE education_level WHEN 'High School' THEN 'High School' WHEN 'Bachelor' THEN 'Bachelor''s Degree'
            WHEN 'Master' THEN 'Master''s Degree' WHEN 'PhD' THEN 'PhD'
            WHEN 'Associate' THEN 'Associate Degree' ELSE education_level END AS education,
       job_role, location,
       CASE WHEN CAST(trunc(CAST(skills_count AS DOUBLE)) AS INTEGER) > 0
            THEN list_transform(range(0, CAST(trunc(CAST(skills_count AS DOUBLE)) AS INTEGER)), lambda i: 'skill' || CAST(i AS VARCHAR))
            ELSE []::VARCHAR[] END AS skills,
       'Technology' AS industry, company_size, 'Full-time' AS employment_type,
       CAST(trunc(salary) AS INTEGER) AS salary, gender, CAST(trunc(CAST(age AS DOUBLE)) AS INTEGER) AS age,
       'seed' AS source
FROM cand"""), ops=("P9", "P17"))
def normalize_profile(spark, sf):
    return round_doubles(FE.normalize_profile(cand(spark, sf)))


@register("parse_skill_lists", """
SELECT p_partkey,
       list_filter(list_transform(string_split(replace(p_name, ' ', ' , ,'), ','), lambda x: trim(x)),
                   lambda x: x <> '') AS skills
FROM part""", ops=("P11",))
def parse_skill_lists(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", FE.parse_skill_list(F.replace(F.col("p_name"), F.lit(" "), F.lit(" , ,")))
                    .alias("skills"))


@register("served_intervals", with_cand("""
SELECT l_orderkey, l_linenumber,
       CAST(round_even(predicted_salary, 0) AS DOUBLE) AS predicted,
       CAST(round_even(greatest(0.0, predicted_salary - 20000.0), 0) AS DOUBLE) AS min_salary,
       CAST(round_even(predicted_salary + 20000.0, 0) AS DOUBLE) AS max_salary,
       CAST(round_even(predicted_salary, -3) AS DOUBLE) AS predicted_thousands,
       CAST(0.9 AS DOUBLE) AS confidence
FROM cand"""), ops=("P13", "P14"))
def served_intervals(spark, sf):
    df = FE.with_interval(cand(spark, sf), "predicted_salary", q_hat=20000.0, alpha=0.1)
    return df.select("l_orderkey", "l_linenumber",
                     FE.round_amount("predicted_salary").alias("predicted"),
                     FE.round_amount("min_salary").alias("min_salary"),
                     FE.round_amount("max_salary").alias("max_salary"),
                     FE.round_amount("predicted_salary", -3).alias("predicted_thousands"),
                     "confidence")


@register("fallback_intervals", with_cand("""
SELECT gender, count(*) AS n,
       round(avg(greatest(0.0, predicted_salary - 1.96 * 22651.0)), 4) AS mean_min,
       round(avg(predicted_salary + 1.96 * 22651.0), 4) AS mean_max,
       round(min(greatest(0.0, predicted_salary - 1.96 * 22651.0)), 4) AS min_min,
       CAST(0.95 AS DOUBLE) AS confidence
FROM cand GROUP BY gender"""), ops=("P13",))
def fallback_intervals(spark, sf):
    df = FE.with_interval(cand(spark, sf), "predicted_salary")
    return round_doubles(df.groupBy("gender").agg(
        F.count(F.lit(1)).alias("n"), F.avg("min_salary").alias("mean_min"),
        F.avg("max_salary").alias("mean_max"), F.min("min_salary").alias("min_min"),
        F.first("confidence").alias("confidence")))


@register("residuals", with_cand("""
SELECT l_orderkey, l_linenumber, round(salary - predicted_salary, 4) AS residual,
       round(abs(salary - predicted_salary), 4) AS abs_error,
       salary BETWEEN predicted_salary - 3000.0 AND predicted_salary + 3000.0 AS covered,
       CAST(6000.0 AS DOUBLE) AS interval_width
FROM cand"""), ops=("P18",))
def residuals(spark, sf):
    df = cand(spark, sf).withColumn("lo", F.col("predicted_salary") - 3000.0) \
                        .withColumn("hi", F.col("predicted_salary") + 3000.0)
    out = FE.residual_columns(df, "salary", "predicted_salary", "lo", "hi")
    return round_doubles(out.select("l_orderkey", "l_linenumber", "residual", "abs_error",
                                    "covered", "interval_width"))


@register("amount_labels", with_cand("""
SELECT l_orderkey, l_linenumber,
       CASE WHEN salary * 300.0 >= 1e7 THEN '₹' || format('{:,.1f}', round(salary * 300.0 / 1e7, 1)) || ' Cr'
            WHEN salary * 300.0 >= 1e5 THEN '₹' || format('{:,.1f}', round(salary * 300.0 / 1e5, 1)) || ' L'
            ELSE '₹' || format('{:,.0f}', round(salary * 300.0, 0)) END AS amount_label,
       CASE WHEN length(job_role || ' / ' || location || ' / ' || company_size) > 25
            THEN substring(job_role || ' / ' || location || ' / ' || company_size, 1, 25) || '...'
            ELSE job_role || ' / ' || location || ' / ' || company_size END AS short_label
FROM cand"""), ops=("P19",))
def amount_labels(spark, sf):
    c = cand(spark, sf)
    lab = F.concat_ws(" / ", "job_role", "location", "company_size")
    return c.select("l_orderkey", "l_linenumber",
                    FE.compact_amount(F.col("salary") * 300.0).alias("amount_label"),
                    FE.truncate_label(lab).alias("short_label"))
