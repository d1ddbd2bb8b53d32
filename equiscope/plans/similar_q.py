"""Registered queries: similar profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import map_values, round_doubles
from ..operators import similar as SIM
from ..roles import EDUCATION_ORDINAL
from ..sources.tables import cand, with_cand
from .registry import register


@register("similar_profiles", with_cand("""
SELECT r.l_orderkey, r.l_linenumber,
       CAST(CASE WHEN b.n >= 5 THEN b.n ELSE coalesce(ro.n, 0) END AS BIGINT) AS count,
       coalesce(CAST(trunc(CASE WHEN b.n >= 5 THEN b.med ELSE ro.med END) AS INTEGER), 0) AS median_salary,
       coalesce(CAST(trunc(CASE WHEN b.n >= 5 THEN b.p25 ELSE ro.p25 END) AS INTEGER), 0) AS percentile_25,
       coalesce(CAST(trunc(CASE WHEN b.n >= 5 THEN b.p75 ELSE ro.p75 END) AS INTEGER), 0) AS percentile_75
FROM cand r
LEFT JOIN (
  SELECT k.job_role, k.location, k.education_level, k.years_experience, count(p.salary) AS n,
         quantile_cont(p.salary, 0.5) AS med, quantile_cont(p.salary, 0.25) AS p25,
         quantile_cont(p.salary, 0.75) AS p75
  FROM (SELECT DISTINCT job_role, location, education_level, years_experience FROM cand) k
  JOIN cand p ON p.job_role = k.job_role AND p.location = k.location
             AND p.education_level = k.education_level
             AND p.years_experience BETWEEN k.years_experience - 2.0 AND k.years_experience + 2.0
  GROUP BY ALL) b
  ON r.job_role = b.job_role AND r.location = b.location AND r.education_level = b.education_level
     AND r.years_experience = b.years_experience
LEFT JOIN (SELECT job_role, count(salary) AS n, quantile_cont(salary, 0.5) AS med,
                  quantile_cont(salary, 0.25) AS p25, quantile_cont(salary, 0.75) AS p75
           FROM cand GROUP BY job_role) ro ON r.job_role = ro.job_role"""), ops=("J1",))
def similar_profiles(spark, sf):
    c = cand(spark, sf)
    req = c.select("l_orderkey", "l_linenumber", "job_role", "location", "education_level",
                   "years_experience")
    out = SIM.similar_profiles(req, c.select("job_role", "location", "education_level",
                                             "years_experience", "salary"))
    return out.select("l_orderkey", "l_linenumber", *SIM.STAT_COLS)


KNN_NUM = {"years_experience": 2.0, "education_ordinal": 1.5, "skills_count": 1.5}
KNN_CAT = {"company_size": 1.0}


def _knn_frame(spark, sf):
    c = cand(spark, sf)
    return c.withColumn("education_ordinal", map_values("education_level", EDUCATION_ORDINAL))


@register("knn_peers", with_cand("""
SELECT r.l_orderkey, r.l_linenumber, s.count, s.median_salary, s.percentile_25, s.percentile_75,
       s.max_distance
FROM ke r LEFT JOIN (
  SELECT job_role, location, years_experience, education_ordinal, skills_count, company_size,
         count(*) AS count,
         CAST(trunc(quantile_cont(salary, 0.5)) AS INTEGER) AS median_salary,
         CAST(trunc(quantile_cont(salary, 0.25)) AS INTEGER) AS percentile_25,
         CAST(trunc(quantile_cont(salary, 0.75)) AS INTEGER) AS percentile_75,
         round(max(distance), 4) AS max_distance
  FROM (
    SELECT k.*, p.salary, d.distance,
           row_number() OVER (PARTITION BY k.job_role, k.location, k.years_experience, k.education_ordinal,
                                           k.skills_count, k.company_size
                              ORDER BY d.distance, p.salary) AS rn
    FROM (SELECT DISTINCT job_role, location, years_experience, education_ordinal, skills_count, company_size
          FROM ke) k
    JOIN ke p ON p.job_role = k.job_role AND p.location = k.location
             AND p.years_experience BETWEEN k.years_experience - 2.0 AND k.years_experience + 2.0,
    LATERAL (SELECT sqrt(2.0 * (CAST(k.years_experience AS DOUBLE) - CAST(p.years_experience AS DOUBLE))
                             * (CAST(k.years_experience AS DOUBLE) - CAST(p.years_experience AS DOUBLE))
                       + 1.5 * (CAST(k.education_ordinal AS DOUBLE) - CAST(p.education_ordinal AS DOUBLE))
                             * (CAST(k.education_ordinal AS DOUBLE) - CAST(p.education_ordinal AS DOUBLE))
                       + 1.5 * (CAST(k.skills_count AS DOUBLE) - CAST(p.skills_count AS DOUBLE))
                             * (CAST(k.skills_count AS DOUBLE) - CAST(p.skills_count AS DOUBLE))
                       + 1.0 * CASE WHEN k.company_size IS NOT DISTINCT FROM p.company_size THEN 0.0 ELSE 1.0 END)
                    AS distance) d
    WHERE d.distance IS NOT NULL) t
  WHERE rn <= 50
  GROUP BY ALL) s
ON r.job_role = s.job_role AND r.location = s.location AND r.years_experience = s.years_experience
   AND r.education_ordinal IS NOT DISTINCT FROM s.education_ordinal AND r.skills_count = s.skills_count
   AND r.company_size IS NOT DISTINCT FROM s.company_size""", """ke AS (
  SELECT *, CASE education_level WHEN 'High School' THEN 0 WHEN 'Bachelor' THEN 1
                 WHEN 'Master' THEN 2 WHEN 'PhD' THEN 3 END AS education_ordinal FROM cand)"""), ops=("J2",))
def knn_peers(spark, sf):
    c = _knn_frame(spark, sf)
    req = c.select("l_orderkey", "l_linenumber", "job_role", "location", "years_experience",
                   "education_ordinal", "skills_count", "company_size")
    out = SIM.knn_peers(req, c, ["job_role", "location"], "years_experience", KNN_NUM, KNN_CAT)
    return round_doubles(out.select("l_orderkey", "l_linenumber", "count", "median_salary",
                                    "percentile_25", "percentile_75", "max_distance"))
