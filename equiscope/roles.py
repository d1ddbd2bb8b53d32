"""Column-role catalog and the fixed vocabularies of the salary domain.

Every operator takes column names (or a ``FeatureRoles``) as arguments, so it
works on any table; the defaults below describe the salary candidate table.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureRoles:
    numerical: tuple[str, ...]
    categorical: tuple[str, ...]
    protected: tuple[str, ...] = ()
    target: str = "salary"
    prediction: str = "predicted_salary"

    def __post_init__(self):
        overlap = set(self.protected) & (set(self.numerical) | set(self.categorical))
        if overlap:
            raise ValueError(f"protected columns may not be model features: {sorted(overlap)}")

    @property
    def features(self) -> tuple[str, ...]:
        return self.numerical + self.categorical


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------

# Candidate-table roles (numerical, categorical, protected, target).
NUMERICAL_FEATURES = ("years_experience", "skills_count", "previous_salary", "interview_score")
CATEGORICAL_FEATURES = ("education_level", "job_role", "location", "company_size")
PROTECTED_ATTRIBUTES = ("gender", "age")
TARGET = "salary"

CANDIDATE_ROLES = FeatureRoles(NUMERICAL_FEATURES, CATEGORICAL_FEATURES,
                               PROTECTED_ATTRIBUTES, TARGET)

# Engineered feature names, in the reference's order.
ENGINEERED_FEATURES = ("exp_bucket", "log_experience", "education_ordinal", "high_col_location",
                       "company_size_ordinal", "exp_x_edu", "exp_x_skills")

# Right-closed bucket edges and labels.
EXP_BUCKET_EDGES = (-1, 0, 2, 5, 10, 15, 30)
EXP_BUCKET_LABELS = ("0", "0-2", "2-5", "5-10", "10-15", "15+")
EDA_EXP_BIN_EDGES = (0, 2, 5, 10, 15, 30)
EDA_EXP_BIN_LABELS = ("0-2", "2-5", "5-10", "10-15", "15+")
AGE_GROUP_EDGES = (20, 30, 40, 50, 65)
AGE_GROUP_LABELS = ("20-30", "30-40", "40-50", "50+")

# Ordinal maps; unmapped values become NULL.
EDUCATION_ORDINAL = {"High School": 0, "Bachelor": 1, "Master": 2, "PhD": 3}
COMPANY_SIZE_ORDINAL = {"Startup (1-50)": 0, "Small (51-200)": 1,
                        "Medium (201-1000)": 2, "Large (1000+)": 3}
HIGH_COST_LOCATIONS = ("San Francisco", "New York", "Seattle", "Boston")

# Service vocabulary (5 education values) to analytics vocabulary (4 values);
# unknown values pass through unchanged.
SERVICE_EDUCATION_TO_LEVEL = {"High School": "High School", "Associate Degree": "Bachelor",
                              "Bachelor's Degree": "Bachelor", "Master's Degree": "Master",
                              "PhD": "PhD"}
# Reverse map used when raw rows are loaded into the profile table.
LEVEL_TO_SERVICE_EDUCATION = {"High School": "High School", "Bachelor": "Bachelor's Degree",
                              "Master": "Master's Degree", "PhD": "PhD",
                              "Associate": "Associate Degree"}

# Closed vocabularies enforced when a record is appended.
SERVICE_EDUCATIONS = ("High School", "Associate Degree", "Bachelor's Degree",
                      "Master's Degree", "PhD")
COMPANY_SIZES = ("Startup (1-50)", "Small (51-200)", "Medium (201-1000)", "Large (1000+)")
EMPLOYMENT_TYPES = ("Full-time", "Part-time", "Contract", "Internship", "Freelance")
GENDERS = ("Male", "Female", "Non-binary", "Prefer not to say")
DEFAULT_EMPLOYMENT_TYPE = "Full-time"
PROFILE_INDUSTRY = "Technology"
PROFILE_SOURCE_SEED = "seed"
PROFILE_SOURCE_REAL = "real"

# Prediction defaults when a request leaves a field out.
DEFAULT_INTERVIEW_SCORE = 7.0
PREVIOUS_SALARY_FLOOR = 30000.0
PREVIOUS_SALARY_BASE = 40000.0
PREVIOUS_SALARY_PER_YEAR = 12000.0

# Interval fallbacks when no conformal quantile is available.
FALLBACK_RMSE = 22651.0
FALLBACK_Z = 1.96
FALLBACK_CONFIDENCE = 0.95
SERVICE_FALLBACK_HALF_WIDTH = 22333.0
SERVICE_FALLBACK_CONFIDENCE = 0.90

# Fairness dashboard thresholds.
DP_WARNING = 0.10
DP_REVIEW = 0.05
MEAN_DIFF_WARNING = 50000.0
MEAN_DIFF_REVIEW = 20000.0
FOUR_FIFTHS = 0.8
PROXY_CORR_THRESHOLD = 0.3
PROXY_P_THRESHOLD = 0.05

# The audit's verdict on an attribute, and what it recommends if a gap exceeds it.
AUDIT_GAP = 0.05
AUDIT_RECOMMENDATIONS = (
    "Apply fairness-constrained training (ExponentiatedGradient)",
    "Consider post-processing calibration",
    "Review proxy features",
    "Increase representation of underrepresented groups",
)
# Dashboard recommendations: the attribute follows (and, in the first, "fairness: DP difference = 0.000").
REVIEW_TEXT = "Review "
CALIBRATE_TEXT = "Consider post-processing calibration for "

# Drift thresholds.
PSI_HIGH = 0.25
PSI_MODERATE = 0.10
PSI_EMPTY_SHARE = 0.0001
DRIFT_MIN_ROWS = 10
TEST_LEVEL = 0.05

# Metric-name normalisation: (source name, normalised name), first present wins.
METRIC_NAME_MAP = (("MAE", "mae"), ("RMSE", "rmse"), ("R2", "r2"), ("mae", "mae"), ("rmse", "rmse"),
                   ("r2", "r2"), ("cv_mae", "cv_mae"), ("cv_std", "cv_std"))

# Weighted k-NN peer weights (documented method), in the documented order.
KNN_WEIGHTS = {"experience_years": 2.0, "education": 1.5, "job_role": 2.0, "location": 1.5,
               "skills": 1.5, "industry": 1.0, "company_size": 1.0, "employment_type": 0.5}
KNN_TOP_N = 50
PEER_EXPERIENCE_TOLERANCE = 2.0
PEER_MIN_COUNT = 5


@dataclass(frozen=True)
class FixtureVocab:
    """Vocabularies for the fixture view over the driver tables."""
    high_cost_locations: tuple[str, ...] = ("AMERICA", "EUROPE")
    company_size_ordinal: dict = field(default_factory=lambda: {
        "AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "MACHINERY": 3})
