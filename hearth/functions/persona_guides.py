"""Which sections and guidance lines a persona prompt gets (T20, T21): joins of
the category sets of many groups with small fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions.stats import collect_bounded

# A section applies if any of its categories is present
SECTION_CATEGORIES = {
    "financial_decisions": ["income", "assets", "debt", "financial_behavior"],
    "consumption_decisions": ["consumption", "housing_behavior", "income"],
    "investment_decisions": ["assets", "investments", "retirement_savings"],
    "employment_decisions": ["employment_behavior"],
    "housing_decisions": ["housing_behavior"],
    "behavioral_biases": ["attitudes_expectations", "financial_behavior", "assets", "debt"],
}
# The section of a group without any decision section
GENERAL_SECTION = "general_decisions"
BIAS_SECTION = "behavioral_biases"

# The categories that have a line of behaviour, and per dataset those with a line of context
BEHAVIOUR_CATEGORIES = ["consumption", "financial_behavior", "education_investment", "time_use_lifestyle", "employment_behavior",
                        "housing_behavior", "health_behavior", "attitudes_expectations", "program_participation"]
CONTEXT_CATEGORIES = {
    "psid": ["housing_behavior", "employment_behavior", "education_investment", "assets", "debt"],
    "shed": ["financial_behavior", "debt", "attitudes_expectations", "income", "program_participation"],
    "acs": ["housing_behavior", "employment_behavior", "demographics", "income"],
    "ces": ["consumption", "income", "debt", "assets"],
    "sipp": ["program_participation", "income", "employment_behavior", "health_behavior"],
}
LINES = "kind string, for_dataset string, category string, pos int, line string"


def section_rows() -> list[tuple[str, str, int]]:
    return [(c, s, i) for i, (s, cats) in enumerate(SECTION_CATEGORIES.items()) for c in cats]


def decision_sections(categories: DataFrame, group: str = "grp") -> DataFrame:
    """(group, pos, section) for each group of ``categories(group,
    category)``: every section with a category present; a group with no decision
    section gets the general one (pos 100)."""
    rules = F.broadcast(categories.sparkSession.createDataFrame(section_rows(), "category string, section string, pos int"))
    hits = categories.select(group, "category").distinct().join(rules, "category", "left").groupBy(group).agg(
        F.collect_set(F.when(F.col("section").isNotNull(), F.struct("pos", "section"))).alias("s"))
    decided = F.exists("s", lambda x: x["section"] != BIAS_SECTION)
    general = F.array(F.struct(F.lit(100).alias("pos"), F.lit(GENERAL_SECTION).alias("section")))
    return hits.select(group, F.explode(F.when(decided, F.col("s")).otherwise(F.concat("s", general))).alias("x")).select(group, "x.pos", "x.section")


def default_lines(spark: SparkSession) -> DataFrame:
    """The text dimension of ``guidance_lines`` where none is given: each line is its category's name."""
    rows = [("behaviour", None, c, i, c.replace("_", " ")) for i, c in enumerate(BEHAVIOUR_CATEGORIES)]
    rows += [("behaviour", None, None, 0, "household")]
    rows += [("context", d, c, i, c.replace("_", " ")) for d, cats in CONTEXT_CATEGORIES.items() for i, c in enumerate(cats)]
    return spark.createDataFrame(rows, LINES)


def guidance_lines(categories: DataFrame, lines: DataFrame | None = None, group: str = "grp") -> DataFrame:
    """(group, behaviour, context) texts for each group of
    ``categories(group, dataset, category)`` from the text dimension ``lines(kind,
    for_dataset, category, pos, line)``: one behaviour line per category present, the
    lines without a category if there is none; one context line per category that matters
    for the group's dataset (empty if none).  The wording is the caller's; the default
    dimension only names the categories."""
    lines = default_lines(categories.sparkSession) if lines is None else lines
    met = categories.select(group, "dataset", "category").distinct().join(lines.where(F.col("category").isNotNull()), "category", "left")
    met = met.where(F.col("for_dataset").isNull() | (F.col("for_dataset") == F.col("dataset")) | F.col("line").isNull())

    def text(kind: str):
        picked = F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.struct("pos", "line"))))
        return F.array_join(F.transform(picked, lambda x: F.concat(F.lit("* "), x["line"])), "\n")
    found = met.groupBy(group).agg(text("behaviour").alias("b"), text("context").alias("c"))
    generic = collect_bounded(lines.where(F.col("category").isNull()).agg(text("behaviour").alias("g")), 1, "generic lines")[0]["g"]
    return found.select(group, F.when(F.coalesce("b", F.lit("")) == "", F.lit(generic)).otherwise(F.col("b")).alias("behaviour"),
                        F.coalesce("c", F.lit("")).alias("context"))
