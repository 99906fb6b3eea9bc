"""Text parsing and recoding as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.missing import as_col

# Answers and codes that the survey forms use.
NOMINATION_TRAITS = {
    "Boostable classmate": "Boost",
    "Intelligent classmate": "Intelligence",
    "Persevering classmate": "Perseverance",
    "High integrity classmate": "Integrity",
    "Empathetic classmate": "Empathy",
}
OTHER_NOMINATION_TRAIT = "Spike"
TRAITS = ["Boost", "Empathy", "Integrity", "Intelligence", "Perseverance", "Spike"]
INCOME_QUINTILES = {
    "Fifth quintile (Bottom 20%)": 1,
    "Fourth quintile": 2,
    "Third quintile": 3,
    "Second quintile": 4,
    "Top quintile (Top 20%)": 5,
}
GUARDIAN_EDUCATION = {
    "Graduate Degree (PhD, MD, JD...)": "4. Grad school",
    "Bachelor’s Degree (finished university)": "3. Bachelor",
    "Not been to school": "0. No high school",
    "They terminated school at or before age thirteen": "0. No high school",
    "They terminated school before age eighteen": "0. No high school",
    "They completed high school, or their primary education": "1. High school",
}
OTHER_EDUCATION = "2. Some post-school education"
EDUCATION_NOT_SAID = "-9. Prefer not to say"
QUESTION_TRAITS = [
    ("Intelligence", "Q1. How intelligent does this person seem? [Scaled Feedback]"),
    ("Perseverance", "Q1. Does this person seem very persevering? [Scaled Feedback]"),
    ("Integrity", "Q1. Would you say that this person has a strong moral compass? [Scaled Feedback]"),
    ("Empathy", "Q1. How empathetic does this person seem from their response? [Scaled Feedback]"),
    ("Spike", "Q1. How passionate does this person seem about the problem they describe? [Scaled Feedback]"),
    ("Boost", "Q1. How underprivileged do you think this person is? [Scaled Feedback]"),
]


def extract(x, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern`` (or one of its groups); NULL when there is none."""
    if group == 0:
        return F.regexp_substr(as_col(x), F.lit(pattern))
    return F.when(as_col(x).rlike(pattern), F.regexp_extract(as_col(x), pattern, group))


def parse_number(x) -> Column:
    """First number inside a text; grouping commas dropped; NULL when there is none."""
    token = F.regexp_substr(as_col(x), F.lit(r"-?[0-9][0-9,]*(\.[0-9]+)?"))
    return F.regexp_replace(token, ",", "").try_cast("double")


def question_number(x, offset: int = 0) -> Column:
    return extract(x, "[0-9]{1,2}").try_cast("int") - F.lit(offset)


def strip_ordinal(x) -> Column:
    return F.regexp_replace(as_col(x), " [0-9]", "")


def cell_index(x, position: int) -> Column:
    """Index ``position`` (1 or 2) of a parameter cell such as ``theta[12,3]``."""
    return extract(x, r"\[([0-9]+),([0-9]+)\]", position).cast("int")


def after_uid(x) -> Column:
    return extract(x, "UID: (.*)", 1)


def recode(x, mapping: dict, otherwise=None, missing=None) -> Column:
    """Literal mapping; unknown answers and missing answers have their own codes."""
    value = as_col(x)
    out = F.when(value.isNull(), F.lit(missing)) if missing is not None else None
    for key, code in mapping.items():
        hit = value == F.lit(key)
        out = F.when(hit, F.lit(code)) if out is None else out.when(hit, F.lit(code))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def income_code(x) -> Column:
    return recode(x, INCOME_QUINTILES)


def education_level(x) -> Column:
    return recode(x, GUARDIAN_EDUCATION, OTHER_EDUCATION, EDUCATION_NOT_SAID)


def nomination_trait(x) -> Column:
    return recode(x, NOMINATION_TRAITS, OTHER_NOMINATION_TRAIT)


def full_name(first, last) -> Column:
    return F.concat_ws(" ", as_col(first), as_col(last))


def age_in_years(birth, as_of: str) -> Column:
    return F.date_diff(F.lit(as_of).cast("date"), as_col(birth)) / F.lit(365.25)


def paste(*parts, sep: str = "") -> Column:
    """Concatenate; a missing part prints as NA."""
    return F.concat_ws(sep, *[F.coalesce(as_col(p).cast("string"), F.lit("NA")) for p in parts])


def not_given(x, sentinel=-9) -> Column:
    return F.nullif(as_col(x), F.lit(float(sentinel)))


def matches(x, pattern: str) -> Column:
    """Regex test that is false, never NULL, on a missing text."""
    return F.coalesce(as_col(x).rlike(pattern), F.lit(False))


def correct_names(df: DataFrame, column: str, corrections: dict[str, str]) -> DataFrame:
    """Replace known misspellings; the map is a literal argument, so it is inlined."""
    if not corrections:
        return df
    pairs = [F.lit(v) for kv in corrections.items() for v in kv]
    fixed = F.element_at(F.create_map(*pairs), as_col(column))
    return df.withColumn(column, F.coalesce(fixed, as_col(column)))
