"""Column expressions of the review model, all built from pyspark.sql.functions.

Every function returns a Column, so callers stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchdesk import schema as S


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Text or number -> double; unparsable text and NaN -> NULL."""
    x = col(c).try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def to_flag(c) -> Column:
    """0/1 flag from anything: numbers truncate ('1.7' -> 1), text -> 0, NULL -> 0."""
    return F.coalesce(to_number(c).try_cast("int"), F.lit(0))


def blank(c) -> Column:
    """NULL -> '' for text output."""
    return F.coalesce(col(c), F.lit(""))


def number_text(c) -> Column:
    """Text form of a double: integral values without a fraction (100, not 100.0)."""
    x = col(c)
    integral = (x == F.floor(x)) & (F.abs(x) < F.lit(1e15))
    return F.when(integral, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def text_form(name: str, dtype: T.DataType) -> Column:
    """String form of any match column; NULL stays NULL."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text(name)
    if isinstance(dtype, T.StringType):
        return F.col(name)
    return F.col(name).cast("string")


def quote_regex(text: str) -> str:
    """Literal regex for `text` in Java and RE2 syntax (\\Q..\\E, split at \\E)."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def quote_replacement(text: str) -> str:
    """Literal replacement text for Java's regexp_replace ($ and \\ escaped)."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def ci_contains(c, needle: str) -> Column:
    """Case-insensitive literal containment; NULL -> false."""
    return F.coalesce(F.upper(col(c)).contains(F.lit(needle.upper())), F.lit(False))


def cs_contains(c, needle: str) -> Column:
    """Case-sensitive literal containment; NULL -> false."""
    return F.coalesce(col(c).contains(F.lit(needle)), F.lit(False))


def regex_hit(c, pattern: str) -> Column:
    """Case-insensitive regex search; NULL -> false."""
    return F.coalesce(col(c).rlike("(?iu)" + pattern), F.lit(False))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


# ---- derived display columns ---------------------------------------------

def code_label(code: str, sub: str) -> Column:
    """`code-sub` when sub is non-empty, else code; NULLs read as ''."""
    return F.when(blank(sub) != "", F.concat(blank(code), F.lit("-"), blank(sub))).otherwise(blank(code))


def csz_label(city: str, state: str, zipc: str) -> Column:
    """`city, state zip` with blanks kept (punctuation stays)."""
    return F.concat(blank(city), F.lit(", "), blank(state), F.lit(" "), blank(zipc))


def effective_process() -> Column:
    """how_to_process, else a default from the upper-cased recommendation, else ''."""
    rec = F.upper(blank("recommendation"))
    default = reduce(lambda acc, kv: acc.when(rec == kv[0], F.lit(kv[1])),
                     S.DEFAULT_PROCESS[1:],
                     F.when(rec == S.DEFAULT_PROCESS[0][0], F.lit(S.DEFAULT_PROCESS[0][1])))
    return F.when(blank("how_to_process") != "", F.col("how_to_process")).otherwise(
        F.coalesce(default, F.lit("")))


def score_band(c) -> Column:
    x = col(c)
    return (F.when(x.isNull(), F.lit("none"))
            .when(x == S.BAND_PERFECT, F.lit("perfect"))
            .when(x >= S.BAND_HIGH, F.lit("high"))
            .when(x >= S.BAND_MEDIUM, F.lit("medium"))
            .otherwise(F.lit("low")))


def ssn_badge() -> Column:
    return F.when(F.col("ssn_match") == 100, F.lit("Yes")).otherwise(F.lit("No"))


def nameaddr_band() -> Column:
    """N+A score band, shown only for NEEDS REVIEW rows, else 'NS'."""
    return F.when(F.upper(blank("recommendation")) == "NEEDS REVIEW",
                  score_band("nameaddrscore")).otherwise(F.lit("NS"))


def do_not_use(c) -> Column:
    return regex_hit(c, S.DO_NOT_USE_PATTERN)


def is_trust() -> Column:
    return F.coalesce(F.col("is_trust").cast("string").isin(*S.TRUST_TRUE_VALUES), F.lit(False))


def low_name_hint() -> Column:
    return F.coalesce(F.col("name_score") < S.LOW_NAME_SCORE, F.lit(False))


def address_hint() -> Column:
    return F.coalesce((F.col("address_score") > S.ADDRESS_HINT_SCORE)
                      & F.upper(F.col("recommendation")).contains("NEW ADDRESS"), F.lit(False))


def flag_on(c) -> Column:
    return F.coalesce(col(c) != 0, F.lit(False))


def looked_up() -> Column:
    return F.coalesce(F.col("dec_address_looked_up").cast("string") == "1", F.lit(False))


def rec_rank(c="recommendation") -> Column:
    """Position in the preferred recommendation order, unknown -> 999."""
    pos = F.array_position(F.array(*[F.lit(r) for r in S.RECOMMENDATION_ORDER]), col(c))
    return F.when(F.coalesce(pos, F.lit(0)) == 0, F.lit(S.UNKNOWN_RANK)).otherwise(pos.cast("int"))


def trim_ws(c) -> Column:
    """Trim all leading/trailing whitespace (tabs and CR too, not only spaces)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")
