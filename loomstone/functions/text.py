"""Column expressions over document text; built-in functions only, so they stay in the JVM.

Each has a DuckDB twin (DUCK_*) for the column `text`, used by the oracle statements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL = "가-힣"
LATIN = "a-zA-Z"
#: White space as Python's Unicode strings see it.
SPACE = r"\s\x1c-\x1f"
DUCK_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"


def script_ratio(text: str, letters: str = HANGUL) -> Column:
    """Share of characters of the class `letters` among the characters that aren't white space; 0 where there is none."""
    solid = F.regexp_replace(text, rf"(?U)[{SPACE}]", "")
    return F.when(F.length(solid) == 0, F.lit(0.0)).otherwise(
        F.length(F.regexp_replace(solid, f"[^{letters}]", "")).cast("double") / F.length(solid)
    )


def gram_repetition(column: str, width: int = 20) -> Column:
    """Share of repeated grams among the back-to-back grams of `width` characters; 0 for texts under two grams.

    A gram that would end exactly at the end of the text isn't counted."""
    count = f"CAST((length({column}) - {width + 1}) DIV {width} + 1 AS INT)"
    grams = f"slice(regexp_extract_all({column}, '(?s).{{{width}}}', 0), 1, {count})"  # one pass, where substring() would start over for each
    return F.expr(f"CASE WHEN length({column}) < {2 * width} THEN 0.0D ELSE 1.0D - size(array_distinct({grams})) / CAST({count} AS DOUBLE) END")


def keep_document(
    text: str, letters: str | None = HANGUL, min_chars: int = 200, min_script: float = 0.3, max_repetition: float = 0.5,
) -> Column:
    """Length, script share (not asked for with letters=None) and repetition, cheapest first; null text is rejected."""
    keep = F.length(text) >= min_chars
    if letters is not None:
        keep = keep & (script_ratio(text, letters) >= min_script)
    return F.coalesce(keep & (gram_repetition(text) <= max_repetition), F.lit(False))


def words(text: str) -> Column:
    """Runs of Hangul, of Latin letters, of digits, and every other solid character by itself."""
    other = f"[^{SPACE}{HANGUL}{LATIN}0-9]"
    return F.regexp_extract_all(F.col(text), F.lit(f"(?U)[{HANGUL}]+|[{LATIN}]+|[0-9]+|{other}"), F.lit(0))


def shingles(text: str, n: int = 5) -> Column:
    """Distinct overlapping n-character grams; an empty array for texts under n characters."""
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def code_points(text: str) -> Column:
    """The text's characters as an array of code points: ids of a character-level vocabulary."""
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), F.ascii))


def decode_lossy(raw: str | Column) -> Column:
    """UTF-8 bytes as text, malformed parts replaced by U+FFFD."""
    return F.make_valid_utf8((F.col(raw) if isinstance(raw, str) else raw).cast("string"))


DUCK_SOLID = f"regexp_replace(text, '[{DUCK_SPACE}]', '', 'g')"
DUCK_LATIN = f"""(CASE WHEN length({DUCK_SOLID}) = 0 THEN 0.0::DOUBLE ELSE
    length(regexp_replace({DUCK_SOLID}, '[^{LATIN}]', '', 'g'))::DOUBLE / length({DUCK_SOLID})::DOUBLE END)"""
DUCK_REPETITION = """(CASE WHEN length(text) < 40 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_distinct(list_transform(
    range(0, (length(text) - 21) // 20 + 1), lambda i: substr(text, (i * 20 + 1)::BIGINT, 20))))::DOUBLE
    / ((length(text) - 21) // 20 + 1)::DOUBLE END)"""
DUCK_KEEP = f"coalesce(length(text) >= 200 AND {DUCK_LATIN} >= 0.3 AND {DUCK_REPETITION} <= 0.5, false)"
DUCK_WORDS = f"regexp_extract_all(text, '[{HANGUL}]+|[{LATIN}]+|[0-9]+|[^{DUCK_SPACE}{HANGUL}{LATIN}0-9]')"
DUCK_POINTS = "list_transform(string_split(text, ''), lambda c: unicode(c))"
