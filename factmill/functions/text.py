"""Text expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Every character Unicode counts as white space, the four separators included.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Words of ASCII letters with no letter after another mark, parted by blanks: here a
# word starts only after a blank, and there is nothing to strip. Most values are so.
_WORD = r"(?:[A-Za-z]+[!-@\[-`{-~]*|[!-@\[-`{-~]+)"
# (\z, as $ would also match before a final line break)
_SIMPLE = f"^{_WORD}(?: +{_WORD})*" + r"\z"

_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"
_BREAK = "\u0000 "


def strip_space(text: Column) -> Column:
    """Strip all Unicode white space; plain ``trim`` strips only blanks."""
    return F.trim(text, F.lit(SPACES))


def title_case(text: Column) -> Column:
    """Capital after every uncased character, lower case elsewhere.

    ``initcap`` starts a word only after a blank, so each other uncased character
    is first followed by a break mark that ends in a blank. The mark's own first
    character is uncased and is marked too where the text holds it; so taking the
    marks out again restores any text.
    """
    marked = F.regexp_replace(text, f"([^{_CASED} ])", "$1" + _BREAK)
    return F.replace(F.initcap(marked), F.lit(_BREAK), F.lit(""))


def normal_case(text: Column) -> Column:
    """Strip and title-case, at the price of one match for simple values."""
    full = title_case(strip_space(text))
    return F.when(text.rlike(_SIMPLE), F.initcap(text)).otherwise(full)


def replace_values(value: Column, mapping: Mapping[str, str]) -> Column:
    """Replace whole values by a small map; others pass."""
    result = value
    if mapping:
        cases = None
        for old, new in mapping.items():
            hit = value == F.lit(old)
            cases = F.when(hit, new) if cases is None else cases.when(hit, new)
        result = cases.otherwise(value)
    return result


def blank(value: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def dash(value: Column) -> Column:
    """Null as a dash, for display."""
    return F.coalesce(value.cast("string"), F.lit("-"))
