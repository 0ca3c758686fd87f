"""Row predicates of the catalog as Column expressions. Every pattern is anchored and free of leading wildcards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"\t-\r\x{85}\p{Z}"
#: Placeholder texts, and folders that hold no text.
PLACEHOLDERS = ("TextBlockDefaultValue", "None")
#: Namespaces of developer text.
DEV_NAMESPACE, DEV_PREFIX = "UMG", "UnrealEd"

BLANK = rf"\A[{_WS}]*\z"
GUID = rf"\A[{_WS}]*[0-9A-Fa-f]{{32}}[{_WS}]*\z"
ALL_NUMBER = r"\A\p{N}*\z"
ALL_DOT = r"\A\.*\z"
TRUE = rf"\A[{_WS}]*[Tt][Rr][Uu][Ee][{_WS}]*\z"
PATH = r"\\[^\n]*\\|/[^\n]*/"
STRING_DIGIT = r"\A[\p{L}\p{Mn}\p{Nd}\p{Pc}]*?\p{Nd}"
SHORT = rf"\A[{_WS}]*[^{_WS}\x{{10000}}-\x{{10FFFF}}]?[{_WS}]*\z"
NOT_UPPER = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"
NOT_LOWER = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}]"
UPPER_ONLY = r"\A[\p{Lu} ]*\z"


def is_blank(c: Column) -> Column:
    """Null, empty, or white space only, that of Unicode too."""
    return F.coalesce(c.rlike(BLANK), F.lit(True))


def is_guid(c: Column) -> Column:
    return c.rlike(GUID)


def is_all_number(c: Column) -> Column:
    return c.rlike(ALL_NUMBER)


def is_all_dot(c: Column) -> Column:
    return c.rlike(ALL_DOT)


def is_boolean(c: Column) -> Column:
    return c.isin("True", "False") | c.rlike(TRUE)


def is_path(c: Column) -> Column:
    return ~F.contains(c, F.lit('"')) & c.rlike(PATH)


def is_string_digit(c: Column) -> Column:
    return c.rlike(STRING_DIGIT)


def is_all_same(c: Column) -> Column:
    return F.length(F.replace(c, F.left(c, F.lit(1)), F.lit(""))) == 0


def is_short(c: Column) -> Column:
    """Blank, or one UTF-16 unit between white space."""
    return c.rlike(SHORT)


def is_upper(c: Column) -> Column:
    return ~c.rlike(NOT_UPPER)


def is_upper_and_space(c: Column) -> Column:
    return c.rlike(UPPER_ONLY)


def is_valid_hash(c: Column) -> Column:
    return (F.length(c) == 32) & c.rlike(GUID) & ~is_all_number(c) & ~is_all_same(c)


REASONS = {
    "placeholder": lambda c: c.isin(*PLACEHOLDERS),
    "short": is_short,
    "guid": is_guid,
    "all_number": is_all_number,
    "all_dot": is_all_dot,
    "boolean": is_boolean,
    "path": is_path,
    "all_same": is_all_same,
    "string_digit": is_string_digit,
}


def is_not_allowed(c: Column) -> Column:
    out = F.lit(False)
    for test in REASONS.values():
        out = out | test(c)
    return out


def is_developer_namespace(c: Column) -> Column:
    return (c == DEV_NAMESPACE) | c.startswith(DEV_PREFIX)


def path_contains(path: Column, part: str) -> Column:
    return F.contains(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lit(part.replace("\\", "/").lower()))


def is_lower(c: Column) -> Column:
    """All letters are lower case; true where there is none."""
    return ~c.rlike(NOT_LOWER)


def is_upper_lower(c: Column) -> Column:
    """No white space, two upper-case letters at least, and more lower-case ones."""
    upper = F.regexp_count(c, F.lit(r"\p{Lu}"))
    return ~c.rlike(rf"[{_WS}]") & (upper >= 2) & (F.regexp_count(c, F.lit(r"\p{Ll}")) > upper)


def is_valid_decode(c: Column) -> Column:
    """Does not start with three NULs."""
    return ~c.startswith("\0\0\0")


def has_extension(path: Column, *extensions: str) -> Column:
    return F.lower(path).rlike("(?:" + "|".join(e.lower().replace(".", r"\.") for e in extensions) + r")\z")


def wanted_source(c: Column, no_underscore: bool = False, no_uppercase: bool = False) -> Column:
    """The optional row filters: sources with an underscore, and sources whose letters are all upper case."""
    keep = F.lit(True)
    if no_underscore:
        keep = keep & ~F.contains(c, F.lit("_"))
    return keep & ~is_upper(c) if no_uppercase else keep


def cell_test(cells: Column, index: int, width: int, test: str, value: str = "", ignore_case: bool = False) -> Column:
    """``equals``, ``contains``, ``starts``, ``ends`` or ``empty`` on one cell of a row of ``width`` columns.

    Missing cells are empty. Beyond the width ``empty`` holds and the others do not.
    """
    if not 0 <= index < width:
        return F.lit(test == "empty")
    cell, wanted = F.coalesce(F.get(cells, F.lit(index)), F.lit("")), F.lit(value)
    if ignore_case:
        cell, wanted = F.lower(cell), F.lower(wanted)
    tests = {"equals": cell == wanted, "contains": F.contains(cell, wanted), "starts": F.startswith(cell, wanted), "ends": F.endswith(cell, wanted), "empty": cell == ""}
    return tests[test]
