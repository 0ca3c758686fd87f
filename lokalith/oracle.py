"""SQL texts that several queries share: escapes and the row predicates, as DuckDB expressions over a column ``s``."""

from __future__ import annotations

from lokalith.functions import predicates

ESC = "replace(replace(replace(replace(replace({0}, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), '\\r\\n', '<cf>'), '\"', '\"\"')"
UNESC = "replace(replace(replace(replace(replace({0}, '<cf>', '\\r\\n'), '\\n', chr(10)), '\\r', chr(13)), '\\t', chr(9)), '\"\"', '\"')"


def matches(pattern: str, s: str = "s") -> str:
    return f"regexp_matches({s}, '{pattern}')"


def blank(s: str) -> str:
    """White space only, that of Unicode too."""
    return "regexp_matches(" + s + r", '^[\t-\r\x{85}\p{Z}]*$')"


REASONS = {
    "placeholder": "s IN ('TextBlockDefaultValue', 'None')",
    "short": matches(predicates.SHORT),
    "guid": matches(predicates.GUID),
    "all_number": matches(predicates.ALL_NUMBER),
    "all_dot": matches(predicates.ALL_DOT),
    "boolean": f"(s IN ('True', 'False') OR {matches(predicates.TRUE)})",
    "path": f"(NOT contains(s, '\"') AND {matches(predicates.PATH)})",
    "all_same": "length(replace(s, left(s, 1), '')) = 0",
    "string_digit": matches(predicates.STRING_DIGIT),
}
BAD = "(" + " OR ".join(REASONS.values()) + ")"
