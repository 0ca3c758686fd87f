"""Text functions of the catalog as Column expressions; all but the masked search stay in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes in the order in which they are applied.
ESCAPES = [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\\r\\n", "<cf>"), ('"', '""')]
UNESCAPES = [("<cf>", "\\r\\n"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('""', '"')]
#: Pairs that a single-byte decoding leaves, and the marks meant.
REPAIRS = [("\u0019 ", "\u2019"), ("\u0018 ", "\u2018"), ("\u001c ", "\u201c"), ("\u001d ", "\u201d"), ("& ", "\u2026"), ("\u0014 ", "\u2014"), ("\u0013 ", "\u2013")]


#: How the title with encrypted string tables is named, in full and in part.
ENCRYPTED_TITLE = ("NTE", "NEVERNESS")
_CONTENT = r"\\([^\\]+)\\Content(?!.*Paks)\\.+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = {ord(x): x.lower() for x in _UPPER}


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column) -> Column:
    return _replaced(c, ESCAPES)


def unescape(c: Column) -> Column:
    return _replaced(c, UNESCAPES)


def repair_latin1(c: Column) -> Column:
    return F.replace(_replaced(c, REPAIRS), F.lit("\0"), F.lit(""))


def utf16_length(c: Column) -> Column:
    return (F.length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def string_crc32(c: Column) -> Column:
    """CRC-32 over the UTF-16 units, each as a little-endian 32-bit integer."""
    return F.crc32(F.unhex(F.regexp_replace(F.hex(F.encode(c, "UTF-16LE")), "([0-9A-F]{4})", "$10000")))


def namespace_of(key: Column) -> Column:
    return F.when(F.instr(key, "::") > 0, F.substring_index(key, "::", 1)).otherwise("")


def composite_key(namespace: Column, key: Column) -> Column:
    return F.when(namespace != "", F.concat(namespace, F.lit("::"), key)).otherwise(key)


def actual_key(namespace: Column, key: Column) -> Column:
    """The key without any leading ``namespace::``."""
    prefix = F.concat(namespace, F.lit("::"))
    quoted = F.concat(F.lit("^(?:\\Q"), F.replace(prefix, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)+"))
    return F.when((namespace != "") & key.startswith(prefix), F.regexp_replace(key, quoted, F.lit(""))).otherwise(key)


def without_one_prefix(namespace: Column, key: Column) -> Column:
    prefix = F.concat(namespace, F.lit("::"))
    return F.when((namespace != "") & key.startswith(prefix), F.substr(key, F.length(prefix) + 1)).otherwise(key)


def decorated_key(key: Column, hash_: Column | None = None, url: Column | None = None) -> Column:
    if hash_ is not None:
        key = F.concat(F.lit("["), key, F.lit("]["), hash_, F.lit("]"))
    return key if url is None else F.concat(F.lit("["), url, F.lit("]"), key)


def csv_field(c: Column) -> Column:
    """Quotes doubled unless a doubled one is there already; wrapped where a comma or quote is present."""
    c = F.coalesce(c, F.lit(""))
    doubled = F.when(F.contains(c, F.lit('""')), c).otherwise(F.replace(c, F.lit('"'), F.lit('""')))
    return F.when(F.contains(c, F.lit(",")) | F.contains(c, F.lit('"')), F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(doubled)


def effective_text(translation: Column, source: Column) -> Column:
    return unescape(F.coalesce(F.nullif(translation, F.lit("")), source))


def simplify_quotes(c: Column) -> Column:
    quoted = c.startswith('"') & c.endswith('"') & F.contains(c, F.lit(","))
    return F.when(quoted, F.btrim(c, F.lit('"'))).otherwise(c)


def base_name(path: Column) -> Column:
    last = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(last, r"\.[^.]*\z", "")


def fstring_size(c: Column) -> Column:
    """Bytes of a length-prefixed string: 4, plus its units and terminator; one byte a unit where all are ASCII."""
    n = F.length(F.encode(c, "UTF-16LE"))
    ascii_ = F.octet_length(c) == F.length(c)
    return F.when(c == "", F.lit(4)).when(ascii_, F.lit(5) + F.length(c)).otherwise(F.lit(6) + n).cast("long")


def byte_find(content: Column, pattern: bytes) -> Column:
    """0-based place of a byte pattern in a binary column, -1 where absent."""
    return F.instr(F.decode(content, "ISO-8859-1"), pattern.decode("latin-1")) - 1


def byte_find_from(content: Column, pattern: bytes, start: Column) -> Column:
    """0-based place of a byte pattern at or after ``start``, -1 where absent."""
    return F.call_function("locate", F.lit(pattern.decode("latin-1")), F.decode(content, "ISO-8859-1"), start.cast("int") + 1) - 1


def byte_find_ignore_case(content: Column, pattern: bytes) -> Column:
    """0-based place of a byte pattern, ASCII letters in any case; -1 where absent."""
    return F.instr(F.translate(F.decode(content, "ISO-8859-1"), _UPPER, _UPPER.lower()), pattern.decode("latin-1").translate(_LOWER)) - 1


def masked_finds(content: Column, pattern: list[int | None]) -> Column:
    """All 0-based places, overlapping ones too, of a byte pattern in which None stands for any byte. Null content: null.

    One comparison for each byte of the pattern over the bytes of a whole batch, so the work does not grow with the hits.
    """
    fixed = [(k, b) for k, b in enumerate(pattern) if b is not None]

    @F.arrow_udf("array<int>")
    def found(column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        hit = np.ones(max(len(data) - len(pattern) + 1, 0), bool)
        for k, b in fixed:
            hit &= data[k : k + len(hit)] == b
        at = np.flatnonzero(hit)
        row = np.searchsorted(ends, at, "right") - 1  # the row that a place lies in; empty rows hold none
        inside = (row >= 0) & (row < len(column))
        at, row = at[inside], row[inside]
        inside = at + len(pattern) <= ends[row + 1]
        at, row = at[inside], row[inside]
        counts = np.bincount(row, minlength=len(column))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((at - ends[row]).astype(np.int32), pa.int32()))
        return pc.if_else(column.is_valid(), lists, pa.scalar(None, lists.type)) if column.null_count else lists

    return found(content)


def to_bytes(c: Column) -> Column:
    """The low byte of each UTF-16 unit."""
    return F.unhex(F.regexp_replace(F.hex(F.encode(c, "UTF-16LE")), "([0-9A-F]{2})[0-9A-F]{2}", "$1"))


def bytes_to_hex(content: Column) -> Column:
    return F.hex(content)


def hex_to_bytes(c: Column) -> Column:
    """Null where the text is no hex number."""
    return F.unhex(c)


def asset_path(path: Column, with_name: bool = True) -> Column:
    """The part from the folder above ``Content`` on, unless container folders follow; the path itself where there is none."""
    found = F.rtrim(F.regexp_extract(path, _CONTENT, 0), F.lit('"'))
    if not with_name:
        found = F.replace(found, F.regexp_extract(path, r"[^\\/]*\z", 0), F.lit(""))
    return F.when(F.trim(found) == "", path).otherwise(found)


def title_key(c: Column, program: bool = False) -> Column:
    """A folder name without blanks, dashes and underscores, or a program's without dashes and underscores, in lower case."""
    return F.lower(F.translate(c, "_-" if program else "_- ", ""))


def version_name(c: Column) -> Column:
    """``UE`` before a leading digit, dots as underscores; blank texts stay as they are."""
    named = F.when(c.rlike(r"\A\p{Nd}"), F.concat(F.lit("UE"), c)).otherwise(c)
    return F.when(F.trim(c) == "", c).otherwise(F.replace(named, F.lit("."), F.lit("_")))


def asks_for_encryption(c: Column) -> Column:
    """Whether a version text names the title whose string tables are encrypted."""
    plain = F.upper(F.translate(c, "_- ", ""))
    return (plain == ENCRYPTED_TITLE[0]) | F.contains(plain, F.lit(ENCRYPTED_TITLE[1]))


def encrypt_value(c: Column, key: Column, sentinel: str) -> Column:
    """AES-256-ECB over text, the format's sentinel and zero padding; URL-safe Base64. Key and sentinel are the caller's."""
    raw = F.encode(F.concat(c, F.lit(sentinel)), "UTF-8")
    padded = F.concat(raw, F.unhex(F.repeat(F.lit("00"), F.pmod(-F.length(raw), F.lit(16)).cast("int"))))
    cipher = F.aes_encrypt(padded, key, F.lit("ECB"), F.lit("PKCS"))
    return F.translate(F.base64(_head(cipher)), "+/", "-_")


def _head(cipher: Column) -> Column:
    """All but the last block."""
    return F.substr(cipher, F.lit(1), F.length(cipher) - 16)


def decrypt_value(c: Column, key: Column, sentinel: str) -> Column:
    """The reverse, cut at the sentinel; '' where it fails. A valid padding block is appended for the cipher mode."""
    block = F.substr(F.aes_encrypt(F.unhex(F.repeat(F.lit("00"), F.lit(16))), key, F.lit("ECB"), F.lit("PKCS")), F.lit(17), F.lit(16))
    raw = F.try_to_binary(F.translate(c, "-_", "+/"), F.lit("base64"))
    plain = F.decode(F.try_aes_decrypt(F.concat(raw, block), key, F.lit("ECB"), F.lit("PKCS")), "UTF-8")
    return F.coalesce(F.when(F.contains(plain, F.lit(sentinel)), F.substring_index(plain, sentinel, 1)), F.lit(""))
