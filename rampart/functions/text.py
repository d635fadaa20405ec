"""String and time column expressions used by the log parsers.

All of these are built-in Catalyst expressions, so they stay inside
whole-stage codegen; none needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "RemoteAddress="

# Tokenizer: a double-quoted run (backslash escapes anything but a newline)
# or a run of non-whitespace.  The quoted branch is possessive, so Java's
# regex engine loops instead of recursing and a 200,000-character quoted
# field cannot overflow the stack.  Whitespace is Python's ``str.isspace``
# set: with ``(?U)`` Java's ``\s`` is Unicode White_Space, which is that set
# minus the four separators \x1c-\x1f, added explicitly.  (Spelling the set
# out as code point ranges gives the same matches but runs ten times slower.)
TOKEN_PATTERN = r'(?U)"(?:\\[^\n]|[^\\"])*+"|[^\s\x1c-\x1f]+'

# Local time as written in the marker log (no zone), and with a zone.
LOCAL_TIME_FORMAT = "d/MMM/yyyy:H:m:s"
ZONED_TIME_FORMAT = "d/MMM/yyyy:H:m:s Z"

# Fixed value: first "dd/Mon/yyyy:HH:MM:SS" in a line (merge key).
EMBEDDED_TIME_PATTERN = r"\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}"

PRINTABLE_PATTERN = r"[^\x20-\x7E\n\r\t]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_marker(line) -> Column:
    """The line from its first ``RemoteAddress=`` on; ``''`` if absent."""
    at = F.instr(col(line), MARKER)
    return F.when(at > 0, F.substr(col(line), at)).otherwise(F.lit(""))


def tokens(line) -> Column:
    """Quote-aware tokens of a line, as ``ARRAY<STRING>``."""
    return F.regexp_extract_all(col(line), F.lit(TOKEN_PATTERN), F.lit(0))


def token_at(toks, n: int) -> Column:
    """Token ``n`` (0-based), null when the array is shorter."""
    return F.get(col(toks), n)


def strip_prefix(c, prefix: str) -> Column:
    return F.regexp_replace(col(c), "^" + prefix, "")


def parse_local_time(c) -> Column:
    """``d/Mon/yyyy:H:M:S`` → ``TIMESTAMP_NTZ``; null when it does not parse.

    ``try_to_timestamp`` only validates; the value comes from
    ``to_timestamp_ntz``, which never involves a zone, so the wall clock is
    kept in any session zone (also inside a DST gap).  The CASE guard keeps
    ANSI mode from raising on text that does not parse.
    """
    fmt = F.lit(LOCAL_TIME_FORMAT)
    return F.when(F.try_to_timestamp(col(c), fmt).isNotNull(), F.to_timestamp_ntz(col(c), fmt))


def parse_zoned_epoch(c) -> Column:
    """``d/Mon/yyyy:H:M:S +hhmm`` → epoch seconds, honouring the offset."""
    return F.unix_timestamp(F.try_to_timestamp(col(c), F.lit(ZONED_TIME_FORMAT)))


def ascii_clean(c) -> Column:
    """Keep printable ASCII plus newline, carriage return and tab."""
    return F.regexp_replace(col(c), PRINTABLE_PATTERN, "")


def quote_wrap(c) -> Column:
    """``"`` + value with inner quotes doubled + ``"`` (CSV export form)."""
    return F.concat(F.lit('"'), F.replace(col(c), F.lit('"'), F.lit('""')), F.lit('"'))


def export_clean(c) -> Column:
    """The reference's writer form of a string field: clean, then wrap."""
    return quote_wrap(ascii_clean(c))


def unescape_backslash(c) -> Column:
    """``\\x`` → ``x`` for every backslash-escaped character."""
    return F.regexp_replace(col(c), r"\\(.)", "$1")


def embedded_time(c) -> Column:
    """First embedded ``dd/Mon/yyyy:HH:MM:SS`` of a line → ``TIMESTAMP_NTZ``."""
    s = F.regexp_extract(col(c), EMBEDDED_TIME_PATTERN, 0)
    return F.when(s != "", parse_local_time(s))


def btrim_ws(c) -> Column:
    """Strip spaces, tabs, CR and LF at both ends (``str.strip`` on a line)."""
    return F.btrim(col(c), F.lit(" \t\r\n\f\x0b"))


def compute_once(df, keep: list, exprs: dict):
    """``df`` with ``keep`` columns plus ``exprs`` evaluated exactly once.

    The expressions come out of a one-row ``inline`` generator.  A later
    filter on them cannot be pushed below a generator, so Catalyst does not
    copy an expensive expression (a tokenizer, six regex searches) into the
    filter condition, where it would run again for every row.
    """
    packed = F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))
    return df.select(*keep, F.inline(packed))
