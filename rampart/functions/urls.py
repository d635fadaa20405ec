"""URL decoding and attack predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for the same results.
# Attack classes in their declared order, each with its search pattern
# (case-insensitive search anywhere in the decoded URL), and the label
# written when no class matches.
ATTACK_PATTERNS = [
    ("SQL Injection", r"('|--|;|\/\*|\*\/|UNION|SELECT|DROP|INSERT|UPDATE|DELETE|%27|%23|%3B)"),
    ("XSS", r"(<script>|%3Cscript|%3C\/script|<img|%3Cimg|javascript:|%3C|%3E)"),
    ("LFI", r"(\/etc\/passwd|\/etc\/shadow|\/proc\/self|\.\/|\/\.\.|\/%2e\/|%2f%2e%2e%2f)"),
    ("RFI", r"(http:\/\/|https:\/\/|ftp:\/\/|%3A%2F%2F)"),
    ("Command Injection", r"(\||;|&|>|<|`|\\|%7C|%3B|%26|%3E|%3C|%60|%5C)"),
    ("Directory Traversal", r"(\.\.\/|\.\.\\|%2e%2e%2f|%2e%2e%5c)"),
]
NO_ATTACK = "Aucune"
ATTACK_SEPARATOR = ", "
# ---------------------------------------------------------------------------

ATTACK_NAMES = [n for n, _ in ATTACK_PATTERNS]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Percent-encoded bytes that are no well-formed UTF-8, one maximal part at a
# time (Unicode's table of well-formed byte sequences): what precedes it in
# group 1 is anything well-formed, then comes the longest beginning of a
# sequence that breaks off, or a byte that cannot begin one.  Possessive
# groups, so that no length of URL overflows the stack.
def _bytes(*ranges: str) -> str:
    """A percent-encoded byte whose two hex digits match one of the patterns."""
    return "(?:%(?:" + "|".join(ranges) + "))"


_TAIL = _bytes("[89AB][0-9A-F]")
_STARTS = [                                       # first byte, second byte, further bytes
    (_bytes("C[2-9A-F]", "D[0-9A-F]"), _TAIL, 0),
    (_bytes("E0"), _bytes("[AB][0-9A-F]"), 1),
    (_bytes("E[1-9A-CEF]"), _TAIL, 1),
    (_bytes("ED"), _bytes("[89][0-9A-F]"), 1),
    (_bytes("F0"), _bytes("[9AB][0-9A-F]"), 2),
    (_bytes("F[1-3]"), _TAIL, 2),
    (_bytes("F4"), _bytes("8[0-9A-F]"), 2),
]
_WHOLE = "|".join(a + b + _TAIL * n for a, b, n in _STARTS)
_BROKEN = "|".join([*(a + b + _TAIL + "{0,%d}" % (n - 1) for a, b, n in _STARTS if n), _bytes("[89A-F][0-9A-F]")])
ILL_FORMED = rf"(?i)\G((?:[^%]++|%(?![89A-F][0-9A-F])|{_WHOLE})*+)(?:{_BROKEN})"
REPLACEMENT = "%EF%BF%BD"                          # U+FFFD


def percent_decode(url) -> Column:
    """One pass of ``%XX`` decoding as ``urllib.parse.unquote`` does it.

    ``+`` stays ``+`` and a ``%`` not followed by two hex digits stays as it
    is; both are escaped first because Java's decoder treats them otherwise.
    Of bytes that are not UTF-8, every maximal part that breaks off becomes
    one U+FFFD.
    """
    u = _c(url)
    esc = F.regexp_replace(F.regexp_replace(u, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.try_url_decode(F.regexp_replace(esc, ILL_FORMED, "$1" + REPLACEMENT))


def attack_flag(decoded, name: str) -> Column:
    """Search of one class's pattern; ``(?iu)`` folds case like Python does."""
    pattern = dict(ATTACK_PATTERNS)[name]
    return _c(decoded).rlike("(?iu)" + pattern)


def attack_flags(decoded) -> list[Column]:
    return [attack_flag(decoded, n) for n in ATTACK_NAMES]


def attack_map(flags: list[Column]) -> Column:
    """``MAP<STRING,BOOLEAN>`` of all classes, in declared order."""
    kv = []
    for name, f in zip(ATTACK_NAMES, flags):
        kv += [F.lit(name), f]
    return F.create_map(*kv)


def attack_types(flags: list[Column]) -> Column:
    """Names of the matching classes joined by ``, ``, else ``Aucune``."""
    joined = F.concat_ws(ATTACK_SEPARATOR, *[F.when(f, F.lit(n)) for n, f in zip(ATTACK_NAMES, flags)])
    return F.when(joined == "", F.lit(NO_ATTACK)).otherwise(joined)


def any_attack(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def critical_alert(flags: list[Column], status) -> Column:
    """Some class matched and the status starts with ``2``."""
    return any_attack(flags) & F.coalesce(_c(status), F.lit("")).startswith("2")
