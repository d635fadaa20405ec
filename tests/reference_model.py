"""Plain-Python statements of the behaviour rampart reproduces.

Written from the survey's description of the reference's semantics, for
differential tests: these run row by row on small inputs only.
"""

from __future__ import annotations

import re
import urllib.parse
from datetime import datetime

# The tokenizer and attack patterns as the reference states them.
TOKEN_RE = re.compile(r'"(?:\\.|[^\\"])*"|\S+')
ATTACKS = [
    ("SQL Injection", re.compile(r"('|--|;|\/\*|\*\/|UNION|SELECT|DROP|INSERT|UPDATE|DELETE|%27|%23|%3B)", re.I)),
    ("XSS", re.compile(r"(<script>|%3Cscript|%3C\/script|<img|%3Cimg|javascript:|%3C|%3E)", re.I)),
    ("LFI", re.compile(r"(\/etc\/passwd|\/etc\/shadow|\/proc\/self|\.\/|\/\.\.|\/%2e\/|%2f%2e%2e%2f)", re.I)),
    ("RFI", re.compile(r"(http:\/\/|https:\/\/|ftp:\/\/|%3A%2F%2F)", re.I)),
    ("Command Injection", re.compile(r"(\||;|&|>|<|`|\\|%7C|%3B|%26|%3E|%3C|%60|%5C)", re.I)),
    ("Directory Traversal", re.compile(r"(\.\.\/|\.\.\\|%2e%2e%2f|%2e%2e%5c)", re.I)),
]


def parse_marker(line: str):
    """Parsed dict, or a reject reason string."""
    i = line.find("RemoteAddress=")
    s = line[i:] if i >= 0 else ""
    toks = TOKEN_RE.findall(s)
    if not toks:
        return "no_marker"
    if len(toks) > 18:
        return "too_many"
    if len(toks) < 17:
        return "too_few"
    try:
        t = datetime.strptime(re.sub(r"^TimeLocal=", "", toks[2]), "%d/%b/%Y:%H:%M:%S")
    except ValueError:
        return "bad_time"
    return {"RemoteAddress": re.sub(r"^RemoteAddress=", "", toks[0]), "RemoteUser": toks[1],
            "TimeLocal": t, "Request": toks[4], "URL": toks[5], "Version": toks[6], "Status": toks[7],
            "BodyBytesSent": toks[8], "Referer": toks[9], "UserAgent": toks[10], "token": toks[16]}


def classify(url: str | None, status: str | None):
    decoded = urllib.parse.unquote(url or "")
    hits = [name for name, rx in ATTACKS if rx.search(decoded)]
    types = ", ".join(hits) if hits else "Aucune"
    critical = bool(hits) and (status or "").startswith("2")
    return decoded, types, critical


def clean(s: str) -> str:
    return "".join(c for c in s if 32 <= ord(c) <= 126 or c in "\n\r\t")


def wrap(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


# Our combined-log rules (not the reference's, which rejected standard lines).
COMBINED_RE = re.compile(r'^(\S+) (\S+) (\S+) \[([^\]]*)\] "((?:[^"\\]|\\.)*+)" (\S+) (\S+)'
                         r' "((?:[^"\\]|\\.)*+)" "((?:[^"\\]|\\.)*+)"', re.S)
METHODS = {"GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"}


def parse_combined(line: str):
    m = COMBINED_RE.match(line)
    if not m:
        return "malformed"
    g = m.groups()
    try:
        status = int(g[5])
    except ValueError:
        return "bad_status"
    try:
        size = int(g[6])
    except ValueError:
        return "bad_size"
    try:
        t = datetime.strptime(g[3], "%d/%b/%Y:%H:%M:%S %z")
    except ValueError:
        return "bad_time"
    parts = g[4].split(" ")
    known = parts[0] in METHODS
    path = re.sub(r"\\(.)", r"\1", parts[1] if len(parts) > 1 else "") if known else ""
    return {"remote_addr": g[0], "remote_user": g[2], "time_local": int(t.timestamp()),
            "request_type": parts[0] if known else "", "request_path": path,
            "request_protocol": (parts[2] if len(parts) > 2 else "") if known else "",
            "status": status, "size": size, "referer": g[7], "user_agent": g[8]}
