"""Column functions on message texts: sentiment, rephrasing, redaction, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word boundaries as ASCII look-arounds (fixed values: the phrases).
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
POSITIVE = "thanks?|thank you|thankyou|perfect|great|awesome|nice|excellent|beautiful|love it|lgtm|(?:that|it) works|works (?:now|great|perfectly)|exactly|that'?s correct|nailed it|ship it|well done|good job"
NEGATIVE = "nope|wrong|incorrect|not right|that's not|thats not|still (?:broken|failing|not|wrong)|doesn'?t work|does not work|didn'?t work|broken|revert|undo|rollback|that broke|you broke|not what i|isn'?t what"
NO_LEAD = r"^[ \t\r\n]*no(?:[ \t\r\n]*$|[,.!]|[ \t\r\n]+thanks?(?![A-Za-z0-9_]))"
REPHRASE_LEAD = r"^[ \t\r\n]*(?:no,|actually,|i meant|i said|to be clear|let me rephrase|what i (?:meant|want)|try again|again,|instead,)"


def sentiment(text: Column) -> Column:
    """negative, positive or neutral; negative wins."""
    return (
        F.when(text.rlike(f"(?i)(?:{NO_LEAD}|{_L}(?:{NEGATIVE}){_R})"), "negative")
        .when(text.rlike(f"(?i){_L}(?:{POSITIVE}){_R}"), "positive")
        .otherwise("neutral")
    )


def token_set(text: Column) -> Column:
    """Distinct runs of three or more of a-z and 0-9, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), 1))


def is_rephrase(text: Column, before: Column) -> Column:
    """A leading phrase of rewording, or 60 % of the smaller token set (3 or more) shared with the text before."""
    a, b = token_set(text), token_set(F.coalesce(before, F.lit("")))
    least = F.least(F.size(a), F.size(b))
    return text.rlike(f"(?i){REPHRASE_LEAD}") | ((least >= 3) & (F.size(F.array_intersect(a, b)) >= 0.6 * least))


#: Order matters (fixed values: the shapes).
SECRETS = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("openrouter-key", r"sk-or-v1-[a-f0-9]{64}"),
    ("openai-key", r"sk-[A-Za-z0-9_-]{20,}"),
    ("github-token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("aws-key", r"AKIA[0-9A-Z]{16}"),
    ("slack-token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("google-api-key", r"AIza[0-9A-Za-z_-]{35}"),
    ("npm-token", r"npm_[A-Za-z0-9]{36}"),
    ("huggingface-token", r"hf_[A-Za-z0-9]{34,}"),
    ("bearer", r"(?<=Bearer\s)[A-Za-z0-9._~+/=-]{16,}"),
)


def redact_paths(text: Column) -> Column:
    """User names in home paths, also where the path is written with dashes."""
    out = F.regexp_replace(text, r"/(Users|home)/([^/\s]+)", "/$1/[redacted]")
    for folder in ("Users", "home"):
        out = F.regexp_replace(out, rf"(-{folder}-)([^-\s/]+)(?=[-/\s]|$)", "$1[redacted]")
    return out


def redact_secrets(text: Column) -> Column:
    for kind, shape in SECRETS:
        text = F.regexp_replace(text, shape, f"[REDACTED:{kind}]")
    return text


def redact(text: Column) -> Column:
    """User names in home paths, then secrets by shape."""
    return redact_secrets(redact_paths(text))


def path_users(text: Column) -> Column:
    """Distinct user names of home paths in a text; names under four characters are too common as words."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"/(?:Users|home)/([^/\s]+)"), 1))
    return F.filter(names, lambda n: (F.length(n) >= 4) & (n != "[redacted]"))


def redact_users(text: Column, names: Column) -> Column:
    """Mentions of the names by themselves; names: an array."""
    quoted = lambda n: F.concat(F.lit(r"(?<![A-Za-z0-9_-])\Q"), n, F.lit(r"\E(?![A-Za-z0-9_-])"))
    return F.aggregate(names, text, lambda t, n: F.regexp_replace(t, quoted(n), F.lit("[redacted]")))


def compact_path(path: Column) -> Column:
    """A path for people: its home folder as ~, user names left out."""
    safe = redact_paths(path)
    rest = F.regexp_extract(safe, r"^/(?:Users|home)/[^/]+/(.+)$", 1)
    return F.when(rest != "", F.concat(F.lit("~/"), rest)).otherwise(safe)


def redacted_with_report(text: Column) -> Column:
    """(text, secrets, paths): secrets first, then paths, and whether each layer changed the text."""
    safe = redact_secrets(text)
    both = redact_paths(safe)
    return F.struct(both.alias("text"), (safe != text).alias("secrets"), (both != safe).alias("paths"))


def mcp_server(tool: Column) -> Column:
    """Second part of a tool name mcp__server__tool, else null."""
    return F.when(tool.startswith("mcp__"), F.split_part(tool, F.lit("__"), F.lit(2)))


def project_path(folder: Column) -> Column:
    """A folder name with - for / (and -- for /.) as a path."""
    return F.regexp_replace(F.regexp_replace(folder, "--", "/."), "-", "/")
