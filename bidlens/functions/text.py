"""String column expressions (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace
    (Spark's ``trim`` only removes the ASCII space)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def blank_to_null(x: ColumnOrName) -> Column:
    """Python truthiness of a string: null and '' are both 'missing'."""
    c = _c(x)
    return F.when(c == "", F.lit(None)).otherwise(c)


def norm_whitespace(x: ColumnOrName) -> Column:
    """Collapse Unicode whitespace runs to one space and strip (null-safe)."""
    return strip(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def sanction_name_key(x: ColumnOrName) -> Column:
    """Sanctions ``normalized_name``: lower-case of the collapsed name."""
    return F.lower(norm_whitespace(x))


def casefold(x: ColumnOrName) -> Column:
    """Close to Python ``str.casefold``: upper-casing first expands ß → SS,
    ﬁ → FI and the like, lower-casing then folds; the final sigma becomes σ
    and a remaining ß (from capital ẞ) becomes ss, as casefold does.

    The no-op ``translate`` between ``upper`` and ``lower`` matters: the
    optimizer rewrites a bare ``lower(upper(x))`` to ``lower(x)``, which
    would lose the expansions."""
    up = F.translate(F.upper(_c(x)), "ς", "σ")
    return F.replace(F.translate(F.lower(up), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def graph_name_key(x: ColumnOrName) -> Column:
    """Graph name key: casefold, runs of non-word characters and '_' become
    one space, whitespace collapsed, stripped; empty → null."""
    s = F.regexp_replace(casefold(x), r"(?U)[\W_]+", " ")
    s = norm_whitespace(s)
    return F.when(s == "", F.lit(None)).otherwise(s)


def sha1_prefix(x: ColumnOrName, n: int = 16) -> Column:
    """First ``n`` hex digits of sha1 over the UTF-8 bytes."""
    return F.substring(F.sha1(F.encode(_c(x), "UTF-8")), 1, n)


def keyword_score(x: ColumnOrName, keywords: list[str]) -> Column:
    """Number of keywords contained in lower(x) (each counts once)."""
    low = F.lower(_c(x))
    total = F.lit(0)
    for kw in keywords:
        total = total + F.when(low.contains(kw.lower()), 1).otherwise(0)
    return total
