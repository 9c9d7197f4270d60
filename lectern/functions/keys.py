"""Forms in which keys and titles are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of any kind, in the syntax that Java's and RE2's engines share.
BLANK = r"[\s\p{Z}]"


def key_form(c: Column | str) -> Column:
    """Lower case, without blanks at the ends and without one trailing '#'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, rf"^{BLANK}+|{BLANK}*#?{BLANK}*$", ""))


def title_form(c: Column | str) -> Column:
    """Lower case, runs of blanks as one space, none at the ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.regexp_replace(c, rf"{BLANK}+", " ")))
