"""Ordered replacement rules, said once and rendered twice: as Spark columns and as SQL.

A rule replaces ``core`` where the characters beside it allow it. As a column the neighbours are looked at
without being taken (look-around); SQL dialects without look-around take them and put them back, twice, so
that two places that share a neighbour are both met.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a word, for boundaries.
WORD = r"\p{L}\p{N}_"


@dataclass(frozen=True)
class Rule:
    """``core`` (with groups) becomes ``new`` (``{1}`` is a group); ``before``/``after`` and ``not_before``/``not_after`` are character
    classes of the neighbours that must or must not be there (the end of the text is no character)."""

    core: str
    new: str
    not_before: str = ""
    before: str = ""
    not_after: str = ""
    after: str = ""
    ignore_case: bool = False

    def column(self, c: Column) -> Column:
        look = f"(?<![{self.not_before}])" if self.not_before else f"(?<=[{self.before}])" if self.before else ""
        ahead = f"(?![{self.not_after}])" if self.not_after else f"(?=[{self.after}])" if self.after else ""
        new = re.sub(r"\{(\d)\}", r"$\1", self.new)
        return F.regexp_replace(c, ("(?iu)" if self.ignore_case else "") + look + self.core + ahead, new)

    def sql(self, text: str) -> str:
        groups = re.compile(self.core).groups
        left = f"(^|[^{self.not_before}])" if self.not_before else f"([{self.before}])" if self.before else "()"
        right = f"($|[^{self.not_after}])" if self.not_after else f"([{self.after}])" if self.after else "()"
        pattern = (("(?i)" if self.ignore_case else "") + left + self.core + right).replace("'", "''")
        new = r"\1" + re.sub(r"\{(\d)\}", lambda m: "\\" + str(int(m.group(1)) + 1), self.new).replace("'", "''") + "\\" + str(groups + 2)
        once = lambda t: f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
        return once(once(text)) if self.not_before or self.before or self.not_after or self.after else once(text)


def apply_rules(c: Column, rules: tuple[Rule, ...]) -> Column:
    """All rules, in order."""
    return reduce(lambda x, r: r.column(x), rules, c)


def rules_sql(text: str, rules: tuple[Rule, ...]) -> str:
    """The same as an SQL expression."""
    return reduce(lambda x, r: r.sql(x), rules, text)
