"""Courts, their ranks and legal terms of the three jurisdictions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


@dataclass(frozen=True)
class Jurisdiction:
    code: str
    name: str
    courts: tuple[str, ...]
    aliases: dict[str, str]
    terms: frozenset[str]

    def is_legal_term(self, word: str) -> bool:
        return word.lower() in self.terms

    def legal_term(self, word: Column) -> Column:
        return F.lower(word).isin(*sorted(self.terms))

    def court_level(self, court: Column) -> Column:
        """Rank from 0, the highest; unknown courts come after all known ones."""
        low = F.lower(F.trim(court))
        named = reduce(lambda rest, a: F.when(low == a.lower(), F.lit(self.aliases[a].lower())).otherwise(rest), self.aliases, low)
        level = F.lit(len(self.courts))
        for k in reversed(range(len(self.courts))):
            level = F.when(F.contains(named, F.lit(self.courts[k].lower())), F.lit(k)).otherwise(level)
        if self.code == "us":
            at = self.courts.index
            level = (
                F.when(court.rlike(r"\bCir\."), F.lit(at("Court of Appeals"))).when(court.rlike(r"\bBankr\."), F.lit(at("Bankruptcy Court")))
                .when(F.trim(court).rlike(r"^(?:[CEMNSW]\.)?D\.\s?[A-Z][\s.\w]*\z"), F.lit(at("District Court"))).otherwise(level)
            )
        return level


ALL = {c: Jurisdiction(c, name, tuple(fixed.COURT_RANKS[c]), fixed.COURT_ALIASES[c], frozenset(fixed.JURISDICTION_TERMS[c])) for c, name in fixed.JURISDICTION_NAMES.items()}


def jurisdiction(code: str) -> Jurisdiction:
    if code.lower() not in ALL:
        raise ValueError(f"unknown jurisdiction {code!r}: one of {', '.join(ALL)}")
    return ALL[code.lower()]
