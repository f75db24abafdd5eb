"""Type IIB enzymes: recognition sites with their flanks, as regular expressions for either strand."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# Id, name and site of each enzyme. A number stands for so many bases of any kind, brackets for a choice.
SITES = (
    (1, "CspCI", "11 CAA 5 GTGG 10"),
    (2, "AloI", "7 GAAC 6 TCC 7"),
    (3, "BsaXI", "9 AC 5 CTCC 7"),
    (4, "BaeI", "10 AC 4 GTA[CT]C 7"),
    (5, "BcgI", "10 CGA 6 TGC 10"),
    (6, "CjeI", "8 CCA 6 GT 9"),
    (7, "PpiI", "7 GAAC 5 CTC 8"),
    (8, "PsrI", "7 GAAC 6 TAC 7"),
    (9, "BplI", "8 GAG 5 CTC 8"),
    (10, "FalI", "8 AAG 5 CTT 8"),
    (11, "Bsp24I", "8 GAC 6 TGG 7"),
    (12, "HaeIV", "7 GA[CT] 5 [AG]TC 9"),
    (13, "CjePI", "7 CCA 7 TC 8"),
    (14, "Hin4I", "8 GA[CT] 5 [GAC]TC 8"),
    (15, "AlfI", "10 GCA 6 TGC 10"),
    (16, "BslFI", "6 GGGAC 14"),
)

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def _tokens(site: str) -> list[str]:
    """Bases of a site, one regular expression for each position."""
    out = []
    for part in site.split():
        out += ["[ACGT]"] * int(part) if part.isdigit() else re.findall(r"\[[ACGT]+\]|[ACGT]", part)
    return out


def _turned(tokens: list[str]) -> list[str]:
    """The other strand's positions, from its own start."""
    return ["[" + "".join(sorted(t.strip("[]").translate(COMPLEMENT))) + "]" if "[" in t else t.translate(COMPLEMENT) for t in reversed(tokens)]


def _anchored(tokens: list[str]) -> str:
    """A zero-length match where the site's first fixed bases lie, with the whole window as group 1: nearly all offsets fail at one base."""
    start = next(i for i, t in enumerate(tokens) if t != "[ACGT]")
    end = next(i for i in range(start, len(tokens) + 1) if i == len(tokens) or tokens[i] == "[ACGT]")
    return f"(?={''.join(tokens[start:end])})(?<=(?=({_regex(tokens)})).{{{start}}})"


def _regex(tokens: list[str]) -> str:
    out, i = [], 0
    while i < len(tokens):
        k = i
        while k < len(tokens) and tokens[k] == tokens[i]:
            k += 1
        out.append(tokens[i] if k - i == 1 else f"{tokens[i]}{{{k - i}}}")
        i = k
    return "".join(out)


@dataclass(frozen=True)
class Enzyme:
    id: int
    name: str
    site: str

    @cached_property
    def tag_length(self) -> int:
        return len(_tokens(self.site))

    @cached_property
    def forward(self) -> str:
        return _regex(_tokens(self.site))

    @cached_property
    def reverse(self) -> str:
        """The same site read on the other strand."""
        return _regex(_turned(_tokens(self.site)))

    @cached_property
    def anchored(self) -> tuple[str, ...]:
        """One anchored expression for each strand on which the site reads differently."""
        site = _tokens(self.site)
        return tuple(dict.fromkeys(map(_anchored, (site, _turned(site)))))

    @cached_property
    def either(self) -> str:
        return self.forward if self.forward == self.reverse else f"{self.forward}|{self.reverse}"


ENZYMES = tuple(Enzyme(*s) for s in SITES)
_BY_NAME = {e.name.lower(): e for e in ENZYMES} | {str(e.id): e for e in ENZYMES}


def enzyme(key: str | int | Enzyme) -> Enzyme:
    """An enzyme by name (in any case) or id."""
    if isinstance(key, Enzyme):
        return key
    found = _BY_NAME.get(str(key).strip().lower())
    if found is None:
        raise ValueError(f"unknown enzyme {key!r}; known: {', '.join(e.name for e in ENZYMES)}")
    return found


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e.id, e.name, e.tag_length, e.forward, e.reverse) for e in ENZYMES], "id INT, name STRING, tag_length INT, fwd STRING, rev STRING")
