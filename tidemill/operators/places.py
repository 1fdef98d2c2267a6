"""Places in posts: one automaton of all names, built once in each task, and votes for a region.

Names of regions, districts and landmarks are looked for at the beginnings of words in one pass over the folded text. Where names
overlap the longest counts, then the first. Accounts, addresses of mail and pages are no places, and a region's name before
a word for a street is a street. The region with most mentions wins, ties go to the first; regions of more than one area make
a post ``many``, areas being regions or groups of them. The district is the first one named of the region that won.

Rules come as a table (``Places``), by hand, so they are sent with the function. Defined results: a null or empty text, or one without
a name, has no region; a name that two entries share counts for the first; an entry without letters is ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from tidemill.functions.text import fold

FOUND = StructType([StructField("region", StringType()), StructField("regions", ArrayType(StringType())), StructField("district", StringType()), StructField("remote", BooleanType()), StructField("n", LongType())])
_NO_PLACE = re.compile(r"\S*@\S+|(?:https?://|www\.)\S*|\S+\.[a-z]{2,}/\S*")


@dataclass(frozen=True)
class Places:
    """Names (folded, region, district or none), words for streets, of remote work and of work on site, and areas of several regions."""

    names: tuple[tuple[str, str, str | None], ...]
    streets: tuple[str, ...] = ()
    remote: tuple[str, ...] = ()
    on_site: tuple[str, ...] = ()
    areas: tuple[tuple[str, str], ...] = ()  # region, its area
    many: str = "many"


def _starts_word(text: str, at: int) -> bool:
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "'")


class Finder:
    def __init__(self, places: Places):
        self.places, self.area = places, dict(places.areas)
        self.names = ahocorasick.Automaton()
        for k, (name, region, district) in enumerate(places.names):
            if any(c.isalpha() for c in name) and not self.names.exists(name):
                self.names.add_word(name, (k, len(name), region, district))
        if len(self.names):
            self.names.make_automaton()
        street = "|".join(map(re.escape, places.streets))
        self.street = re.compile(rf"\w*\s*(?:{street})") if street else None

    def mentions(self, text: str) -> list[tuple[int, str, str | None]]:
        """(place in the text, region, district) of the names that count, in order."""
        if not len(self.names):
            return []
        plain = _NO_PLACE.sub(lambda m: " " * len(m[0]), text)
        met = [(end - n + 1, n, region, district) for end, (_, n, region, district) in self.names.iter(plain) if _starts_word(plain, end - n + 1)]
        taken, out = bytearray(len(plain)), []
        for at, n, region, district in sorted(met, key=lambda m: (-m[1], m[0])):
            if any(taken[at : at + n]) or district is None and self.street and self.street.match(plain, at + n):
                continue
            taken[at : at + n] = b"\x01" * n
            out.append((at, region, district))
        return sorted(out, key=lambda m: m[0])

    def find(self, text: str | None) -> dict:
        found = self.mentions(text or "")
        regions = list(dict.fromkeys(r for _, r, _ in found))
        votes, areas = Counter(r for _, r, _ in found), {self.area.get(r, r) for r in regions}
        region = self.places.many if len(areas) > 1 else max(regions, key=lambda r: votes[r], default=None)  # the first of the most
        district = next((d for _, r, d in found if d and r == region), None)
        return {"region": region, "regions": regions, "district": district, "remote": any(map(self._is_remote, (text or "").split("\n"))), "n": len(found)}

    def _is_remote(self, line: str) -> bool:
        def has(words: tuple[str, ...]) -> bool:
            return any(_starts_word(line, m.start()) for w in words for m in re.finditer(re.escape(w), line))

        return has(self.places.remote) and not has(self.places.on_site)


@cache
def _finder(places: Places) -> Finder:
    return Finder(places)


def places_of(text: Column, places: Places) -> Column:
    """``struct<region, regions, district, remote, n>`` of a post."""

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = _finder(places)
        for texts in batches:
            yield pd.DataFrame([finder.find(t) for t in texts], columns=FOUND.names)

    return run(fold(text))
