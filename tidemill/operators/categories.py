"""Category and profession of a post by words, from one automaton of all words, built once in each task.

A word counts 3 where the title holds it and 1 where the text does, once. A profession has the sum of its words, a category that of
its professions; the best profession of the best category wins, ties go to what is named first. Words begin at a word's beginning and may have any ending.

Defined results: without a word the category is ``other`` and there is no profession; null texts hold no words; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

TITLE, TEXT = 3, 1
VOTE = StructType([StructField("category", StringType()), StructField("profession", StringType()), StructField("score", LongType())])
#: (word in its folded form, profession, category).
Words = tuple[tuple[str, str, str], ...]


class Voter:
    def __init__(self, words: Words, fallback: str):
        self.fallback, self.names = fallback, ahocorasick.Automaton()
        held: dict[str, list[tuple[str, str]]] = {}
        for word, profession, category in words:
            held.setdefault(word, []).append((profession, category))
        for word, owners in held.items():
            self.names.add_word(word, (word, owners))
        if len(self.names):
            self.names.make_automaton()

    def _hits(self, text: str) -> dict[str, int]:
        """Words of a text with the place of their first occurrence."""
        out: dict[str, int] = {}
        for end, (word, _) in self.names.iter(text) if len(self.names) else ():
            at = end - len(word) + 1
            if at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "'"):
                out.setdefault(word, at)
        return out

    def vote(self, title: str | None, text: str | None) -> tuple[str, str | None, int]:
        in_title, in_text = self._hits(title or ""), self._hits(text or "")
        score: dict[tuple[str, str], list[int]] = {}
        for word in {**in_title, **in_text}:
            points = TITLE if word in in_title else TEXT
            # what the title names comes before the text
            at = in_title.get(word, 0) if word in in_title else in_text[word] + len(title or "") + 1
            for owner in self.names.get(word)[1]:
                s = score.setdefault(owner, [0, at])
                s[0], s[1] = s[0] + points, min(s[1], at)
        if not score:
            return self.fallback, None, 0
        by_category: dict[str, list[int]] = {}
        for (_, category), (points, at) in score.items():
            c = by_category.setdefault(category, [0, at])
            c[0], c[1] = c[0] + points, min(c[1], at)
        category = min(by_category, key=lambda c: (-by_category[c][0], by_category[c][1], c))
        profession = min((o for o in score if o[1] == category), key=lambda o: (-score[o][0], score[o][1], o))[0]
        return category, profession, by_category[category][0]


@cache
def _voter(words: Words, fallback: str) -> Voter:
    return Voter(words, fallback)


def category_of(title: Column, text: Column, words: Words, fallback: str = "other") -> Column:
    """``struct<category, profession, score>`` of a post from its folded title and text."""

    @F.pandas_udf(VOTE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        voter = _voter(words, fallback)
        for titles, texts in batches:
            yield pd.DataFrame([voter.vote(a, b) for a, b in zip(titles, texts, strict=True)], columns=VOTE.names)

    return run(title, text)
