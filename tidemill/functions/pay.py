"""Pay in messy texts: typed tokens of a block of text, and an automaton that reads amounts off them, in Arrow batches.

A block is the value of a pay label with the lines that belong to it, or, where no label gives an amount, a line that names money.
The blocks of a text are read as one sequence. What reading one token does depends on the amount that is open:

- a number opens an amount; a multiplier that touches it scales it where it is small enough for that;
- a bound before it ("from", "up to") or after it and its units ("+", "-dan", "-gacha") makes it one side of a range;
- a number that counts hours, years of age, days or people, clock times, shares, years and shifts such as 6/1 are no amounts.

Then neighbours lend each other what was left out: the multiplier of a range's end, its zeros, or the size of a number whose
groups are not of three digits. All amounts together give the least and the greatest. Words are a table, so a caller may
pass other ones; texts are matched in their folded form (lower case, Latin letters).

Defined results: null where a text has no block; no numbers, but the text of the blocks, where nothing is read or a number is
not sane for its currency and period; a text of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tidemill.functions import text as forms

#: Sane amounts by currency and period, and the period of pay that names none.
SANE = {
    "UZS": {"month": (500_000, 200_000_000), "week": (100_000, 50_000_000), "day": (30_000, 5_000_000), "hour": (5_000, 1_000_000)},
    "USD": {"month": (50, 30_000), "week": (20, 10_000), "day": (5, 1_000), "hour": (1, 200)},
    "EUR": {"month": (50, 30_000), "week": (20, 10_000), "day": (5, 1_000), "hour": (1, 200)},
    "RUB": {"month": (5_000, 2_000_000)},
}
USUAL_PERIOD, LONGEST_SHOWN = "month", 255
#: Words whose meaning a task keeps.
KNOWN_WORDS = 20_000
_NONE = {"lo": None, "hi": None, "currency": None, "period": None, "text": None, "negotiable": False}
_ARROW = pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("currency", pa.string()), ("period", pa.string()), ("text", pa.string()), ("negotiable", pa.bool_())])
SHAPE = StructType([StructField(n, t) for n, t in (("lo", LongType()), ("hi", LongType()), ("currency", StringType()), ("period", StringType()), ("text", StringType()), ("negotiable", BooleanType()))])


@dataclass(frozen=True)
class Words:
    """What words mean, in folded form. A word counts for what it begins with where its entry ends in ``*``."""

    labels: tuple[str, ...] = ("oylik maosh", "kunlik maosh", "ish haqi", "maosh", "oylik", "kunlik", "haftalik", "salary", "pay", "wage", "zarplata", "oklad", "oplata")
    #: Multiplier, and the number from which on it is not meant.
    multipliers: dict[str, tuple[int, int]] = field(default_factory=lambda: {"mln*": (1_000_000, 1000), "million*": (1_000_000, 1000), "m": (1_000_000, 1000), "ming*": (1000, 10_000), "k": (1000, 10_000), "tys*": (1000, 10_000), "mlrd*": (1_000_000_000, 100)})
    currencies: dict[str, str] = field(default_factory=lambda: {"so'm*": "UZS", "som": "UZS", "sum": "UZS", "uzs": "UZS", "$": "USD", "usd": "USD", "dollar*": "USD", "€": "EUR", "eur": "EUR", "evro": "EUR", "euro": "EUR", "₽": "RUB", "rub": "RUB", "rubl*": "RUB"})
    periods: dict[str, str] = field(default_factory=lambda: {"soatbay": "hour", "soatiga": "hour", "soatlik": "hour", "hourly": "hour", "kunlik": "day", "kuniga": "day", "kunbay": "day", "daily": "day", "haftalik": "week", "haftasiga": "week", "weekly": "week", "oylik": "month", "oyiga": "month", "monthly": "month"})
    #: Units of time that make a period after a slash or one of these words.
    per: tuple[str, ...] = ("/", "per", "a", "an", "v", "za", "bir")
    per_units: dict[str, str] = field(default_factory=lambda: {"soat*": "hour", "hour": "hour", "chas": "hour", "kun*": "day", "day": "day", "den'": "day", "hafta*": "week", "week": "week", "nedelyu": "week", "oy": "month", "month": "month", "mesyats": "month"})
    #: What small numbers count that are no pay, and what a year is followed by.
    counted: tuple[str, ...] = ("yosh*", "yil*", "oy", "oyga", "oyda", "oydan", "kun*", "soat*", "hafta*", "smena*", "mahal*", "marta*", "nafar*", "kishi*", "let", "year*", "month*", "day*", "hour*", "ta", "x", "kurs*", "sinf*")
    years: tuple[str, ...] = ("yil*", "god*", "year*")
    from_before: tuple[str, ...] = ("ot", "from", "min", "minimum", "kamida", "at least", "starting")
    to_before: tuple[str, ...] = ("do", "up to", "upto", "max", "maximum", "until")
    from_after: tuple[str, ...] = ("+", "dan", "va undan", "and more", "and above")
    to_after: tuple[str, ...] = ("gacha",)
    bonus: tuple[str, ...] = ("kpi", "bonus*", "premiya*", "foiz*")
    negotiable: tuple[str, ...] = ("kelishiladi", "kelishilgan", "suhbat*", "shtat jadvali", "negotiable", "competitive")
    not_pay: tuple[str, ...] = ("depozit*", "zalog*", "ijara*", "arenda*", "deposit*")


WORDS = Words()
_TOKEN = re.compile(
    r"(?=\d)(?:(?P<clock>(?<!\d)\d{1,2}[:.]\d\d\s*[-–—]\s*\d{1,2}[:.]\d\d(?!\d)|(?<!\d)\d{1,2}:\d\d(?!\d))|(?P<share>\d++(?:[.,]\d++)?+\s*+%)|(?P<shift>(?<!\d)\d{1,2}\s*/\s*\d{1,2}(?!\d))"
    r"|(?P<number>\d+(?:[ .,]\d+)*))|(?P<word>[^\W\d_]+(?:'[^\W\d_]*)*)|(?P<sign>[$€₽+|/–—-])"
)
_DIGIT = re.compile(r"\d")
_OTHER_LABEL = re.compile(r"^[^\w$€]*[^\W\d_][^\d:|]{1,40}:")
_NEXT_VALUE = re.compile(r"[\s–—-]*(?:\d|\$|do\s|up to)")
_CLOCK_LINE = re.compile(r"\s*\d{1,2}[:.]\d\d\s*")
_SHOWN_FROM = re.compile(r"(?i)(?:\b(?:от|ot|do|до|from|up to)\s+)?[$€\d]")
_DASHES = ("-", "–", "—")
_NAMED_FIRST = ("EUR", "USD", "RUB")
_MONEY_BEFORE = ("$", "€", "usd")


class _Table:
    """Look-up of words, by the whole word, else by the longest entry with a star that it begins with."""

    def __init__(self, entries):
        pairs = entries.items() if isinstance(entries, dict) else ((e, True) for e in entries)
        self.whole, self.begin = {}, {}
        for k, v in pairs:
            (self.begin if k.endswith("*") else self.whole)[k.rstrip("*")] = v
        self.longest = sorted(self.begin, key=len, reverse=True)
        self.get = lru_cache(KNOWN_WORDS)(self._get)

    def _get(self, word: str):
        if word in self.whole:
            return self.whole[word]
        return next((self.begin[b] for b in self.longest if word.startswith(b)), None)


class _Tables:
    def __init__(self, words: Words):
        for name in ("multipliers", "currencies", "periods", "per_units", "counted", "years", "from_before", "to_before", "from_after", "to_after", "bonus", "negotiable", "not_pay"):
            setattr(self, name, _Table(getattr(words, name)))
        self.per = words.per
        self.meaning, self.told_by = lru_cache(KNOWN_WORDS)(self._meaning), lru_cache(KNOWN_WORDS)(self._told_by)
        # whether what a number before a word is makes a difference to the word
        phrases = (*words.negotiable, *words.from_before, *words.to_before, *words.from_after, *words.per)
        self.numbered = any(_DIGIT.match(x) for x in phrases)
        # characters without which a text holds no label, no word of what is no pay, no dollars, no amount of money: most texts need no closer look
        self.label_parts = tuple(dict.fromkeys(max(x.split(), key=len) for x in words.labels))
        self.not_pay_part = re.compile("|".join(re.escape(x.rstrip("*")) for x in words.not_pay) or r"(?!)")
        self.dollar_parts = tuple(x.rstrip("*") for x, c in words.currencies.items() if c == "USD")
        units = "|".join(re.escape(x.rstrip("*")) for x in (*words.currencies, *words.multipliers))
        self.money_parts = re.compile(rf"\d(?!\d)[^\S\n]*(?:{units})"), re.compile(rf"(?:{'|'.join(map(re.escape, _MONEY_BEFORE))})[^\S\n]*\d")
        label = "|".join(re.escape(x).replace(r"\ ", r"\s+") for x in sorted(words.labels, key=len, reverse=True))
        self.label = re.compile(rf"^[^\w$€]*(?P<label>{label})\s*(?:[:–—-]|$)")
        self.inside = re.compile(rf"(?<![\w'])(?P<label>{label})(?![\w'])\s*[:–—-]?\s*(?=[$€]?\s*\d|ot\s+\d|do\s+\d|from\s|up\s+to\s)")

    def suffix(self, word: str) -> tuple[str, str | None]:
        """A word without a bound at its end, and the bound, where what is left is nothing or a unit."""
        for ending, bound in (("dan", "from"), ("gacha", "to")):
            stem = word.removesuffix(ending)
            if stem != word and (not stem or self.multipliers.get(stem) or self.currencies.get(stem)):
                return stem, bound
        return "", None

    def _meaning(self, word: str, previous: str) -> tuple:
        """All that the tables tell of a word after another token."""
        phrase = f"{previous} {word}"
        stem, bound = self.suffix(word)
        period = self.periods.get(word) or (self.per_units.get(word) if previous in self.per or previous == "1" else None)
        before = "from" if self.from_before.get(word) or self.from_before.get(phrase) else "to" if self.to_before.get(word) or self.to_before.get(phrase) else None
        on = bool(self.from_after.get(phrase))
        return (
            bool(self.bonus.get(word)), bool(self.negotiable.get(word) or self.negotiable.get(phrase)), bound, period, self.currencies.get(stem or word), before,
            bool(self.years.get(word)), bool(self.counted.get(word)), self.multipliers.get(stem or word), on, on or bool(self.from_after.get(word)), bool(self.to_after.get(word)),
        )

    def _told_by(self, label: str) -> tuple[frozenset[str], bool]:
        """The periods that labels name, and whether that is all that they tell of the numbers after them."""
        r = Reader(tables=self)
        r.read(label)
        return frozenset(r.periods), not (r.amounts or r.currencies or r.bonus or r.negotiable or r.before)

    def money_lines(self, folded: str) -> list[int]:
        """Numbers of the lines that have a number beside something that may be a unit of money."""
        if not _DIGIT.search(folded):
            return []
        return _lines_at(folded, [[m.start() for m in p.finditer(folded)] for p in self.money_parts])

    def label_lines(self, folded: str) -> list[int]:
        """Numbers of the lines that may have a label."""
        return _lines_at(folded, [_places(x, folded) for x in self.label_parts if x in folded])


def _places(part: str, text: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + len(part))


def _lines_at(text: str, places: list[Iterable[int]]) -> list[int]:
    """Numbers of the lines of ordered lists of places, in order, once."""
    found = set()
    for some in places:
        line = last = 0
        for at in some:
            line, last = line + text.count("\n", last, at), at
            found.add(line)
    return sorted(found)


@cache
def _tables(words: Words | None) -> _Tables:
    return _Tables(words or WORDS)


class _Amount:
    __slots__ = ("value", "odd", "start", "end", "bound", "small", "factor", "pair")

    def __init__(self, value: float, odd: bool, start: int, end: int, bound: str | None, small: bool):
        self.value, self.odd, self.start, self.end, self.bound, self.small = value, odd, start, end, bound, small
        self.factor, self.pair = 1, None


def _number(run: str) -> tuple[float, bool]:
    """Value of digits in groups, and whether the groups are odd ones."""
    if run.isdigit():
        return float(run), False
    groups = re.split("[ .,]", run)
    if len(groups) == 2 and len(groups[1]) < 3 and run[len(groups[0])] != " ":
        return float(".".join(groups)), False
    even = len(groups) == 1 or (len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:]))
    return float("".join(groups)), not even


class Reader:
    """The automaton over one sequence of tokens."""

    def __init__(self, words: Words | None = None, tables: _Tables | None = None):
        self.t = tables or _tables(words)

    def read(self, folded: str) -> None:
        t = self.t
        self.amounts: list[_Amount] = []
        self.currencies, self.periods, self.bonus, self.negotiable = set(), set(), False, False
        self.open: _Amount | None = None  # the amount that what follows may still belong to
        self.dashed: _Amount | None = None  # the one that a dash has just ended
        self.passed, self.touching = 0, False  # words since it; whether nothing came between it and here
        self.before: str | None = None  # a bound that waits for its number
        previous, end, told = "", 0, True
        for m in _TOKEN.finditer(folded):
            kind, token, start = m.lastgroup, m[0], m.start()
            near = start == end or folded[end:start].isspace()
            end = m.end()
            if kind == "number":
                self._opened(token, start, end, previous, near)
            elif kind == "word":
                self._word(t.meaning(token, previous if told or previous == "1" or t.numbered else "0"), near)
            elif kind == "sign":
                self._sign(token)
            else:
                self.open = self.before = None
                self.bonus |= kind == "share" and previous == "+"
            self.touching = kind == "number"
            previous, told = token, kind in ("word", "sign")
        _lend(self.amounts, folded)

    def _opened(self, token: str, start: int, end: int, previous: str, near: bool) -> None:
        value, odd = _number(token)
        self.open = _Amount(value, odd, start, end, self.before, len(token) <= 2)
        if near and previous in _DASHES and self.amounts and self.amounts[-1].small and start - self.amounts[-1].end <= 4:
            self.open.pair = self.amounts[-1]
        self.amounts.append(self.open)
        self.passed, self.before, self.dashed = 0, None, None

    def _word(self, meaning: tuple, near: bool) -> None:
        bonus, negotiable, bound, period, currency, self.before, year, counted, multiplier, on, onward, below_it = meaning
        self.bonus |= bonus
        self.negotiable |= negotiable
        if period:
            self.periods.add(period)
        if currency:
            self.currencies.add(currency)
        counts = self.open if self.touching else self.dashed
        if near and counts is not None and not bound and counts.factor == 1:
            if year and counts.value in range(1900, 2100) or counts.small and counted:
                self._drop(counts)
                return
        if self.open is None:
            return
        if multiplier and self.touching and near:
            factor, below = multiplier
            if self.open.value < below:
                self.open.factor, self.open.value = factor, self.open.value * factor
        elif not currency and not bound:
            self.passed += 1
        if self.open.bound is None or bound == "from":
            self.open.bound = bound or self.open.bound
        if onward:
            self.open.bound = "from"
        elif below_it and self.open.bound is None:
            self.open.bound = "to"
        if bound or self.passed > 1 and not on:
            self.open = None

    def _sign(self, sign: str) -> None:
        currency = self.t.currencies.get(sign)
        if currency:
            self.currencies.add(currency)
            return
        self.before = None
        if sign == "+" and self.open is not None:
            self.open.bound = "from"
        if sign != "/":
            self.dashed, self.open = self.open if sign in _DASHES and self.touching else None, None

    def _drop(self, counted: _Amount) -> None:
        """This number, and the one that a dash ties to it, count something."""
        self.amounts = [a for a in self.amounts if a is not counted and a is not counted.pair]
        self.open = self.dashed = None


def _lend(amounts: list[_Amount], folded: str) -> None:
    """What a number leaves out is taken from its neighbour."""
    if len(amounts) < 2:
        return
    for a, b in zip(amounts, amounts[1:]):
        if b.factor > 1 == a.factor and a.value < 1000 and b.start - a.end <= 12:
            a.factor, a.value = b.factor, a.value * b.factor
    for a, b in zip(amounts, amounts[1:]):
        if a.factor == 1 and a.value < 1000 and b.value >= 100_000 and folded[a.end : b.start].strip() in _DASHES:
            fits = [s for s in (1_000_000, 1000) if b.value / 20 <= a.value * s <= b.value]
            if fits:
                a.factor, a.value = fits[0], a.value * fits[0]
    for i, a in enumerate(amounts):
        if a.odd:
            beside = [b for b in (*amounts[max(i - 1, 0) : i], *amounts[i + 1 : i + 2]) if not b.odd and abs(b.start - a.start) <= 30]
            if not beside or not a.value or not beside[0].value:  # nothing and a number are of no size that could be compared
                continue
            if beside[0].start < a.start:
                while a.value / 10 >= beside[0].value:
                    a.value /= 10
            else:
                while a.value * 10 <= beside[0].value:
                    a.value *= 10


def names_money(folded: str, words: Words | None = None) -> bool:
    """A number with a unit of money right after it, or a sign of money right before it."""
    if not _DIGIT.search(folded):
        return False
    t, last, at = _tables(words), "", 0
    for m in _TOKEN.finditer(folded):
        near, token = not folded[at : m.start()].strip(), m[0]
        kind = m.lastgroup
        if near and kind == "number" and last == "money":
            return True
        if near and last == "number" and kind in ("word", "sign"):
            if t.currencies.get(token) or kind == "word" and (t.multipliers.get(token) and token not in ("k", "m") or t.suffix(token)[0]):
                return True
        last = "number" if kind == "number" else "money" if kind in ("word", "sign") and t.currencies.get(token) and token in _MONEY_BEFORE else kind
        at = m.end()
    return False


def _shown(blocks: list[tuple[str, str, bool]]) -> str | None:
    """The text of blocks, of an unlabelled one from its amount on."""

    def shown(block: tuple[str, str, bool]) -> str:
        first = None if block[2] else _SHOWN_FROM.search(block[0])
        return block[0][first.start() :].strip() if first else block[0]

    return " | ".join(map(shown, blocks)).strip(" |;,")[:LONGEST_SHOWN] or None


def _amounts(blocks: list[tuple[str, str, bool]], t: _Tables) -> Reader:
    """What the automaton reads off the blocks that name nothing that is no pay."""

    told = [b[1] for b in blocks]
    if t.not_pay_part.search(" | ".join(told)):
        told = [x for x in told if not any(t.not_pay.get(m[0]) for m in _TOKEN.finditer(x) if m.lastgroup == "word")]
    reader = Reader(tables=t)
    reader.read(" | ".join(told))
    return reader


def _judged(read: Reader, label: str, usual: str) -> dict:
    """Numbers, currency and period of what was read; ``usual``: the currency where none is named."""
    if not read.amounts:
        return _NONE | {"negotiable": read.negotiable}
    periods = read.periods | read.t.told_by(label)[0]
    period = next((p for p in ("hour", "day", "week", "month") if p in periods), USUAL_PERIOD)
    currency = next((c for c in _NAMED_FIRST if c in read.currencies), usual)
    values, bounds = [a.value for a in read.amounts], {a.bound for a in read.amounts}
    lo, hi = min(values), max(values)
    if bounds == {"from"} or len(values) == 1 and bounds == {None} and read.bonus:
        hi = None
    elif bounds == {"to"}:
        lo = None
    least, most = SANE.get(currency, {}).get(period, (0, float("inf")))
    if lo is not None and not least <= lo <= most or hi is not None and not least <= hi <= most:
        return dict(_NONE)
    return {"lo": lo if lo is None else round(lo), "hi": hi if hi is None else round(hi), "currency": currency, "period": period, "text": None, "negotiable": False}


def _has_numbers(pay: dict | None) -> bool:
    return pay is not None and (pay["lo"] is not None or pay["hi"] is not None)


def pay_of_blocks(blocks: list[tuple[str, str, bool]], label: str = "", usual: str = "UZS", words: Words | None = None) -> dict | None:
    """Pay of blocks (shown text, folded text, whether labelled): numbers, currency, period, text, negotiable."""
    blocks = [b for b in blocks if b[1].strip()]
    return _judged(_amounts(blocks, _tables(words)), label, usual) | {"text": _shown(blocks)} if blocks else None


def _blocks(lines: list[str], folded: list[str], t: _Tables, maybe: list[int], most: int = 4) -> tuple[list[tuple[str, str, bool]], str]:
    """Labelled blocks of a text, and their labels, which only the lines of these numbers may have."""
    blocks, labels = [], []
    for i in maybe:
        line = folded[i]
        m = t.label.match(line)
        if m:
            value = lines[i][len(lines[i]) - len(line) + m.end() :].strip() if len(lines[i]) >= len(line) - m.end() else ""
            value = value if line[m.end() :].strip() else ""
            taken = []
            if value.strip(" .–—-"):
                taken.append((value, line[m.end() :].strip()))
                if i + 1 < len(folded) and _NEXT_VALUE.match(folded[i + 1]) and not _OTHER_LABEL.match(folded[i + 1]):
                    taken.append((lines[i + 1], folded[i + 1]))
            else:
                for k in range(i + 1, min(i + 1 + most, len(folded))):
                    if not folded[k].strip() or _OTHER_LABEL.match(folded[k]) or t.label.match(folded[k]):
                        break
                    taken.append((lines[k], folded[k]))
            labels.append(m["label"])
            blocks += [(x, y, True) for x, y in taken]
        elif m := t.inside.search(line):
            rest = line[m.end() :]
            labels.append(m["label"])
            blocks.append((lines[i][len(lines[i]) - len(rest) :] if len(lines[i]) >= len(rest) else rest, rest, True))
    return blocks, " ".join(labels)


def _read_with_label(blocks: list[tuple[str, str, bool]], label: str, folded: list[str], maybe: list[int], t: _Tables) -> list[int]:
    """The line of these that was read as the only block, where it reads no differently with its label: a line of a label that tells periods only, and a number."""
    value = blocks[0][1]
    if len(blocks) > 1 or len(maybe) != 1 or not _DIGIT.match(value) or not t.told_by(label)[1]:
        return []
    line = folded[maybe[0]]
    m = t.label.match(line)
    return maybe if m and m.start("label") == 0 and m["label"] == label and line[m.end() :].strip() == value else []


def pay_of_text(shown: str | None, folded: str | None, words: Words | None = None) -> dict | None:
    """Pay of a whole text: its labelled blocks, else lines that name money; amounts without a currency are dollars where the text names dollars and nothing else is sane."""
    t, whole = _tables(words), folded or ""
    lines, low = (shown or "").split("\n"), whole.split("\n")
    lines = lines if len(lines) == len(low) else low
    blocks, label = _blocks(lines, low, t, t.label_lines(whole))
    blocks = [b for b in blocks if b[1].strip()]
    read = _amounts(blocks, t) if blocks else None
    labelled = _judged(read, label, "UZS") if blocks else None
    if labelled:
        labelled["text"] = _shown(blocks)
        if _has_numbers(labelled):
            return labelled
    money = t.money_lines(whole)
    if blocks and money == _read_with_label(blocks, label, low, money, t):
        money = []
    named = [(lines[i], low[i], False) for i in money if names_money(low[i], words) and not _CLOCK_LINE.fullmatch(low[i])]
    loose = _judged(_amounts(named, t), "", "UZS") if named else None
    if _has_numbers(loose):
        return loose | {"text": _shown(named)}
    # a currency that is named counts before the usual one
    if labelled and read.currencies.isdisjoint(_NAMED_FIRST) and _DIGIT.search(labelled["text"] or "") and any(x in whole for x in t.dollar_parts) and any(t.currencies.get(m[0]) == "USD" for m in _TOKEN.finditer(whole)):
        dollars = _judged(read, label, "USD")
        if _has_numbers(dollars):
            return dollars | {"text": labelled["text"]}
    return labelled


def _struct(f):
    """``f`` of texts as read and folded; an ASCII text comes without its folded form, which is its lower case."""

    @F.arrow_udf(SHAPE)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for shown, folded in batches:
            yield pa.array([f(a, a.lower() if b is None else b) for a, b in zip(shown.to_pylist(), folded.to_pylist(), strict=True)], _ARROW)

    return run


def _of_value(shown: str, folded: str) -> dict | None:
    return pay_of_blocks([(shown, folded, True)]) if shown else None


_text_pay, _value_pay = _struct(pay_of_text), _struct(_of_value)


def _forms(text: Column) -> tuple[Column, Column]:
    """A text as it is shown, and its folded form where that is more than its lower case."""
    shown = forms.readable(text)
    return shown, F.when(~forms.is_plain(text), forms.lower_latin(F.lower(shown)))


def pay(text: Column) -> Column:
    """``struct<lo, hi, currency, period, text, negotiable>`` of a post; null where it has no pay block."""
    return _text_pay(*_forms(text))


def pay_once(text: Column) -> Column:
    """:func:`pay` as a column of a select that a condition may follow: a condition on a plain one is moved down with all that the column is made of, and
    every text read twice."""
    return F.explode_outer(F.array(pay(text)))


def pay_value(text: Column) -> Column:
    """The same of a text that is a value of pay as a whole."""
    return _value_pay(*_forms(text))
