"""What a post is about: its title, its employer, and the positions of a list, as ranked candidates with repairs.

Every line gives candidates of a kind; a post's title is the best kind's first candidate that stands after its repairs. All is column
expressions over the post's lines (readable form, line breaks kept), so a pass over posts needs no shuffle. Rules are data (``Rules``), by
hand; words are matched with a boundary on their left, in any case.

Defined results: a null or empty text has no title, no employer and no positions; a value that is only punctuation is none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.contacts import URL, LinkRules, apply_score
from tidemill.functions.text import keyword_pattern, let

#: Most characters of a title; of a line that may be a title as a whole, and its words; lines that phrases are looked for in; words of an employer's name.
LONGEST, SHORT_LINE, SHORT_WORDS, FIRST_LINES, NAME_WORDS = 90, 60, 7, 8, 6
#: Least score of a link under words, and of a bare one, to apply; positions that make a list.
LINK, BARE_LINK, LEAST = 2, 3, 2
LINKS = "array<struct<text:string,url:string>>"


@dataclass(frozen=True)
class Rules:
    """Words of one language or site."""

    title_labels: tuple[str, ...] = ("position", "vacancy", "job title")
    company_labels: tuple[str, ...] = ("company", "employer")
    other_labels: tuple[str, ...] = ("salary", "schedule", "duties", "place", "requirements")
    #: What comes after a title ("X wanted") and before one ("looking for X"), and lines that announce one on the next.
    wanted: tuple[str, ...] = ("wanted", "required", "needed")
    looking: tuple[str, ...] = ("looking for", "we hire")
    announced: tuple[str, ...] = ("open position", "we offer work")
    #: Where a title ends inside a sentence; words at its end that name no position; words that name none at all.
    tails: tuple[str, ...] = ("to", "with", "who", "for", "in", "at", "on")
    generic: tuple[str, ...] = ("people", "staff", "men", "women", "and")
    #: Words of roles, written small inside a title, and words between a role and its field that are in the wrong order.
    roles: tuple[str, ...] = ("manager", "specialist", "operator")
    turned: tuple[str, ...] = ("by", "of")
    professions: tuple[str, ...] = ()
    #: Forms of firms, words of a team, words and signs that are in no name.
    firms: tuple[str, ...] = ("LLC", "Ltd", "JSC")
    teams: tuple[str, ...] = ("join the", "team of")
    not_names: tuple[str, ...] = ("modern", "friendly", "comfortable")
    #: Lines that open a list of positions, and words of a whole ad inside a post of several.
    lists: tuple[str, ...] = ("open positions", "vacancies")
    details: tuple[str, ...] = ("salary", "place", "address")


def _any(words: tuple[str, ...]) -> str:
    return "|".join(sorted(map(_plain, words), key=len, reverse=True)) or r"(?!)"


def _plain(word: str) -> str:
    return "".join("\\" + c if c in r".+*?()[]{}|^$\\" else c for c in word).replace(" ", r"\s+")


def _word(words: tuple[str, ...]) -> str:
    return rf"(?i)(?<![\p{{L}}\p{{N}}'])(?:{_any(words)})(?![\p{{L}}\p{{N}}])"


def _known(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(keyword_pattern(w) for w in words)) if words else F.lit(False)


def _labelled(line: Column, labels: tuple[str, ...]) -> Column:
    return F.regexp_extract(line, rf"(?i)^[^\p{{L}}\p{{N}}]*(?:{_any(labels)})\s*[:–—-]\s*(\S.*)$", 1)


def bare(line: Column) -> Column:
    """Without a bullet or number in front, and without signs at its ends."""
    return F.regexp_replace(F.regexp_replace(line, r"^(?:[^\p{L}\p{N}(«\"“]|\d{1,2}(?:[.)]|\x{FE0F}?\x{20E3}))*\s*", ""), r"[\s.,;:!–—-]+$", "")


def repaired(title: Column, rules: Rules) -> Column:
    """A title's own words: the tail of a sentence and generic words go, a turned role comes last, roles inside and shouted words are written small."""
    out = F.regexp_replace(bare(title), r"(?i)^(?:an?|the)\s+", "")
    out = F.regexp_replace(out, rf"(?i)\s*(?:[,.;!?|]|\s(?:{_any(rules.tails)})\s).*$", "")
    out = F.regexp_replace(out, rf"(?i)(?:(?:^|\s+)(?:{_any(rules.generic)}))+$", "")
    out = F.regexp_replace(out, rf"(?i)^({_any(rules.roles)})\s+(?:{_any(rules.turned)})\s+([\p{{L}}][\p{{L}} ']{{1,39}})$", "$2 $1")
    out = let(out, lambda x: F.when(x.rlike(r"\p{Lu}{3}") & ~x.rlike(r"\p{Ll}"), F.lower(x)).otherwise(x))
    words = F.transform(F.split(out, r"\s+"), lambda w, i: F.when((i > 0) & w.rlike(rf"(?i)^(?:{_any(rules.roles)})\p{{L}}{{0,4}}$"), F.lower(w)).otherwise(w))
    return let(F.trim(F.array_join(words, " ")), lambda x: F.when(x.rlike(r"\p{L}{2}"), F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, LONGEST - 1))))


def _phrase(line: Column, rules: Rules) -> Column:
    """The title that a phrase of a line names, repaired; null where it names none."""
    before = F.regexp_extract(line, rf"(?i)^[^\p{{L}}]*(\p{{L}}[\p{{L}}\p{{N}}' /-]{{2,60}}?)\s+(?:is\s+|are\s+)?(?:{_any(rules.wanted)})(?![\p{{L}}])", 1)
    after = F.regexp_extract(line, rf"(?i)(?:{_any(rules.looking)})\s*:?\s+(\p{{L}}[\p{{L}}\p{{N}}' /,-]{{2,90}})", 1)
    label = line.rlike(rf"(?i)^[^\p{{L}}]*(?:{_any(rules.other_labels)})\s*[:–—-]")
    told = let(after, lambda a: F.when(a != "", a).otherwise(let(before, lambda b: F.when(b != "", b))))
    return F.when(~label, let(repaired(told, rules), lambda x: F.when(_known(F.lower(x), rules.professions), x)))


def title(text: Column, rules: Rules) -> Column:
    """``struct<title, source>``: from a label, else from a phrase or an announced line of the first lines, else the first short line that names a profession."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n\s*\n+", "\n"), "\n")

    def first(values: Column, source: str) -> Column:
        return F.get(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.struct(v.alias("title"), F.lit(source).alias("source"))), F.lit(0))

    def labelled(line: Column) -> Column:
        return let(_labelled(line, rules.title_labels), lambda v: F.when(v != "", repaired(v, rules)))

    def whole(line: Column) -> Column:
        short = (F.length(line) <= SHORT_LINE) & (F.size(F.split(F.trim(line), r"\s+")) <= SHORT_WORDS) & ~line.rlike(r"[!?:]\s*$") & ~line.rlike(r"^\s*#") & _known(F.lower(line), rules.professions)
        return F.when(short & ~line.rlike(_word((*rules.wanted, *rules.looking))), repaired(line, rules))

    def best(lines: Column) -> Column:
        """A kind is looked for only where no better one is found."""
        early = F.slice(lines, 1, FIRST_LINES)
        pairs = F.arrays_zip(early.alias("a"), F.slice(lines, 2, FIRST_LINES).alias("b"))
        announced = F.transform(pairs, lambda p: F.when(p["a"].rlike(_word(rules.announced)), let(F.coalesce(p["b"], F.lit("")), lambda x: F.when(_known(F.lower(x), rules.professions), repaired(x, rules)))))
        return F.coalesce(
            first(F.transform(lines, labelled), "label"), first(F.transform(early, lambda x: _phrase(x, rules)), "phrase"),
            first(announced, "announced"), first(F.transform(F.slice(lines, 1, 1), whole), "first line"),
        )

    return let(lines, best)


def name(value: Column, rules: Rules) -> Column:
    """A firm's name, or null for slogans and sentences: what a dash explains goes, quotes are taken off."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\s+[–—-]\s+.*$", ""), r"^[^\p{L}\p{N}«\"“„]+|[\s.,;:!]+$", ""), "[«»\"“”„]", ""))
    sentence = out.rlike(r"[.!?]\s+\p{L}") | _known(F.lower(out), (*rules.not_names, *rules.wanted, *rules.looking))
    small = out.rlike(r"^\p{Ll}") & ~out.contains(".")
    return F.when((out != "") & out.rlike(r"\p{L}") & (F.size(F.split(out, r"\s+")) <= NAME_WORDS) & ~sentence & ~small, F.substring(out, 1, LONGEST))


def employer(text: Column, rules: Rules) -> Column:
    """The employer: labels that agree (several that do not give none), else who looks for someone, else a name beside a form of firms, else a team."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    labelled = F.array_compact(F.transform(lines, lambda x: F.when(_labelled(x, rules.company_labels) != "", name(_labelled(x, rules.company_labels), rules))))
    one = F.size(F.array_distinct(F.transform(labelled, F.lower))) == 1
    proper = r"\p{Lu}[\p{L}\p{N}&'-]*(?:\s+[\p{Lu}\p{N}][\p{L}\p{N}&'-]*){0,3}"
    firm = rf"(?:{_any(rules.firms)})"
    patterns = (
        rf"(?m)^[^\p{{L}}\n]*({proper})\s+(?:is|are)?\s*(?i:{_any(rules.looking)})",
        rf"(?<![\p{{L}}]){firm}\s*[«\"“]([^»\"”\n]{{2,40}})[»\"”]", rf"[«\"“]([^»\"”\n]{{2,40}})[»\"”]\s*{firm}(?![\p{{L}}])", rf"({proper})\s+{firm}(?![\p{{L}}])",
        rf"(?i:{_any(rules.teams)})\s+({proper})",
    )
    others = F.coalesce(*(F.when(F.regexp_extract(text, p, 1) != "", name(F.regexp_extract(text, p, 1), rules)) for p in patterns))
    return F.when(F.size(labelled) > 0, F.when(one, F.get(labelled, F.lit(0)))).otherwise(others)


def linked_lines(text: Column, links: Column, rules: LinkRules) -> Column:
    """``array<struct<position, url>>``: lines with a link of their own to apply, and at least two words besides.

    Hidden links come in the order of the text, and each belongs to one line: lines and links are walked together, a line takes the
    first link not passed yet whose words it holds. A line without one may hold an address.
    """
    told = F.transform(F.filter(links, lambda x: (F.trim(F.coalesce(x["text"], F.lit(""))) != "") & x["url"].isNotNull()), lambda x: F.struct(F.trim(x["text"]).alias("text"), x["url"].alias("url"), apply_score(x["url"], x["text"], rules).alias("score")))
    start = F.struct(told.alias("links"), F.array().cast("array<struct<position:string,url:string>>").alias("out"))

    def walk(state: Column, line: Column) -> Column:
        numbered = F.transform(state["links"], lambda x, i: F.struct(i.alias("i"), x["text"].alias("text"), x["url"].alias("url"), x["score"].alias("score")))
        address = F.get(F.filter(F.regexp_extract_all(line, F.lit(URL), F.lit(0)), lambda u: apply_score(u, None, rules) >= BARE_LINK), F.lit(0))

        def with_link(p: Column) -> Column:
            mine, address = p["mine"], p["address"]
            left = F.when(mine.isNull(), state["links"]).otherwise(F.slice(state["links"], F.coalesce(mine["i"], F.lit(0)) + 2, F.size(state["links"])))
            url = F.when(mine["score"] >= LINK, mine["url"]).otherwise(address)
            rest = F.when(mine["score"] >= LINK, F.replace(line, mine["text"], F.lit(" "))).otherwise(F.replace(line, F.coalesce(address, F.lit("\u0000")), F.lit(" ")))
            position = let(F.when(url.isNotNull(), rest), lambda r: F.when(F.regexp_count(r, F.lit(r"\p{L}[\p{L}\p{N}']+")) >= 2, bare(F.regexp_replace(F.regexp_replace(bare(r), r"\(\s*\)", ""), r"\s+", " "))))
            told = let(position, lambda x: F.when(x.isNotNull(), F.concat(state["out"], F.array(F.struct(x.alias("position"), url.alias("url"))))).otherwise(state["out"]))
            return F.struct(left.alias("links"), told.alias("out"))

        return let(F.struct(F.get(F.filter(numbered, lambda x: F.contains(line, x["text"])), F.lit(0)).alias("mine"), address.alias("address")), with_link)

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, walk, lambda s: s["out"])


def n_linked(found: Column) -> Column:
    """How many links of their own the lines have."""
    return F.size(F.array_distinct(F.transform(found, lambda x: x["url"])))


def _listed(items: Column, rules: Rules) -> Column:
    """Items as positions, each once in any case; null where fewer than ``LEAST`` are left."""
    clean = F.filter(F.transform(items, bare), lambda x: x.rlike(r"\p{L}{2}") & (F.length(x) <= LONGEST))
    once = F.transform(F.filter(F.transform(clean, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: F.array_position(F.transform(clean, F.lower), F.lower(p["x"])) == p["i"] + 1), lambda p: p["x"])
    return F.when(F.size(once) >= LEAST, once)


def positions(text: Column, links: Column, rules: Rules, link_rules: LinkRules) -> Column:
    """Positions of a list, by the first of four signs that gives two: lines under a heading for positions, lines with links of their own, numbered
    lines that name a profession, and blocks that are whole ads (a phrase that names a position, and pay or a place before the next)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    heading = rf"(?i)(?:{_any(rules.lists)})\s*:\s*$"
    any_label = rf"(?i)^[^\p{{L}}]*(?:{_any((*rules.title_labels, *rules.company_labels, *rules.other_labels))})\s*[:–—-]"
    none = F.array().cast("array<string>")

    def under(state: Column, line: Column) -> Column:
        """Items after the first heading, up to another heading, a label or two blank lines."""
        empty = F.trim(line) == ""
        over = (state["on"] == 1) & (line.rlike(r":\s*$") | line.rlike(any_label) | (empty & (state["blank"] >= 1) & (F.size(state["items"]) > 0)))
        on = F.when(over, 2).when((state["on"] == 0) & line.rlike(heading), 1).otherwise(state["on"])
        takes = (state["on"] == 1) & (on == 1) & ~empty
        return F.struct(on.cast("int").alias("on"), F.when(empty, state["blank"] + 1).otherwise(0).cast("int").alias("blank"), F.when(takes, F.concat(state["items"], F.array(line))).otherwise(state["items"]).alias("items"))

    start = F.struct(F.lit(0).alias("on"), F.lit(0).alias("blank"), none.alias("items"))
    by_heading = _listed(F.aggregate(lines, start, under, lambda s: s["items"]), rules)
    linked = linked_lines(text, links, link_rules)
    by_link = F.when(n_linked(linked) >= LEAST, _listed(F.transform(linked, lambda x: x["position"]), rules))
    numbered = F.filter(lines, lambda x: x.rlike(r"^\s*\d{1,2}(?:[.)]|\x{FE0F}?\x{20E3})\s*\S") & (F.length(x) <= SHORT_LINE) & (_known(F.lower(x), rules.professions) | ~x.rlike(r"\p{Ll}")))

    def block(state: Column, x: Column) -> Column:
        """Heads of blocks, and whether what came since the last one has details."""
        head = F.when(state["fresh"], _phrase(x, rules))
        told = F.when(head.isNotNull(), F.lit(False)).otherwise(state["told"] | x.rlike(_word(rules.details)))
        whole = F.when(head.isNotNull() & (F.size(state["heads"]) > 0), state["whole"] & state["told"]).otherwise(state["whole"])
        return F.struct((F.trim(x) == "").alias("fresh"), told.alias("told"), whole.alias("whole"), F.when(head.isNotNull(), F.concat(state["heads"], F.array(head))).otherwise(state["heads"]).alias("heads"))

    begin = F.struct(F.lit(True).alias("fresh"), F.lit(False).alias("told"), F.lit(True).alias("whole"), none.alias("heads"))
    by_block = F.aggregate(lines, begin, block, lambda s: F.when(s["whole"] & s["told"], s["heads"]).otherwise(none))
    return F.coalesce(by_heading, by_link, _listed(numbered, rules), _listed(by_block, rules), none)
