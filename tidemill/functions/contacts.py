"""Contacts in texts as column expressions: phones, accounts, emails, links, and their masking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import let

#: Operator and city codes of the national numbering plan.
CODES = [str(c) for c in (20, 33, 50, 55, *range(61, 80), 87, 88, 90, 91, 93, 94, 95, 97, 98, 99)]
COUNTRY = "998"
_STEP = r"[ .-]?[(]?\d[)]?"  # one more digit, alone or after a separator
#: A run of digits that may be a number: the country's code and nine more, or nine of which two stand together.
PHONE = rf"(?<![\p{{L}}\p{{N}}_+])(?:\+?[ ]?{COUNTRY}(?:{_STEP}){{9}}|[(]?\d\d[)]?(?:{_STEP}){{7}})(?!\d)"
PHONE_LINK = r"t\.me/\+998(\d{9})"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"(?:https?://|www\.)[^\s<>\"]+|\b(?:t\.me|telegra\.ph)/[^\s<>\"]+"
#: A text with a link holds one of these.
URL_PARTS = ("://", "www.", "t.me/", "telegra.ph/")
ACCOUNT = r"(?<![\p{L}\p{N}_.@/])@([A-Za-z][A-Za-z0-9_]{3,31})|(?:t|telegram)\.me/([A-Za-z][A-Za-z0-9_]{3,31})(?![A-Za-z0-9_/])"
#: A text that is nothing but the name of an account.
BARE_ACCOUNT = r"^@?([A-Za-z][A-Za-z0-9_]{4,31})$"
TRACKING = r"^(?:utm_|hhtm)"


@dataclass(frozen=True)
class LinkClass:
    """A class of links by their address, and how much such a link looks like one to apply (0: not at all)."""

    name: str
    address: str
    score: int


@dataclass(frozen=True)
class LinkRules:
    """Classes of links, in the order in which they are tried; a link of none of them is judged by its words: beginnings of words that invite to apply, and whole ones."""

    classes: tuple[LinkClass, ...] = ()
    begin: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()


def _empty(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def phones(text: Column, context: tuple[str, ...] = ()) -> Column:
    """Numbers as +998XXXXXXXXX, in order, once: runs of digits with the country's code, with a known code, or beside a word of ``context`` on the line.

    ``context``: beginnings of words that make a number beside them a phone, whatever its code.
    """
    near = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(context)})" if context else None

    def line(x: Column) -> Column:
        linked = F.transform(F.regexp_extract_all(x, F.lit(PHONE_LINK), F.lit(1)), lambda d: F.concat(F.lit("+998"), d))
        plain = F.regexp_replace(F.regexp_replace(x, EMAIL, " "), URL, " ")
        digits = F.transform(F.regexp_extract_all(plain, F.lit(PHONE), F.lit(0)), lambda h: F.regexp_replace(h, r"\D", ""))
        known = F.array(*map(F.lit, CODES))

        def judged(d: Column) -> Column:
            told = (F.length(d) == 12) | F.array_contains(known, F.substring(d, 1, 2))
            return ~d.endswith("000000") & (told | F.rlike(x, F.lit(near)) if near else told)

        return F.concat(linked, F.transform(F.filter(digits, judged), lambda d: F.concat(F.lit("+998"), F.right(d, F.lit(9)))))

    return F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)))


def canonical_account(name: Column) -> Column:
    """``@name`` in lower case from a handle or a link."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"^(?:https?://)?(?:(?:t|telegram)\.me/)?@?", "")
    return F.concat(F.lit("@"), F.split_part(F.split_part(bare, F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1)))


def accounts(text: Column, own: Column | None = None) -> Column:
    """Accounts mentioned, in order, once, without the source's own ones."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ACCOUNT), F.lit(0)), canonical_account))
    return found if own is None else F.array_except(found, F.coalesce(own, _empty()))


def emails(text: Column) -> Column:
    # the pattern is slow over words, and most texts hold no @
    return let(text, lambda x: F.when(F.contains(x, F.lit("@")), F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(EMAIL), F.lit(0)), F.lower))).otherwise(_empty()))


def urls(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!]+$", "")))


def clean_url(url: Column, drop: list[str] | None = None) -> Column:
    """Without tracking parameters and the ones to drop."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.array(*map(F.lit, drop or ["\u0000"]))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(TRACKING)) & ~F.array_contains(names, F.lower(F.split_part(p, F.lit("="), F.lit(1)))))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.contains("?"), F.concat(F.regexp_extract(url, r"^([^?]*)", 1), tail, F.regexp_extract(url, r"(#.*)$", 1))).otherwise(url)


def apply_score(url: Column, link_text: Column | None = None, rules: LinkRules = LinkRules()) -> Column:
    """How much a link looks like one to apply: by the first class that its address is of, else 2 by its words, 1 bare, 0 not."""
    patterns = [*rules.begin, *(rf"(?:{w})(?![\p{{L}}\p{{N}}_])" for w in rules.whole)]
    inviting = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(patterns)})" if patterns else r"(?!)"
    told = F.lit(1) if link_text is None else F.when(link_text.isNull(), 1).when(link_text.rlike(inviting), 2).otherwise(0)
    return F.coalesce(*(F.when(url.rlike(c.address), c.score) for c in rules.classes), told)


def apply_links(links: Column, rules: LinkRules = LinkRules()) -> Column:
    """URLs of ``array<struct<text,url>>`` that look like links to apply, best score first, then in order."""
    scored = F.transform(links, lambda x, i: F.struct((-apply_score(x["url"], x["text"], rules)).alias("s"), i.alias("i"), x["url"].alias("url")))
    return F.array_distinct(F.transform(F.array_sort(F.filter(scored, lambda x: x["s"] < 0)), lambda x: x["url"]))


def contacts(text: Column, links: Column | None = None, own: Column | None = None, context: tuple[str, ...] = (), rules: LinkRules = LinkRules(), drop: tuple[str, ...] = ()) -> Column:
    """All contacts of a post as one struct, from its text and its hidden links and buttons.

    ``drop``: patterns of accounts and addresses that are no one's contact (the service's own, sharing buttons): what matches one goes.
    """
    links = links if links is not None else _empty("array<struct<text:string,url:string>>")
    bare = F.transform(urls(text), lambda u: F.struct(F.lit(None).cast("string").alias("text"), u.alias("url")))
    every = F.concat(bare, links)
    hidden = F.array_join(F.transform(links, lambda x: x["url"]), "\n")
    unwanted = "(?i)(?:" + "|".join(drop) + ")" if drop else None

    def kept(found: Column) -> Column:
        return F.filter(found, lambda x: ~F.rlike(x, F.lit(unwanted))) if unwanted else found

    return F.struct(
        F.array_union(phones(text, context), phones(hidden, context)).alias("phones"),
        kept(F.array_union(accounts(text, own), accounts(hidden, own))).alias("accounts"),
        kept(emails(text)).alias("emails"),
        kept(apply_links(every, rules)).alias("links"),
    )


def mask(text: Column) -> Column:
    """Links, emails, accounts and phones replaced by tokens."""
    out = F.regexp_replace(text, URL, "[URL]")
    out = F.regexp_replace(out, EMAIL, "[EMAIL]")
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}_.])@[A-Za-z][A-Za-z0-9_]{3,31}", "[USER]")
    return F.regexp_replace(out, r"\+?\d[\d\s()\-]{7,}\d", "[PHONE]")


def post_url(source: Column, external_id: Column, site_url: Column | None = None) -> Column:
    """Link of the original post; a site's own link wins."""
    made = F.when(external_id.rlike(r"^\d+$"), F.concat(F.lit("https://t.me/"), F.regexp_replace(source, "^@", ""), F.lit("/"), external_id))
    return made if site_url is None else F.coalesce(site_url, made)
