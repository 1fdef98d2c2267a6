"""The flow of every post from arrival to one status: classify, parse, contacts, duplicates, caps.

What a text tells is read by column expressions in one pass, once for equal texts; only the posts that are left as job ads meet each other, in the
duplicate layers. A post has one status at the end:

skipped_backfill (an old post of a new source), a status for each kind that is no job (no_text, closed, resume,
suspicious, opportunity, not_job), no_contact, low_quality (neither title nor pay), duplicate (another post of its group
is published), skipped_limit (an international ad over the day's cap), done.

Columns of ``posts``: ``id, source, text, posted_at, fetched_at, is_backfill``; where they are given also ``links``
(array of text and url), ``own`` (accounts of the source), ``is_site`` (from a job site's interface, so never other than
a job unless closed, resume or suspicious), ``international``, ``needs_tag``. Null texts are empty; a null flag is
false; equal rows are duplicates of the first one by id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import contacts
from tidemill.functions.text import fold
from tidemill.operators import categories, dedup, extract, headings, places, queue
from tidemill.session import stage

LINKS = "array<struct<text:string,url:string>>"


@dataclass(frozen=True)
class Rules:
    """What the flow is told about its posts."""

    markers: dict[str, list[str]]
    title_label: str = "position|vacancy|job title|lavozim|vakansiya"
    company_label: str = "company|employer|kompaniya|ish beruvchi"
    professions: list[str] = field(default_factory=lambda: ["driver", "cook", "teacher"])
    job_tags: list[str] = field(default_factory=list)
    other_tags: list[str] = field(default_factory=list)
    zone: str = "UTC"
    hold_minutes: int = 20
    international_a_day: int | None = None
    publish_backfill: bool = False
    context: tuple[str, ...] = ()
    links: contacts.LinkRules = contacts.LinkRules()
    drop: tuple[str, ...] = ()
    titles: dedup.TitleWords = dedup.TitleWords()
    #: Boilerplate by source (source, kind, pattern), names of places, words of categories, words of titles and lists, and the shape of a seeker's profile.
    boilerplate: tuple[tuple[str, str, str], ...] = ()
    places: places.Places = places.Places(())
    categories: categories.Words = ()
    headings: headings.Rules | None = None
    profile_labels: tuple[str, ...] = ()
    seeker: tuple[str, ...] = ()
    employer: tuple[str, ...] = ()


def _or_false(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def _links_of(posts: DataFrame) -> Column:
    return F.coalesce("links", F.array().cast(LINKS)) if "links" in posts.columns else F.array().cast(LINKS)


def _all_contacts(text: Column, links: Column, own: Column, rules: Rules) -> Column:
    return contacts.contacts(text, links, own, rules.context, rules.links, rules.drop)


def _n_linked(text: Column, links: Column, rules: Rules) -> Column:
    return headings.n_linked(headings.linked_lines(text, links, rules.links))


def _has_contact(c: Column) -> Column:
    return (F.size(c["phones"]) > 0) | (F.size(c["accounts"]) > 0) | (F.size(c["emails"]) > 0) | (F.size(c["links"]) > 0)


def _kind(folded: Column, links: Column, linked: Column, needs_tag: Column, rules: Rules) -> Column:
    """The kind that a text without boilerplate and its links tell, its deadline aside."""
    tags = F.regexp_extract_all(folded, F.lit(r"#([^\s#]+)"), F.lit(1))
    seeker = extract.is_seeker(folded, rules.profile_labels, rules.seeker, rules.employer) if rules.profile_labels else None
    return extract.classify(
        folded, rules.markers, None, seeker, tags=tags, job_tags=rules.job_tags, other_tags=rules.other_tags,
        needs_tag=needs_tag, linked=linked, addresses=F.lower(F.array_join(F.transform(links, lambda x: x["url"]), "\n")),
    )


def _read(posts: DataFrame, rules: Rules, keep: list[Column | str]) -> DataFrame:
    """All that a text tells, whenever it was posted, beside the columns to keep: ``kind`` (its deadline aside), ``dates``, contacts, title, ...

    ``_clean``, the text without boilerplate, is among what may be kept."""
    links = _links_of(posts)
    own = F.col("own") if "own" in posts.columns else F.array().cast("array<string>")
    whole = F.coalesce("text", F.lit(""))
    clean = posts.withColumn("_clean", extract.stripped_text(whole, F.col("source"), rules.boilerplate) if rules.boilerplate else whole)
    text = F.col("_clean")
    folded = clean.select("*", fold(text).alias("_folded"), _all_contacts(text, links, own, rules).alias("_contacts"), own.alias("_own"), _n_linked(text, links, rules).alias("_linked"))
    kind = _kind(F.col("_folded"), links, F.col("_linked"), _or_false(posts, "needs_tag"), rules)
    if rules.headings is None:
        title, company = extract.title_of(text, rules.title_label, rules.professions), extract.company_of(text, rules.company_label)
    else:
        title, company = headings.title(text, rules.headings)["title"], headings.employer(text, rules.headings)
    out = folded.select(
        *keep, kind.alias("kind"), extract.deadline_words(text).alias("dates"), F.col("_folded").alias("text"), F.col("_own").alias("own"),
        title.alias("title"), company.alias("company"), extract.pay(text).alias("pay"), F.col("_contacts").alias("contacts"),
        (places.places_of(text, rules.places) if rules.places.names else F.lit(None).cast(places.FOUND)).alias("place"),
    )
    if rules.categories:
        out = out.withColumn("vote", categories.category_of(F.lower("title"), F.col("text"), rules.categories))
    else:
        out = out.withColumn("vote", F.lit(None).cast(categories.VOTE))
    return out.withColumn("has_contact", _has_contact(F.col("contacts"))).withColumn("low_quality", F.col("title").isNull() & F.col("pay").isNull())


def _own_columns(posts: DataFrame) -> list[Column]:
    """What a post has beside its text."""
    return ["id", "source", F.coalesce("posted_at", "fetched_at").alias("posted_at"), *(_or_false(posts, c).alias(c) for c in ("is_backfill", "international", "is_site"))]


def _timed(read: DataFrame, now: Column) -> DataFrame:
    """Kinds with what a post adds to its text: the year of its deadline, its site."""
    late = F.coalesce(extract.deadline_of(F.col("dates"), F.year("posted_at")) < F.to_date(now), F.lit(False))
    kind = F.when((F.col("kind") != "no_text") & late, "closed").otherwise(F.col("kind"))
    kind = F.when(F.col("is_site") & kind.isin("not_job", "opportunity", "no_text"), "job").otherwise(kind)
    return read.withColumn("kind", kind).drop("dates", "is_site")


def parsed(posts: DataFrame, rules: Rules, now: Column) -> DataFrame:
    """``id, posted_at, kind, has_contact, low_quality, ...``: each post on its own, in one pass without a shuffle.

    The source's boilerplate goes first, all that follows reads what is left: contacts, kind (with the shape of a profile and
    lines with links of their own), title, employer, pay, place, category.
    """
    return _timed(_read(posts, rules, _own_columns(posts)), now)


def parsed_once(posts: DataFrame, rules: Rules, now: Column) -> DataFrame:
    """The same rows, where copies are many: a text (with all that is read beside it) is read once, and its posts take what it tells."""
    given = ["text", *(c for c in ("links", "own", "needs_tag") if c in posts.columns), *(["source"] if rules.boilerplate else [])]
    key = F.sha2(F.to_json(F.struct(*given)), 256).alias("_key")
    texts = stage(_read(posts.select(key, *given).distinct(), rules, ["_key"]), "texts")
    return _timed(posts.select(key, *_own_columns(posts)).join(texts, "_key").drop("_key"), now)


def parsed_by_text(posts: DataFrame, rules: Rules, now: Column, columns: tuple[str, ...]) -> DataFrame:
    """These columns of the same rows, beside ``id`` and ``posted_at``, where copies are many and links differ from copy to copy: a text is read once,
    without links, and only what they add (contacts, lines with links of their own, the kind) is read for each post that has some."""
    given = ["text", *(c for c in ("own", "needs_tag") if c in posts.columns), *(["source"] if rules.boilerplate else [])]
    key = F.sha2(F.to_json(F.struct(*given)), 256).alias("_key")
    # what the posts with links need again
    again = ["_clean", "text", "own", "contacts", "kind", "has_contact"] if "links" in posts.columns else ["kind"]
    read = _read(posts.select(*given).distinct().select(key, *given), rules, ["_key", "_clean"])
    texts = stage(read.select("_key", "dates", *(c for c in dict.fromkeys((*again, *columns)) if c in read.columns)), "texts-alone")
    told = posts.select(key, *_own_columns(posts), _links_of(posts).alias("_links"), _or_false(posts, "needs_tag").alias("_needs_tag")).join(texts, "_key")
    if "links" in posts.columns:
        has, clean, links = F.size("_links") > 0, F.col("_clean"), F.col("_links")
        told = told.withColumn("contacts", F.when(has, _all_contacts(clean, links, F.col("own"), rules)).otherwise(F.col("contacts")))
        told = told.withColumn("has_contact", F.when(has, _has_contact(F.col("contacts"))).otherwise(F.col("has_contact")))
        told = told.withColumn("kind", F.when(has, _kind(F.col("text"), links, _n_linked(clean, links, rules), F.col("_needs_tag"), rules)).otherwise(F.col("kind")))
    return _timed(told, now).select("id", "posted_at", *columns)


def confidence() -> Column:
    """How sure a parsed post is: title .35, contact .35; pay, region and employer .1 each."""
    parts = ((F.col("title").isNotNull(), 0.35), (F.col("has_contact"), 0.35), (F.coalesce("pay.lo", "pay.hi").isNotNull(), 0.1), (F.col("place.region").isNotNull(), 0.1), (F.col("company").isNotNull(), 0.1))
    total = F.lit(0.0)
    for given, points in parts:
        total = total + F.when(given, points).otherwise(0.0)
    return F.round(F.least(total, F.lit(1.0)), 2)


def flow(posts: DataFrame, rules: Rules, now: Column, layers: tuple[str, ...] = tuple(dedup.LAYERS)) -> DataFrame:
    """``id, kind, status, job_id`` of every post; ``job_id`` is the first post of its group, for done and duplicate posts."""
    one = stage(parsed_once(posts, rules, now), "parsed")
    skipped = F.lit(False) if rules.publish_backfill else F.col("is_backfill")
    alone = F.when(skipped, "skipped_backfill").when(F.col("kind") != "job", F.col("kind")).when(~F.col("has_contact"), "no_contact").when(F.col("low_quality"), "low_quality")
    judged = one.withColumn("_status", alone)
    ads = judged.where("_status is null")
    entry = dedup.entries(
        ads.withColumn("fetched_at", F.col("posted_at")), F.concat("contacts.phones", "contacts.accounts"),
        company=F.lower(F.coalesce("company", F.lit(""))), own=F.col("own"), title=F.lower("title"),
    )
    root = stage(dedup.roots(dedup.parents(entry, layers=layers, words=rules.titles)), "roots-of-copies")
    c, p = F.col("contacts"), F.col("pay")
    full = dedup.completeness(F.get(c["phones"], F.lit(0)), F.get(c["accounts"], F.lit(0)), F.coalesce(p["lo"], p["hi"]), F.col("place.region"), F.col("place.district"), F.col("title"), confidence())
    versions = ads.select(F.col("id").alias("seq"), "posted_at", full.alias("score"))
    chosen = dedup.survivors(versions, root, rules.hold_minutes)
    grouped = ads.select("id", "posted_at", "international").join(root.withColumnsRenamed({"seq": "id"}), "id", "left").withColumn("root", F.coalesce("root", "id"))
    told = grouped.join(chosen, "root").select("id", "root", "posted_at", "international", (F.col("id") == F.col("survivor")).alias("first"))
    if rules.international_a_day is None:
        limited = told.withColumn("over", F.lit(False))
    else:
        abroad = stage(told.where("first and international"), "international")
        capped = queue.daily_cap(abroad.select("id", "posted_at"), "posted_at", rules.zone, rules.international_a_day, ["posted_at", "id"])
        limited = told.join(capped.where("not accepted").select("id", F.lit(True).alias("over")), "id", "left")
    status = F.when(~F.col("first"), "duplicate").when(F.coalesce("over", F.lit(False)), "skipped_limit").otherwise("done")
    ended = limited.select("id", status.alias("_end"), F.col("root").alias("job_id"))
    return judged.select("id", "kind", "_status").join(ended, "id", "left").select("id", "kind", F.coalesce("_status", "_end").alias("status"), F.when(F.coalesce("_status", "_end").isin("done", "duplicate"), F.col("job_id")).alias("job_id"))


def counters(statuses: DataFrame) -> DataFrame:
    """``status, n``: what became of a run's posts."""
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
