"""Parsing and classifying posts with rule tables: lines, fields, pay, places, categories.

Rule tables are DataFrames written by hand, so they are broadcast. Work on lines and words is a join and an aggregation
over exploded rows; work on one value is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.contacts import ACCOUNT, EMAIL, PHONE, URL
from tidemill.functions.pay import pay, pay_value
from tidemill.functions.text import fold, keyword_pattern, let, without_keywords

KEEP_SHARE = 0.4
#: Job markers that outweigh advertising, job markers of a job, positions with links of their own that make a list.
STRONG, LEAST_EVIDENCE, LEAST_LINKED = 4, 2, 2
MONTHS = "january february march april may june july august september october november december".split()


def lines(posts: DataFrame, id_col: str = "id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id, pos, line`` of every post, and other columns to keep."""
    return posts.select(F.col(id_col).alias("id"), *(keep or []), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))


def stripped(posts: DataFrame, rules: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, text`` of the lines that stay, where any does. ``posts``: with a ``source``; ``rules``: (source, kind, pattern); kind ``line`` (whole), ``part``,
    ``cut`` (this line and all after it, where at least ``KEEP_SHARE`` of the characters stay before it). Trailing hashtag lines and leading lines without
    letters go too. Of dropped lines those come back that are the first with a contact that no kept line has. A text is read as a column: no shuffle."""

    def of(kind: str) -> Column:
        return F.array_join(F.collect_list(F.when(F.col("kind") == kind, F.concat(F.lit("(?:"), F.col("pattern"), F.lit(")")))), "|").alias(f"_{kind}")

    # the patterns of a source are one alternation for each kind
    told = posts.join(F.broadcast(rules.groupBy("source").agg(*map(of, ("line", "part", "cut")))), "source", "left")

    def meets(kind: str, line: Column, whole: bool = False) -> Column:
        pattern = F.concat(F.lit("^(?:"), F.col(f"_{kind}"), F.lit(")$")) if whole else F.col(f"_{kind}")
        return F.when(F.col(f"_{kind}") != "", F.coalesce(F.rlike(line, pattern), F.lit(False))).otherwise(False)

    def contact(line: Column) -> Column:
        return F.array_distinct(F.concat(*(F.regexp_extract_all(line, F.lit(p), F.lit(0)) for p in (EMAIL, PHONE, ACCOUNT))))

    def ends(lines: Column) -> Column:
        """``struct<first, last, cut>``: the first line with a letter, the last one that is not tags only, the line that ends the post."""
        total = F.greatest(F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x)), F.lit(1))
        none = F.lit(None).cast("int")
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("chars"), none.alias("first"), none.alias("last"), none.alias("cut"))

        def read(state: Column, x: Column) -> Column:
            line, i = F.trim(x), state["i"]
            return F.struct(
                (i + 1).alias("i"), (state["chars"] + F.length(x)).alias("chars"),
                F.when(state["first"].isNotNull(), state["first"]).when(line.rlike(r"\p{L}|\p{N}"), i).alias("first"),
                F.when(line.rlike(r"^(?:#[^\s#]+\s*)*$"), state["last"]).otherwise(i).alias("last"),
                F.when(state["cut"].isNotNull(), state["cut"]).when((state["chars"] / total >= KEEP_SHARE) & meets("cut", line), i).alias("cut"),
            )

        return F.aggregate(lines, start, read)

    def stays(x: Column, i: Column, at: Column) -> Column:
        inside = F.coalesce((i >= at["first"]) & (i <= at["last"]), F.lit(False)) & (at["cut"].isNull() | (i < at["cut"]))
        return inside & ~meets("line", F.trim(x), True) & ~meets("part", F.trim(x))

    line = "struct<i:int,x:string,stays:boolean>"
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    marked = told.select(F.col(id_col).alias("id"), let(lines, lambda x: let(ends(x), lambda at: F.transform(x, lambda y, i: F.struct(i.alias("i"), y.alias("x"), stays(y, i, at).alias("stays")).cast(line)))).alias("_lines"))
    split = marked.select("id", "_lines", F.filter(F.transform(F.filter("_lines", lambda p: ~p["stays"]), lambda p: F.struct(p["i"].alias("i"), contact(p["x"]).alias("c"))), lambda p: F.size(p["c"]) > 0).alias("_gone"))

    def kept(c: Column) -> Column:
        """Whether a line that stays has the contact; only lines that hold its characters are read for contacts."""
        return F.exists("_lines", lambda p: F.when(p["stays"] & F.contains(p["x"], c), F.array_contains(contact(p["x"]), c)).otherwise(False))

    def back(gone: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("back"))

        def read(state: Column, p: Column) -> Column:
            new = F.exists(F.array_except(p["c"], state["seen"]), lambda c: ~kept(c))
            return F.struct(F.array_union(state["seen"], p["c"]).alias("seen"), F.when(new, F.concat(state["back"], F.array(p["i"]))).otherwise(state["back"]).alias("back"))

        return F.aggregate(gone, start, read, lambda s: s["back"])

    told_back = split.select("id", "_lines", F.when(F.size("_gone") > 0, back(F.col("_gone"))).otherwise(F.array().cast("array<int>")).alias("_back"))
    rows = told_back.select("id", F.filter("_lines", lambda p: p["stays"] | F.array_contains("_back", p["i"])).alias("_rows"))
    text = F.when(F.size("_rows") > 0, F.array_join(F.transform("_rows", lambda p: p["x"]), "\n"))
    # a condition on a plain column would be moved down with all that the column is made of, and that computed again
    return rows.select("id", F.explode_outer(F.array(text)).alias("text")).where("text is not null")


def stripped_text(text: Column, source: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Much the same of a whole text as a column, for rules written by hand (source, kind, pattern): every pattern stays a literal, so each is compiled once.

    A line with a contact that no kept line has comes back to its place. An empty source has no rules.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    total = F.greatest(F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(""))), F.lit(1))

    def meets(kind: str, line: Column) -> Column:
        out = F.lit(False)
        for s in dict.fromkeys(r[0] for r in rules if r[1] == kind):
            pattern = "|".join(f"(?:{r[2]})" for r in rules if r[:2] == (s, kind))
            out = F.when(source == s, line.rlike(f"^(?:{pattern})$" if kind == "line" else pattern)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    def read(state: Column, x: Column) -> Column:
        def with_line(line: Column) -> Column:
            ended = state["ended"] | ((state["chars"] / total >= KEEP_SHARE) & meets("cut", line))
            begun = state["begun"] | line.rlike(r"\p{L}|\p{N}")
            return let(F.struct(ended.alias("ended"), begun.alias("begun"), (~meets("line", line) & ~meets("part", line)).alias("stays")), put)

        def put(p: Column) -> Column:
            row = F.array(F.struct((F.size(state["kept"]) + F.size(state["gone"])).alias("i"), x.alias("x")))
            kept = p["begun"] & ~p["ended"] & p["stays"]
            return F.struct((state["chars"] + F.length(x)).alias("chars"), p["ended"].alias("ended"), p["begun"].alias("begun"), F.when(kept, F.concat(state["kept"], row)).otherwise(state["kept"]).alias("kept"), F.when(kept, state["gone"]).otherwise(F.concat(state["gone"], row)).alias("gone"))

        return let(F.trim(x), with_line)

    none = F.array().cast("array<struct<i:int,x:string>>")
    start = F.struct(F.lit(0).alias("chars"), F.lit(False).alias("ended"), F.lit(False).alias("begun"), none.alias("kept"), none.alias("gone"))

    def joined(state: Column) -> Column:
        def back(whole: Column) -> Column:
            def alone(p: Column) -> Column:
                return F.exists(F.concat(*(F.regexp_extract_all(p["x"], F.lit(c), F.lit(0)) for c in (EMAIL, PHONE, ACCOUNT))), lambda c: ~F.contains(whole, c))

            return F.array_sort(F.concat(state["kept"], F.filter(state["gone"], alone)))

        rows = let(F.array_join(F.transform(state["kept"], lambda p: p["x"]), "\n"), back)
        return F.regexp_replace(F.array_join(F.transform(rows, lambda p: p["x"]), "\n"), r"(?:^|\n)[ \t]*(?:#[^\s#]+\s*)+$", "")

    return F.aggregate(lines, start, read, joined)


def is_seeker(text: Column, labels: tuple[str, ...], seeker: tuple[str, ...], employer: tuple[str, ...]) -> Column:
    """The shape of a job seeker's profile: at least three distinct profile labels, words of a seeker, no sign of an employer."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(?m)^[^\p{L}\n]*([\p{L}' ]{2,25})\s*[:\-]"), F.lit(1)), F.trim)
    n = F.size(F.array_intersect(found, F.array(*map(F.lit, labels)))) if labels else F.lit(0)
    return (n >= 3) & (evidence(F.lower(text), list(seeker)) > 0) & (evidence(F.lower(text), list(employer)) == 0)


def ad_contact_lines(rows: DataFrame, phrases: str) -> DataFrame:
    """Lines that offer advertising: a phrase and an account on the line, or a phrase at its end and a short account line next."""
    w = Window.partitionBy("id").orderBy("pos")
    full = rows.where(F.trim("line") != "")
    following = F.lead("line").over(w)
    marked = full.withColumn("_next", following)
    here = F.rlike("line", F.lit(phrases)) & F.rlike("line", F.lit(ACCOUNT))
    next_ = F.rlike(F.trim("line"), F.lit(f"(?:{phrases})\\s*:?$")) & F.rlike("_next", F.lit(ACCOUNT)) & (F.length("_next") <= 40)
    return marked.where(here | F.coalesce(next_, F.lit(False))).select(*rows.columns)


def evidence(text: Column, markers: list[str]) -> Column:
    """How many distinct markers occur (left word boundary)."""
    found = F.lit(0)
    for m in dict.fromkeys(markers):
        found = found + F.coalesce(text.rlike(keyword_pattern(m)), F.lit(False)).cast("int")
    return found


def classify(
    text: Column,
    markers: dict[str, list[str]],
    past_deadline: Column | None = None,
    seeker: Column | None = None,
    tags: Column | None = None,
    job_tags: list[str] | None = None,
    other_tags: list[str] | None = None,
    needs_tag: Column | None = None,
    linked: Column | None = None,
    addresses: Column | None = None,
) -> Column:
    """Kind of a post by the first rule that holds.

    no_text; closed by a marker or a deadline that is past; resume by a marker or a seeker's shape; suspicious by a scam
    marker outside its exceptions; opportunity by a strong marker where no exception is; not_job by a strong marker;
    not_job by a tag of the source for other posts, or without a job tag where the source needs one; job by
    ``LEAST_LINKED`` positions with links of their own. Then, without a job tag and under ``STRONG`` job markers,
    opportunity by any marker and not_job by advertising markers (in the text or its addresses) that are no fewer than
    the job's. Then job by tag or ``LEAST_EVIDENCE`` markers, else not_job.
    """

    def n(kind: str, where: Column = text) -> Column:
        return evidence(where, markers[kind]) if markers.get(kind) else F.lit(0)

    def told(c: Column | None) -> Column:
        return F.lit(False) if c is None else F.coalesce(c, F.lit(False))

    def has(listed: list[str] | None) -> Column:
        return F.lit(False) if tags is None or not listed else F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, listed))), F.lit(False))

    quiet = without_keywords(text, markers.get("scam_exceptions", []))
    job, tagged = n("job"), has(job_tags)
    weak = ~tagged & (job < STRONG)
    ads = n("ad", text if addresses is None else F.concat_ws("\n", text, addresses))
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "no_text")
        .when((n("closed") > 0) | told(past_deadline), "closed")
        .when((n("resume") > 0) | told(seeker), "resume")
        .when(n("scam", quiet) > 0, "suspicious")
        .when((n("opportunity_strong") > 0) & (n("opportunity_exceptions") == 0), "opportunity")
        .when(n("not_job_strong") > 0, "not_job")
        .when(has(other_tags) | (told(needs_tag) & ~tagged), "not_job")
        .when(F.lit(False) if linked is None else F.coalesce(linked >= LEAST_LINKED, F.lit(False)), "job")
        .when(weak & (n("opportunity") > 0), "opportunity")
        .when(weak & (ads > 0) & (ads >= job), "not_job")
        .when(tagged | (job >= LEAST_EVIDENCE), "job")
        .otherwise("not_job")
    )


def seekers(rows: DataFrame, labels: list[str], seeker: str, employer: str) -> DataFrame:
    """``id, is_seeker``: at least three distinct profile labels, words of a seeker, no sign of an employer."""
    label = F.lower(F.regexp_extract("line", r"^[^\p{L}]*([\p{L}' ]{2,25})\s*[:\-]", 1))
    known = F.when(F.trim(label).isin(labels), F.trim(label))
    return rows.groupBy("id").agg(
        ((F.count_distinct(known) >= 3) & (F.max(F.rlike(F.lower("line"), F.lit(seeker)).cast("int")) == 1) & (F.max(F.rlike(F.lower("line"), F.lit(employer)).cast("int")) == 0)).alias("is_seeker")
    )


def deadline_words(text: Column) -> Column:
    """``struct<iso, dotted, named>``: what follows a deadline word, in three forms; empty where a form is not there."""
    word = r"(?is)(?:deadline|until|muddat|gacha|apply by|до)\D{0,20}?"
    return F.struct(
        F.regexp_extract(text, word + r"(\d{4})-(\d\d)-(\d\d)", 0).alias("iso"),
        F.regexp_extract(text, word + r"(\d{1,2}[./]\d{1,2}(?:[./]\d{4})?)", 1).alias("dotted"),
        F.lower(F.regexp_extract(text, word + r"(\d{1,2}\s+(?:" + "|".join(MONTHS) + r"))", 1)).alias("named"),
    )


def deadline_of(words: Column, year: int | Column) -> Column:
    """The date of :func:`deadline_words`; a year that is left out is ``year``."""
    year = (F.lit(year) if isinstance(year, int) else year).cast("string")
    iso, dotted, named = words["iso"], words["dotted"], words["named"]
    parts = F.split(dotted, "[./]")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(named, r"([a-z]+)$", 1))

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")

    return F.coalesce(
        F.when(iso != "", F.try_to_date(F.right(iso, F.lit(10)), "yyyy-MM-dd")),
        F.when(dotted != "", made(F.coalesce(F.get(parts, F.lit(2)), year), F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))),
        F.when(named != "", made(year, month, F.regexp_extract(named, r"^(\d+)", 1))),
    )


def deadline(text: Column, year: int | Column) -> Column:
    """The date after a deadline word: 31.12.2024, 31/12, 2024-12-31 or 31 December; a date that does not exist is null."""
    return deadline_of(deadline_words(text), year)


def budget(text: Column, negotiable: str, names: dict[str, str] | None = None) -> Column:
    """``struct<amount, currency, shown>`` of a one-time project's pay, its period aside: the lower bound (else the upper one), and both in words.

    An empty text is shown as ``negotiable``; a text without an amount as it was typed. ``names``: how a currency is shown.
    """
    typed = F.trim(F.coalesce(text, F.lit("")))
    found = pay_value(typed)
    lo, hi = found["lo"], found["hi"]
    name = found["currency"]
    for code, shown in (names or {}).items():
        name = F.when(found["currency"] == code, shown).otherwise(name)

    def spaced(n: Column) -> Column:
        return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))

    one_side = F.when(hi.isNull(), F.lit("dan")).when(lo.isNull(), F.lit("gacha"))
    glue = F.when(name == "so'm", "").otherwise(" ")
    both = F.concat(spaced(lo), F.lit(" – "), spaced(hi), F.lit(" "), name)
    one = F.concat(spaced(F.coalesce(lo, hi)), F.lit(" "), name, F.coalesce(F.concat(glue, one_side), F.lit("")))
    worded = F.when(lo.isNotNull() & hi.isNotNull() & (lo != hi), both).otherwise(one)
    shown = F.when(typed == "", negotiable).when(F.coalesce(lo, hi).isNull(), typed).otherwise(worded)
    return F.struct(F.coalesce(lo, hi).alias("amount"), found["currency"].alias("currency"), shown.alias("shown"))


def named(posts: DataFrame, names: DataFrame, most_words: int = 3, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Mentions of listed names (``name, key``): word n-grams joined by equality, longer ones hiding the shorter ones inside them."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.transform(F.col("_w"), lambda w, i: F.struct(i.alias("pos"), n.alias("n"), F.array_join(F.slice(F.col("_w"), i + 1, n), " ").alias("name")))))
    rows = posts.select(F.col(id_col).alias("id"), words.alias("_w")).select("id", F.explode(grams).alias("g")).select("id", "g.*")
    # a name that ends beyond the text would repeat a shorter one
    hits = rows.where(F.size(F.split("name", " ")) == F.col("n")).join(F.broadcast(names), "name")
    before = Window.partitionBy("id").orderBy("pos", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("pos") + F.col("n")).over(before), F.lit(0))
    return hits.withColumn("_reach", reach).where(F.col("pos") >= F.col("_reach")).select("id", "pos", "name", "key")


def place_vote(mentions: DataFrame, capital: tuple[str, str] | None = None) -> DataFrame:
    """``id, region, n, multi``: most mentions, then the first; more than one area makes it multi (a capital and its region are one)."""
    area = F.when(F.col("key") == capital[0], capital[1]).otherwise(F.col("key")) if capital else F.col("key")
    votes = mentions.withColumn("area", area).groupBy("id", "key", "area").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    return votes.groupBy("id").agg(F.min_by("key", F.struct(-F.col("n"), F.col("pos"))).alias("region"), F.max("n").alias("n"), (F.count_distinct("area") > 1).alias("multi"))


def category_vote(title_hits: DataFrame, text_hits: DataFrame, professions: DataFrame, fallback: str = "other") -> DataFrame:
    """``id, category, profession, score``: 3 for a title hit, 1 for a text hit, each keyword once; best profession of the best category; ties to the first mention.

    ``professions``: (key, category); hits as from :func:`named`, their key being a profession.
    """
    every = title_hits.withColumn("points", F.lit(3)).unionByName(text_hits.withColumn("points", F.lit(1)).withColumn("pos", F.col("pos") + 100_000))
    words = every.groupBy("id", "key", "name").agg(F.max("points").alias("points"), F.min("pos").alias("pos"))
    by_profession = words.groupBy("id", "key").agg(F.sum("points").alias("score"), F.min("pos").alias("pos")).join(F.broadcast(professions), "key")
    by_category = by_profession.groupBy("id", "category").agg(F.sum("score").alias("score"), F.min("pos").alias("pos"), F.min_by("key", F.struct(-F.col("score"), F.col("pos"))).alias("profession"))
    best = by_category.groupBy("id").agg(F.min_by(F.struct("category", "profession", "score"), F.struct(-F.col("score"), F.col("pos"))).alias("b"))
    return best.select("id", F.coalesce("b.category", F.lit(fallback)).alias("category"), "b.profession", "b.score")


def tags(text: Column, patterns: dict[str, str], negation: str, within: int = 25) -> Column:
    """Tags whose pattern occurs without a negation in the characters after it on the line."""
    found = [F.when(F.rlike(text, F.lit(f"(?i)(?:{p})(?![^\\n]{{0,{within}}}(?:{negation}))")), F.lit(tag)) for tag, p in patterns.items()]
    return F.array_compact(F.array(*found))


def labelled_field(rows: DataFrame, label: str, most_lines: int = 8) -> DataFrame:
    """``id, value`` after a label: the rest of its line, else the list lines that follow it."""
    w = Window.partitionBy("id").orderBy("pos")
    is_label = F.rlike("line", F.lit(rf"(?i)^\s*(?:{label})\s*:"))
    any_label = F.rlike("line", F.lit(r"^\s*[\p{L}' ]{2,30}:"))
    blocks = rows.withColumn("_block", F.sum(any_label.cast("int")).over(w)).withColumn("_label", is_label)
    inside = Window.partitionBy("id", "_block").orderBy("pos")
    blocks = blocks.withColumn("_mine", F.first("_label").over(inside)).withColumn("_place", F.row_number().over(inside) - 1).withColumn("_stop", F.sum((F.trim("line") == "").cast("int")).over(inside))
    value = F.when(F.col("_place") == 0, F.trim(F.regexp_replace("line", r"^[^:]*:", ""))).otherwise(F.trim(F.regexp_replace("line", r"^\s*[-•*–]\s*", "")))
    kept = blocks.where("_mine").withColumn("_v", value)
    own = kept.groupBy("id", "_block").agg(F.max(F.when(F.col("_place") == 0, F.col("_v"))).alias("own"), F.array_sort(F.collect_list(F.when((F.col("_place") > 0) & (F.col("_place") <= most_lines) & (F.col("_stop") == 0), F.struct("_place", "_v")))).alias("list"))
    text = F.when(F.col("own") != "", F.col("own")).otherwise(F.array_join(F.transform("list", lambda x: x["_v"]), ", "))
    return own.groupBy("id").agg(F.min_by(text, "_block").alias("value")).where("value <> ''")


def field_of(text: Column, label: str, most_lines: int = 8) -> Column:
    """The same of a whole text as a column, its lines read in order; null where :func:`labelled_field` has no row."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("on"), F.lit(False).alias("stopped"), F.lit("").alias("own"), F.lit(0).alias("place"), none.alias("items"))

    def read(state: Column, line: Column) -> Column:
        """``on``: 0 before the label's block, 1 inside, 2 after it."""
        begins = (state["n"] == 0) | line.rlike(r"^\s*[\p{L}' ]{2,30}:")
        on = F.when((state["on"] == 1) & begins, 2).when((state["on"] == 0) & begins & line.rlike(rf"(?i)^\s*(?:{label})\s*:"), 1).otherwise(state["on"])
        return let(on.cast("int"), lambda now: put(state, line, now))

    def put(state: Column, line: Column, now: Column) -> Column:
        opened, inside = (state["on"] == 0) & (now == 1), (state["on"] == 1) & (now == 1)
        stopped = state["stopped"] | (inside & (F.trim(line) == ""))
        takes = inside & ~stopped & (state["place"] < most_lines)
        item = F.trim(F.regexp_replace(line, r"^\s*[-•*–]\s*", ""))
        return F.struct(
            (state["n"] + 1).alias("n"), now.alias("on"), stopped.alias("stopped"), F.when(opened, F.trim(F.regexp_replace(line, r"^[^:]*:", ""))).otherwise(state["own"]).alias("own"),
            (state["place"] + inside.cast("int")).alias("place"), F.when(takes, F.concat(state["items"], F.array(item))).otherwise(state["items"]).alias("items"),
        )

    value = F.aggregate(lines, start, read, lambda s: F.when(s["own"] != "", s["own"]).otherwise(F.array_join(s["items"], ", ")))
    return let(value, lambda v: F.when(v != "", v))


def title(rows: DataFrame, label: str, hiring: str, professions: list[str], most: int = 90) -> DataFrame:
    """``id, title``: a labelled one, else what a hiring phrase in the first eight lines names, else the first short line with a profession."""
    line = F.trim("line")
    labelled = F.trim(F.regexp_extract("line", rf"(?i)^\s*(?:{label})\s*:\s*(.+)$", 1))
    hired = F.trim(F.regexp_extract("line", rf"(?i)(?:{hiring})\s*:?\s*([\p{{L}}' -]{{3,60}})", 1))
    named_ = F.when((F.length(line) <= 60) & F.rlike(F.lower(line), F.lit("|".join(keyword_pattern(p) for p in professions))), line)
    candidates = F.array(
        F.when(labelled != "", F.struct(F.lit(1).alias("p"), F.col("pos"), labelled.alias("t"))),
        F.when((hired != "") & (F.col("pos") < 8), F.struct(F.lit(2).alias("p"), F.col("pos"), hired.alias("t"))),
        F.when(named_.isNotNull(), F.struct(F.lit(3).alias("p"), F.col("pos"), named_.alias("t"))),
    )
    best = rows.select("id", F.explode(F.array_compact(candidates)).alias("c")).groupBy("id").agg(F.min("c").alias("c"))
    return best.select("id", F.substring(F.regexp_replace(F.col("c.t"), r"[\s.,;:!-]+$", ""), 1, most).alias("title"))


def title_of(text: Column, label: str, professions: list[str], most: int = 90) -> Column:
    """The title of a whole text as a column: a labelled one, else the first short line that names a profession; null without either."""
    labelled = F.trim(F.regexp_extract(text, rf"(?im)^[^\p{{L}}\n]*(?:{label})\s*:[ \t]*(\S[^\n]*)$", 1))
    named_ = F.get(F.filter(F.split(text, "\n"), lambda x: (F.length(F.trim(x)) <= 60) & F.rlike(F.lower(x), F.lit("|".join(keyword_pattern(p) for p in professions)))), F.lit(0))
    found = F.coalesce(F.when(labelled != "", labelled), F.trim(named_))
    return F.substring(F.regexp_replace(found, r"[\s.,;:!-]+$", ""), 1, most)


def company_of(text: Column, label: str) -> Column:
    """The labelled employer of a whole text, where it is like a name (seven words at most, no sentence)."""
    value = F.trim(F.regexp_extract(text, rf"(?im)^[^\p{{L}}\n]*(?:{label})\s*:[ \t]*(\S[^\n]*)$", 1))
    return F.when((value != "") & (F.size(F.split(value, r"\s+")) <= 7) & ~value.rlike(r"[.!?]\s+\p{L}"), value)


def company(rows: DataFrame, label: str) -> DataFrame:
    """``id, company``: the labelled value where all labels agree; values like a sentence are not names."""
    value = F.trim(F.regexp_extract("line", rf"(?i)^\s*(?:{label})\s*:\s*(.+)$", 1))
    good = rows.select("id", "pos", value.alias("v")).where((F.col("v") != "") & (F.size(F.split("v", r"\s+")) <= 7) & ~F.rlike("v", F.lit(r"[.!?]\s+\p{L}")))
    agreed = good.groupBy("id").agg(F.count_distinct(F.lower("v")).alias("n"), F.min_by("v", "pos").alias("company"))
    return agreed.where("n = 1").select("id", "company")


def linked_positions(rows: DataFrame) -> DataFrame:
    """``id, pos, position, url``: lines of a vacancy list that carry a link of their own; a list has two distinct links at least."""
    url = F.regexp_extract("line", URL, 0)
    hits = rows.select("id", "pos", F.trim(F.regexp_replace(F.regexp_replace("line", URL, ""), r"^[\s\d.)•*-]+|[\s:–-]+$", "")).alias("position"), url.alias("url")).where((F.col("url") != "") & (F.col("position") != ""))
    listed = hits.groupBy("id").agg(F.count_distinct("url").alias("n")).where("n >= 2").select("id")
    return hits.join(listed, "id", "left_semi")


def positions(rows: DataFrame, professions: list[str]) -> DataFrame:
    """``id, positions``: numbered or bulleted lines that name a profession, once each; two at least."""
    item = F.trim(F.regexp_replace("line", r"^\s*(?:\d{1,2}[.)]|[-•*–])\s*", ""))
    good = rows.where(F.rlike("line", F.lit(r"^\s*(?:\d{1,2}[.)]|[-•*–])\s*\S")) & F.rlike(F.lower("line"), F.lit("|".join(keyword_pattern(p) for p in professions))) & (F.length("line") <= 80))
    once = good.groupBy("id", F.lower(item).alias("k")).agg(F.min(F.struct(F.col("pos"), item.alias("t"))).alias("x"))
    listed = once.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs")).where(F.size("xs") >= 2)
    return listed.select("id", F.transform("xs", lambda x: x["t"]).alias("positions"))


def assembled(fields: DataFrame) -> DataFrame:
    """``confidence`` (title .35, a guessed one .2; contact .35; pay, region, company .1 each) and ``low_quality`` of parsed posts."""

    def points(c: Column, p: float) -> Column:
        return F.when(c, p).otherwise(0.0)

    total = F.when(F.col("title").isNull(), 0.0).when(F.coalesce("title_guessed", F.lit(False)), 0.2).otherwise(0.35)
    total = total + points(F.coalesce("phone", "account").isNotNull(), 0.35) + points(F.coalesce("salary_min", "salary_max").isNotNull(), 0.1) + points(F.col("region").isNotNull(), 0.1) + points(F.col("company").isNotNull(), 0.1)
    return fields.withColumn("confidence", F.round(F.least(total, F.lit(1.0)), 2)).withColumn("low_quality", F.col("title").isNull() & F.coalesce("salary_min", "salary_max").isNull())


def translated(titles: DataFrame, exact: DataFrame, words: list[tuple[str, str]]) -> DataFrame:
    """Titles by an exact dictionary (``folded, translated``), else word by word, longest first."""
    told = titles.withColumn("folded", F.lower(F.trim("title"))).join(F.broadcast(exact), "folded", "left")
    piece = F.col("folded")
    for a, b in sorted(words, key=lambda w: (-len(w[0]), w[0])):
        piece = F.regexp_replace(piece, rf"(?<![\p{{L}}']){a}(?![\p{{L}}'])", b)
    return told.withColumn("translated", F.coalesce("translated", piece)).drop("folded")


def overlay(parsed: DataFrame, site: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Fields given by a site win over those parsed; yearly pay becomes monthly."""
    given = site.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    both = parsed.join(given, key, "left")
    for f in fields:
        value = F.coalesce(f"_{f}", f)
        if f.startswith("salary_m"):
            value = F.when(F.coalesce("_salary_period", "salary_period") == "year", F.bround(value / 12).cast("long")).otherwise(value)
        both = both.withColumn(f"_{f}", value)
    period = F.when(F.col("_salary_period") == "year", "month").otherwise(F.col("_salary_period"))
    return both.select(*(c for c in parsed.columns if c not in fields), *((period if f == "salary_period" else F.col(f"_{f}")).alias(f) for f in fields))


def enriched(parsed: DataFrame, answers: DataFrame, version: str, text: Column, least: float = 0.7) -> DataFrame:
    """Stored answers (``key, title, company``) for rows that want them (low confidence or quality): the parsed value wins where it is sure."""
    wants = (F.col("confidence") < least) | F.col("low_quality")
    keyed = parsed.withColumn("_key", F.when(wants, F.sha2(F.concat_ws("|", F.lit(version), text), 256)))
    got = answers.select(F.col("key").alias("_key"), F.col("title").alias("_title"), F.col("company").alias("_company"))
    both = keyed.join(got, "_key", "left")
    good = F.length(F.trim("_title")).between(3, 90)
    return both.withColumn("title", F.when(good, F.col("_title")).otherwise(F.col("title"))).withColumn("company", F.coalesce("company", "_company")).withColumn("was_enriched", F.col("_title").isNotNull()).drop("_key", "_title", "_company")


def own_accounts(sources: DataFrame) -> DataFrame:
    """``source, account``: a source's identifier and listed accounts, to be left out of contacts."""
    listed = F.concat(F.array(F.col("identifier")), F.coalesce("own_usernames", F.array().cast("array<string>")))
    return sources.select("source", F.explode(listed).alias("a")).select("source", F.concat(F.lit("@"), F.regexp_replace(F.lower("a"), "^@", "")).alias("account")).distinct()


def stored_columns(parsed: DataFrame) -> DataFrame:
    """Parsed posts in the stored shape: first phone and account, lengths limited."""
    return parsed.select("id", F.substring("title", 1, 200).alias("title"), F.substring("company", 1, 200).alias("company"), F.get("phones", F.lit(0)).alias("phone"), F.get("accounts", F.lit(0)).alias("account"), F.substring("text", 1, 4000).alias("description"))


def content_verdict(text: Column, spam: list[str], scam: list[str], exceptions: list[str], banned: Column | None = None) -> Column:
    """First content rule that holds: a banned author, spam words, over two links, shouting, over ten pictographs, scam words outside exceptions; else ``ok``.

    Words are looked for in the folded text, so other alphabets and spellings of a letter count too.
    """
    letters = F.regexp_count(text, F.lit(r"\p{L}"))

    def verdict(folded: Column) -> Column:
        return (
            F.when(evidence(folded, spam) > 0, "spam words")
            .when(F.regexp_count(text, F.lit(URL)) > 2, "links")
            .when(let(letters, lambda n: (n >= 20) & (F.regexp_count(text, F.lit(r"\p{Lu}")) > n * 0.6)), "capitals")
            .when(F.regexp_count(text, F.lit(r"\p{So}")) > 10, "pictographs")
            .when(evidence(without_keywords(folded, exceptions), scam) > 0, "scam words")
            .otherwise("ok")
        )

    return F.when(F.lit(False) if banned is None else F.coalesce(banned, F.lit(False)), "banned").otherwise(let(fold(text), verdict))
