"""The per-post flow, and text forms and rules that need their own wording, over texts that are derived from whole tables.

A wording is SQL over a table's columns; the operators read it as text, and the SQL of a query computes the outcome
from the columns, so neither repeats the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import contacts, text
from tidemill.operators import dedup, extract, flow
from tidemill.plans.catalog import query
from tidemill.plans.views import ctes, view
from tidemill.session import spread, table

#: The flow's now, inside the time over which orders are dealt as posts (one a minute).
FLOW_NOW = "2024-01-06 00:00:00"
MARKERS = {
    "closed": ["vacancy is closed"], "resume": ["looking for a job", "#resume"], "scam": ["deposit"], "scam_exceptions": ["no deposit"], "opportunity_strong": ["unpaid internship"],
    "opportunity_exceptions": ["paid later"], "not_job_strong": ["video lessons"], "opportunity": ["grant"], "ad": ["discount", "sale of"], "job": ["position", "salary", "duties", "phone", "schedule"],
}
CONTEXT = ("phone", "call", "ring")
LINKS = contacts.LinkRules(
    (contacts.LinkClass("message of a channel", r"t\.me/\w+/\d+", 0), contacts.LinkClass("picture page", r"instagram\.com/", 0), contacts.LinkClass("form", r"forms\.gle/", 3)),
    begin=("apply", "havola"), whole=("form",),
)
TITLES = dedup.TitleWords(roles=("kerak", "menejer", "mutaxassis"), fillers=("va",))
RULES = flow.Rules(MARKERS, professions=["role"], international_a_day=40, context=CONTEXT, links=LINKS, titles=TITLES)

# each line of a post comes from columns of its order; the flow sees the text only
_POST = """CASE WHEN profession IS NULL THEN 'Work for you' ELSE 'Position: ' || category || ' ' || profession END || chr(10)
|| CASE WHEN coalesce(salary_min, salary_max) IS NULL THEN 'By agreement' WHEN currency = 'UZS' THEN 'Salary: ' || CAST(1 + user_id % 9 AS VARCHAR(9)) || ' mln so''m' ELSE 'Salary by agreement' END || chr(10)
|| 'Schedule: 5/2, 09:00-18:00' || chr(10) || 'Place: ' || region || chr(10)
|| CASE WHEN status = 'failed' THEN 'This vacancy is CLOSED' || chr(10) ELSE '' END
|| CASE WHEN origin = 'user' AND category = 'low' THEN 'I am looking for a job' || chr(10) ELSE '' END
|| CASE WHEN kind = 'project' THEN CASE WHEN category = 'high' THEN 'There is no deposit' ELSE 'Send a deposit' END || chr(10) ELSE '' END
|| CASE WHEN is_remote AND category = 'urgent' THEN 'An unpaid internship' || CASE WHEN origin = 'user' THEN ', paid later' ELSE '' END || chr(10) ELSE '' END
|| CASE WHEN category = 'medium' AND salary_period = 'day' THEN 'Our video lessons' || chr(10) ELSE '' END
|| CASE WHEN expires_at IS NULL THEN 'Deadline: ' || CASE WHEN user_id % 2 = 0 THEN '2024-01-05' ELSE '06.02.2024' END || chr(10) ELSE '' END
|| CASE WHEN priority_tier IS NULL THEN 'Write to us' ELSE 'Phone: +998 90 ' || lpad(CAST(user_id % 1000 AS VARCHAR(9)), 3, '1') || ' 45 ' || CAST(10 + user_id % 90 AS VARCHAR(9)) END"""
_AT = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * id"
_FLOW = f"SELECT id, source, {_POST} AS text, {_AT} AS posted_at, {_AT} AS fetched_at, user_id % 31 = 0 AS is_backfill, next_retry_at IS NULL AS is_site, next_retry_at IS NULL AS international FROM jobs"
# status by the columns that the text was worded from
_ALONE = """CASE WHEN user_id % 31 = 0 THEN 'skipped_backfill' WHEN status = 'failed' OR (expires_at IS NULL AND user_id % 2 = 0) THEN 'closed' WHEN origin = 'user' AND category = 'low' THEN 'resume' WHEN kind = 'project' AND category <> 'high' THEN 'suspicious'
WHEN is_remote AND category = 'urgent' AND origin <> 'user' AND next_retry_at IS NOT NULL THEN 'opportunity' WHEN category = 'medium' AND salary_period = 'day' AND next_retry_at IS NOT NULL THEN 'not_job' WHEN profession IS NULL AND coalesce(salary_min, salary_max) IS NULL AND priority_tier IS NULL AND next_retry_at IS NOT NULL THEN 'not_job'
WHEN priority_tier IS NULL THEN 'no_contact' WHEN profession IS NULL AND NOT coalesce(coalesce(salary_min, salary_max) IS NOT NULL AND currency = 'UZS', false) THEN 'low_quality' END"""
# copies: equal texts with at most 14 days between neighbours are one group
_FLOW_SQL = ctes("jobs").rstrip() + f""", p AS (SELECT id, {_POST} AS text, {_AT} AS came, {_ALONE} AS alone, next_retry_at IS NULL AS international FROM jobs), a AS (SELECT * FROM p WHERE alone IS NULL),
g AS (SELECT *, CASE WHEN came > lag(came) OVER w + INTERVAL 14 DAY THEN 1 ELSE 0 END AS gap FROM a WINDOW w AS (PARTITION BY text ORDER BY came, id)), i AS (SELECT *, sum(gap) OVER (PARTITION BY text ORDER BY came, id) AS island FROM g),
r AS (SELECT *, min(id) OVER (PARTITION BY text, island) AS root FROM i), c AS (SELECT id, root, CASE WHEN root = id AND international THEN row_number() OVER (PARTITION BY root = id AND international, CAST(came AS DATE) ORDER BY came, id) ELSE 0 END AS place FROM r),
f AS (SELECT p.id, coalesce(alone, CASE WHEN root <> p.id THEN 'duplicate' WHEN place > 40 THEN 'skipped_limit' ELSE 'done' END) AS status, root FROM p LEFT JOIN c ON p.id = c.id) """


def flow_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders worded as posts."""
    return spark.sql(_FLOW.replace("FROM jobs", "FROM {jobs}"), jobs=spread(view(spark, sf_dir, "jobs")))


def _run(spark: SparkSession, sf_dir: str, layers: tuple[str, ...]) -> DataFrame:
    return flow.flow(flow_posts(spark, sf_dir), RULES, F.lit(FLOW_NOW).cast("timestamp"), layers)


@query("post_flow", _FLOW_SQL + "SELECT id, status, CASE WHEN status IN ('done', 'duplicate') THEN root END AS job_id FROM f")
def post_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status for every post, with copies by equal text (the layer that SQL can express; a test runs all layers)."""
    return _run(spark, sf_dir, ("hash",)).select("id", "status", "job_id")


@query("flow_counters", _FLOW_SQL + "SELECT status, count(*) AS n FROM f GROUP BY status")
def flow_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of a run's posts."""
    return flow.counters(_run(spark, sf_dir, ("hash",)))


# ---- text forms on letters of another alphabet: letters that stand for one another are exchanged, so the result is the given text
_LATIN, _CYRILLIC = "abvgdjziyklmnoprstufxqh", "абвгджзийклмнопрстуфхқҳ"
_BOTH = _LATIN + _LATIN.upper(), _CYRILLIC + _CYRILLIC.upper()


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("latin_again", "SELECT doc_id, md5(text) AS latin FROM documents")
def latin_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: whole texts written in Cyrillic letters, made Latin again with their capitals."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.to_latin(F.translate("text", *_BOTH))).alias("latin"))


@query("wide_letters", "SELECT doc_id, md5(regexp_replace(lower(text), '[‘’ʻʼ`´′]', '''', 'g')) AS plain FROM documents")
def wide_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: compatibility forms (full-width letters and digits) and apostrophes of whole texts, unified."""
    narrow = "".join(map(chr, range(0x30, 0x3A))) + "".join(map(chr, range(0x61, 0x7B)))
    wide = "".join(chr(ord(c) + 0xFEE0) for c in narrow)
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.unify(F.translate(F.lower("text"), narrow, wide))).alias("plain"))


_UZ, _RU = ["керак", "билан"], ["нужен", "для"]
_WORDED = "CASE doc_id % 4 WHEN 0 THEN 'Ҳайдовчи керак ' || doc_id WHEN 1 THEN 'Нужен водитель для ' || doc_id WHEN 2 THEN text ELSE 'haydovchi kerak, ' || doc_id END"
_LATIN_WORDS = {"uz_latin": ["kerak", "bilan", "uchun"], "en": ["the", "of", "and", "to", "that", "was"]}


@query("script_language", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'uz_cyrillic' WHEN 1 THEN 'ru' WHEN 3 THEN 'uz_latin' ELSE CASE WHEN len(list_filter(regexp_extract_all(lower(text), '[\\p{L}]+(?:''[\\p{L}]+)*'), lambda w: list_contains(['the', 'of', 'and', 'to', 'that', 'was'], w))) > len(list_filter(regexp_extract_all(lower(text), '[\\p{L}]+(?:''[\\p{L}]+)*'), lambda w: list_contains(['kerak', 'bilan', 'uchun'], w))) THEN 'en' ELSE 'uz_latin' END END AS language FROM documents")
def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by script, then by words; ties and texts without a listed word go to the first."""
    docs = _docs(spark, sf_dir).withColumn("text", F.expr(_WORDED))
    return docs.select("doc_id", text.language(F.col("text"), "ўқғҳ", _UZ, _RU, _LATIN_WORDS).alias("language"))


@query("normal_forms", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'haydovchi kerak' WHEN 1 THEN 'нужен водитель' ELSE 'driver wanted' END || chr(10) || lower(c_name) AS normal FROM customer")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only lines that look Uzbek become Latin; other lines keep their letters."""
    first = F.expr("CASE c_custkey % 3 WHEN 0 THEN '🔥 Ҳайдовчи КЕРАК' WHEN 1 THEN '  Нужен   водитель' ELSE 'Driver wanted' END")
    posts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("\n", first, F.col("c_name")).alias("text"))
    ready = posts.select("id", text.prepared(F.col("text")).alias("text"))
    return ready.select("id", text.normal_form(F.col("text"), "ўқғҳ", _UZ, _RU).alias("normal"))


@query("displayed", "SELECT c_custkey AS id, c_name || ' ' || c_mktsegment || ' O''zbek' AS shown FROM customer")
def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable lines: symbols out, one apostrophe, case kept."""
    line = F.concat(F.lit(" 🔥"), F.col("c_name"), F.lit("\t  "), F.col("c_mktsegment"), F.lit("   Oʻzbek✅"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.display(line).alias("shown"))


@query("calm_texts", "SELECT c_custkey AS id, 'Company looking ' || lower(c_mktsegment) || ' CEO today!' AS calm FROM customer")
def calm_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shouting in sentence case with acronyms kept, rude sentences out, runs of marks once."""
    line = F.concat(F.lit("COMPANY LOOKING "), F.upper("c_mktsegment"), F.lit(" CEO TODAY!!! You stupid people."))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.trim(text.calm(line, ["stupid"])).alias("calm"))


@query("tidy_addresses", "SELECT c_custkey AS id, 'City ' || n_name || ', Street ' || c_custkey AS address FROM customer JOIN nation ON c_nationkey = n_nationkey")
def tidy_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces and commas of addresses in order, repeated parts once."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a fixed list of nations
    given = F.concat(F.lit("  City   "), F.col("n_name"), F.lit(" ,,Street  "), F.col("c_custkey").cast("string"), F.lit(";\n city "), F.col("n_name"), F.lit(", "))
    return rows.select(F.col("c_custkey").alias("id"), text.tidy_address(given).alias("address"))


@query("schedules", "SELECT event_id AS id, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00-' || lpad(CAST(minute(ts) % 24 AS VARCHAR), 2, '0') || ':30, ' || (1 + user_id % 7) || '/2' AS schedule FROM events")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time ranges and day patterns, once each."""
    events = table(spark, sf_dir, "events")
    two = F.lpad(F.hour("ts").cast("string"), 2, "0"), F.lpad((F.minute("ts") % 24).cast("string"), 2, "0")
    days = F.concat((1 + F.col("user_id") % 7).cast("string"), F.lit("/2"))
    worded = F.concat(F.lit("Hours "), two[0], F.lit(":00 – "), two[1], F.lit(":30, days "), days, F.lit(", again "), two[0], F.lit(":00-"), two[1], F.lit(":30 and "), days)
    return events.select(F.col("event_id").alias("id"), text.schedule_numbers(worded).alias("schedule"))


@query("hashtag_words", "SELECT c_custkey AS id, 'Hello ' || lower(c_mktsegment) || '. Work in ' || upper(substr(lower(r_name), 1, 1)) || substr(lower(r_name), 2) AS plain FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'MIDDLE EAST'")
def hashtag_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashtags as words, with capitals at the start of a sentence and for places (regions whose name is one word)."""
    region = table(spark, sf_dir, "region").where("r_name <> 'MIDDLE EAST'")
    nations = table(spark, sf_dir, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat(F.lit("#hello #"), F.upper("c_mktsegment"), F.lit(". #work in #"), F.lower("r_name"))
    return rows.select(F.col("c_custkey").alias("id"), text.plain_hashtags(line, ["africa", "america", "asia", "europe"]).alias("plain"))


@query("filler_words", "SELECT o_orderkey AS id, CAST(1 + o_orderkey % 3 AS INT) AS n FROM orders")
def filler_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are neither fillers nor begin like a word of the title."""
    extra = F.expr("array_join(slice(array('clean', 'kitchen', 'quickly'), 1, cast(1 + o_orderkey % 3 as int)), ' ')")
    line = F.concat(F.lit("And the drivers will "), extra)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.meaningful_words(line, ["and", "the", "will"], F.lit("Driver of a truck")).cast("int").alias("n"))


@query("masked_texts", "SELECT c_custkey AS id, 'Call [PHONE], write to [EMAIL] or [USER], see [URL]' AS masked FROM customer")
def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts replaced by tokens."""
    k = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("Call +998 90 123 "), F.lpad(k, 4, "5"), F.lit(", write to c"), k, F.lit("@mail.uz or @user_"), k, F.lit(", see https://a.uz/x?y="), k)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), contacts.mask(line).alias("masked"))


@query("phone_spellings", "SELECT c_custkey AS id, '+99897' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '7') || '6722' AS phones, '@user_' || c_custkey AS accounts FROM customer")
def phone_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number in many groupings, beside prices, dates and links that are none; accounts in any spelling, the source's own left out."""
    k = F.col("c_custkey")
    three, user = F.lpad((k % 1000).cast("string"), 3, "7"), F.concat(F.lit("User_"), k.cast("string"))
    written = F.concat(F.lit("97."), three, F.lit(" 67 22"))
    again = F.concat(F.lit("+998 97 "), F.substring(three, 1, 3), F.lit("6 722"))
    line = F.concat(F.lit("Salary 4 000 000 so'm since 2026-09-19\n"), written, F.lit(" or ("), F.lit("97) "), three, F.lit("-67-22\nhttps://hh.uz/vacancy/137865831 "), again, F.lit("\nhotel 12 123 45 67 @"), user, F.lit(" https://t.me/"), F.upper(user), F.lit(" @own_one"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), line.alias("t"))
    return rows.select("id", F.array_join(contacts.phones(F.col("t"), CONTEXT), ",").alias("phones"), F.array_join(contacts.accounts(F.col("t"), F.array(F.lit("@own_one"))), ",").alias("accounts"))


@query("apply_choices", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://forms.gle/' || page_id WHEN 1 THEN 'https://b.example.com/go/' || page_id WHEN 2 THEN 'https://a.uz/' || page_id ELSE '' END AS best FROM pages")
def apply_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the best link to apply of every page's hidden links: by address, by words, bare; none for social pages and channel messages."""
    k = F.col("page_id").cast("string")

    def link(words: str | None, *url) -> Column:
        return F.struct(F.lit(words).cast("string").alias("text"), F.concat(*url).alias("url"))

    social, message = link("Instagram", F.lit("https://instagram.com/"), k), link("havola", F.lit("https://t.me/name/"), k)
    bare, told, form = link(None, F.lit("https://a.uz/"), k), link("📝 Apply here", F.lit("https://b.example.com/go/"), k), link("Jobs", F.lit("https://forms.gle/"), k)
    kind = F.col("page_id") % 4
    links = F.array(social, message, *(F.when(keep, x) for keep, x in ((kind <= 2, bare), (kind <= 1, told), (kind == 0, form))))
    found = table(spark, sf_dir, "pages").select("page_id", contacts.apply_links(F.array_compact(links), LINKS).alias("l"))
    return found.select("page_id", F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("best"))


@query("title_cores", "SELECT o_orderkey AS id, 'sotuv ' || lower(substr(o_orderpriority, 1, 1)) AS core FROM orders")
def title_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of titles that tell positions apart, spellings folded."""
    line = F.concat(F.lit("“HUNTER” Sottuv/menejeri va "), F.substring("o_orderpriority", 1, 1), F.lit(" mutaxxassisi kerak"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dedup.title_core(line, TITLES.roles, TITLES.fillers).alias("core"))


@query("deadline_forms", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS deadline FROM orders")
def deadline_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same date as ISO, with dots, without its year, and with the month's name; the 31st of February is none."""
    d = F.col("o_orderdate")
    month = F.get(F.array(*(F.lit(m.capitalize()) for m in extract.MONTHS)), F.month(d) - 1)
    forms = F.expr("cast(o_orderkey % 5 as int)")
    line = F.when(forms == 0, F.date_format(d, "yyyy-MM-dd")).when(forms == 1, F.date_format(d, "d.MM.yyyy")).when(forms == 2, F.date_format(d, "dd/MM")).when(forms == 3, F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), month)).otherwise("31.02.2024")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), extract.deadline(F.concat(F.lit("Deadline: "), line), F.year(d)).cast("string").alias("deadline"))


@query("negated_tags", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'meals' ELSE '' END AS tags FROM orders")
def negated_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag whose pattern is negated just after it does not count."""
    line = F.when(F.col("o_orderkey") % 2 == 0, "Free lunch for all").otherwise("Lunch is not provided\nnot on Sundays")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(extract.tags(line, {"meals": "lunch"}, "not"), ",").alias("tags"))


@query("cut_boilerplate", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'We need a clerk for our office in town' || chr(10) || 'Come tomorrow' WHEN 1 THEN 'Short' || chr(10) || 'Apply only by form, and then wait for a long answer from us' ELSE 'We need a clerk' || chr(10) || 'Tel 90 123 45 67' END AS text FROM customer")
def cut_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line that ends a post, where enough stays before it; whole lines of a rule; a phone that is nowhere else comes back."""
    posts = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("s").alias("source"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'We need a clerk for our office in town\nCome tomorrow\nApply only by form\nMore' WHEN 1 THEN 'Short\nApply only by form, and then wait for a long answer from us' ELSE '***\nWe need a clerk\nOur channel\nTel 90 123 45 67\n#job #work' END").alias("text"),
    )
    rules = spark.createDataFrame([("s", "cut", "^Apply only"), ("s", "line", "Our channel"), ("s", "part", "^Tel")], "source string, kind string, pattern string")
    return extract.stripped(posts, rules)


@query("folded_rules", "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'banned' WHEN c_custkey % 3 = 0 THEN 'spam words' WHEN c_custkey % 3 = 1 THEN 'ok' ELSE 'scam words' END AS verdict FROM customer")
def folded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content rules on folded texts, after the ban of the author."""
    posts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("banned"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'Казино учун' WHEN 1 THEN 'no deposit needed' ELSE 'Депозит керак' END").alias("t"))
    return posts.select("id", extract.content_verdict(F.col("t"), ["kazino"], ["deposit", "depozit"], ["no deposit"], F.col("banned")).alias("verdict"))
