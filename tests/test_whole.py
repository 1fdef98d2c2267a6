"""Queries cover whole tables and whole texts."""

import re

from pyspark.sql import functions as F

from tidemill.plans import catalog
from tidemill.session import table

QUERIES = catalog.queries()


def summary(text, limit):
    out = ""
    for unit in re.findall(r"[^.!?\n]+[.!?]*\s*|\n+", text, re.ASCII):
        if len((out + unit).rstrip(" ")) > limit:
            break
        out += unit
    return re.sub(r"(\n[^\n]*:)+\s*$", "", out.rstrip(" "), flags=re.ASCII)


def test_summaries_equal_a_loop_over_whole_texts(spark, sf, tmp_path):
    late = spark.createDataFrame([(10**9, "." * 2500 + "After the dots. And more.", "en", "a", 2525)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = table(spark, sf, "documents").select(*late.columns).unionByName(late)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["summary"] for r in QUERIES["whole_units"](spark, str(tmp_path)).collect()}
    assert got[10**9] == "After the dots. And more."
    assert got == {r["doc_id"]: summary(r["text"], 300) for r in docs.collect()}


def test_slugs_read_past_the_prefix(spark, tmp_path):
    text = "\u4e2d" * 100 + " late title\nbody"
    docs = spark.createDataFrame([(1, text, "en", "a", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["slugs_all"](spark, str(tmp_path)).first()["slug"] == "late-title"


def test_whole_tables_are_covered(spark, sf):
    sources = QUERIES["source_overview_all"](spark, sf)
    assert sources.count() == table(spark, sf, "supplier").count()
    assert QUERIES["rotating_assets_all"](spark, sf).select("id").distinct().count() == table(spark, sf, "orders").count()
    merged = QUERIES["album_texts"](spark, sf)
    assert merged.agg(F.sum("n_parts")).first()[0] == table(spark, sf, "events").count()
    assert merged.select("digest").distinct().count() > 1
    assert QUERIES["open_page_all"](spark, sf).count() > 8
    assert QUERIES["source_changes"](spark, sf).count() == table(spark, sf, "supplier").count()
    assert QUERIES["asset_changes"](spark, sf).count() == table(spark, sf, "part").count()


def test_phones_of_all_documents_equal_a_loop(spark, sf, tmp_path):
    """Numbers read character by character, not by the operator's pattern."""
    from tidemill.functions import contacts

    more = [(10**9 + k, t, "en", "a", 1) for k, t in enumerate(["a +998 93 511 22 07, 93-511-22-08", "x(93)511.22.09 @olim_hr @Olim_hr", "12 511 22 07\n+998125112207", "no. 9351122071, 935112207", "see a@b.example.uz 93 500 00 00 0"])]
    docs = table(spark, sf, "documents").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def digits_from(line, i, n):
        """End of n digits from i on, each after one separator at most and with brackets around some; None where they end early."""
        for k in range(n):
            j = i
            if k and j < len(line) and line[j] in " .-":
                j += 1
            if j < len(line) and line[j] == "(":
                j += 1
            if j >= len(line) or not (line[j].isascii() and line[j].isdigit()):
                return None
            i = j + 1
            if i < len(line) and line[i] == ")" and (k + 1 < n):
                i += 1
        return i

    def phones(text):
        out = []
        for line in text.split("\n"):
            line = re.sub(contacts.URL, " ", re.sub(contacts.EMAIL, " ", line))
            i = 0
            while i < len(line):
                free = i == 0 or not (line[i - 1].isalnum() or line[i - 1] in "_+")
                begin = i + 1 if line[i] == "+" else i
                ends = []
                if free and line[begin : begin + 3] == "998":
                    ends.append((begin, 12))
                if free and re.match(r"[(]?\d\d", line[i:], re.ASCII):
                    ends.append((i, 9))
                for start, n in ends:
                    end = digits_from(line, start, n)
                    if end is not None and not line[end : end + 1].isdigit():
                        d = re.sub(r"\D", "", line[start:end])
                        if not d.endswith("000000") and (n == 12 or d[:2] in contacts.CODES) and "+998" + d[-9:] not in out:
                            out.append("+998" + d[-9:])
                        i = end - 1
                        break
                i += 1
        return out

    got = {r["doc_id"]: r["phones"] for r in QUERIES["phones_found"](spark, str(tmp_path)).collect()}
    assert got[10**9] == "+998935112207,+998935112208" and got[10**9 + 2] == "+998125112207"
    assert got == {r["doc_id"]: ",".join(phones(r["text"])) for r in docs.collect()}
    assert sum(bool(p) for p in got.values()) >= 4
