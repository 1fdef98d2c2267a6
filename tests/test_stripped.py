"""Boilerplate out of posts: equal to a loop over lines, and every post is read where it lies."""

import random
import re

from pyspark.sql import functions as F

from tidemill.functions.contacts import ACCOUNT, EMAIL, PHONE
from tidemill.operators import extract

RULES = [("a", "part", "Join us"), ("a", "cut", "^Apply only"), ("a", "line", "Our motto"), ("b", "part", "[Aa]dvert"), ("b", "part", "^Tel"), ("c", "line", "More.*")]
LINES = ["***", "", "  ", "Cook wanted", "Join us @one_two", "Write to @one_two", "Our motto", "Our motto is long", "Apply only by form", "Tel +998 90 123 45 67", "Call +998 90 123 45 67", "advert x@y.example", "x@y.example, @one_two", "#job #work", " #job", "More @three_x", "Reach @three_x now"]


def by_loop(source, text, contacts):
    lines = (text or "").split("\n")
    total, so_far, ended, begun, kept = max(sum(map(len, lines)), 1), 0, False, False, []
    rules = {k: [r[2] for r in RULES if r[:2] == (source, k)] for k in ("line", "part", "cut")}
    for i, x in enumerate(lines):
        line = x.strip(" ")
        ended |= so_far / total >= extract.KEEP_SHARE and any(re.search(p, line) for p in rules["cut"])
        begun |= any(c.isalnum() for c in line)
        tags = all(re.fullmatch(r"(?:#[^\s#]+\s*)*", y.strip(" ")) for y in lines[i:])
        kept.append(begun and not ended and not tags and not any(re.fullmatch(p, line) for p in rules["line"]) and not any(re.search(p, line) for p in rules["part"]))
        so_far += len(x)
    seen = {c for x, k in zip(lines, kept) if k for c in contacts[x]}
    out = []
    for x, k in zip(lines, kept):
        new = not k and not seen.issuperset(contacts[x])
        seen.update(contacts[x])
        out += [x] if k or new else []
    return "\n".join(out) if out else None


def test_stripped_equals_a_loop_and_needs_no_shuffle(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", None]), None if i % 50 == 0 else "\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 9)))) for i in range(1500)]
    posts = spark.createDataFrame(rows, "id long, source string, text string")
    found = F.concat(*(F.regexp_extract_all("x", F.lit(p), F.lit(0)) for p in (EMAIL, PHONE, ACCOUNT)))
    contacts = {r["x"]: r["c"] for r in spark.createDataFrame([(x,) for x in LINES], "x string").select("x", found.alias("c")).collect()}
    out = extract.stripped(posts, spark.createDataFrame(RULES, "source string, kind string, pattern string"))
    wanted = {i: w for i, s, t in rows if (w := by_loop(s, t, contacts)) is not None}
    assert {r["id"]: r["text"] for r in out.collect()} == wanted and 0 < len(wanted) < len(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1  # that of the rules
