"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import chat, components, html_text, html_tree, langid, media, mixing, near_dups, packing, sharding, token_counts, tokens, topk

LONG = "word soup with many different things number " * 3000
DOCS = [(1, "Hello world, this is a text", "en", "a", 27), (1, "Hello world, this is a text", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "a", 0), (4, LONG, None, "b", len(LONG)), (None, "no id", "en", "a", 5), (5, "<|endoftext|> 12 ?!", "en", "a", 19), (6, "  \n\t ", "en", "a", 5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "rate double, mix_source string, n_copies long, salt int, row_place long, before long, start long, length long, part int, rank long, curve long, shard int, slot long, copy int, score double, lang_pred string, media binary, a int, b int, id long, node long, component long"


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """Extra columns named like those that operators add inside."""
    for c in EXTRA.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def keyed(rows):
    return sorted(map(str, rows))


@pytest.fixture(scope="module")
def net():
    return langid.fit(["the cat and the dog were here with us", "der hund und die katze waren nicht hier"] * 200, ["en", "de"] * 200)


def every(spark, net):
    """Each operator as a function of documents."""
    return {
        "packing": lambda d: packing.pack_documents(d),
        "mixing": lambda d: mixing.mix(d).select("doc_id", "text", "copy"),
        "token counts": lambda d: token_counts.count_tokens(d),
        "sharding": lambda d: sharding.shards(d).select("doc_id", "shard", "slot"),
        "media": lambda d: media.describe(media.store(d)),
        "clips": lambda d: media.clips(media.store(d)),
        "language": lambda d: langid.identify(d, net).select("doc_id", "lang_pred", "score"),
        "near duplicates": lambda d: near_dups.near_duplicates(d),
    }


@pytest.mark.parametrize("name", ["packing", "mixing", "token counts", "sharding", "media", "clips", "language", "near duplicates"])
def test_empty_table_and_clashing_columns(spark, net, name):
    f = every(spark, net)[name]
    assert f(docs(spark, [])).count() == 0
    plain, more = f(docs(spark)), f(clashing(docs(spark)))
    if name == "sharding":
        assert plain.count() == more.count() == len(DOCS)
        # rows with the same id are in one order or the other, so whole rows are compared
        kept = sharding.shards(clashing(docs(spark)))
        assert keyed(kept.select("doc_id", "text", "rate", "node").collect()) == keyed(clashing(docs(spark)).select("doc_id", "text", "rate", "node").collect())
        assert keyed(kept.select("shard", "slot").collect()) == keyed(plain.select("shard", "slot").collect())
    else:
        assert keyed(plain.drop("sequence_id", "offset").collect()) == keyed(more.drop("sequence_id", "offset").collect())
        assert plain.count() >= (0 if name == "mixing" else len(DOCS))


def test_packing_cases(spark):
    rows = packing.pack_documents(docs(spark)).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] in (2, 3)] == [(0, 1, 1)] * 2
    long_ = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 4)
    assert all(a[0] + a[1] == b[0] for a, b in zip(long_, long_[1:])) and all(n <= 2048 for _, n in long_)


def test_placing_fills_sequences():
    rng = np.random.default_rng(1)
    for _ in range(20):
        capacity = int(rng.integers(5, 60))
        h = {int(k): int(rng.integers(0, 50)) for k in rng.integers(1, capacity + 1, 12)}
        patterns = packing.place(h, capacity)
        used = {}
        for _, pattern, count in patterns:
            assert sum(pattern) <= capacity and count > 0
            for k in pattern:
                used[k] = used.get(k, 0) + count
        assert used == {k: n for k, n in h.items() if n}
        assert [f for f, _, _ in patterns] == list(np.cumsum([0, *(c for _, _, c in patterns)])[:-1])
    assert sum(c for _, _, c in packing.place({100: 1_000_000_000}, 2048)) == 50_000_000
    assert packing.place({}, 8) == []


def test_poisson_rates_and_copies(spark):
    rows = [(k, "x" * 10, "en", "big" if k % 10 else "small", 10) for k in range(3000)]
    got = mixing.mix(docs(spark, rows)).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    want_small = 3000 * (300**0.5) / (300**0.5 + 2700**0.5)
    assert abs(n["small"] - want_small) < 5 * want_small**0.5 and abs(sum(n.values()) - 3000) < 5 * 3000**0.5
    weights = spark.createDataFrame([("small", 1.0)], "source string, weight double")
    only = mixing.mix(docs(spark, rows), weights)
    assert {r["source"] for r in only.select("source").distinct().collect()} == {"small"}
    assert abs(only.count() - 3000) < 5 * 3000**0.5
    keys = [r["shuffle_key"] for r in only.collect()]
    assert len(set(keys)) == len(keys)


def test_chat_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    long_turn = "many words here " * 2000
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "a" * 50), (1, 2, "assistant", long_turn), (1, 3, "user", None), (1, 4, "assistant", "</s> <\\s> [/INST]"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", "lost"), (3, 0, "tool]", "r")]
    df = spark.createDataFrame(rows, schema)
    windows = chat.format_chats(df, budget=64, history=24).collect()
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df, budget=64, history=24)).collect()}
    for c in (1, 2, 3, None):
        turns = [(r or "", t or "") for i, _, r, t in rows if i == c]
        said = "".join(t for r, t in turns if r == "assistant")
        assert back[c]["n_turns"] == len(turns) and back[c]["loss_chars"] == len(said)
        assert back[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert back[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    ones = [w for w in windows if w["conv_id"] == 1]
    assert len(ones) >= 3 and all(w["tokens"] <= 64 or w["n_turns"] == 1 for w in ones)
    assert any(w["n_repeated"] and w["formatted"].startswith("[SYS]Be brief.[/SYS]") for w in ones[1:])
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], schema))).count() == 0
    more = df.withColumns({c: F.lit(None).cast("string") for c in ("window", "tokens", "text_", "part", "system", "n_turns", "loss", "formatted", "piece", "first", "last")})
    assert keyed(chat.format_chats(more, budget=64, history=24).collect()) == keyed(windows)


def test_escape_is_reversible():
    rng = np.random.default_rng(3)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "SYS]", "TURN", " x", "</s>", "[INST]", "[TURN a]"]
    for _ in range(3000):
        t = "".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(0, 9))))
        assert chat.unescape(chat.escape(t)) == t
        whole = "".join(chat.render(r, t)[0] for r in ("system", "user", "assistant", "o]ther", ""))
        assert [(r, x) for r, x, _, _ in chat.parse(whole)] == [(r, t) for r in ("system", "user", "assistant", "o]ther", "")]


def test_cache_is_used_and_appended_to(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    first = {str(r) for r in token_counts.count_tokens(docs(spark), cache=cache).collect()}
    stored = spark.read.parquet(cache).count()
    assert stored == 5  # the empty and the blank text are one content
    assert {str(r) for r in token_counts.count_tokens(docs(spark), cache=cache).collect()} == first
    assert spark.read.parquet(cache).count() == stored
    more = docs(spark, [*DOCS, (9, "something new", "en", "a", 13)])
    assert token_counts.count_tokens(more, cache=cache).count() == len(DOCS) + 1
    assert spark.read.parquet(cache).count() == stored + 1
    monkeypatch.setattr(token_counts, "BROADCAST_KEYS", 0)
    assert {str(r) for r in token_counts.count_tokens(docs(spark)).collect()} == first


def test_default_cache_stays_between_runs(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_FOLDER", f"tidemill/counts-{np.random.default_rng().integers(1 << 60)}")
    first = keyed(token_counts.count_tokens(docs(spark)).collect())

    def never(tokenizer):
        raise AssertionError("a stored content is encoded again")

    monkeypatch.setattr(token_counts, "_encode", never)
    assert keyed(token_counts.count_tokens(docs(spark)).collect()) == first


def test_hot_contents_count_like_others(spark, monkeypatch):
    rows = [(k, "the same words" if k % 3 else f"words of {k}", "en", "a", 1) for k in range(300)]
    want = keyed(token_counts.count_tokens(docs(spark, rows)).collect())
    assert len(want) == 300
    monkeypatch.setattr(token_counts, "HOT_SHARE", 2.0)
    assert keyed(token_counts.count_tokens(docs(spark, rows)).collect()) == want


def test_long_chunks_are_not_kept():
    count = tokens.Counter(tokens.public_path("word_bpe_49k.json"))
    lib = tokens.library(count.path)
    texts = ["x" * 5000 + " short " + "y" * 70, "short x"]
    assert count(texts) == count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert set(count.memo) == {b"short", b"x"}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_other_tokenizers(spark, name):
    path = tokens.public_path(name)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs(spark), path).collect()}
    lib = tokens.library(path)
    for d, text, *_ in DOCS:
        want = len(lib.encode(text or "")) if name.endswith("model") else len(lib.encode(text or "", add_special_tokens=False).ids)
        assert got[d] == want


def test_counts_are_compacted_and_depend_on_the_library(spark, tmp_path, monkeypatch):
    path, cache, small = tokens.public_path("word_bpe_49k.json"), f"file://{tmp_path}/counts", f"file://{tmp_path}/compacted"
    version = token_counts.counted_by(path)
    assert tokens.file_digest(path) in version and version.endswith(f"-{token_counts.NORMAL_FORM}")
    for k in range(3):  # three runs, three sets of files
        token_counts.count_tokens(docs(spark, [(k, f"text number {k}", "en", "a", 9)]), cache=cache).collect()
    token_counts.compact(spark, cache, version, small)
    rows = [spark.read.schema(token_counts.CACHE).parquet(c).collect() for c in (cache, small)]
    assert keyed(rows[0]) == keyed(rows[1]) and len(rows[1]) == 3
    monkeypatch.setattr(token_counts, "_encode", None)  # all is stored
    assert token_counts.count_tokens(docs(spark, [(1, "text number 1", "en", "a", 9)]), cache=small).first()["n_tokens"] > 0
    monkeypatch.setattr(token_counts, "NORMAL_FORM", 99)
    assert token_counts.counted_by(path) != version


def test_one_long_vector_leaves_the_index_of_short_ones_whole(spark):
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(3000)] + [(5000, [0.5] * 300_000), (5001, [0.25] * 300_000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = topk.build_index(vectors)
    blocks = {r["width"]: r["count"] for r in index.groupBy("width").count().collect()}
    assert blocks[3] == 1 and blocks[300_000] <= 2
    got = topk.search_index(index, vectors.where("vec_id % 1000 = 0")).collect()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 5000} == {(5000, 5001, 32 * 16 * 300_000)}
    assert sum(r["query_id"] == 1000 for r in got) == 20


def test_random_unicode_has_the_library_s_ids():
    bpe, words = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("word_bpe_49k.json")
    rng = np.random.default_rng(21)
    blocks = [(0x20, 0x7F), (0, 0x20), (0xA0, 0x250), (0x300, 0x370), (0x400, 0x460), (0x600, 0x700), (0x900, 0x980), (0x2000, 0x2070), (0x3040, 0x30FF), (0x4E00, 0x4F00), (0x1F300, 0x1F600), (0xFF00, 0xFF60)]
    texts = []
    for _ in range(1500):
        a, b = zip(*(blocks[k] for k in rng.integers(0, len(blocks), int(rng.integers(1, 4)))))
        pick = rng.integers(0, len(a), int(rng.integers(0, 40)))
        texts.append("".join(chr(int(rng.integers(a[k], b[k]))) if rng.random() < 0.85 else " " for k in pick))
    assert [list(tokens.byte_bpe(bpe)(t)) for t in texts] == [tokens.library(bpe).encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens.Counter(words)(texts) == [len(tokens.library(words).encode(t, add_special_tokens=False).ids) for t in texts]


def test_odd_texts_have_the_library_s_ids():
    bpe, words = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("word_bpe_49k.json")
    odd = ["a<|endoftext|>b  c\n\n d", "", " ", "x\u0085y  z", "Ünḯ ١٢٣ ½ ²x 😀‍👨", "it's we'll I'M\r\n\t x", " \n a\n\n\n b", "a\x1fb \x1c", "x <|startoftext|> Y<|ENDOFTEXT|>z ΣΑΣ İ", "e ́x"]
    assert [list(tokens.byte_bpe(bpe)(t)) for t in odd] == [tokens.library(bpe).encode(t, add_special_tokens=False).ids for t in odd]
    assert tokens.counter(words)(odd) == [len(tokens.library(words).encode(t, add_special_tokens=False).ids) for t in odd]


VECTORS = [(1, [0.5, -0.25]), (2, [0.5, -0.25]), (2, [0.1, 0.1]), (3, None), (4, [0.1, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-0.5, 0.9]), (8, [0.0, 0.0]), (9, [0.3, 0.2, 0.1]), (20, [0.5, -0.25]), (40, [-1.0, 2.0])]


def test_values_of_clashing_columns_stay(spark):
    names = ["rate", "mix_source", "n_copies", "salt", "salt_of_source", "row_place", "before", "part", "rank", "__text", "Rate_"]
    df = docs(spark)
    for k, name in enumerate(names):
        df = df.withColumn(name, F.lit(-7 - k))
    for out in (mixing.mix(df), sharding.shards(df)):
        rows = out.collect()
        assert rows and set(df.columns) <= set(out.columns)
        assert all(r[name] == -7 - k for r in rows for k, name in enumerate(names))


def test_mixing_with_many_sources_is_the_same(spark, monkeypatch):
    few = keyed(mixing.mix(docs(spark)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert keyed(mixing.mix(docs(spark)).collect()) == few


def test_top_k_of_large_components_and_clashing_columns(spark):
    rows = [(0, [3e5, 1.0]), (20, [4e5, 0.0]), (1, [1e6, -1e12]), (2, [1e12, 3.5]), (3, [-1e300, 2.0]), (4, [0.1, 0.2]), (5, [-0.3, 0.9]), (6, []), (40, []), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = [(i, [int(np.floor(x * 64)) if abs(x) < 2**53 else int(x) * 64 for x in v]) for i, v in rows]
    want = []
    for q, w in exact:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, v in exact if i != q and len(v) == len(w))
            want += [(q, n + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, i) in enumerate(best)]
    more = df
    for name in ("v", "wide", "width", "block", "chunk", "ids", "rank", "score", "exact"):
        more = more.withColumn(name, F.lit(3))
    for frame in (df, more):
        assert sorted(map(tuple, topk.top_k(frame, frame.where("vec_id % 20 = 0")).collect())) == sorted(want)


def test_index_is_stored_once_and_searched_again(spark, monkeypatch):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(k, rng.normal(0, 0.2, 6).tolist()) for k in range(700)], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 20 = 0")).collect()))
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "LEAST_CHUNK", 5)
    index = topk.build_index(df)
    assert 5 <= index.count() <= 7
    for _ in range(2):
        assert sorted(map(tuple, topk.search_index(index, df.where("vec_id % 20 = 0")).collect())) == one


def test_top_k_equals_brute_force(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    rng = np.random.default_rng(2)
    big = spark.createDataFrame([(k, rng.normal(0, 0.2, 8).astype("float32").tolist()) for k in range(300)], "vec_id long, embedding array<float>")
    for frame, k in ((df, 3), (df, 50), (big, 20)):
        rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in frame.collect() if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])]
        ints = [(i, np.floor(64 * v).astype(int)) for i, v in rows]
        want = []
        for q, w in ints:
            if q % 20 == 0:
                best = sorted(((-int(v @ w), i) for i, v in ints if i != q and len(v) == len(w)))[:k]
                want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
        got = [tuple(r) for r in topk.top_k(frame, frame.where("vec_id % 20 = 0"), k).collect()]
        assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        digit, follow = sharding.curve_tables(dims)
        place = {}
        for cell in np.ndindex(*[1 << bits] * dims):
            state = index = 0
            for i in range(bits - 1, -1, -1):
                at = state * (1 << dims) + sum((cell[k] >> i & 1) << k for k in range(dims))
                index, state = index * (1 << dims) + digit[at], follow[at]
            place[index] = cell
        assert sorted(place) == list(range(1 << bits * dims))
        assert all(np.abs(np.subtract(place[i], place[i + 1])).sum() == 1 for i in range(len(place) - 1))


def test_curve_prunes_files_better_than_a_plain_sort(spark, sf01, tmp_path):
    """Files whose min-max ranges meet a filter, on each dimension in turn."""
    from tidemill.session import table

    df = table(spark, sf01, "documents")
    names = [c for c, _ in sharding.DIMENSIONS]
    filters = {"source": [r[0] for r in df.select("source").distinct().collect()], "lang": [r[0] for r in df.select("lang").distinct().collect()], "n_chars": [200, 1000, 4000], "doc_id": [50, 500, 900]}

    def met(rows, column):
        ranges = rows.groupBy("f").agg(F.min(column).alias("a"), F.max(column).alias("b")).collect()
        return sum(r["a"] <= v <= r["b"] for v in filters[column] if v is not None for r in ranges if r["a"] is not None)

    curve = sharding.shards(df).withColumn("f", F.col("shard"))
    plain = df.withColumn("f", F.expr("cast(doc_id * 16 div 1000 as int)"))
    by_curve, by_id = ({c: met(x, c) for c in names} for x in (curve, plain))
    assert sum(by_curve[c] for c in names if c != "doc_id") < 0.75 * sum(by_id[c] for c in names if c != "doc_id"), (by_curve, by_id)


def test_shards_are_written_as_folders(spark, tmp_path):
    out = f"file://{tmp_path}/shards"
    placed = sharding.shards(docs(spark), n_shards=3)
    sharding.write_shards(placed, out)
    assert spark.read.parquet(out).groupBy("shard").count().count() == 3


def test_media_cases():
    rng = np.random.default_rng(4)
    for data in (b"", b"\xff" * 577, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), bytes(range(256)) * 9):
        payload = media.pad(data)
        assert len(payload) % media.FRAME == 0 and len(payload) > 0
        samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, media.FRAME)
        avi = media.write_avi(media.encode_frames(samples))
        rate, frames = media.read_avi(avi)
        assert rate == media.FRAMES_A_SECOND and (media.decode_frames(frames) == samples).all()
    still = np.full((12, media.FRAME), 40, dtype=np.uint8)
    still[5:] = 200
    assert media.shots(still) == [0, 5] and media.shots(still[:0]) == []
    with pytest.raises(ValueError):
        media.read_avi(b"no file")


def test_language_cases(spark, net):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(spark), net).collect()}
    assert got[2] == got[3] == got[6] == ("und", 0.0) and got[5][0] in ("en", "de")
    assert {r["lang_pred"] for r in langid.identify(docs(spark), None).collect()} == {"und"}
    assert langid.train(docs(spark, [(1, "x", None, "a", 1)])) is None
    assert langid.classify(net, ["the cat and the dog"])[0] == ["en"]
    w, size = langid.windows_of(b"x" * 1500)
    assert len(w) == 3 and size.sum() >= 1500


def test_near_duplicate_cases(spark):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(10, base), (11, base.upper()), (12, base + " tail"), (13, "only four words here"), (14, "ONLY four  words\nhere"), (15, "only four words"), (16, ""), (17, None), (18, "  "), (19, base), (20, " ".join(f"v{k}" for k in range(40))), (21, LONG), (22, LONG + " end")]
    df = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(df).collect()}
    assert [got[d][1] for d in range(10, 23)] == [10, 10, 10, 13, 13, 15, 16, 17, 18, 10, 20, 21, 21]
    nameless = near_dups.near_duplicates(spark.createDataFrame([(None, base, "en", "a", 1), (1, base, "en", "a", 1), (None, "alone", "en", "a", 1)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in nameless) == [(0, True), (0, True), (1, True)]
    assert got[16] == (0, 16, True) and got[13][0] == 1 and got[10][0] == 36


def test_drifting_copies_are_linked_like_brute_force(spark):
    from test_tables import brute_components

    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    rows = []
    for k in range(150):  # copies of one text with 1 to 14 changed words: similarities on both sides of the threshold
        words = list(base)
        for at in rng.integers(0, 120, 1 + k % 14):
            words[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_posterior_bound():
    least = near_dups.least_matches(0.75)
    assert len(least) == near_dups.HASHES // near_dups.BATCH and least == sorted(least)
    rng = np.random.default_rng(5)
    matches = rng.random((20000, near_dups.HASHES)) < 0.75
    sums = matches.cumsum(axis=1)[:, near_dups.BATCH - 1 :: near_dups.BATCH]
    assert ((sums < least).any(axis=1)).mean() < 1e-3


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 99), (99, 98), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 98: 98, 99: 98, 100: 98}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = "<html><body><nav><a href=/>Home</a></nav><div class=sidebar><p>Other stories to read</p></div><article><h1>A &amp; B</h1><p>First   part<br>of the text, which goes on for a while. It has sentences.<p>Second &lt;part&gt; of the text, which is here.</article><footer>&copy; x</footer></body></html>"


def test_html_cases(spark):
    model = html_text.fit([PAGE.replace("First", f"First {k} more") for k in range(40)])
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "<p"), (5, "u", "<!-- x"), (None, "u", PAGE), (1, "u", PAGE), (6, "u", "<div>" * 5000 + "deep" + "</div>" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = html_text.extract(df, model).collect()
    assert len(got) == len(rows)
    want = "A & B\nFirst part of the text, which goes on for a while. It has sentences.\nSecond <part> of the text, which is here."
    assert [r["text"] for r in got if r["page_id"] == 1] == [want] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert html_text.extract(df.limit(0), model).count() == 0


def test_hard_pages_take_linear_time():
    import time

    hard = ["<a " * 1_000_000, "<div>" * 200_000 + "x" + "</div>" * 200_000, "<ul>" * 100_000 + "<p>x</p>" * 100_000, "<select>" * 100_000, "<a b=\"x' " * 200_000, "<script " * 200_000]
    for source in hard:
        start = time.perf_counter()
        page = html_tree.parse(source)
        assert sum(len(x) for x in html_tree.feature_chunks([page], {"a": 0})) == len(page.tags)
        assert time.perf_counter() - start < 5, source[:20]


@pytest.mark.parametrize(
    ("source", "runs"),
    [
        ("<a title=it's>x</a> rest", ["x rest"]),
        ("<p title='a > b' class=x>t</p>u", ["t", "u"]),
        ("<p>a<b>b</b> 1 < 2 <3 &#8217;&eacute;&nbsp;x</p>", ["ab 1 < 2 <3 \u2019\u00e9 x"]),
        ("<p>AT&<b>amp;T</b></p>", ["AT&amp;T"]),
        ("<math>x<mi>y</mi></math> <object>fall</object><noscript>back</noscript>", ["xy fallback"]),
        ("<p>kept</p><p class='cut", ["kept"]),
        ("<ul><li>a<li>b</ul><script>x</script><!-- c --><style>y", ["a", "b"]),
    ],
)
def test_markup_is_read_as_browsers_do(source, runs):
    assert [r for _, r, _ in html_tree.parse(source).runs] == runs


def test_marks_mean_nothing_on_pages():
    page = html_tree.parse("<article><p>text</p><div class=comments><p>said</p></div></article><div data-main>more</div>")
    known = html_text.labels(page)
    assert [r for k, r, _ in page.runs if known[k]] == ["text"]


def test_all_parts_of_a_name_are_tokens():
    assert len(html_tree.attribute_tokens(f'class="{" ".join(f"n{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))}"')[0]) == 60


def test_features_do_not_depend_on_chunks():
    pages = [html_tree.parse(PAGE), html_tree.parse(""), html_tree.parse("<div class=sidebar><p>a</p></div>")]
    vocabulary = {"sidebar": 0, "x": 1}
    whole = html_tree.features(pages, vocabulary)
    assert (np.concatenate(list(html_tree.feature_chunks(pages, vocabulary, 1))) == whole).all() and len(whole) == sum(len(p.tags) for p in pages)


def test_samples_are_the_same_in_every_run(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(html_text, "fit", lambda pages: seen.append(pages))
    monkeypatch.setattr(html_text, "SAMPLE", 5)
    pages = spark.createDataFrame([(k % 3, f"<p>{k // 2}") for k in range(40)] + [(None, None)], "page_id long, html string")
    html_text.train(pages)
    html_text.train(pages.repartition(7))
    assert len(seen[0]) == 5 and seen[0] == seen[1]
    taken = []
    monkeypatch.setattr(langid, "fit", lambda texts, labels: taken.append((texts, labels)))
    monkeypatch.setattr(langid, "SAMPLE", 2)
    rows = [(1, f"text {k} of {k % 90}", f"l{k % 90:02}", "a", 1) for k in range(400)] + [(1, "same", "zz", "a", 1)] * 50
    langid.train(docs(spark, rows))
    langid.train(docs(spark, rows).repartition(5))
    # every language is learned, the 91st too, and one of equal rows
    assert len(set(taken[0][1])) == 91 and taken[0][1].count("zz") == 1 and taken[0] == taken[1]


def test_decoding_never_keeps_under_a_dropped_node():
    rng = np.random.default_rng(6)
    page = html_tree.parse("<div><section><p>a</p><p>b</p></section><ul><li>c<li>d</ul></div><div><p>e</div>")
    for _ in range(300):
        odds = rng.normal(0, 3, len(page.tags)).tolist()
        kept = html_text.decode(page, odds)
        assert all(not k or page.parent[n] < 0 or kept[page.parent[n]] for n, k in enumerate(kept))


def test_layouts_are_learned():
    rng = np.random.default_rng(7)
    vocabulary = [f"word{k}" for k in range(300)]

    def blocks(n):
        return [" ".join(rng.choice(vocabulary, int(rng.integers(10, 60)))) + "." for _ in range(n)]

    train = [f"<body><nav><a>x</a></nav><article>{''.join(f'<p>{b}</p>' for b in blocks(4))}</article><footer>y</footer></body>" for _ in range(60)]
    model = html_text.fit(train)
    good = total = 0
    for _ in range(60):
        page = html_tree.parse(html_text.Layout(rng, vocabulary).page(blocks(int(rng.integers(2, 8)))), html_text.MARK)
        known = html_text.labels(page)
        kept = html_text.decode(page, model.trees.score(html_tree.features([page], model.vocabulary)).tolist())
        for node, run, _ in page.runs:
            total += len(run)
            good += len(run) * (known[node] == kept[node])
    assert good / total > 0.9
