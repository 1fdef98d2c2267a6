"""Operators on the given tables against brute force, exact round trips or SQL."""

import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemill.llm import langid, media, near_dups, queries, tokens
from tidemill.session import table


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}


def test_pieces_hold_all_ids_and_sequences_are_full(spark, sf, docs):
    got = queries.op1_packing(spark, sf).toPandas()
    bpe = tokens.library(tokens.public_path("byte_bpe_50k.json"))
    by_doc = defaultdict(list)
    for r in got.sort_values(["doc_id", "start"]).itertuples():
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(docs)
    for d, parts in by_doc.items():
        ids = np.array([*bpe.encode(docs[d]["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in parts:
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == list(s.length.cumsum() - s.length) and s.length.sum() <= 2048
    assert got.length.sum() / (2048 * got.sequence_id.nunique()) > 0.98


def test_chat_windows_read_back(spark, sf):
    chats = defaultdict(list)
    for r in table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        chats[r["conv_id"]].append((r["role"], r["text"] or ""))
    mark = "</s>[INST] ok [/INST]"
    chats[-7] = [("user", mark), ("assistant", mark)]
    got = {r["conv_id"]: r for r in queries.op3_chat(spark, sf).collect()}
    assert set(got) == set(chats)
    for c, turns in chats.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_token_counts_are_the_library_s(spark, sf, docs):
    lib = tokens.library(tokens.public_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in queries.op4_token_counts(spark, sf).collect()}
    assert set(got) == set(docs)
    for d, r in docs.items():
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len((r["text"] or "").encode()), n, n > 2048)


def test_shards_differ_by_one_row_at_most(spark, sf, docs):
    got = queries.op6_sharding(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(docs) and set(got.law) == {"rows"}
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    ordered = got.sort_values(["shard", "slot"])
    assert list(ordered.curve) == sorted(got.curve)
    for r in got.itertuples():
        data = (docs[r.doc_id]["text"] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_media_round_trip(spark, sf, docs):
    for r in queries.op7_media(spark, sf).collect():
        data = (docs[r["doc_id"]]["text"] or "").encode()
        payload = media.pad(data)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        # clips cover the frames without a gap, and their levels are those of their part of the payload
        frames, at = np.frombuffer(payload, dtype=np.uint8).reshape(-1, media.FRAME), 0
        rate = json.loads(r["feature"])["fps"]
        assert [c["first_frame"] for c in r["clips"]] == json.loads(r["feature"])["shots"]
        for k, c in enumerate(r["clips"]):
            part = frames[at : at + c["n_frames"]]
            assert (c["clip"], c["first_frame"], c["start_s"], c["end_s"]) == (k, at, at / rate, (at + c["n_frames"]) / rate)
            assert abs(c["mean_level"] - part.mean()) < 1e-9
            at += c["n_frames"]
        assert at == len(frames)


def test_languages_of_held_out_documents(spark, sf01):
    known = {r["doc_id"]: r["lang"] for r in table(spark, sf01, "documents").select("doc_id", "lang").collect()}
    got = queries.op8_langid(spark, sf01).toPandas()
    assert len(got) == len(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    held = got[got.held_out]
    assert np.mean([known[r.doc_id] == r.lang_pred for r in held.itertuples()]) > 0.97
    assert got.score.between(0, 1).all()


def brute_components(rows):
    sets = {}
    for d, text in rows:
        w = near_dups.split_words(text)
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    top[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_near_duplicates_equal_brute_force(spark, sf, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op9_near_dups(spark, sf).collect()}
    assert got == brute_components([(d, r["text"]) for d, r in docs.items()])


def test_pages_give_their_articles(spark, sf01):
    import re
    from html import unescape

    def article(source):
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = re.split(r"<(?:/?(?:p|h1|h2|ul|li|div))(?:\s[^>]*)?>", inner)
        return "\n".join(b for b in (" ".join(unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in blocks) if b)

    from tidemill.llm import html_text

    every = table(spark, sf01, "pages")
    sources = {r["page_id"]: r["html"] for r in every.collect()}
    # learned from every second page, so that the others are new to the model
    model = html_text.train(every.where("page_id % 2 = 0"))
    new = {r["page_id"]: r["text"] for r in html_text.extract(every.where("page_id % 2 = 1"), model).collect()}
    assert len(new) > 100 and np.mean([t == article(sources[p]) for p, t in new.items()]) > 0.98
    got = {r["page_id"]: r for r in queries.op10_html(spark, sf01).collect()}
    assert set(got) == set(sources)
    assert np.mean([got[p]["text"] == article(s) for p, s in sources.items()]) > 0.98
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    from oracle import connect, same

    same(spark, connect(sf), queries.queries()[name], queries.oracle_sql()[name], sf)


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    seen = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
        rows = out.collect()
        if name == "language ID":
            kept = {r["doc_id"] for r in rows}
            wanted = {d for d, r in docs.items() if r["text"] and langid._LETTER.search(r["text"])}
            assert len(kept & wanted) > 0.98 * len(wanted) and not kept - wanted
        if name == "near dedup":
            want = {d for d, (_, _, keep) in brute_components([(r["doc_id"], r["text"]) for r in seen.collect()]).items() if keep}
            assert sorted(r["doc_id"] for r in rows) == sorted(want)
        seen = spark.createDataFrame(rows, out.schema)
    assert corpus_pipeline.run(spark, sf).count() >= len(rows)
