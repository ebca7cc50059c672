"""The registered queries over a small table: rows, SQL where there is some, and exact or brute-force checks."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from packetloom.llm import queries as Q
from packetloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def collected(spark, name):
    return Q.QUERIES[name](spark, SF).collect()


def components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where, shared = defaultdict(list), Counter()
    for i in sorted(sets):
        for x in sets[i]:
            for j in where[x]:
                shared[j, i] += 1
            where[x].append(i)
    for (i, j), both in shared.items():
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    r = c.execute(Q.ORACLES[name])
    names = [d[0] for d in r.description]
    key = lambda row: tuple(str(f"{x:.9g}" if isinstance(x, float) else x) for x in row)
    assert sorted(df.columns) == sorted(names)
    assert sorted(key(x) for x in df.select(*names).collect()) == sorted(key(x) for x in r.fetchall())


def test_op1_recall_and_order(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)
    got = defaultdict(list)
    for r in collected(spark, "op1_neighbours"):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = 0
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(got) == sorted(queries)
    for q in queries:
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        scores = x @ x[ids == q][0]
        assert all(abs(scores[ids == v][0] - s) < 1e-9 for _, v, s in rows)
        true = ids[np.lexsort((ids, -scores))]
        hit += len({v for _, v, _ in rows} & set(true[true != q][:20]))
    assert hit / (20 * len(queries)) >= 0.9


def test_op2_held_out_accuracy(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    lang = dict(zip(t["doc_id"], t["lang"], strict=True))
    rows = collected(spark, "op2_language")
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_op3_digests(spark):
    t = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    said = "</s>[INST] ok [/INST]"
    t += [{"conv_id": -1, "turn": 0, "role": "user", "text": said}, {"conv_id": -1, "turn": 1, "role": "assistant", "text": said}]
    by = defaultdict(list)
    for r in sorted(t, key=lambda r: (r["conv_id"], r["turn"])):
        by[r["conv_id"]].append((r["role"], r["text"] or ""))
    rows = {r.conv_id: r for r in collected(spark, "op3_chat")}
    assert set(rows) == set(by)
    for c, turns in by.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        r = rows[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars >= sum(len(x) for _, x in turns)


def test_op4_places(spark, docs):
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    for r in collected(spark, "op4_licenses"):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), docs[r.doc_id] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        at = [(i, n) for n, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({n for _, n in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op5_components(spark, docs):
    sets = {i: shingles(t, 4) for i, t in docs.items()}
    want = components(sets, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in collected(spark, "op5_jaccard_join")}
    assert got == {i: (len(sets[i]), want[i]) for i in docs}


def test_op6_is_lossless_and_repeatable(spark):
    one = {r.doc_id: r for r in collected(spark, "op6_pieces")}
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in one.values())
    again = Q.QUERIES["op6_pieces"](spark, SF).repartition(7).collect()
    assert all(one[r.doc_id].ids == r.ids for r in again)


def test_op7_balance(spark, docs):
    rows = collected(spark, "op7_sharding")
    assert {r.law for r in rows} == {"bytes"} and len(rows) == len(docs)
    load, slots, home = Counter(), defaultdict(list), {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert home.setdefault(docs[r.doc_id], r.shard) == r.shard
    assert sorted(load) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 24


def test_op8_windows(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    names = list(docs)
    ids = {d: [*e.ids, 1] for d, e in zip(names, tok.encode_batch([docs[d] or "" for d in names], add_special_tokens=False), strict=True)}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in collected(spark, "op8_packing"):
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(part))
    for d, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at and n > 0
            at += n
        assert at == len(ids[d])
    assert set(pieces) == set(docs)
    sizes = {}
    for s, p in windows.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == 2048 for s, n in sizes.items() if s < len(sizes) - 1)


def test_op10_pages(spark):
    import html

    t = pq.read_table(f"{SF}/pages.parquet")
    page = dict(zip(t["page_id"].to_pylist(), t["html"].to_pylist(), strict=True))
    rows = collected(spark, "op10_extraction")
    assert len(rows) == len(page)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", page[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_pipeline_against_brute_force(spark, docs):
    import corpus_pipeline
    from packetloom.llm import langid, quality

    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {i: t for i, t in docs.items() if quality.judge(quality.TextFeatures((t or "").encode()), quality.RULES)[0]}
    table = spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id IN ({','.join(map(str, kept))})")
    known = langid.identify(table, langid.fit(table)).where("accepted").select("doc_id").collect()
    kept = {r.doc_id: kept[r.doc_id] for r in known}
    comp = components({i: shingles(t, 5) for i, t in kept.items()}, 80)
    assert {r.doc_id for r in rows} == {i for i in kept if comp[i] == i}
    assert len(rows) > 0
