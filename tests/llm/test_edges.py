"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetloom.llm import ann, chat, components, extraction, jaccard, langid, licenses, packing, pieces, quality, sharding
from packetloom.llm.queries import tokenizer_path


def by_text(rows):
    return {(r.doc_id, (getattr(r, "text", "") or "")[:20]): r for r in rows}


def test_quality(odd_docs, no_docs):
    rows = by_text(quality.quality_cascade(odd_docs, with_counts=True).collect())
    assert len(rows) == 9
    assert rows[1, "The quick brown fox "].kept and rows[2, ""].kept is False and rows[2, ""].n_words == 0
    long = rows[7, "lorem ipsum dolor si"]
    assert (long.n_words, long.n_repeat_words, long.kept) == (120_000, 120_000, False)
    assert quality.quality_cascade(no_docs).count() == 0


def test_rules_order_by_rejection_per_cost():
    rules = (quality.Rule("never", lambda f: False), quality.Rule("always", lambda f: True))
    e = [quality.RuleEstimate("never", 1e-6, 0.0), quality.RuleEstimate("always", 1e-3, 1.0)]
    assert [r.name for r in quality.order_rules(e, rules)] == ["always", "never"]
    assert quality.judge(quality.TextFeatures(b"x"), tuple(rules[::-1])) == (False, "always", 1)


def test_language(spark, odd_docs, no_docs):
    model = langid.train([b"the cat and the dog", b"le chat et le chien"] * 20, ["en", "fr"] * 20)
    rows = by_text(langid.identify(odd_docs, model).collect())
    assert rows[2, ""].lang_pred == "und" and rows[5, "1234 !!"].lang_pred == "und" and rows[5, "1234 !!"].score == 0
    assert rows[1, "The quick brown fox "].lang_pred in ("en", "fr")
    assert langid.identify(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.fit(no_docs)).collect()} == {"und"}
    assert model.predict([b"le chien et le chat"])[0][0] == 1


def test_scores_do_not_depend_on_neighbours():
    model = langid.train([b"the cat and the dog", b"le chat et le chien"] * 20, ["en", "fr"] * 20)
    texts = [b"the chat", b"", b"x", b"dog and le chien " * 50]
    alone = [model.mean_scores([t])[0][0] for t in texts]
    assert np.allclose(model.mean_scores(texts)[0], alone)


def test_rejection_is_calibrated_on_held_back_texts(spark):
    words = {lang: [f"{lang}{a}{b}" for a in "aeiou" for b in "klmnpr"] for lang in ("qu", "zo", "vy")}
    r = random.Random(5)
    make = lambda lang, n=30: " ".join(r.choices(words[lang], k=n))
    labels = [lang for lang in words for _ in range(200)]
    model = langid.train([make(lang).encode() for lang in labels], labels)
    assert model.info["calibration_pairs"] == 2 * model.info["calibration_rows"] and model.info["noise_rejected"] > 0.99
    clean = [make(a) + " " + make(b) for a in words for b in words if a != b for _ in range(5)] + [make(a, 10) for a in words for _ in range(20)]
    letters = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz   ", k=n)) for n in (40, 200, 3000) for _ in range(10)]
    unknown = ["hidden text of some other tongue", "bcdfg hjkl wxtsh", "漢字仮名交じり文の例", "Привет мир как дела", *letters]
    rows = langid.identify(spark.createDataFrame([(t,) for t in clean + unknown], "text string"), model).collect()
    accepted = {x.text: x.accepted for x in rows}
    assert all(accepted[t] for t in clean) and not any(accepted[t] for t in unknown)
    assert {x.lang_pred for x in rows} <= set(words)
    # What a word or a letter is worth: no certainty.
    assert model.predict([b"x"])[1][0] < 0.6 < 0.9 < model.predict([make("qu").encode()])[1][0]


def test_language_against_plain_code():
    """Scores of the whole-batch code against averaging bucket by bucket, text by text."""
    texts = [b"the cat and the dog", b"le chat et le chien", "él niño".encode(), b"", b"x" * 5000]
    model = langid.train(texts[:2] * 20, ["en", "fr"] * 20)
    for t, got in zip(texts, zip(*model.predict(texts), strict=True), strict=True):
        folded = "".join(chr(b) if b >= 128 or 97 <= b <= 122 else chr(b + 32) if 65 <= b <= 90 else " " for b in b" " + t + b" ")
        rows = []
        for n in langid.ORDERS:
            for i in range(len(folded) - n + 1):
                g = folded[i : i + n]
                if " " in g[1:-1] or (g[0] == g[-1] == " "):
                    continue
                h = 2166136261 + n
                for c in g:
                    h = (h ^ ord(c)) * 16777619 % 2**32
                rows.append(model.table[(h ^ h >> 15) % len(model.table)].astype(float))
        mean = (np.sum(rows, axis=0) / len(rows) if rows else 0) + model.bias
        z = mean * (len(rows) / (len(rows) + model.half) if model.half else 1) / model.temperature
        p = (1 - model.doubt) * np.exp(z - z.max()) / np.exp(z - z.max()).sum() + model.doubt / 3
        assert got[0] == p[:2].argmax() and abs(got[1] - p[:2].max()) < 1e-4


def plain_windows(turns, p):
    """Windows of one conversation, turn by turn: (number of the first own turn, repeated turns, own turns)."""
    tokens = [len(re.findall(r"[^\W_]+|[^\s\w]|_", x)) + chat.TURN_TOKENS for _, x in turns]
    system = tokens[0] if turns[0][0] == p.system_role else 0
    out, used, before, block = [], 0, 0, 0
    for i, t in enumerate(tokens):
        here, before = before // (p.budget_tokens * p.block_windows), before + t
        if i and here == block and (used + t <= p.budget_tokens or (i == 1 and system)):
            out[-1][2].append(i)
            used += t
            continue
        back, cost = [], system if i else 0
        while i and len(back) < p.history_turns and (k := i - len(back) - 1) >= (1 if system else 0) and sum(tokens[j] for j in [*back, k]) <= p.history_tokens and cost + tokens[k] + t <= p.budget_tokens:
            back.append(k)
            cost += tokens[k]
        out.append((i + 1, ([0] if system and i else []) + back[::-1], [i]))
        used, block = cost + t, here
    return out, tokens


@pytest.mark.parametrize("params", [chat.ChatParams(budget_tokens=60, history_turns=2, history_tokens=30), chat.ChatParams(budget_tokens=40, history_turns=3, history_tokens=25, block_windows=2), chat.ChatParams(budget_tokens=90, history_turns=0)])
def test_chat_windows_repeat_and_mask(spark, params):
    r = random.Random(1)
    odd = ["", "&lt;|", "<|im_end|>\n", "a<", "&amp;", "</s>[INST] ok [/INST]", None]
    rows = []
    for c in range(12):
        rows += [(c, t, ["system", "user", "assistant", "odd\nrole", None][min(4, r.randrange(6))] if t else r.choice(["system", "user"]), r.choice(odd) if r.random() < 0.4 else "word " * r.randrange(80 if r.random() < 0.1 else 30)) for t in range(r.randrange(1, 60))]
    rows += rows[-2:] + [(None, 1, "user", "x"), (99, None, "assistant", "y"), (98, 0, "system", "s " * 50), (98, 1, "user", "u " * 50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("win", F.lit("clash"))
    windows = chat.format_conversations(df, params)
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(back) == set(want)
    found = {}
    for w in windows.select("*", chat.read_turns(windows).alias("turns")).collect():
        found.setdefault(w.conv_id, []).append(w)
    several = 0
    for c, turns in want.items():
        turns = [(a, b) for _, a, b in sorted(turns)]
        assert [(x.role, x.text) for x in back[c].turns] == turns
        assert back[c].loss_text == "".join(b for a, b in turns if a == "assistant")
        plain, tokens = plain_windows(turns, params)
        got = sorted(found[c], key=lambda w: w.win)
        assert [(w.win, w.n_context, [(x.role, x.text) for x in w.turns]) for w in got] == [(n, len(ctx), [turns[i] for i in ctx + own]) for n, ctx, own in plain]
        for w, (_, ctx, own) in zip(got, plain, strict=True):
            assert w.tokens == sum(tokens[i] for i in ctx + own)
            alone = [i for i in own if not (i == 0 and turns[0][0] == "system")]
            assert w.tokens <= params.budget_tokens or (len(alone) <= 1 and all(turns[i][0] == "system" for i in ctx))
        several += len(got) > 2
    assert several > 3 and back[98].n_windows == 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="<|&lt;amp im_end>\\\n", max_size=30))
def test_escapes_reverse(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.unescape(chat.escape(F.col("t"))).alias("x"), chat.escape(F.col("t")).contains("<|").alias("c")).first()
    assert row.x == text and not row.c


def test_licenses(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(20, "CC BY cc-by all rights RESERVED"), (21, "licensed under apache license, version 2.0"), (22, "cc"), (23, "public license general")], "doc_id long, text string")
    rows = by_text(licenses.scan_licenses(extra.unionByName(odd_docs.select("doc_id", "text"))).withColumn("text", F.lit("")).collect())
    assert (rows[20, ""].n_base, rows[20, ""].first_word, rows[20, ""].last_word, rows[20, ""].base_labels) == (3, 0, 4, "cc-by,reserved")
    assert (rows[21, ""].labels, rows[21, ""].base_labels) == ("apache-2.0", "")
    assert rows[22, ""].n_words == 1 and rows[23, ""].n_base == 0 and rows[7, ""].n_words == 120_000
    assert licenses.scan_licenses(no_docs).count() == 0


def test_licenses_with_a_doubled_word(spark):
    texts = ["gnu lesser general public public license", "released under the the mit license", "released under the mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [rows[i].labels for i in range(3)] == ["lgpl", "mit", "mit"] and [rows[i].score for i in range(3)] == [1.0] * 3
    spans = licenses.license_spans(df).where("label IN ('mit', 'lgpl')").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("exact").alias("exact")).collect()
    assert {r.doc_id: (r.n, r.exact) for r in spans} == {0: (1, False), 1: (1, False), 2: (1, True)}


def brute(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a | sets[j])):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_against_all_pairs(spark, k, percent):
    r = random.Random(k)
    texts = [None, "", "one", "One two", "one two", "a b c", " \t"]
    for size in (5, 8, 12, 20, 40, 80, 200):
        base = [f"w{r.randrange(50 if size < 20 else 10_000)}" for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, size // 6))):
                copy[r.randrange(len(copy))] = f"e{r.randrange(9999)}"
            texts.append(" ".join(copy[: len(copy) - r.randrange(0, 3)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(5)
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else {tuple(w)} if w else set())
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df, k=k, percent=percent).collect()}
    want = brute(sets, percent)
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.floats(0, 0.09), st.integers(0, 10**6))
def test_linked_sets_share_a_key(size, edits, seed):
    """Pigeonhole: two sets within the bound meet under a key, whatever the scheme."""
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    y = x.copy()
    for i in rng.choice(len(y), int(edits * len(y)), replace=False):
        y[i] = rng.integers(0, 2**63)
    y = np.unique(y)[: len(y) - int(rng.integers(0, 2))] if len(y) > 3 else np.unique(y)
    both = len(np.intersect1d(x, y))
    if not len(y) or 100 * both < 85 * (len(x) + len(y) - both) or np.array_equal(x, y):
        return
    small, large = sorted((x, y), key=len)
    band = jaccard.band_of(len(large), 85)
    assert band - jaccard.band_of(len(small), 85) in (0, 1)
    plan = jaccard.default_scheme(band, 85)
    for scheme in (plan, jaccard.allocate(plan, [x, y, x[: len(x) // 2 + 1]], 50.0)):
        assert len(np.intersect1d(jaccard.signatures(x, scheme), jaccard.signatures(y, scheme)))


def test_keep_one(odd_docs, no_docs):
    kept = jaccard.keep_one(odd_docs.where("doc_id IS NULL OR doc_id <> 8")).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id), key=int) == [1, 2, 3, 4, 5, 7] and len(kept) == 7
    assert jaccard.keep_one(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(7, 7), (0, 1), (1, 0)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(200, 260)}


def test_pieces(spark, odd_docs, no_docs):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = pieces.encode(odd_docs, path, F.col("doc_id"))
    assert all(r.lossless for r in rows.select("lossless").collect())
    decoded = pieces.decode(rows, path).select("text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in decoded)
    same = rows.where("doc_id = 8").select("ids").collect()
    assert same[0] == same[1]
    assert pieces.encode(no_docs, path, F.col("doc_id")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=120), max_size=5))
def test_pieces_round_trip(texts):
    v = pieces.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    ids, counts = pieces.encode_batch(texts, np.arange(len(texts), dtype=np.uint64), v, pieces.SampleParams())
    ends = np.concatenate([[0], np.cumsum(counts)])
    assert [pieces.decode_ids(ids[a:b].tolist(), v) for a, b in zip(ends[:-1], ends[1:], strict=True)] == texts


def test_pieces_follow_the_lattice_distribution():
    v = pieces.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    n = 20_000
    ids, counts = pieces.encode_batch(["hello"] * n, np.arange(n, dtype=np.uint64), v, pieces.SampleParams())
    ends = np.concatenate([[0], np.cumsum(counts)])
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True))
    known = {b: i for i, b in enumerate(v.bytes) if v.probability[i] > 0}

    def ways(rest):
        if not rest:
            yield (), 1.0
        for size in range(1, len(rest) + 1):
            if rest[:size] in known:
                i = known[rest[:size]]
                for tail, p in ways(rest[size:]):
                    yield (i, *tail), p * v.probability[i]

    exact = dict(ways(b" hello"))
    total = sum(exact.values())
    assert set(seen) <= set(exact)
    assert all(abs(seen[w] / n - p / total) < 0.02 for w, p in exact.items())


def test_sharding(odd_docs, no_docs):
    rows = sharding.shard_by_bytes(odd_docs, 3).collect()
    assert len(rows) == 10 and {r.shard for r in rows} <= {0, 1, 2}
    homes = {}
    for r in rows:
        homes.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(h) == 1 for k, h in homes.items() if k != (0, 8))
    assert sharding.shard_by_bytes(no_docs, 3).count() == 0


def test_differencing_beats_the_largest_item():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1000, 500).astype(float)
    got = sharding.difference_items(sizes, np.zeros(8))
    load = np.bincount(got, sizes, minlength=8)
    assert load.max() - load.min() < 10
    uneven = np.array([9_000.0, 0, 0, 0])
    got = sharding.difference_items(sizes, uneven)
    load = np.bincount(got, sizes, minlength=4) + uneven
    assert load.max() - load.min() < 10


def test_packing(odd_docs, no_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack_documents(odd_docs, path, length=64).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1
    assert sum(r.length for r in rows if r.doc_id == 8) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 8)
    sizes = Counter()
    for r in rows:
        sizes[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length
    assert all(n == 64 for s, n in sizes.items() if s < max(sizes))
    assert packing.pack_documents(no_docs, path).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), st.sampled_from(["<|endoftext|>", "<|endoftext", " <|endoftext|> ", "\n\n", "  "])), max_size=6).map("".join))
def test_same_ids_as_the_tokenizers_library(text):
    from tokenizers import Tokenizer

    ours = packing.byte_bpe(tokenizer_path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert ours.encode(text, allowed_special="all") == t.encode(text, add_special_tokens=False).ids
    t.encode_special_tokens = True
    assert ours.encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def test_packing_of_special_strings(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    ids = lambda **how: np.frombuffer(packing.tokenize(df, path, **how).first().ids, "<u4").tolist()
    assert 50256 in ids() and 50256 not in ids(special_as_text=True)


def test_padding_of_sequences(spark):
    df = spark.createDataFrame([(0, 2048), (1, 1000), (1, 24), (2, 5)], "sequence_id long, length long")
    assert {r.sequence_id: r.padding for r in packing.sequences(df).collect()} == {0: 0, 1: 0, 2: 2043}


def test_extraction(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, "u", "<p>no structure</p>"), (4, "u", "<article><h1>T &amp; t</h1><p>a\n b&nbsp;c<br>d<p>second <!-- x --> one<script>var a='<p>';</script></article><footer>&copy; x</footer>"), (5, "u", "<!-- open"), (6, "u", "<article>" + "<p>block of text here</p>" * 5_000 + "</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = {r.page_id: r for r in extraction.extract(df).collect()}
    assert rows[1].text == "" and rows[2].n_chars == 0 and rows[5].text == ""
    assert rows[4].text == "T & t\na b c d\nsecond one"
    assert rows[6].text.count("\n") == 4_999
    assert extraction.extract(df.limit(0)).count() == 0


def test_extraction_on_held_out_pages():
    field = extraction.default_field()
    right = total = 0
    for blocks, labels, _ in extraction.training_pages(200, seed=77):
        got = field.decode(blocks)
        total += len(labels)
        right += sum(a == b for a, b in zip(got, labels, strict=True))
    assert right / total > 0.97


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.integers(0, 99))
def test_viterbi_is_exact(scores, seed):
    rng = np.random.default_rng(seed)
    field = extraction.Field({}, rng.normal(size=(2, 2)), rng.normal(size=2))
    field.emissions = lambda blocks: blocks
    n = len(scores)

    def value(y):
        return field.start[y[0]] + sum(s for s, l in zip(scores, y, strict=True) if l) + sum(field.step[a, b] for a, b in zip(y, y[1:], strict=False))

    best = max(value([int(c) for c in f"{i:0{n}b}"]) for i in range(2**n))
    assert value(field.decode(scores)) == pytest.approx(best)


def test_neighbours(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [1.0]), (0, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = ann.nearest(df, F.col("vec_id") == 20, params=ann.AnnParams(k=5, leaf_sample=8)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 2, 5, 8, 11] and got[0].score == 15.0
    assert ann.nearest(df, F.col("vec_id") >= 100).count() == 0
    assert ann.nearest(df.limit(0), F.col("vec_id") == 20).count() == 0
    few = ann.nearest(df.where("vec_id IN (1, 2, 4)"), F.col("vec_id") == 1).collect()
    assert len(few) == 2


def test_neighbour_groups_stay_bounded(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(2000, 6)), np.ones((300, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    params = ann.AnnParams(k=5, sample_rows=100, leaf_sample=50, chunk_rows=100, split_sample=64, block_queries=50, target_recall=1.0)
    rows, dim = ann.usable(df, "vec_id", "embedding")
    asked = rows.where("id % 5 = 0")
    tree = ann.build_tree(x[::23], params)
    assert tree.n_leaves < 20
    ann.grow(rows, tree, dim, params)
    indexed = ann.in_leaves(rows, tree, dim)
    assert tree.n_leaves >= 20 and sorted(ann.leaf_sizes(indexed).values())[-2] <= 100
    routed, stored = ann.dealt(indexed, asked, tree, (np.arange(100), x[:100], ann.leaves_of(tree, x[:100])), 10, dim, params)
    for side, most in ((routed, 150), (stored, 200)):
        assert side.groupBy("leaf", "chunk", "block").count().agg(F.max("count")).first()[0] <= most
    got = ann.nearest(df, F.col("vec_id") % 5 == 0, params=params).orderBy("query_id", "rank").collect()
    ids, hit = np.arange(len(x)), 0
    for q in range(0, len(x), 5):
        mine = [r.vec_id for r in got if r.query_id == q]
        hit += len(set(mine) & set(ann.top(x @ x[q], ids, q, 5).tolist()))
        assert len(mine) == 5
    assert hit >= 0.97 * len(got)


def test_neighbours_of_small_tight_clusters(spark):
    rng = np.random.default_rng(2)
    axes = np.repeat(np.arange(42), [25] * 40 + [5] * 2)
    x = 10.0 * np.eye(42)[axes] + rng.normal(0, 0.01, (len(axes), 42))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 5 == 0, params=ann.AnnParams(leaf_sample=26, target_recall=0.5)).groupBy("query_id").count().collect()
    assert len(got) == 202 and {r["count"] for r in got} == {20}


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "\n" * 2_000_000, "\t \n" * 100_000 + "a b", "a" + " " * 9_999 + "b", "<s>" + "　" * 20_000 + "</s>"])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_packing_of_long_white_space(text, special_as_text):
    path = tokenizer_path("byte_bpe_50k.json")
    library = packing.library_bpe(path, special_as_text)
    assert packing.encoder(path, special_as_text)(text) == library.encode(text, add_special_tokens=False).ids


def plain_differencing(sizes, width):
    """Loads after combining, again and again, the two partial partitions of largest spread in opposite order."""
    parts = [(i, [(s, [i])] + [(0, [])] * (width - 1)) for i, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0][0] - p[1][-1][0]), p[0]))
        (_, a), (_, b) = parts[:2]
        both = [(x + y, k + m) for (x, k), (y, m) in zip(a, reversed(b), strict=True)]
        parts = [*parts[2:], (made, sorted(both, key=lambda s: -s[0]))]
        made += 1
    return parts[0][1]


@pytest.mark.parametrize(("n", "width"), [(1, 3), (7, 2), (40, 5), (90, 24)])
def test_sharding_against_plain_differencing(spark, n, width):
    r = random.Random(n)
    texts = ["x" * size for size in r.sample(range(3_000, 6_000), n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sharding.shard_by_bytes(df, width).collect()
    loads = Counter()
    for row in rows:
        loads[row.shard] += row.size
    sizes = sorted((len(t) + sharding.ROW_BYTES for t in texts), reverse=True)
    large = sum(s > max(1, int(sum(sizes) / width * sharding.LARGE_SHARE)) for s in sizes)
    if large in (0, n):  # one block, or all of them ahead of it
        assert sorted(loads.values(), reverse=True) == [s for s, _ in plain_differencing(sizes, width) if s]
    assert {row.doc_id for row in rows} == set(range(n)) and max(loads.values()) - min([*loads.values(), *[0] * (width > n)]) <= max(sizes)


def test_license_sql_keeps_merged_spans_that_are_whole():
    import duckdb

    from packetloom.llm.queries import op4_sql

    c = duckdb.connect()
    c.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (0, 'gnu lesser general public public license'), (1, 'released under the the mit license'), (2, 'released under the mit license')) t(doc_id, text)")
    assert c.execute(f"SELECT labels, score FROM ({op4_sql()}) ORDER BY doc_id").fetchall() == [("lgpl", 1.0), ("mit", 1.0), ("mit", 1.0)]
