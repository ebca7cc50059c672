"""What the similarity join moves and writes: whole sets once, and pairs that sketches can't tell from links only."""

import random

from packetloom.llm import jaccard

PERCENT = 80


def sets_of(spark, texts):
    """candidate_sets() of texts that are named 0, 1, ...; and each text's h."""
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    named = [(i, jaccard._id64(jaccard.set_key(x)), 1) for i, x in enumerate(jaccard.shingle_sets([t.encode() for t in texts], 5))]
    return jaccard.candidate_sets(docs, spark.createDataFrame(named, "id long, h long, copies long"), 5), [h for _, h, _ in named]


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def passages(rng, n):
    """Texts of one passage and words of their own, of which no two are similar."""
    common = words(rng, 100)
    return [" ".join([*common, *words(rng, 18)]) for _ in range(n)]


def test_large_sets_of_no_kin_are_ruled_out_by_sketches(spark):
    rng = random.Random(5)
    one = words(rng, 9_000)
    sets, h = sets_of(spark, [" ".join(one), " ".join(one[:8_200]), " ".join(words(rng, 9_000)), " ".join(words(rng, 7_400)), "a b c d e f"])
    pairs = spark.createDataFrame([(h[0], h[i]) for i in range(1, 5)] + [(h[2], h[3]), (h[4], h[4])], "a long, b long")
    got = {(r.a, r.b) for r in jaccard.plausible(pairs, sets, PERCENT).collect()}
    assert got == {(h[0], h[1]), (h[4], h[4])}


def test_sets_under_one_rare_shingle_make_rows_of_likely_links_only(spark):
    rng = random.Random(6)
    texts = [" ".join(words(rng, 60)) for _ in range(40)]
    sets, h = sets_of(spark, [*texts, f"{texts[0]} and one word more"])
    prefixes = sets.selectExpr("7L AS token", "h", "n", "0L AS pos", "h AS comp")
    assert jaccard.crossing_pairs(prefixes, PERCENT).count() == 41 * 40 // 2
    assert [{r.a, r.b} for r in jaccard.crossing_pairs(prefixes, PERCENT, sets=sets).collect()] == [{h[0], h[-1]}]


def test_whole_sets_are_written_once(spark, monkeypatch):
    written, plain = [], jaccard.materialize

    def seen(df, label, keep=False):
        written.append((label, "items" in df.columns))
        return plain(df, label, keep)

    monkeypatch.setattr(jaccard, "materialize", seen)
    texts = passages(random.Random(7), 12)
    df = spark.createDataFrame(list(enumerate([*texts, f"{texts[0]} and one word more"])), "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == list(range(12))
    assert "rest-pairs" in [label for label, _ in written]
    assert [label for label, whole in written if whole] == ["items"]


def test_more_sets_left_than_can_be_sent_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    texts = passages(random.Random(8), 12)
    df = spark.createDataFrame(list(enumerate([*texts, f"{texts[3]} and one word more"])), "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == list(range(12))
