"""keep_one has whole sets moved in slices, with the rows that moving them at once would give."""

from packetloom.llm import jaccard


def test_whole_sets_are_moved_in_slices(spark, monkeypatch):
    asked = []
    sliced = jaccard.verified_in_slices

    def seen(pairs, sets, percent, label, slices):
        asked.append(slices)
        return sliced(pairs, sets, percent, label, slices)

    monkeypatch.setattr(jaccard, "verified_in_slices", seen)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[1:]), "a b c d e f g h", "other words of no kin to any of these"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == [0, 3, 4]
    assert asked and min(asked) > 1
