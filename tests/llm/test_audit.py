"""The filter audit against a plain walk of every order."""

import random
import re
from collections import Counter
from itertools import permutations

from packetloom.llm import audit as A


def plain(rows, labels):
    """rows: (id, text, part); labels: {id: (good, toxic)}."""
    fails = []
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in rows)
        fails.append((part or "", {k for k, v in f.items() if v}, labels.get(i, (0, 0)) if i is not None else (0, 0)))
    out, total = {}, Counter()
    for part in {p for p, _, _ in fails}:
        own = [(f, lab) for p, f, lab in fails if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(f, lab) for f, lab in left if x in f]
                left = [(f, lab) for f, lab in left if x not in f]
                total[part, x] += len(gone)
                redundant = sum(x in f for f, _ in own) - len(gone)
                out[part, order, step] = [x, len(left), len(gone), redundant, sum(f == {x} for f, _ in own), sum(lab[0] for _, lab in gone), sum(lab[1] for _, lab in gone)]
    return {k: (*v, total[k[0], v[0]]) for k, v in out.items()}


def table(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_a_plain_walk(spark):
    r = random.Random(8)
    texts = [None, "", "  ", "x " * 60, "A" * 30, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " |", "Ä#" * 9, " ".join(f"W{i}" for i in range(49)), "a\x85b " + " ".join(f"v{i}" for i in range(49))]
    rows = [(r.choice([None, *range(40)]), r.choice(texts), r.choice(["p", "q", "", None])) for _ in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 40, 2), *range(0, 20, 3), None]]
    best = {}
    for i, good, toxic in labels:
        old = best.get(i, (0, 0))
        best[i] = (max(old[0], good or 0), max(old[1], toxic or 0))
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, source string, mask string, quality int")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert table(A.audit(docs, given)) == plain(rows, best)
    assert A.audit(docs.limit(0), given).count() == 0
    bare = table(A.audit(docs, given.limit(0)))
    assert all(v[5:7] == (0, 0) for v in bare.values()) and {k: v[:5] for k, v in bare.items()} == {k: v[:5] for k, v in plain(rows, {}).items()}


def test_many_parts_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(A, "HELD_PARTS", 3)
    rows = [(i, "long " * 200_000 if i == 5 else f"t{i % 7}", f"part{i % 20}") for i in range(60)]
    got = table(A.audit(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")))
    assert got == plain(rows, {1: (1, 1)})


def test_table_of_removals():
    t = A.removal_table()
    assert t.shape == (32, 120) and (t[0] == 5).all() and (t[31] == 0).all()
    assert all(t[1 << A.FILTERS.index(f), o] == order.index(f) for o, order in enumerate(A.ORDERS) for f in A.FILTERS)
