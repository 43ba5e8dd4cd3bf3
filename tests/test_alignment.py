import re
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from priorkit.operators import resolve
from priorkit.plans import resolution

SF = "/root/testdata/sf0.001"
SCHEMA = "day int, key long, pos int, symbol string"


def rows_of(sequences):
    return [(day, key, i, c) for (day, key), s in sequences.items() for i, c in enumerate(s)]


def brute(left, right, ratio, size, margin):
    """Aligned rows from all pairs of classes by plain loops."""
    classes = []
    for side in (left, right):
        c = {}
        for (day, key), s in sorted(side.items()):
            c.setdefault((day, s), key)
        classes.append(c)
    scores = {}
    for (day, s), a in classes[0].items():
        for (other, t), b in classes[1].items():
            if day == other and min(len(s), len(t)) >= size * max(len(s), len(t)):
                m = SequenceMatcher(None, s, t, autojunk=False)
                if m.ratio() >= ratio:
                    scores[day, a, b] = (m.ratio(), [x for x in m.get_matching_blocks() if x.size])
    out = set()
    for (day, a, b), (r, blocks) in scores.items():
        mine = sorted(((-v[0], k[2]) for k, v in scores.items() if k[:2] == (day, a)))
        theirs = sorted(((-v[0], k[1]) for k, v in scores.items() if k[0] == day and k[2] == b))
        gap = -mine[0][0] + mine[1][0] if len(mine) > 1 else None
        if mine[0][1] == b and theirs[0][1] == a and (gap is None or gap >= margin):
            out |= {(day, a, b, round(r, 9), None if gap is None else round(gap, 9), x.a + i, x.b + i) for x in blocks for i in range(x.size)}
    return out


def collected(df):
    return {(r["day"], r["a"], r["b"], round(r["ratio"], 9), None if r["margin"] is None else round(r["margin"], 9), r["pos_a"], r["pos_b"]) for r in df.collect()}


def test_aligned_rows_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    left = {(d, k): "".join(rng.choice(list("abcd"), rng.integers(4, 14))) for d in range(3) for k in range(25)}
    right = {}
    for (d, k), s in left.items():
        t = [c for c in s if rng.random() > 0.08] + (["a"] if rng.random() < 0.2 else [])
        right[d, 1000 + k] = "".join(t) or "a"
    right[0, 999] = right[0, 1000]  # two of one sequence: one class
    for ratio, size, margin in ((0.7, 0.75, 0.0), (0.6, 0.5, 0.04), (0.9, 0.9, 0.1)):
        got, members = resolve.aligned_classes(spark.createDataFrame(rows_of(left), SCHEMA), spark.createDataFrame(rows_of(right), SCHEMA), ["day"], ratio, size, margin)
        want = brute(left, right, ratio, size, margin)
        assert want and collected(got) == want
    held = {(r["side"], r["key"]): r["class"] for r in members.where("day = 0").collect()}
    assert held["right", 1000] == held["right", 999] == 999 and len(held) == 51


def test_a_hot_sequence_nulls_and_empty_sides(spark):
    copies = [(0, k, i, c) for k in range(1500) for i, c in enumerate("abcab")]
    left = spark.createDataFrame([*copies, (0, None, 0, "a"), (None, 7, 0, "a"), (0, 9000, 0, None)], SCHEMA)
    right = spark.createDataFrame(copies, SCHEMA)
    got, members = resolve.aligned_classes(left, right, ["day"], 0.8)
    assert got.count() == 5 and members.count() == 3000
    none = spark.createDataFrame([], SCHEMA)
    got, members = resolve.aligned_classes(none, right, ["day"], 0.8)
    assert got.count() == 0 and members.count() == 1500


def test_the_query_finds_the_other_sides_users(spark):
    out = resolution.partial_aligned_rows(spark, SF)
    rows = out.where("kind = 'row'")
    n, right, same = rows.agg(F.count("*"), F.count_if(F.col("b") == F.col("a") * 7 + 1000003), F.count_if(F.col("id_a") == F.col("id_b"))).first()
    assert n > 0 and right > 0.9 * n and same > 0.8 * n
    users = out.where("kind LIKE 'member%'").groupBy("kind").agg(F.countDistinct("a").alias("n")).collect()
    assert {r["kind"] for r in users} == {"member left", "member right"}


def test_segments_lose_no_pair():
    from itertools import product

    texts = ["".join(t) for n in range(1, 8) for t in product("ab", repeat=n)]
    for ratio in (0.85, 0.9):
        plans = resolve.segment_plans(ratio)
        cut = []
        for k, plan in enumerate(plans):
            held = {}
            for n, other, i, at, size in plan:
                held.setdefault(n, []).append((other, i, at, size))
            cut.append({t: {((len(t), o) if k == 0 else (o, len(t)), i, t[at : at + size]) for o, i, at, size in held.get(len(t), [])} for t in texts})
        for a, b in product(texts, texts):
            if SequenceMatcher(None, a, b, autojunk=False).ratio() >= ratio:
                assert cut[0][a] & cut[1][b]


def test_many_texts_of_the_same_letters_reach_the_matcher_seldom(spark):
    """Permutations all have the symbols of each other, so that letters alone keep every pair."""
    rng = np.random.default_rng(0)
    texts = [(0, k, "".join(rng.permutation(list("aaabbbcccdddee")))) for k in range(400)]
    side = spark.createDataFrame(texts, "day int, class long, s string")
    near = resolve._near_texts(side, side, ["day"], 0.9)
    found = resolve.matched(near, 0.9)
    want = sum(SequenceMatcher(None, x[2], y[2], autojunk=False).ratio() >= 0.9 for x in texts for y in texts)
    assert found.count() == want and near.count() < 400 * 400 / 20


def test_small_and_large_blocks_give_one_result_and_a_hot_pair_of_texts_meets_nowhere(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(b, 100 * b + k, "".join(rng.choice(list("abc"), rng.integers(2, 6)))) for b in range(6) for k in range(12)]
    rows += [(b, 10**6 + 2 * b + k, s) for b in range(300) for k, s in enumerate(("abca", "abcb"))]  # one pair of texts in many blocks
    df = spark.createDataFrame(rows, "g int, k long, s string")
    found = []
    for bound in (4096, 0):
        monkeypatch.setattr(resolve, "PAIRS_OF_A_BLOCK", bound)
        pairs, members = resolve.alike_classes(df, ["g"], "k", "s", 0.7)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Join.*\(sa#\d+ = sa#\d+\)", plan)
        found.append((sorted(map(tuple, pairs.collect())), sorted(map(tuple, members.collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 300


def test_texts_that_share_a_segment_alone_are_not_paired(spark):
    """Such pairs grow with the square of a block and are let through by the join only if their edits allow the ratio."""
    rng = np.random.default_rng(5)
    letters = list("abcdeé字")
    texts = ["".join(rng.choice(letters[:5] if k % 2 else letters, rng.integers(13, 19))) for k in range(240)] + ["a" * n + "b" * (30 - n) for n in range(0, 30, 3)]
    other = ["".join(c for c in t if rng.random() > 0.05) for t in texts]
    left, right = (spark.createDataFrame([(0, k, t) for k, t in enumerate(side)], "day int, class long, s string") for side in (texts, other))
    near = resolve._near_texts(left, right, ["day"], 0.9)
    got = {(r["a"], r["b"]) for r in resolve.matched(near, 0.9).collect()}
    want = {(a, b) for a, t in enumerate(texts) for b, u in enumerate(other) if SequenceMatcher(None, t, u, autojunk=False).ratio() >= 0.9}
    assert got == want and len(want) > 150 and near.count() < 1.2 * len(want)


def test_edits_change_a_bit_each_at_most(spark):
    rng = np.random.default_rng(6)
    pairs = []
    for n in (1, 5, 40, 48):
        for letters in ("ab", "abcdefgh", "aé字😀"):
            for d in (1, 2, 5):
                t = list(rng.choice(list(letters), n))
                u = list(t)
                for _ in range(d):
                    if rng.random() < 0.5 and len(u) > 1:
                        u.pop(rng.integers(len(u)))
                    else:
                        u.insert(rng.integers(len(u) + 1), rng.choice(list(letters)))
                pairs.append(("".join(t), "".join(u), d))
    df = spark.createDataFrame(pairs, "t string, u string, d int").select("d", resolve.symbol_bits(F.col("t")).alias("x"), resolve.symbol_bits(F.col("u")).alias("y"))
    assert df.where("bit_count(x ^ y) > d").count() == 0 and df.where("x > 0 AND y > 0").count() == len(pairs)
