import random
import re

from pyspark.sql import functions as F

from priorkit.llm import ngram_join
from priorkit.llm.common import table

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sets_of(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if x]
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    """component by row index, over all pairs."""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least[root(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def check(make, rows):
    got = sorted(map(tuple, ngram_join.link_components(make(rows)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def corpus(seed, chain=False):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(60)]
    rows, i = [], 0
    for _ in range(14):
        base = [word() for _ in range(rng.randint(3, 150))] + (passage if rng.random() < 0.5 else [])
        w = list(base)
        for k in range(rng.choice([1, 2, 6, 14])):
            if not chain:
                w = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = w + [word() for _ in range(rng.randint(1, 30))]
            rows.append((i, " ".join(w).upper() if k % 2 else " ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(make):
    check(make, corpus(1) + [(1000 + k, "one two") for k in range(3)] + [(2000, None), (2001, ""), (2002, " \n")])


def test_chains_of_edits(make):
    check(make, corpus(2, chain=True))


def test_large_group_around_the_threshold(make):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(0, 100, 7), rng.choice([0, 1, 2, 3, 4, 5])):
            w[k] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    check(make, rows)


def test_frequent_shingles_come_last(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 3)
    check(make, corpus(4))


def test_odd_rows(make, odd, spark):
    rows = [(r[0], r[1]) for r in odd] + [(8, "alpha beta gamma delta epsilon zeta eta"), (8, "quite another text with the same id here")]
    check(make, rows)
    docs = make(odd).withColumn("component_id", F.lit("clash"))
    kept = ngram_join.keep_one(spark, docs, "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "component_id"]
    assert ngram_join.link_components(make([])).count() == 0


def test_counts_that_are_joined(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 3)
    monkeypatch.setattr(ngram_join, "MOST_HELD", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 2)
    check(make, corpus(5))


def test_long_lists_in_blocks(make, monkeypatch):
    """Texts that share much and link with few: every list is taken in blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join(passage + [f"o{i}_{k}" for k in range(rng.choice([4, 12, 16, 18, 20, 30]))])) for i in range(40)]
    rows += [(100 + i, " ".join([f"q{i % 3}_{k}" for k in range(20 + i)] + passage)) for i in range(20)]
    check(make, rows)


def kept_of(rows):
    """What keep_one keeps, in plain Python: of each component the smallest id, of one id's texts either, of equal rows one."""
    found = brute(rows)
    groups = {}
    out = []
    for (d, t), (_, n, component) in zip(rows, found):
        if d is None or n == 0:
            out.append((d, t))
        else:
            groups.setdefault(root_of(rows, t), set()).add((d, t))
    return out, groups


def root_of(rows, text):
    """The set of texts linked with `text`, over all rows with an id."""
    texts = {t for d, t in rows if d is not None}
    seen, todo = {text}, [text]
    while todo:
        a = sets_of(todo.pop())
        for t in texts - seen:
            b = sets_of(t)
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                seen.add(t)
                todo.append(t)
    return frozenset(seen)


def test_keep_one_loses_no_text(make, spark):
    """Ids with two texts, equal rows, null ids: one row of each component stays, and no component goes."""
    t = " ".join(f"t{k}" for k in range(40))
    u = " ".join(f"u{k}" for k in range(40))
    s = " ".join(f"s{k}" for k in range(40))
    rows = [(1, t), (8, t + " x"), (8, u), (9, u + " y"), (20, s), (20, s), (20, s.upper()), (None, t), (None, None), (3, None), (3, None), (4, ""), (7, "a b"), (7, "c d"), (6, "c d")]
    got = [(r.doc_id, r.text) for r in ngram_join.keep_one(spark, make(rows).withColumn("first", F.lit("clash")).withColumn("th", F.lit(0)), "").collect()]
    loose, groups = kept_of(rows)
    for members in groups.values():
        mine = [x for x in got if x in members]
        assert len(mine) == 1 and mine[0][0] == min(d for d, _ in members), members
        got.remove(mine[0])
    assert sorted(got, key=str) == sorted(loose, key=str)
    assert ngram_join.keep_one(spark, make([]), "").count() == 0


def test_whole_table_equals_all_pairs(spark):
    """Every link of the 1,000 documents of sf0.01 against all pairs: none lost, none added."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(brute(rows), key=str)
    assert sum(1 for d, _, c in want if d != c) > 50
    assert sorted(map(tuple, ngram_join.op10_ngram_join(spark, "/root/testdata/sf0.01").collect()), key=str) == want


def test_words_alike_to_a_polynomial_do_not_link(make):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} {word} x y z"), (4, f"{other} {word} x y z"), (5, word)]
    got = [tuple(r) for r in ngram_join.link_components(make(rows)).collect()]
    assert sorted(got) == sorted(brute(rows))
