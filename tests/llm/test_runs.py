import hashlib
import random
import zlib

from priorkit.llm import runs
from priorkit.llm.common import table
from tests.conftest import SF


def brute(x, least, times):
    """All maximal stretches with a smallest period, by comparing words at every distance."""
    n, out = len(x), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if x[i] == x[i + q]:
                j = i
                while j + q < n and x[j] == x[j + q]:
                    j += 1
                start, length = i, j - i + q
                w = x[start : start + length]
                if length >= max(least, times * q) and not any(w[p:] == w[:-p] for p in range(1, q)):
                    out.add((start, length, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        k = rng.choice([1, 2, 2, 3, 4])
        x = [rng.randint(0, k - 1) for _ in range(rng.randint(0, 40))]
        if x and rng.random() < 0.5:
            part = x[: rng.randint(1, max(1, len(x) // 3))]
            x = x[: rng.randint(0, len(x))] + part * rng.randint(1, 6) + x[: rng.randint(0, 5)]
        for least, times in ((2, 2), (1, 3), (6, 4)):
            assert runs.lyndon_runs(x, least, times) == brute(x, least, times), x
        assert runs.runs_of(x) == brute(x, 6, 4), x


class Counted:
    """A number that counts how often it is compared."""

    compared = 0

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Counted.compared += 1
        return self.v == other.v

    def __lt__(self, other):
        Counted.compared += 1
        return self.v < other.v


def test_comparisons_are_linear():
    a, b = [0], [0, 1]
    while len(b) < 4000:
        a, b = b, b + a
    rng = random.Random(2)
    for x in (b, [1] * 4000, ([0] * 60 + [1]) * 60, list(range(200)) * 20, [rng.randint(0, 1) for _ in range(4000)], ([0, 1] * 50 + [0]) * 40):
        Counted.compared = 0
        runs.next_smaller([*map(Counted, x), Counted(-1)])
        assert Counted.compared <= 6 * len(x), x[:20]


def plain(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 6, 4)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in found), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


KEY = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


def test_whole_table_equals_brute_force(spark):
    want = sorted((plain(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()), key=KEY)
    got = sorted(map(tuple, runs.op12_runs(spark, SF).collect()), key=KEY)
    assert got == want
    assert any(r[1] for r in got)


def test_odd_rows(make, odd, tmp_path, spark):
    rows = odd + [(i, " ".join("ab"[j % 2] for j in range(i % 30)) + " ü é", None, None) for i in range(20, 90)]
    make(rows).selectExpr("*", "'x' AS runs", "1 AS collapsed").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, runs.op12_runs(spark, str(tmp_path)).collect()), key=KEY)
    small = [r for r in rows if not (r[1] and len(r[1]) > 10_000)]
    want = sorted([plain(r[0], r[1]) for r in small], key=KEY)
    assert [r for r in got if r[0] != 4] == want
    (long_one,) = [r for r in got if r[0] == 4]
    assert long_one[1:6] == (1, 0, 30_000, 1, 30_000_000) and long_one[7] == hashlib.sha256(b"word").hexdigest()
    assert runs.periodic_runs(make([])).count() == 0
