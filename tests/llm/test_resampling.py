import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from priorkit.llm import resampling
from priorkit.llm.common import Scope

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words_of(text):
    return [w for w in re.split("[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", (text or "").translate(FOLD)) if w]


def features_of(text, longest):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, percent, least, buckets, longest, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features_of(t, longest))
    t = Counter(bucket(f) for x in target for f in features_of(x, longest))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for d, text in rows:
        f = features_of(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = i
    return [tuple(r[:5]) for r in out]


KEY = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
TARGET = ["alpha beta GAMMA", "Ünï 42 42 über", None, "", "beta beta"]


def test_draws_equal_plain_python(make, odd, spark):
    rows = [r[:2] for r in odd] + [(i, " ".join(f"w{(i * j) % 17} Beta,été{j % 3}" for j in range(i % 9)) + " ÉCOLE x_y") for i in range(100, 260)]
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    for longest, buckets, percent in ((1, 10_000, 10), (3, 64, 35)):
        docs = make(rows).withColumn("rank", F.lit("clash")).withColumn("bucket", F.lit(1))
        got = sorted(map(tuple, resampling.resample(docs, target, percent, 5, buckets, longest).collect()), key=KEY)
        assert got == sorted(brute(rows, TARGET, percent, 5, buckets, longest), key=KEY)


def test_empty_tables(make, spark):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(make([]), nothing).count() == 0
    rows = [(i, "one two three") for i in range(10)]
    got = resampling.resample(make(rows), nothing, 50, 1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]


def test_gains_cover_every_bucket(make, spark):
    docs, target = make([(1, "a b c")]), spark.createDataFrame([("a a",)], "text string")
    assert resampling.gain_table(docs, target, Scope(spark), 50).count() == 50
