import math
import hashlib

from pyspark.sql import functions as F

from priorkit.llm.mixing import SEED, mix_sources, source_rates


def drawn(doc_id, rate, seed=SEED):
    u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_counts_are_inverse_poisson_draws(make, spark):
    docs = make([(i, f"t{i}", "en", "hot" if i % 3 else "cold") for i in range(3000)])
    rates = {r.source: r.rate for r in source_rates(docs, {"hot": 0.5, "cold": 0.5}).collect()}
    assert abs(rates["hot"] - 0.75) < 1e-9 and abs(rates["cold"] - 1.5) < 1e-9
    out = mix_sources(docs, {"hot": 0.5, "cold": 0.5})
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for i in range(3000):
        assert got.get(i, 0) == drawn(i, rates["hot" if i % 3 else "cold"]), i
    shares = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(shares["hot"] / sum(shares.values()) - 0.5) < 0.05


def test_odd_rows(make, odd, spark):
    out = mix_sources(make(odd).withColumn("copy_no", F.lit("clash")), total=60).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in odd}
    assert all(1 <= r.copy_no <= r.n_copies for r in out)
    assert mix_sources(make([])).count() == 0
    only = mix_sources(make(odd), {"a": 1.0}).collect()
    assert {r.source for r in only} <= {"a"}


def test_large_rates_do_not_underflow(make):
    out = mix_sources(make([(i, "x", "en", "s") for i in range(4)]), total=4 * 900)
    assert abs(out.count() - 3600) < 400
