"""The whole pipeline against plain Python on the smallest table."""

from collections import Counter

import sentencepiece
from test_mixing import drawn
from test_ngram_join import brute

import corpus_pipeline
from priorkit.llm import pii, toxicity
from priorkit.llm.common import table
from priorkit.llm.mixing import ALPHA
from priorkit.llm.sentencepiece_bpe import model_path

SF = "/root/testdata/sf0.001"


def cut(text, spans):
    """`text` with its spans replaced by tags; overlapping spans become the first one's tag."""
    tags = {k.name: k.tag for k in pii.KINDS}
    out, at = [], 0
    for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
        if start >= at:
            out += [text[at:start], tags[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline_equals_plain_steps(spark):
    docs = table(spark, SF, "documents")
    score = {r.doc_id: r.score for r in toxicity.op1_toxicity(spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if score[r.doc_id] < toxicity.THRESHOLD]
    assert len(rows) < docs.count()
    kept = {i for i, _, component in brute(rows) if i == component}
    assert len(kept) < len(rows)
    found = {r.doc_id: r for r in pii.find_pii(docs).collect() if r.doc_id in kept}
    texts = {i: cut(r.text or "", r.pii) for i, r in found.items()}
    sizes = Counter(r.source for r in found.values())
    total = sum(n**ALPHA for n in sizes.values())
    rate = {s: n**ALPHA / total * len(found) / n for s, n in sizes.items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = Counter()
    for i, r in found.items():
        if n := drawn(i, rate[r.source]):
            want[(i, tuple(sp.encode(texts[i], add_eos=True)))] += n
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
