import base64
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorkit.llm import quality_rules, sentencepiece_bpe as bpe, spotsigs, token_counts
from priorkit.llm.words import WordHasher, shingle_sets, windows

SPACES = "\x20\x09-\x0d"
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
MIXED = ["", "a", " ", "   a  b   ", "▁x", "a▁▁b c", "\n\n\t x", "ngngngngng", "a" * 40, "日本語 テキスト 😀😀", "    " * 7, "a" + " " * 33 + "b", "=====-----=====", "ab" * 57, "\x00a", "é́"]


def random_texts(n, alphabet, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_sentencepiece_equals_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=bpe.model_path())
    vocabulary = bpe.Vocabulary(bpe.model_path())
    long = [base64.b64encode(random.Random(9).randbytes(60_000)).decode(), "".join(chr(random.Random(i).randint(0x4E00, 0x5FFF)) for i in range(80_000))]
    long += ["".join(random.Random(8).choices(letters, k=n)) for letters, n in (("etaoinshrdlu", 30_000), ("ACGT", 20_000), ("=-_*#", 5_000))] + [" " * 20_000]
    long += ["".join(random.Random(i).choices(["etaoinsh", "=-_*#", "ing", "theratio", "ntiongs"][i % 5], k=65 + i)) for i in range(200)]
    for t in long:
        began = time.perf_counter()
        assert vocabulary.encoder()([t])[0].tolist() == sp.encode(t, add_eos=True), t[:80]
        assert time.perf_counter() - began < 10  # far less; rounds that grow with the length take minutes
    texts = MIXED + random_texts(1500, "abtheinor  ▁ngs.,0123456789=-_\"()éüñ日😀\n\t", 60, 1) + random_texts(1500, "  ▁theing=- ", 40, 2) + ["the quick brown fox " * 5000, "x" * 3000]
    mine, theirs = vocabulary.encoder()(texts), sp.encode(texts, add_eos=True)
    for t, a, b in zip(texts, mine, theirs):
        assert a.tolist() == b, t[:80]
        assert vocabulary.decode(b) == sp.decode(b)


def test_encode_and_decode_tables(make, odd):
    encoded = bpe.encode_documents(make(odd).withColumn("ids", F.lit("clash")))
    rows = encoded.collect()
    assert len(rows) == len(odd)
    assert sorted(r.n_tokens for r in rows)[0] == 1
    back = Counter((r.doc_id, r.text) for r in bpe.decode_documents(encoded).collect())
    assert back == Counter((r[0], (r[1] or "").replace("▁", " ")) for r in odd)
    assert bpe.encode_documents(make([])).count() == 0


def test_token_counts_equal_plain_dynamic_programming(make, odd):
    model = token_counts.Unigram(bpe.model_path())
    words = sorted({w for t in MIXED + random_texts(300, "thequickbrown▁日😀", 14, 3) for w in token_counts.pretokens(t)})

    def plain(w):
        best = [(0, 0)]
        for end in range(1, len(w) + 1):
            options = []
            for start in range(end):
                s = model.score.get(w[start:end])
                if s is not None:
                    options.append((best[start][0] + s, best[start][1] - 1))
                elif start == end - 1:
                    options.append((best[start][0] + model.unknown, best[start][1] - len(w[start].encode())))
            best.append(max(options))
        return -best[-1][1]

    assert model.counts(words) == {w: plain(w) for w in words}
    rows = token_counts.count_tokens(make(odd)).collect()
    assert len(rows) == len(odd) and all(r.n_tokens == 0 for r in rows if r.doc_id in (2, 3))


def test_scores_and_document_sums_equal_plain_estimation(make):
    """Two rounds over all texts and the sums of whole documents, against plain dynamic programming."""
    texts = [" ".join(x) for x in (["the cat sat on the mat"] * 3, ["the theory of the weather"], ["a cat 日 \n there"])] + [None, "", "the cat", "the cat"]
    docs = make(list(enumerate(texts))).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    words = Counter(w for t in texts for w in token_counts.pretokens(t or ""))
    score = token_counts.Unigram(bpe.model_path()).score

    def best(w, score):
        unknown = min(score.values()) - 10_000_000
        at = [(0, 0, ())]
        for end in range(1, len(w) + 1):
            options = []
            for start in range(end - 1, -1, -1):
                s, n, parts = at[start]
                if w[start:end] in score:
                    options.append((s + score[w[start:end]], n - 1, parts + (w[start:end],)))
                elif start == end - 1:
                    options.append((s + unknown, n - len(w[start].encode()), parts + (w[start],)))
            top = max(o[:2] for o in options)
            at.append(next(o for o in options if o[:2] == top))
        return at[-1]

    for _ in range(token_counts.ROUNDS):
        found = Counter()
        for w, n in words.items():
            for p in best(w, score)[2]:
                found[p] += n
        total = sum(found[p] for p in score) + 0.5 * len(score)
        score = {p: round(1e6 * math.log((found[p] + 0.5) / total)) for p in score}
    model = token_counts.fitted(docs)
    assert model.score == score
    got = Counter((r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(docs, model).collect())
    want = Counter()
    for i, t in enumerate(texts):
        parts = token_counts.pretokens(t or "")
        want[(i, len(parts), sum(-best(w, score)[1] for w in parts))] += 1
    assert got == want
    assert token_counts.count_tokens(make([])).count() == 0


def test_shared_prefixes_are_computed_once_in_a_range(make, spark):
    texts = random_texts(300, "abcab é日 ", 200, 11)
    docs = make([(i, t) for i, t in enumerate(texts)] + [(None, None), (1, ""), (9999, "x" * 30_000)])
    words = {r.word: r.n for r in token_counts.pretoken_counts(docs).collect()}
    assert words == Counter(w for t in texts + ["x" * 30_000] for w in token_counts.pretokens(t))
    model = token_counts.Unigram(bpe.model_path())
    few = sorted(w for w in words if len(w) < 100)
    prefixes = len({w[:k] for w in few for k in range(1, len(w) + 1)})
    found, nodes, characters = model.piece_counts((w, words[w]) for w in few)
    assert nodes == prefixes < characters == sum(map(len, few))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # ranges of many batches
    try:
        table_ = token_counts.sorted_words(docs.where("doc_id IS NULL OR doc_id != 9999"))
        sums, nodes, characters = token_counts.piece_sums(table_, model)
        ranges = table_.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    plain, _, _ = model.piece_counts((w, words[w]) for w in sorted(words) if len(w) < 100)
    assert sums == {k: v for k, v in plain.items() if k in model.score}
    longest = max(map(len, few))
    assert prefixes <= nodes <= prefixes + ranges * longest and characters == sum(map(len, few))


def plain_rules(t):
    t = t or ""
    w = [x for x in re.split(f"[{SPACES}]+", t) if x]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(f"[^{SPACES}]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def plain_kept(t):
    n, chars, symbols, dup, repeat = plain_rules(t)
    t = t or ""
    w = [x for x in re.split(f"[{SPACES}]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(f"[^{SPACES}]", x)]
    upper = sum(1 for x in w if re.search("[A-Z]", x) and not re.search("[a-z]", x))
    shouts = 2 * upper > n and sum(c.isupper() for c in t) > 3 * sum(c.islower() for c in t)
    return n >= 20 and 100 * repeat <= 30 * n and 2 * n <= chars <= 15 * n and 4 * symbols <= n and 10 * dup <= 3 * len(lines) and not shouts


def test_quality_rules_against_brute_force(make, odd):
    texts = [r[1] for r in odd] + ["a b c d e f g h " * 3 + "x", "l1 a\nl1 a\n\n \nl2|#", "one  two three\x1cfour"] + random_texts(200, "ab \n\t|#", 120, 4) + random_texts(300, "abcdefgh ijkl AB CD\nE", 400, 14) + random_texts(100, "ABCDE FGH\n", 300, 15)
    rows = quality_rules.cascade(make([(i, t) for i, t in enumerate(texts)]), measures=True).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows} == {i: plain_rules(t) for i, t in enumerate(texts)}
    for r in rows:
        assert r.kept == plain_kept(texts[r.doc_id]), texts[r.doc_id]
    alone = quality_rules.cascade(make([(i, t) for i, t in enumerate(texts)]).withColumn("kept", F.lit("clash"))).collect()
    assert {r.doc_id: r.kept for r in alone} == {r.doc_id: r.kept for r in rows}


def test_cascade_verdict_does_not_depend_on_order(make):
    docs = make([(i, t) for i, t in enumerate(random_texts(80, "abcde AB|#\n", 400, 5))])
    names = list(quality_rules.RULES)
    a = quality_rules.cascade(docs, order=names).orderBy("doc_id").collect()
    b = quality_rules.cascade(docs, order=names[::-1]).orderBy("doc_id").collect()
    assert a == b
    assert sorted(quality_rules.order_of(docs)) == sorted(names)
    assert quality_rules.cascade(make([])).count() == 0


def test_word_and_shingle_hashes():
    texts = MIXED + random_texts(200, "abc ABC\n\té", 60, 6)
    words, bounds = WordHasher()(texts)
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    by = {}
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        plain = [x for x in re.split(f"[{SPACES}]+", t.translate(fold)) if x]
        assert len(plain) == b - a, t
        for x, h in zip(plain, words[a:b].tolist()):
            assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
    alone = [shingle_sets(WordHasher(), [t])[0].tolist() for t in texts]
    assert [s.tolist() for s in shingle_sets(WordHasher(), texts)] == alone
    assert len(windows(words[:3], 5)) == 0


def thue_morse(bits: int) -> tuple[str, str]:
    """A word over a and b, and the word with the two exchanged: alike to any polynomial modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_alike_to_a_polynomial_have_hashes_of_their_own(make):
    for bits in (9, 10, 11, 12):
        a, b = thue_morse(bits)
        hashes, _ = WordHasher()([f"{a} {b} {a}", b.upper()])
        assert hashes[0] != hashes[1] and hashes[0] == hashes[2] and hashes[1] == hashes[3]
    a, b = thue_morse(10)
    doc = quality_rules.Doc(f"{a} c d e f g h i {b} c d e f g h i", WordHasher(lower=False))
    assert doc.n_repeat_words == 0
    assert quality_rules.Doc(f"{a} c d e f g h i {a} c d e f g h i", WordHasher(lower=False)).n_repeat_words == 16
    prints = {r.doc_id: r.fingerprint for r in spotsigs.fingerprints(make([(1, f"the {a} cat sat"), (2, f"the {b} cat sat")])).collect()}
    assert spotsigs.jaccard(*map(spotsigs.from_text, prints.values())) == 0.0


def test_the_table_of_word_hashes_is_bounded():
    small = WordHasher()
    small.MOST_KEPT = 3
    text = " ".join(f"w{i % 5}" for i in range(20)) + " " + "x" * 100
    assert small([text])[0].tolist() == WordHasher()([text])[0].tolist()
    assert len(small.known) <= 4


def plain_signatures(text):
    """SpotSigs in plain Python: tuples of words instead of hashes."""
    words = [w for w in re.split(f"[{SPACES}]+", (text or "").translate(FOLD)) if w]
    common = set(spotsigs.ANCHORS)
    content = [i for i, w in enumerate(words) if w not in common]
    found = set()
    for i, w in enumerate(words):
        chain = [words[k] for k in content if k > i][: spotsigs.CHAIN]
        if w in common and len(chain) == spotsigs.CHAIN:
            found.add((w, *chain))
    if found or not words:
        return found
    n = spotsigs.CHAIN + 1
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_next(rows):
    """(row, next text) for rows (doc_id, text) in the order of op7."""
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode()))
    return [(r, (named[(i + 1) % len(named)][1] or "")) for i, r in enumerate(named)]


def test_fingerprints_and_edits(make, spark, tmp_path):
    a, b = "The quick brown fox is a lazy dog in the warm sun " * 3, "nothing shared here at all with any other text of that kind " * 3
    rows = [(i, t) for i, t in enumerate([a, b, a, None, "", "zz yy xx ww", a[:-20] + " extra", "one", "der Hund und the", "is the of", "日本 語 the 😀 x"] * 3)]
    rows += [(5, "another text of an id with two"), (5, "another text of an id with two"), (40, "the end is near the sea")]
    make(rows).withColumn("key", F.lit(1)).withColumn("part", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, len(r.fingerprint) // 16, len(r.edited_fingerprint) // 16, round(r.near_edited, 9), round(r.near_next, 9)) for r in spotsigs.op7_spotsigs(spark, str(tmp_path)).collect())
    want = Counter()
    for (i, t), following in plain_next(rows):
        t = t or ""
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, other, near = map(plain_signatures, (t, new, following))
        want[(i, len(t), hashlib.sha256(new.encode()).hexdigest(), len(own), len(other), round(plain_jaccard(own, other), 9), round(plain_jaccard(own, near), 9))] += 1
    assert got == want


def test_rows_without_an_id_are_fingerprinted(make, spark, tmp_path):
    texts = ["the red house", "a blue house of stone", "the red house", None]
    make([(None, t) for t in texts] + [(3, "the red house"), (1, "one more")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = spotsigs.op7_spotsigs(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == {None: 4, 3: 1, 1: 1}
    equal = {r.fingerprint for r in got if r.n_chars == len("the red house")}
    assert len(equal) == 1 and "" not in equal
    last, first = next(r for r in got if r.doc_id == 3), min((r for r in got if r.doc_id is None), key=lambda r: 0)
    assert 0 <= last.near_next <= 1 and first is not None
    make([]).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert spotsigs.op7_spotsigs(spark, str(tmp_path / "none")).count() == 0
    assert spotsigs.spotsigs_near(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("percent", [55, 75])
def test_near_pairs_against_all_pairs(make, percent):
    rng = random.Random(7)
    base = [[rng.choice(["the", "of", "is"]) if k % 3 == 0 else f"w{rng.randint(0, 5000)}" for k in range(120)] for _ in range(12)]
    texts = []
    for words in base:
        for edits in (0, 0, 2, 6, 15):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
            texts.append(" ".join(w))
    docs = make(list(enumerate(texts)) + [(900, None), (901, ""), (None, texts[0])])
    pairs, members = spotsigs.near_pairs(spotsigs.fingerprints(docs), percent)
    class_of = {r.doc_id: r.class_id for r in members.collect()}
    assert set(class_of) == {*range(len(texts)), 900, 901}
    got = {(r.left_id, r.right_id): (r.both, r.either) for r in pairs.collect()}
    sets = dict(enumerate(map(plain_signatures, texts)))
    met = 0
    for i in sets:
        for j in range(i):
            a, b = sorted((class_of[i], class_of[j]))
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            assert (100 * both >= percent * either) == (a == b or (a, b) in got)
            if (a, b) in got:
                met += 1
                assert got[a, b] == (both, either)
    assert met


@pytest.mark.parametrize("percent", [50, 55, 75, 90])
def test_length_partitions_reach_one_further(percent):
    edges = np.array(spotsigs.length_partitions(percent, 100_000))
    for n in range(1, 20_000, 37):
        most = 100 * n // percent
        assert np.searchsorted(edges, most) - np.searchsorted(edges, n) <= 1
    assert spotsigs.least_length(100, 55) == 55 and spotsigs.least_length(180, 55) == 99


def test_near_fingerprints_are_made_once(spark):
    near = spotsigs.spotsigs_near(spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in near._jdf.queryExecution().optimizedPlan().toString()  # the members read the staged fingerprints
    docs = spark.createDataFrame([(1, "the red fox is in a green wood"), (2, None), (3, "one"), (4, ""), (5, "the red fox")], "doc_id long, text string").coalesce(1)
    whole = {r[0]: r[1] for r in spotsigs.fingerprints(docs).collect()}
    assert whole == {i: spotsigs.as_text(spotsigs.Signer()([t or ""])[0]) for i, t in docs.collect()}
