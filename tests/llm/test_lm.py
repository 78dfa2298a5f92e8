"""Language-model scores: counts and base scores by definition, normalisation, gain on texts held out."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lzseq.llm import lm, textkit

from .helpers import ODD, table

FIRST, SECOND = "the an in re er on at or es ing".split(), "ka mo zu ti lu bo ny ve pa xo".split()


def two_tongues(rng, n):
    out = []
    for k in range(n):
        parts = (FIRST, SECOND)[k % 2]
        out.append(" ".join(rng.choice(parts) if rng.random() < 0.4 else "".join(rng.choices(parts, k=rng.randint(2, 3))) for _ in range(rng.randint(5, 80))))
    return out


def words(text):
    return [*(text or "").encode().translate(textkit.LOWER).split(), None]


@pytest.fixture(scope="module")
def texts():
    return [*two_tongues(random.Random(6), 300), *(t for t in ODD if t is None or len(t) < 60_000), "THE the ÉÉ éé", "y" * 200]


@pytest.mark.parametrize("most_common", [30, 10**6])  # most words by a join, all short ones by a broadcast
def test_base_scores_follow_definition(spark, texts, most_common, monkeypatch):
    monkeypatch.setattr(lm, "TOGETHER", 3_000)
    got = {r.doc_id: r for r in lm.scored_documents(table(spark, texts), most_common=most_common).collect()}
    assert sorted(got) == list(range(len(texts)))
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in got}
    count = Counter(w for k, t in enumerate(texts) if not held[k] for w in words(t))
    n, v = sum(count.values()), len(count)
    for k, t in enumerate(texts):
        w, r = words(t), got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(x in count for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-9)


def test_held_out_texts_are_likelier_than_by_single_tokens(spark):
    got = lm.scored_documents(table(spark, two_tongues(random.Random(7), 1_500))).collect()
    for part in (True, False):
        score, base = (sum(r[k] for r in got if r.held_out == part) for k in ("score", "base_score"))
        assert score > 0.95 * base  # logs are below 0


def test_probabilities_of_all_tokens_add_up(spark, texts):
    docs = table(spark, texts[:300])
    counts = lm.word_counts(lm.training(docs)).cache()
    model = lm.fit(docs, counts, lm.training(docs).count())
    size = model.classes.size
    context = np.random.default_rng(1).integers(0, size + 1, (5, lm.BEFORE))
    for c in context:
        of_class = 10 ** (model.network.scores(np.tile(c, (size, 1)), np.arange(size)).astype(float) / math.log(10))
        assert math.isclose(of_class.sum(), 1, rel_tol=1e-4)
    rows = counts.collect()
    kind = model.classes.of(pa.array([r.word for r in rows], pa.large_string()))
    shares = np.zeros(size)
    for r, k in zip(rows, kind):
        shares[k] += (r.n + 1) / (model.class_words[k] + model.class_distinct[k] + 1)
    shares += 1 / (model.class_words + model.class_distinct + 1)  # any unknown word
    shares[model.classes.end] += (model.class_words[model.classes.end] + 1) / (model.class_words[model.classes.end] + 2)
    assert np.allclose(shares, 1)


def test_scores_of_a_text_follow_the_model(spark, texts):
    docs = table(spark, texts[:120])
    counts = lm.word_counts(lm.training(docs)).cache()
    model = lm.fit(docs, counts, lm.training(docs).count())
    n = {r.word.encode(): r.n for r in counts.collect()}
    got = {r.doc_id: r.score for r in lm.score(docs, model, counts, 10).collect()}
    for k in (0, 1, 7, 50):
        w = words(texts[k])
        kind = [model.classes.end if x is None else int(model.classes.of(pa.array([x.decode()], pa.large_string()))[0]) for x in w]
        total = 0.0
        for i, c in enumerate(kind):
            before = [kind[i - d - 1] if i > d else model.classes.size for d in range(lm.BEFORE)]
            h = sum(model.network.before[d][x].astype(float) for d, x in enumerate(before))
            z = model.network.after.astype(float) @ h + model.network.bias
            have = model.class_words[c] if w[i] is None else n.get(w[i], 0)
            total += (z[c] - math.log(np.exp(z).sum())) / math.log(10) + math.log10((have + 1) / (model.class_words[c] + model.class_distinct[c] + 1))
        assert math.isclose(got[k], total, rel_tol=1e-4)


def test_classes_and_network_are_of_all_texts(spark, texts, monkeypatch):
    def sample(*args, **options):
        raise AssertionError("a sample of the texts")

    monkeypatch.setattr(lm, "sample_texts", sample, raising=False)
    monkeypatch.setattr(lm, "TOGETHER", 2_000)
    monkeypatch.setattr(lm, "AT_ONCE", 50)
    docs = table(spark, texts).repartition(3)
    counts = lm.word_counts(docs)
    heads = pa.array([r.word for r in counts.orderBy(F.desc("n"), "word").limit(20).collect()], pa.large_string())
    codes = lm.coded(docs, heads).cache()
    want, rows = Counter(), [c for r in codes.collect() for c in np.frombuffer(r.codes, np.uint16).tolist()]
    assert sum(c == lm.END for c in rows) == len(texts) and len(rows) == sum(len(words(t)) for t in texts)
    for i, c in enumerate(rows):
        for j in range(i + 1, min(i + 5, len(rows))):
            if lm.END in rows[i : j + 1]:
                break
            for own, other in ((c, rows[j]), (rows[j], c)):
                if own >= len(heads) > other:
                    want[own - len(heads), other] += 1
    got = lm.near(codes, len(heads))
    assert want and {(int(a), int(b)): int(got[a, b]) for a, b in zip(*np.nonzero(got))} == want
    assert lm.fit(docs, counts, docs.count()).words == int(counts.agg(F.sum("n")).first()[0]) + len(texts)


def test_networks_of_tasks_are_averaged(spark, monkeypatch):
    learnt = []
    of = lm.network_of
    monkeypatch.setattr(lm, "LEARNT", 5_000)
    monkeypatch.setattr(lm, "BATCH", 64)
    monkeypatch.setattr(lm, "WARM", 40)
    monkeypatch.setattr(lm, "network_of", lambda p: learnt.append(p) or of(p))
    got = lm.scored_documents(table(spark, two_tongues(random.Random(9), 1_500)).repartition(4)).collect()
    score, base = (sum(r[k] for r in got if r.held_out) for k in ("score", "base_score"))
    assert score > 0.95 * base and len(learnt) == 1 and all(np.isfinite(x).all() for x in learnt[0].values())


def test_odd_tables(spark):
    assert lm.scored_documents(table(spark, [])).count() == 0
    got = lm.scored_documents(table(spark, ["a b", "a b", None, ""], ids=[2, 2, None, 8])).collect()
    assert len(got) == 4 and sorted(r.n_tokens for r in got) == [1, 1, 3, 3] and len({r.base_score for r in got if r.doc_id == 2}) == 1
    none = [r for r in got if r.doc_id is None][0]
    assert none.held_out is None and none.n_known <= 1
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    alone = lm.scored_documents(table(spark, ["a b c"] * 3, ids=ids)).collect()  # nothing to learn from
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score < 0 for r in alone)


def test_samples_are_bounded_in_bytes(spark):
    docs = table(spark, ["x" * 100] * 20)
    got = textkit.sample_texts(docs, docs.select("doc_id", F.lit(1).alias("y")), "y", 10, most_bytes=250)
    assert len(got) == 2
    assert len(textkit.sample_texts(docs, docs.select("doc_id", F.lit(1).alias("y")), "y", 10, most_bytes=5)) == 1
