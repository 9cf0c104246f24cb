"""Quality, toxicity and language: held-out accuracy and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeboard.llm import ftrl_langid, knn_quality, queries, weak_toxicity
from noticeboard.llm.common import remainder
from tests.conftest import SF
from tests.llm.helpers import LABELS, ROWS, documents

SMALL = "/root/testdata/sf0.01"


def scored(spark, name, label):
    got = queries.QUERIES[name](spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return got.join(labels, "doc_id").toPandas()


def test_quality_on_documents_held_out(spark):
    rows = scored(spark, "op1_knn_quality", "quality")
    held = rows[rows.held_out]
    assert len(held) > 50 and (held.predicted == held.y).mean() > 0.95
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()


def test_toxicity_leaves_clean_documents_alone(spark):
    rows = scored(spark, "op2_weak_toxicity", "toxic")
    held = rows[rows.held_out]
    assert (held.predicted == held.y).mean() > 0.93
    assert (rows[rows.y == 0].score < 0.5).mean() > 0.99


def test_language_on_documents_held_out(spark):
    got = queries.QUERIES["op7_ftrl_langid"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(docs, "doc_id").toPandas()
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.98


def test_folds_are_those_of_the_contract(spark):
    import zlib
    got = {r.doc_id: r.held_out for r in queries.QUERIES["op1_knn_quality"](spark, SF).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in got.items())
    some = spark.createDataFrame([(5,), (None,)], "doc_id long").select(remainder(F.col("doc_id"), 5)).collect()
    assert some[0][0] == zlib.crc32(b"5") % 5 and some[1][0] is None


def test_labels_of_the_fold_held_out_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(remainder(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (knn_quality.fit_quality(docs, x) for x in (labels, turned))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)


@pytest.mark.parametrize("labelled", [[], [(1, 1, 1)], [(1, 1, 0), (6, 0, 1), (7, 1, 0), (8, 0, None), (None, 1, 1), (1, 0, 1)]])
def test_odd_rows(spark, labelled):
    docs, labels = documents(spark), spark.createDataFrame(labelled, LABELS)
    for got in (knn_quality.quality_scores(docs, knn_quality.fit_quality(docs, labels, folds=1000, held=999)),
                weak_toxicity.toxicity_scores(docs, weak_toxicity.fit_toxicity(docs, labels, folds=1000, held=999))):
        rows = got.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    empty = documents(spark, [])
    assert knn_quality.quality_scores(empty, knn_quality.fit_quality(empty, labels)).count() == 0
    assert weak_toxicity.toxicity_scores(empty, weak_toxicity.fit_toxicity(empty, labels)).count() == 0


def test_languages_of_odd_rows(spark):
    docs = documents(spark)
    rows = ftrl_langid.languages_of(docs, ftrl_langid.fit_languages(docs, folds=1000)).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r.lang_pred for r in rows}
    assert [got[i] for i in (3, 4, 5, 8)] == ["und"] * 4 and got[7] == "de"
    empty = documents(spark, [])
    model = ftrl_langid.fit_languages(empty)
    assert ftrl_langid.languages_of(docs, model).filter("lang_pred = 'und'").count() == len(ROWS)


def alphabet(k, i):
    """A text in the letters of the k-th language."""
    r = np.random.default_rng((k, i))
    return " ".join("".join(chr(0x4E00 + 40 * k + c) for c in r.integers(0, 40, 5)) for _ in range(30))


def test_every_language_is_learned(spark):
    # 70 languages; the rarest, last in order of count, have one document, and one shares its id with another's
    rows = [(100 * k + i, alphabet(k, i), f"l{k:02}", None, 0) for k in range(70) for i in range(6 if k < 60 else 1)]
    rows.append((0, alphabet(70, 0), "m", None, 0))
    # an id repeated often does not hide its language
    rows += [(7000, alphabet(71, 0), "n", None, 0)] * 3000
    model = ftrl_langid.fit_languages(documents(spark, rows), folds=100_000)
    assert model.languages == [f"l{k:02}" for k in range(70)] + ["m", "n"]
    texts = [alphabet(k, 50) for k in range(72)]
    assert model.predict(texts)[0] == model.languages


def test_the_budget_of_rows_is_shared_by_all_languages(spark):
    rows = [(100 * k + i, alphabet(k, i), f"l{k}", None, 0) for k in range(10) for i in range(8)]
    model = ftrl_langid.fit_languages(documents(spark, rows), rows=20, least=3, folds=100_000)
    assert len(model.languages) == 10


def test_small_samples_are_calibrated_too(spark):
    rows = [(100 * k + i, alphabet(k, i), f"l{k}", None, 0) for k in range(2) for i in range(10)]
    assert ftrl_langid.fit_languages(documents(spark, rows), folds=100_000).temperature != 1.0


def test_lexicon_holds_every_term_that_passes_the_test(spark):
    # 600 words of three letters, each in 15 of 300 toxic documents
    word = lambda i: "".join(chr(97 + i // 26 ** j % 26) for j in range(3))
    rows = [(d, " ".join(word(17 * i + 1000) for i in range(600) if d in {(i + 20 * j) % 300 for j in range(15)}), None, None, 0)
            for d in range(300)]
    rows += [(300 + d, f"plain words of number {d}", None, None, 0) for d in range(300)]
    labels = spark.createDataFrame([(d, 1, int(d < 300)) for d in range(600)], LABELS)
    model = weak_toxicity.fit_toxicity(documents(spark, rows), labels, folds=100_000, held=99_999)
    assert len(model.lexicon) == 600


def test_least_count_follows_from_the_test():
    # log(1 / share) a document: two are enough where one term has as many and toxic rows are rare
    assert weak_toxicity.least_count({1: 50, 2: 1}, 0.05) == (2, 1)
    assert weak_toxicity.least_count({1: 50, 30: 600}, 0.5)[0] == 10
    assert weak_toxicity.least_count({}, 0.5)[1] == 0


def sparse(votes):
    row, voter = np.nonzero(votes)
    return weak_toxicity.Votes(row, voter, *votes.shape)


def drawn_votes(n=600, accuracies=(0.7, 0.6, 0.6, 0.5)):
    r = np.random.default_rng(3)
    y = r.random(n) < 0.3
    votes = np.stack([np.where(y, r.random(n) < a, r.random(n) < 0.01) for a in accuracies], axis=1)
    return y, np.concatenate([votes, votes[:, :1]], axis=1)  # and a voter that repeats another


def test_label_model_finds_the_class_without_labels():
    y, votes = drawn_votes()
    q = weak_toxicity.label_model(sparse(votes), 0.3)
    assert ((q > 0.5) == y).mean() > 0.93
    # the voter that repeats another is tied to it and changes nothing to speak of
    assert weak_toxicity.leaders(sparse(votes))[4] == 0
    without = weak_toxicity.label_model(sparse(votes[:, :4]), 0.3)
    assert np.abs(q - without).max() < 0.05


def test_label_model_equals_enumeration():
    _, votes = drawn_votes(300, (0.7, 0.5, 0.4))
    model, prior, rounds = sparse(votes), 0.3, 40
    q = [0.9 if any(v) else 0.1 * prior for v in votes]
    tied = {}

    def rate(j, fires, c, lead):
        """P(voter j fires | class, whether its partner fires), over the rows one by one."""
        n = sum(w(c, x) for x, v in zip(q, votes) if v[j] and (lead is None or bool(v[tied[j]]) == lead))
        d = sum(w(c, x) for x, v in zip(q, votes) if lead is None or bool(v[tied[j]]) == lead)
        if lead:
            on = [v for v in votes if v[tied[j]]]
            return (n + (sum(bool(v[j]) for v in on) + 0.5) / (len(on) + 1)) / (d + 1)
        return (n + (0.2, 0.02)[c]) / (d + 1)

    def w(c, x):
        return x if c == 0 else 1 - x

    for turn in range(rounds):
        if turn == rounds // 2:
            found = weak_toxicity.leaders(model)
            strong = weak_toxicity.correlation(model, found, np.array(q)) >= 0.1
            tied = {j: int(found[j]) for j in range(votes.shape[1]) if strong[j]}
        states = {(j, s): max(np.log(np.clip(rate(j, True, 0, s), 1e-4, 1 - 1e-4) / np.clip(rate(j, True, 1, s), 1e-4, 1 - 1e-4)), 0)
                  for j in range(votes.shape[1]) for s in ((True, False) if j in tied else (None,))}
        share = np.clip(np.mean(q), 1e-3, 1 - 1e-3)
        none = [sum(w(c, x) for x, v in zip(q, votes) if not any(v)) for c in (0, 1)]
        silent = np.clip([(none[0] + 0.01) / (sum(q) + 1), (none[1] + 1) / (len(q) - sum(q) + 1.02)], 1e-4, 1 - 1e-4)
        fresh = []
        for v in votes:
            logit = np.log(share / (1 - share)) + sum(states[j, bool(v[tied[j]]) if j in tied else None] for j in np.flatnonzero(v))
            logit += np.log((1 - silent[0]) / (1 - silent[1])) if any(v) else np.log(silent[0] / silent[1])
            fresh.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        q = fresh
    assert tied.get(3) == 0
    assert np.allclose(weak_toxicity.label_model(model, prior), q, atol=1e-9)


def test_linear_classifier_is_at_its_optimum():
    y, votes = drawn_votes()
    posterior = np.where(y, 0.95, 0.03)
    w, b = weak_toxicity.linear_classifier(sparse(votes), posterior)
    p = 1 / (1 + np.exp(-(votes @ w + b)))
    assert (w > 0).all() and np.abs(votes.T @ (p - posterior) + 0.05 * w).max() < 1e-4 and abs((p - posterior).sum() + 1e-3 * b) < 1e-4


def test_many_voters_fit_in_little_memory():
    import tracemalloc
    r = np.random.default_rng(1)
    row = np.sort(r.integers(0, 6000, 200_000))
    code = np.unique(row * 20_000 + r.integers(0, 20_000, len(row)))
    votes = weak_toxicity.Votes(code // 20_000, code % 20_000, 6000, 20_000)
    tracemalloc.start()
    weak_toxicity.linear_classifier(votes, weak_toxicity.label_model(votes, 0.5, rounds=4), steps=2)
    assert tracemalloc.get_traced_memory()[1] < 100e6     # a matrix of voters by voters would be 3.2 GB
    tracemalloc.stop()


def test_neighbours_vote_as_one_by_one(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = knn_quality.fit_quality(docs, labels)
    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(25).select("text").collect()] + ["", "x"]
    vectors, got = model.project(np.stack([knn_quality.terms(t) for t in texts])), model.scores(texts)
    for v, score in zip(vectors, got):
        near = sorted(((float(np.dot(v, u)), y) for u, y in zip(model.vectors, model.labels)), reverse=True)
        last = near[model.neighbours - 1][0]
        if near[model.neighbours][0] < last - 1e-9:       # no tie at the edge
            weights = [(max(c, 0) ** 8 + 1e-9, y) for c, y in near[:model.neighbours]]
            assert score == pytest.approx(sum(a * y for a, y in weights) / sum(a for a, _ in weights))


def test_ftrl_equals_its_definition():
    r = np.random.default_rng(8)
    model = ftrl_langid.Ftrl(3, 6)
    z, n = [[0.0] * 6 for _ in range(3)], [[0.0] * 6 for _ in range(3)]

    def weight(c, i):
        if abs(z[c][i]) <= model.l1:
            return 0.0
        return -(z[c][i] - np.sign(z[c][i]) * model.l1) / ((model.beta + n[c][i] ** 0.5) / model.alpha + model.l2)

    for _ in range(60):
        at = np.sort(r.choice(6, 3, replace=False))
        x, label = r.random(3), int(r.integers(0, 3))
        model.learn(at, x, label)
        w = [[weight(c, i) for i in range(6)] for c in range(3)]
        e = np.exp([sum(w[c][i] * v for i, v in zip(at, x)) for c in range(3)])
        for c in range(3):
            for i, v in zip(at, x):
                g = (e[c] / e.sum() - (c == label)) * v
                z[c][i] += g - ((n[c][i] + g * g) ** 0.5 - n[c][i] ** 0.5) / model.alpha * w[c][i]
                n[c][i] += g * g
    assert np.allclose(model.weights(), [[weight(c, i) for i in range(6)] for c in range(3)])


def test_temperature_is_that_of_the_data():
    r = np.random.default_rng(5)
    scores = r.normal(0, 1, (4000, 3))
    p = np.exp(scores)
    labels = (p.cumsum(axis=1) / p.sum(axis=1, keepdims=True) > r.random((4000, 1))).argmax(axis=1)
    assert ftrl_langid._temperature(scores * 4, labels) == pytest.approx(4, rel=0.15)
