import numpy as np
import pyarrow as pa

from lumengraph.llm import quality as S


def test_em_recovers_labellers_accuracies():
    rng = np.random.default_rng(7)
    good = rng.random(30_000) < 0.7
    votes = np.full((30_000, S.N_VOTERS), S.NONE)
    accuracy = [0.95, 0.9, 0.8, 0.85, 0.75, 0.9, 0.7, 0.95]
    for k, a in enumerate(accuracy):
        speaks = rng.random(30_000) < 0.6
        right = rng.random(30_000) < a
        votes[speaks, k] = np.where(good == right, S.GOOD, S.BAD)[speaks]
    codes, n = np.unique(votes @ (3 ** np.arange(S.N_VOTERS)), return_counts=True)
    fitted = S.fit_votes(dict(zip(codes.tolist(), n.tolist(), strict=True)))
    p = np.array([fitted[c] for c in (votes @ (3 ** np.arange(S.N_VOTERS))).tolist()])
    best = sum(np.log(a / (1 - a)) * ((votes[:, k] == S.GOOD) * 1.0 - (votes[:, k] == S.BAD)) for k, a in enumerate(accuracy)) >= 0
    assert ((p >= 0.5) == good).mean() > (best == good).mean() - 0.01
    assert S.fit_votes({}) == {}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = S.Model(docs)
    rows = S.score_documents(docs, model).join(labels.withColumnRenamed("quality", "truth"), "doc_id").collect()
    right = [r["accepted"] == (r["truth"] == 1) for r in rows]
    assert sum(right) / len(right) > 0.98
    assert all(r["accepted"] for r in rows if r["truth"] == 1)
    assert S.accepted_documents(docs, model).count() == S.score_documents(docs, model).where("accepted").count()


def test_votes_of_plain_and_junk_texts():
    junk = ["AAA!! BBB!! CCC!! DDD!! EEE!! FFF!!", "a*** b%%% c$$$ d### e&&& f***", "a | b | c | d | e | f | g", "und " * 40]
    plain = ["A plain sentence of some words. And another one."]
    v = S.Signals(pa.array([*junk, *plain], pa.string())).votes()
    assert (v[:4] == S.BAD).any(1).all() and not (v[:4] == S.GOOD).any() and not (v[4] == S.BAD).any() and (v[4] == S.GOOD).any()


def test_odd_rows(odd_docs, no_docs):
    model = S.Model(odd_docs)
    rows = S.score_documents(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["quality"] <= 1 for r in rows)
    assert S.accepted_documents(odd_docs, model).columns == odd_docs.columns
    empty = S.Model(no_docs)
    assert S.score_documents(no_docs, empty).count() == 0 and S.score_documents(odd_docs, empty).count() == odd_docs.count()
