import zlib

import numpy as np
import pyarrow as pa

from lumengraph.llm import toxicity as S


def index(seed=0, n=300):
    rng = np.random.default_rng(seed)
    terms = np.unique(rng.integers(0, 1 << 60, 80).astype(np.uint64))
    idf = 1 + rng.random(len(terms))
    vectors = []
    for _ in range(n):
        t = np.unique(rng.integers(0, len(terms), rng.integers(1, 7)))
        vectors.append((t, rng.integers(1, 4, len(t)).astype(float)))
    return S.Index(terms, idf, vectors, rng.integers(0, 2, n).tolist(), list(range(n)), 0.2), vectors


def test_nearest_equals_exhaustive_cosine():
    ix, vectors = index()
    rng = np.random.default_rng(9)
    for _ in range(60):
        t = np.unique(rng.integers(0, len(ix.terms), 4))
        w = ix.weigh(t, np.ones(len(t)))
        query = np.zeros(len(ix.terms))
        query[t] = w
        cos = []
        for vt, tf in vectors:
            x = np.zeros(len(ix.terms))
            x[vt] = ix.weigh(vt, tf)
            cos.append(round(float(x @ query), 9))
        want = sorted((c for c in cos if c > 0), reverse=True)[:15]
        got = [round(c, 9) for c, e in ix.nearest(t, w, 15) for _ in range(int(ix.count[e]))][:15]
        assert np.allclose(got, want)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = S.fit(docs, labels)
    rows = S.score_documents(docs, fitted).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [(r["score"] >= 0.5) == (r["toxic"] == 1) for r in held]
    assert sum(right) / len(right) > 0.95
    clean = [r for r in held if r["toxic"] == 0]
    assert sum(r["score"] >= 0.5 for r in clean) / len(clean) < 0.01


def test_labels_of_the_held_out_fold_are_never_read(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in S.score_documents(docs, S.fit(docs, x)).collect()) for x in (labels, flipped))
    assert a == b


def test_features_and_scores_of_odd_texts():
    h, doc = S.features(pa.array(["Abcdef!", None, "", "--", "ab"], pa.string()))
    assert sorted(doc.tolist()) == [0, 0, 0, 0, 4]
    ix, _ = index()
    assert [s for s, _ in ix.score(pa.array([None, "", "unknown"], pa.string()))] == [0.2, 0.2, 0.2]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 0), (2, 1, 0), (None, 1, 1), (3, 1, None), (6, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    fitted = S.fit(odd_docs, labels)
    rows = S.score_documents(odd_docs, fitted).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert S.score_documents(no_docs, S.fit(no_docs, labels)).count() == 0
    none = S.score_documents(odd_docs, S.fit(odd_docs, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.0}
    assert S.clean_documents(odd_docs, fitted).columns == odd_docs.columns


def test_rare_insults_and_whole_norms(spark):
    """A term of three toxic examples in a hundred, far below any chi-squared of 30, is known; cosines are over whole texts."""
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmnp"]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 12)) + (" scoundrel" if i < 3 else " cad" if i < 100 else "") for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 100)) for i in range(200)], "doc_id long, quality int, toxic int")
    fitted = S.fit(docs, labels, modulus=1, held=1)
    every = sorted({h for h in S.features(pa.array(texts))[0].tolist()})
    assert fitted.terms.tolist() == every
    ((score, near),) = fitted.score(pa.array(["Scoundrel!"]))
    assert score > 0.5 and {i for _, e in near for i, _ in fitted.members[e]} == {0, 1, 2}

    def vector(t):
        h, _, tf = S.counted(*S.features(pa.array([t])))
        idf = dict(zip(fitted.terms.tolist(), fitted.idf.tolist(), strict=True))
        return {x: (1 + np.log(n)) * idf.get(x, fitted.unseen) for x, n in zip(h.tolist(), tf.tolist(), strict=True)}

    def cosine(x, y):
        return sum(v * y.get(k, 0.0) for k, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    for t in [*texts[::20], "bak cad dem strange", "scoundrel cad fip"]:
        want = sorted((round(cosine(vector(t), vector(x)), 9) for x in texts), reverse=True)[:15]
        ((_, near),) = fitted.score(pa.array([t]))
        got = [round(c, 9) for c, e in near for _ in fitted.members[e]][:15]
        assert np.allclose(got, [c for c in want if c > 0])


def test_repeated_and_contradictory_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.where("toxic is not null")
    more = labels.unionAll(labels).unionAll(labels).unionAll(labels.where("toxic = 1").selectExpr("doc_id", "quality", "0 as toxic"))
    a, b = (S.fit(docs, x, per_class=50) for x in (labels, more))
    assert sorted(x for g in a.members for x in g) == sorted(x for g in b.members for x in g) and a.base == b.base
    texts = pa.array([r["text"] for r in docs.limit(40).collect()], pa.string())
    assert [s for s, _ in a.score(texts)] == [s for s, _ in b.score(texts)]


def plain_score(texts, toxic, text, k=S.NEIGHBOURS):
    """Score and cosines from the texts alone, all examples being labelled training rows: words and their beginnings as strings."""

    def terms(t):
        out = {}
        for w in t.lower().split():
            w = w.strip(".,;:!?-")
            for x in [w] + [f"{w[:n]}*{n}" for n in S.PREFIXES if len(w) >= n]:
                out[x] = out.get(x, 0) + 1
        return out

    bags = [terms(t) for t in texts]
    n, sick = len(texts), sum(toxic)
    spread = S.SMOOTHING / n

    def contrast(a, b):
        return abs(np.log((a / sick + spread) / (b / (n - sick) + spread)))

    def idf(x):
        a = sum(x in b for b, y in zip(bags, toxic, strict=True) if y)
        b = sum(x in b for b, y in zip(bags, toxic, strict=True) if not y)
        by_label = contrast(a, b) if a + b else sick / n * contrast(1, 0) + (1 - sick / n) * contrast(0, 1)
        return (np.log((1 + n) / (1 + a + b)) + 1) * by_label

    def vector(bag):
        v = {x: (1 + np.log(tf)) * idf(x) for x, tf in bag.items()}
        return v, np.sqrt(sum(y * y for y in v.values()))

    q, size = vector(terms(text))
    near = []
    for b, y in zip(bags, toxic, strict=True):
        v, own = vector(b)
        if (c := sum(w * q.get(x, 0.0) for x, w in v.items())) > 0:
            near.append((round(c / own / size, 10), y))
    near = sorted(near, reverse=True)[:k]
    votes = sum(c for c, _ in near) + S.PRIOR_WEIGHT
    return (sum(c * y for c, y in near) + S.PRIOR_WEIGHT * sick / n) / votes, [c for c, _ in near]


def test_fit_cosine_and_vote_equal_a_plain_version(spark):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}{c}{d}" for a in "bdfg" for b in "aeiou" for c in "kl" for d in "ao"]
    toxic = [int(i % 4 == 0) for i in range(60)]
    texts = [" ".join([*rng.choice(words, 8), *(["villain"] if y and i % 8 else []), f"own{i}word"]) for i, y in enumerate(toxic)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    fitted = S.fit(docs, labels, modulus=1, held=1)
    for text in [texts[4], "Villain!", "villain baka unheard", "villain " + " ".join(f"strange{i}" for i in range(300)), "bako dela"]:
        want, cosines = plain_score(texts, toxic, text, 200)
        ((got, near),) = fitted.score(pa.array([text]), 200)
        assert np.allclose([c for c, e in near for _ in fitted.members[e]], cosines, atol=1e-8) and abs(got - want) < 1e-8


def test_words_that_no_example_has_count_in_the_norm(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fitted = S.fit(docs, labels)
    text = docs.join(labels.where("toxic = 1"), "doc_id").orderBy("doc_id").first()["text"]
    (alone, near), (diluted, far) = fitted.score(pa.array([text, text + " " + " ".join(f"zq{i}xv" for i in range(20_000))]))
    assert far[0][0] < 0.5 * near[0][0] and abs(diluted - fitted.base) < abs(alone - fitted.base)


def test_held_out_scores_are_calibrated(spark):
    """Mean score against the share of toxic documents, by tenths of the score: expected calibration error."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    rows = S.score_documents(held, S.fit(docs, labels)).join(labels.where("toxic is not null"), "doc_id").collect()
    score, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    tenth = np.minimum((score * 10).astype(int), 9)
    gap = sum(abs(score[tenth == b].sum() - y[tenth == b].sum()) for b in range(10)) / len(y)
    assert gap < 0.05 and ((score - y) ** 2).mean() < 0.02 and (score[y == 1] >= 0.5).mean() > 0.9
