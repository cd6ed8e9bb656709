"""The pipeline's near-duplicate stage against brute force, and what it keeps."""

import random

from ravelin.llm import simhash


def test_groups_of_near_copies_are_those_of_brute_force(spark, sf_dir):
    import corpus_pipeline as P

    rng = random.Random(5)
    texts = ["", None, "a b", "A  B"]
    for _ in range(25):
        base = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(rng.choice((20, 80, 300)))]
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.04, 0.05):
            texts.append(" ".join("new" + str(rng.randrange(10**6)) if rng.random() < share else w for w in base))
    line = " ".join(f"l{i}" for i in range(30))  # many hold this line, and are no near copies for it
    texts += [line + " " + " ".join(str(rng.randrange(10**6)) for _ in range(40)) for _ in range(30)]
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    first = list(range(len(texts)))
    links = [(i, j) for j in range(len(texts)) for i in range(j) if near(sets[i], sets[j])]
    for _ in texts:
        for i, j in links:
            first[i] = first[j] = min(first[i], first[j])
    assert any(5 * len(sets[i] & sets[j]) < 4.4 * len(sets[i] | sets[j]) for i, j in links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = P.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(first))
    assert P.drop_near_duplicates(spark, docs.where("false"), sf_dir).count() == 0


def test_one_row_of_each_group_is_kept_whatever_its_id(spark, sf_dir):
    import corpus_pipeline as P

    text = [" ".join(f"{c}{j}" for j in range(50)) for c in "abcdef"]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (7, text[3]), (8, text[3]), (9, text[4]), (None, text[4]), (1, text[5] + " more"), (7, text[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `a.b`")
    want = [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (9, text[4]), (1, text[5] + " more")]
    for part in (docs, docs.orderBy("text").repartition(3)):
        kept = P.drop_near_duplicates(spark, part, sf_dir)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_the_last_stage_returns_token_ids(spark, sf_dir):
    import hashlib

    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "some words, some words"), (1, None), (None, "Grüße")], "doc_id long, text string")
    rows = P.encode(spark, docs, sf_dir).collect()
    assert sorted(r.n_tokens for r in rows)[0] == 0 and len(rows) == 3
    assert all(len(r.ids) == r.n_tokens and hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 for r in rows)


def test_columns_of_any_name_stay_as_they_are(spark, sf_dir):
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    text = [" ".join(f"{c}{j}" for j in range(50)) for c in "ab"]
    rows = [(1, text[0], 11), (2, text[0], 12), (3, text[1], 13), (4, None, 14), (4, None, 14), (5, " \n", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t1 long")
    more = {"t2": F.lit("x"), "row_hash": F.col("doc_id").cast("int"), "group": F.lit(2.5), "part": F.lit(True), "doc": F.lit("d"), "set": F.col("t1"), "n": F.lit(None).cast("string"), "texts": F.col("text"), "score": F.lit(1), "key": F.lit("k"), "size": F.lit(9), "label": F.lit(3), "h": F.lit(4)}
    docs = docs.withColumns(more).withColumn("a.b", F.array(F.lit(1))).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    kept = P.drop_near_duplicates(spark, docs, sf_dir)
    assert kept.schema == docs.schema
    want = {r.doc_id: r for r in docs.collect()}
    assert sorted(kept.collect(), key=lambda r: r.doc_id) == [want[1], want[3], want[4]]
    for stage in (P.keep_quality, P.drop_toxic):
        for part in (docs, docs.where("false")):
            found = stage(spark, part, sf_dir)
            assert found.columns == docs.columns and {str(r) for r in found.collect()} <= {str(r) for r in part.collect()}
    mixed = P.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and {r.t1 for r in mixed.collect()} <= {11, 12, 13} and mixed.count() > 3
    assert P.mix_sources(spark, docs.where("false"), sf_dir).count() == 0
    assert P.encode(spark, docs, sf_dir).count() == 6 and P.encode(spark, docs.where("false"), sf_dir).count() == 0
