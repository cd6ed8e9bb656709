"""Near-duplicates, components, mixing, classifiers and the pipeline: brute force and held-out accuracy."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ravelin.llm import embeddings, labels, mixing, quality, simhash, toxicity
from ravelin.llm.components import _small, components


def roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    pairs = {"chain": [(i, i + 1) for i in range(60)], "star": [(50, i) for i in range(50)], "random": rng.integers(0, 100, (70, 2)).tolist(), "none": []}[shape]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs + [(None, 3), (7, 7)], "a long, b long")).collect()}
    want = roots(100, [(a, b) for a, b in pairs if a != b])
    assert set(found) == {x for a, b in pairs if a != b for x in (a, b)}
    for a in found:
        for b in found:
            assert (found[a] == found[b]) == (want[a] == want[b])


def test_components_are_written_round_by_round(spark):
    """The driver holds no plan of all rounds, and a small table is read by one task, however many partitions it has."""
    found = components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 31
    parts = spark.range(30).repartition(53)
    assert _small(parts, 30).rdd.getNumPartitions() == 1 and _small(parts, 10**6).rdd.getNumPartitions() == 10


def slow_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \n", "a", "A b", "É É x É É", "one two three four five six seven " * 30):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_simhash_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    own = np.array([slow_fingerprint(t) for _, t in docs], np.uint64)
    pairs = [(i, j) for i in range(len(own)) for j in np.flatnonzero(np.bitwise_count(own[:i] ^ own[i]) <= 4)]
    want = roots(len(own), pairs)
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, sf_dir).collect()}
    assert rows == {k: (f"{f:016x}", docs[w][0]) for (k, _), f, w in zip(docs, own.tolist(), want)}


def test_bucket_links_and_pivots():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 30, np.uint64)
    flips = rng.integers(0, 64, (600, 3)).astype(np.uint64)
    fps = np.unique(np.concatenate([centres[rng.integers(0, 30, 600)] ^ np.bitwise_or.reduce(np.uint64(1) << flips, axis=1), rng.integers(0, 2**64, 50, np.uint64)]))
    near = simhash.pivot_distances(fps)
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4)])
    place = {f: i for i, f in enumerate(fps.tolist())}
    for bounds in (np.array([0, len(fps)]), np.append(np.arange(0, len(fps), 6), len(fps))):
        a, b = simhash.bucket_links(fps, near, bounds, 4)
        got = roots(len(fps), [(place[x], place[y]) for x, y in zip(np.concatenate(a).tolist(), np.concatenate(b).tolist())])
        inside = roots(len(fps), [(i, j) for s, e in zip(bounds, bounds[1:]) for i in range(s, e) for j in range(s, i) if (fps[i] ^ fps[j]).item().bit_count() <= 4])
        assert got == inside
        if len(bounds) == 2:
            assert got == want


@pytest.mark.parametrize(("n", "d"), [(10, 4), (10**6, 4), (10**8, 4), (10**10, 4), (10**5, 7)])
def test_every_linked_pair_agrees_on_a_choice_of_blocks(n, d):
    _, masks = simhash.plan(n, d)
    rng = np.random.default_rng(0)
    for _ in range(300):
        diff = sum({1 << int(b) for b in rng.integers(0, 64, d)})
        assert any(diff & m == 0 for m in masks)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 20)
    rng = np.random.default_rng(9)
    fps = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 4)).astype(np.uint64), axis=1))
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4)])
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    place = {f: i for i, f in enumerate(fps.view(np.int64).tolist())}
    edges = [(place[r.a], place[r.b]) for r in simhash.links(df).collect()]
    assert roots(len(fps), edges) == want


def test_simhash_edges(spark):
    rows = [(3, None), (1, ""), (9, "  "), (4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (8, "z" * 100_000), (7, "A B C D E")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS first")
    got = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect()))
    assert got == [(-1, 4), (1, 1), (3, 1), (4, 4), (4, 4), (7, 4), (8, 8), (9, 1)]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.15, size=(20, 16)), np.repeat(base[:1], 30, axis=0) + rng.normal(scale=0.1, size=(30, 16)), base[:3]]).astype(np.float32)
    label = [None if i == 5 else int(i % 2 == 0 and i < 40) for i in range(len(x))]
    rows = [(i * 3, x[i].tolist(), label[i]) for i in range(len(x))]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, [1.0] * 8, 1), (1005, [], 1), (1006, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS n")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = [(i, j) for i in range(len(x)) for j in range(i) if label[i] is not None and label[i] == label[j] and u[i] @ u[j] >= 0.93]
    want = roots(len(x), link)
    n = np.bincount(np.array(link).ravel(), minlength=len(x))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert {k: v for k, v in got.items() if k < 900} == {i * 3: (int(n[i]), want[i] * 3, want[i] == i) for i in range(len(x))}
    assert {k: v for k, v in got.items() if k >= 1000} == {k: (0, k, True) for k in (1000, 1001, 1002, 1003, 1005)} | {1004: (1, 1004, True), 1006: (1, 1004, False)}
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_tiles_of_large_cells_meet(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(3)
    x = (np.ones((120, 16)) + rng.normal(scale=0.2, size=(120, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    n = ((u @ u.T) >= 0.93).sum(axis=1) - 1
    assert {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()} == dict(enumerate(n.tolist()))


def test_embeddings_query_is_the_sql(spark, sf_dir, duck):
    from compare import same

    assert same(embeddings.op5_embeddings(spark, sf_dir), duck, embeddings.ORACLES["op5_embeddings"]) > 0


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 500 / 3 - 500 / 3 + 250 * 2 / 3, 250 / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(0, 1000, rng.integers(1, 30)).tolist()
        t = mixing.targets(sizes)
        assert sum(t) == pytest.approx(1.5 * sum(sizes)) and all(a <= 2 * s + 1e-6 for a, s in zip(t, sizes))
        free = [(a / mixing.WEIGHTS[i % 3]) for i, (a, s) in enumerate(zip(t, sizes)) if a < 2 * s - 1e-6]
        assert not free or max(free) == pytest.approx(min(free))


def test_splitting_tree():
    q = np.array([10, 0, 7, 300])
    out = mixing.split(q, 5, np.random.default_rng(1))
    assert out.sum(axis=1).tolist() == q.tolist() and set(out.sum(axis=0).tolist()) <= {63, 64}
    assert mixing.split(np.zeros(0, np.int64), 3, np.random.default_rng(1)).shape == (0, 3)


def test_mixing_query(spark, sf_dir):
    text = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = mixing.op8_mixing(spark, sf_dir).collect()
    assert len(rows) == len(text) and sorted(rows) == sorted(mixing.op8_mixing(spark, sf_dir).collect())
    for source in {s for _, s in text.values()}:
        own = [r for r in rows if text[r.doc_id][1] == source]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id][0])) and 0 <= r.taken <= 2 * r["size"] for r in rows)


def test_mixing_pieces_are_disjoint_and_edges_hold(spark):
    rows = [(i, None if i == 0 else "w " * (i * 37 % 1500), None if i % 5 == 0 else f"s{i % 3}") for i in range(60)] + [(7, "w " * 259, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "3 AS size", "4 AS target")
    planned = mixing.plan(docs).collect()
    assert len(planned) == 61
    for r in planned:
        seen = sorted((p["pass"], p.word_from, p.word_to) for p in r.pieces)
        assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(seen, seen[1:])) and all(0 <= a < b <= r["size"] for _, a, b in seen)
    by = {}
    for r in planned:
        by.setdefault(r.doc.source, [0, r.target])[0] += sum(p.word_to - p.word_from for p in r.pieces)
    assert all(abs(a - b) <= 1 for a, b in by.values())
    assert mixing.blocks(mixing.plan(docs)).count() == sum(len(r.pieces) for r in planned)
    assert mixing.plan(docs.where("false")).count() == 0


def accuracy(rows, known):
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    return sum(a == b for a, b in held) / len(held)


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, toxic = quality.op7_quality(spark, sf).collect(), toxicity.op6_toxicity(spark, sf).collect()
    assert all(0 <= r.score <= 1 for r in good + toxic)
    assert accuracy(good, {k: v.quality for k, v in known.items()}) > 0.9
    assert accuracy(toxic, {k: v.toxic for k, v in known.items()}) > 0.7


def test_classifiers_without_labels_and_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "x y"), (None, "Word " * 30_000)], "doc_id long, text string").selectExpr("*", "1 AS score", "'a' AS features")
    none = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {1.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert quality.score(docs.where("false"), quality.fit(docs.where("false"), none)).count() == 0


def test_held_out_is_crc32(spark):
    import zlib

    rows = spark.range(200).select("id", labels.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_calibration_finds_the_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    n = quality.Network(np.zeros(1), np.ones(1), np.eye(1) * 0.01, np.zeros(1), np.array([1000.0]), 0.0)  # logit 10x
    assert quality.calibrate(n, x, y).temperature == pytest.approx(5, rel=0.15)


def test_pooling_in_parts_is_pooling_whole():
    words = np.random.default_rng(0).normal(size=(50, quality.DIMENSIONS)).astype(np.float32)
    ids = np.random.default_rng(1).integers(0, 50, 40_000)
    v = words[ids].astype(float)
    got = quality.pool(ids, words)
    assert np.allclose(got[: quality.DIMENSIONS], v.mean(axis=0), atol=1e-4)
    assert got[-3] == pytest.approx((v[1:] * v[:-1]).sum() / 39_999, abs=1e-3)


def test_contexts_are_counts_of_neighbours():
    places, signs = quality.index_vectors()
    total = np.zeros(quality.TYPES * quality.DIMENSIONS, np.int64)
    quality.add_contexts(total, [np.array([5, 9, 7]), np.array([5])], places, signs)
    want = np.zeros((quality.TYPES, quality.DIMENSIONS), np.int64)
    for a, b in ((5, 9), (9, 5), (9, 7), (7, 9), (5, 7), (7, 5)):
        for n in range(2):
            want[a, places[n, b]] += int(signs[n, b])
    assert (total.reshape(want.shape) == want).all()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    assert P.run(spark, sf_dir).count() > 0


def test_pipeline_near_duplicates_and_mixing(spark, sf_dir):
    import corpus_pipeline as P

    rows = [(i, " ".join(f"{chr(97 + i)}{j}" for j in range(50)), "en", "s", 1) for i in range(6)]
    rows += [(10, rows[0][1], "en", "s", 1), (10, rows[0][1], "en", "s", 1), (11, rows[1][1] + " more", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    mixed = P.mix_sources(spark, docs, sf_dir).collect()
    assert sum(len(r.text.split()) for r in mixed) == round(1.5 * sum(len(t.split()) for _, t, *_ in rows))


def test_positions_are_a_permutation_and_shards_hold_their_quotas(spark):
    at = mixing.position(F.col("sid"), F.col("number"), F.col("block"), F.lit(1000).cast("long"))
    rows = spark.range(1000).selectExpr("3L AS sid", "1L AS number", "id AS block").select("block", at.alias("at")).orderBy("block").collect()
    assert sorted(r["at"] for r in rows) == list(range(1000))
    steps = {(b["at"] - a["at"]) % 1000 for a, b in zip(rows, rows[1:])}
    assert len(steps) > 300  # no arithmetic progression
    docs = spark.createDataFrame([(i, "w " * (300 + i), f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string")
    planned = mixing.plan(docs, shards=8).collect()
    words = [0] * 8
    for r in planned:
        for p in r.pieces:
            words[p.shard] += p.word_to - p.word_from
    assert max(words) - min(words) <= 4 * mixing.BLOCK_WORDS  # as many blocks each; three sources have a short and a cut one
    one = {(p["pass"], p.block) for r in mixing.plan(docs, shards=1).collect() for p in r.pieces}
    assert one == {(p["pass"], p.block) for r in planned for p in r.pieces}


def test_a_sample_has_one_row_an_id_and_long_and_null_texts(spark):
    key = next(i for i in range(50) if not spark.range(i, i + 1).select(labels.held_out(F.col("id")).alias("h")).first().h)
    docs = spark.createDataFrame([(key, "a"), (key, "b"), (key, None), (key, "x" * 20_000)], "doc_id long, text string")
    known = spark.createDataFrame([(key, 1), (key, 0), (None, 1)], "doc_id long, toxic int")
    rows = labels.sample(spark, docs, known, "toxic").collect()
    assert len(rows) == 1 and rows[0].label == 1 and len(rows[0].text) <= labels.MOST_BYTES
    assert labels.sample(spark, docs.where("length(text) > 9"), known, "toxic", most_bytes=None).count() == 1


def slow_toxicity(model, packed, language):
    """The forward pass by its definition, window by window."""
    h = toxicity.buckets(packed)
    x = np.concatenate([model.tables[t, h[t]] for t in range(toxicity.TABLES)], axis=1).astype(float)
    while len(x) < toxicity.WIDTHS[-1]:
        x = np.concatenate([x, np.zeros((1, x.shape[1]))])
    z = float(model.bias)
    for k, (w, f) in enumerate(zip(toxicity.WIDTHS, model.filters)):
        for c in range(toxicity.FILTERS):
            top = max(sum(float(x[i + j] @ f[j][:, c]) for j in range(w)) for i in range(len(x) - w + 1)) + float(model.biases[k][c])
            z += max(0.0, top) * float(model.out[k * toxicity.FILTERS + c])
    return 1 / (1 + np.exp(-(z - model.shift[language])))


def test_scores_are_those_of_slow_forward_passes(spark):
    rng = np.random.default_rng(7)
    words = ["alpha", "beta", "gamma", "delta", "vile", "nasty", "the", "and"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 12)))) for _ in range(60)]
    ids = toxicity.Words(1000).ids(texts)
    model = toxicity.train([(p, int("vile" in t)) for (p, _), t in zip(ids, texts)])._replace(shift=np.array([0.1, 0, 0.2, 0, -0.3]))
    scorer = toxicity.Scorer(model)
    assert np.allclose([scorer.score(*x) for x in ids], [slow_toxicity(model, *x) for x in ids], atol=1e-4)
    vectors = rng.normal(size=(quality.TYPES, quality.DIMENSIONS)).astype(np.float32)
    own = quality.Types(1000).of(texts)
    x = np.stack([quality.pool(o, vectors) for o in own])
    net = quality.train(x, np.array([float("vile" in t) for t in texts]))._replace(temperature=1.7, bias=0.2)
    for o, row, got in zip(own, x, net.probability(x)):
        v = vectors[o].astype(float)
        if len(v):
            mean = v.mean(axis=0)
            pairs = max(1, len(v) - 1)
            want = [*mean, *np.sqrt(np.maximum((v * v).mean(axis=0) - mean * mean, 0)), sum(a @ b for a, b in zip(v, v[1:])) / pairs, sum(a == b for a, b in zip(o, o[1:])) / pairs, np.sqrt((mean * mean).sum())]
            assert np.allclose(row, want, atol=1e-4)
        hidden = [np.tanh(sum(np.clip((a - m) / s, -8, 8) * w for a, m, s, w in zip(row, net.mean, net.scale, column)) + b) for column, b in zip(net.w1.T, net.b1)]
        z = sum(a * b for a, b in zip(hidden, net.w2)) + net.b2
        assert got == pytest.approx(1 / (1 + np.exp(-(z / 1.7 + 0.2))), abs=1e-6)


def test_groups_around_a_text_with_many_variants(spark):
    """Variants of one text that are near it and not each other, and sets that share a key only."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(300)]
    rows = [" ".join(base)]
    for n in range(60):
        own = base[:]
        for i in rng.choice(300, 5, replace=False):
            own[i] = f"v{n}x{i}"
        rows.append(" ".join(own))
    rows += [" ".join(base[:40] + [f"u{n}x{i}" for i in range(200)]) for n in range(20)]
    docs = simhash.with_hashes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    sets = [set(simhash.shingles(t).tolist()) for t in rows]
    want = roots(len(rows), [(j, i) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    got = {r.doc_id: (r.group, r.part) for r in simhash.similar_groups(docs).collect()}
    for i in range(len(rows)):
        for j in range(i):
            assert (got[i] == got[j]) == (want[i] == want[j])
