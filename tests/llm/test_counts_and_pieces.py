"""Collocations, SentencePiece and the filter audit: SQL, the public library and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from compare import same

from ravelin.llm import collocations, filter_audit, pieces

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_counts(rows):
    found = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            own = found[lang if lang is not None else "und"]
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    own[tuple(words[i : i + n])] += 1
    return found


def slow_collocations(rows, least=10, covered=50, top=2000):
    out = []
    for lang, f in slow_counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        kept = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        scored = []
        for p, a in kept.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * c >= covered * a for q, c in kept.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def text_rows():
    rng = random.Random(3)
    words = ["New", "york", "City", "a", "b", "É", "é", "x\x1fy", "new", "YORK", "ω"]
    rows = []
    for lang in ("en", None, "und", "d\te"):
        for _ in range(40):
            rows.append((lang, "".join(rng.choice(words) + rng.choice((" ", " ", "  ", "\t", ". ", ",", "\n", "\r")) for _ in range(rng.randrange(60)))))
    return rows + [("en", None), ("en", ""), ("none", " . ,\n"), ("en", "run run " * 300)] * 2


def test_collocations_query(spark, sf_dir, duck):
    assert same(collocations.op11_collocations(spark, sf_dir), duck, collocations.ORACLES["op11_collocations"]) > 0


@pytest.mark.parametrize("size", [7, 64, 1 << 19])
def test_collocations_are_those_of_brute_force(spark, size):
    rows = text_rows()
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").selectExpr("*", "1 AS phrase", "'x' AS f", "2 AS `a.b`").repartition(3)
    own = collocations.shard_counts(docs, (1, 2, 3), size=size).groupBy("lang", "phrase").sum("f").collect()
    want = slow_counts(rows)
    flat = {(lang, " ".join(p)): c for lang, f in want.items() for p, c in f.items()} | {(lang, ""): sum(c for p, c in f.items() if len(p) == 1) for lang, f in want.items() if f}
    assert {(r.lang, r.phrase): r[2] for r in own} == flat
    if size > 64:
        for least, covered, top in ((10, 50, 2000), (3, 90, 5)):
            got = collocations.collocations(docs, least=least, covered=covered, top=top).collect()
            assert sorted(tuple(r) for r in got) == slow_collocations(rows, least, covered, top) != []
        few, many = (sorted(tuple(r) for r in collocations.counts(docs, least=3, bits=bits).collect()) for bits in (512, 1 << 20))  # few bits let much through
        assert few == many
        assert collocations.collocations(docs.where("false")).count() == 0


def test_suffix_order_and_long_texts():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 4, 300)
    order, shared = collocations.suffix_order(ids, 3)
    keys = [tuple(ids[i : i + 3]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(300))
    for i in range(1, 300):
        same_words = 0
        while same_words < 3 and max(order[i], order[i - 1]) + same_words < 300 and ids[order[i] + same_words] == ids[order[i - 1] + same_words]:
            same_words += 1
        assert shared[i] == same_words
    text = "Ab c. " * 3_000_000
    assert sum(map(len, collocations.slices(text))) == 3 * 3_000_000 + 1
    assert list(collocations.slices("")) == [[b"."]] and list(collocations.slices("A\tb\n"))[0] == [b"a", b"b", b"."]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return pieces.encoder(public_tokenizers.path("piece_bpe_32k.model"))


def piece_texts(library):
    rng = random.Random(1)
    texts = ["", " ", "  a", "a  b   c    d", " " * 500 + "x" + " " * 77 + "é" + " " * 48, "\t\n x", "x\0y", "漢字漢字🙂🙂" * 50, "a" * 5000, "ab" * 999, "#" * 333 + "*" * 777, "=-" * 300, "▁▁a▁", "<s></s><0x0A><unk>", "ﬁ Ω é é"]
    texts += [" " * n + "é" * (n % 2) for n in range(100)]
    letters = ("ab ", "  \n\t#*=-", "etaoin shrdlu", "абвгд ", "<>/=\"' \n{}()[];,.", "漢字の。 a", "aA1! é")
    texts += ["".join(rng.choice(rng.choice(letters[:3] if n % 2 else letters)) for _ in range(rng.choice((3, 10, 40, 200)))) for n in range(1500)]
    own = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts += ["".join(rng.choice(own) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    return texts + [rng.choice(own) * rng.randrange(1, 40) + rng.choice(own) * rng.randrange(0, 9) for _ in range(500)]


def test_pieces_are_the_librarys(library, encoder):
    texts = piece_texts(library)
    want = library.encode(texts, add_bos=True, add_eos=True)
    for at in range(0, len(texts), 700):  # some words are remembered, some new
        for text, ids, known in zip(texts[at:], encoder.encode(texts[at : at + 700]), want[at:]):
            assert np.frombuffer(ids, "<u4").tolist() == known
            assert encoder.model.decode(known) == library.decode(known) == text.replace("▁", " ")


def test_any_ids_decode_as_in_the_library(library, encoder):
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice((0, 1, 2, rng.randrange(3, 259), rng.randrange(130, 259), rng.randrange(259, 300), rng.randrange(32000))) for _ in range(rng.randrange(12))]
        assert encoder.model.decode(ids) == library.decode(ids)


def test_rounds_equal_one_merge_at_a_time():
    """Small vocabularies in which merges often make better pairs."""
    rng = random.Random(7)
    for trial in range(60):
        known = {c: (n, -1e9) for n, c in enumerate("ab▁")}
        while len(known) < 14:
            p = "".join(rng.choice("ab") for _ in range(rng.randrange(2, 5))) if rng.random() < 0.8 else "▁" * rng.randrange(2, 5)
            known.setdefault(p, (len(known), float(rng.choice((-5, -6, -7, -8)) if trial % 2 else -rng.randrange(100))))
        model = pieces.Model(known, list(range(100, 356)), [p.encode() for p in known] + [None] * 400, 50, 51)
        words = ["".join(rng.choice("aab▁c") for _ in range(rng.randrange(120))) for _ in range(30)]
        assert model.merge(["", ""]) == [b"", b""] and model.merge([]) == []
        for word, raw in zip(words, model.merge(words)):
            own = list(word)
            while True:
                pairs = [(-known[own[i] + own[i + 1]][1], i) for i in range(len(own) - 1) if own[i] + own[i + 1] in known]
                if not pairs:
                    break
                i = min(pairs)[1]
                own[i : i + 2] = [own[i] + own[i + 1]]
            want = [n for s in own for n in ([known[s][0]] if s in known else [100 + b for b in s.encode()])]
            assert np.frombuffer(raw, "<u4").tolist() == want


def test_sentencepiece_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pieces.op12_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_sentencepiece_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "ab"), (3, "long " * 40000)], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens", "3 AS `a.b`")
    rows = pieces.encode(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows)[:4] == [(0, 3), (1, 2), (1, 2), (2, 2)]
    assert all(r.ids == [1, 2] and r.decoded == "" for r in rows if r.doc_id in (1, 2))
    assert {r.decoded for r in rows if r.doc_id == 3} == {"long " * 40000}
    assert pieces.encode(docs.where("false")).count() == 0


def test_filter_audit_query(spark, sf_dir, duck):
    parts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("coalesce(source, '')").distinct().count()
    assert same(filter_audit.op13_filter_audit(spark, sf_dir), duck, filter_audit.ORACLES["op13_filter_audit"]) == 600 * parts


def slow_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    tests = {
        "A": lambda i, t: len(words(t)) < 200, "B": lambda i, t: 100 * len(set(words(t))) < 50 * len(words(t)), "C": lambda i, t: 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
        "D": lambda i, t: bool(re.search(r"[#$%&*|]", t)), "E": lambda i, t: any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in docs),
    }
    own = [(s or "", {f for f, fails in tests.items() if fails(i, t or "")}, labels.get(i, (0, 0))) for i, t, s in docs]
    out, total = [], Counter()
    for part in {s for s, *_ in own}:
        for order in permutations("ABCDE"):
            left, gone = [(f, y) for s, f, y in own if s == part], []
            for step, name in enumerate(order, 1):
                lost = [x for x in left if name in x[0]]
                redundant = sum(name in f for f, _ in gone)
                left, gone = [x for x in left if name not in x[0]], gone + lost
                unique = sum(s == part and f == {name} for s, f, _ in own)
                total[part, name] += len(lost)
                out.append((part, "".join(order), step, len(left), len(lost), redundant, unique, sum(y[0] == 1 for _, y in lost), sum(y[1] == 1 for _, y in lost)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit_edges(spark):
    rng = random.Random(9)
    kinds = [None, "", "a", "A b", "x # y", "w " * 250, " ".join(f"v{i}" for i in range(220)), "É\x0bB\x0cc\x1fD", "Ab " * 210, "a b " * 200]
    docs = [(rng.choice((None, *range(20))), rng.choice(kinds), rng.choice((None, "", "s", "t"))) for _ in range(120)]
    labels = [(None, 1, 1), (3, 1, 0), (3, 0, 1), (4, None, 1), (5, 1, None), (99, 1, 1), (7, 1, 1), (8, 0, 0)]
    known = {3: (1, 1), 4: (0, 1), 5: (1, 0), 7: (1, 1)}
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "2 AS n", "'p' AS part", "3 AS `a.b`").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.interactions(filter_audit.cells(table, marks)).collect()
    assert sorted(tuple(r) for r in got) == slow_audit(docs, known)
    assert filter_audit.interactions(filter_audit.cells(table.where("false"), marks)).count() == 0
    assert filter_audit.cells(table, marks.where("false")).agg({"good": "sum", "toxic": "sum", "n": "sum"}).first() is not None


def test_the_walk_visits_each_order_once_by_single_swaps():
    orders, before = set(), None
    for order, at in filter_audit.walk(5):
        if before is not None:
            swapped = list(before)
            swapped[at], swapped[at + 1] = swapped[at + 1], swapped[at]
            assert swapped == order
        before = list(order)
        orders.add(tuple(order))
    assert len(orders) == 120


def test_long_texts_are_measured_in_slices(monkeypatch):
    text = "One two\nÉ three# " * 5000
    whole = filter_audit.measure(text)
    monkeypatch.setattr(filter_audit, "SLICE_BYTES", 100)
    assert filter_audit.measure(text) == whole == (20000, 4, 5000, len(text), 5000)
