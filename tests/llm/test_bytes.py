"""Ogg media, BPE, token counts, licenses and WARC: round trips and brute force."""

import base64
import hashlib
import random
import re
import zlib

import pytest
import zstandard

from ravelin.llm import bpe, licenses, ogg, token_counts, warc

TEXTS = [None, "", " ", "  a  b \n c", "Hello, wörld's 123 tests!\n\n", "a" * 5000, "абв 漢字 🙂" * 50, "x\0y", "word " * 3000, "it's we'll I'd ---- ==== 1234567 \t\t tab"]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    own = spark.createDataFrame(list(enumerate(TEXTS)) + [(1, "")], "doc_id long, text string")
    return own.withColumn("ids", own.doc_id).withColumn("n_bytes", own.text)  # clashing names


def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_ogg_query(spark, sf_dir):
    rows = {r.doc_id: r for r in ogg.op1_ogg(spark, sf_dir).collect()}
    for key, text in docs(spark, sf_dir):
        raw = text.encode()
        padded = raw + b"\0" * (-len(raw) % 64)
        r = rows[key]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(ogg.write(padded)).hexdigest()


def test_ogg_edges(spark, texts):
    rows = ogg.store_and_read(texts).collect()
    assert len(rows) == len(TEXTS) + 1
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (0, 1)}) == 1
    assert all(r.payload_bytes % 64 == 0 and r.payload_bytes > 0 for r in rows)
    assert ogg.store_and_read(texts.where("false")).count() == 0
    packets = ogg.read_column(ogg.write_column(texts)).where("doc_id = 5").orderBy("start_s", "serial").collect()
    assert [round(p.start_s * ogg.RATE) for p in packets] == [0, 0] and sum(len(p.samples) for p in packets) == 5056
    broken = spark.createDataFrame([(1, None), (2, b"no media")], "doc_id long, media binary")
    assert ogg.read_column(broken).count() == 0


@pytest.mark.parametrize("size", [64, 4096, 65536, 1 << 20])
@pytest.mark.parametrize("packet", [255, 510, 4096, 65535])
def test_ogg_round_trip(size, packet):
    payload = random.Random(size).randbytes(size)
    held = ogg.read(ogg.write(payload, packet_samples=packet))
    assert ogg.samples(held) == payload and not held.bad_pages
    for s in held.streams.values():
        at = 0
        for p, g in zip(s.packets[2:], s.granules[2:]):
            at += len(p)
            assert g == at
        assert s.ended and not s.lost


def test_ogg_checksum_by_definition_and_damage():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
        return crc

    data = random.Random(1).randbytes(500)
    assert ogg.checksum(data) == slow(data)
    media = bytearray(ogg.write(random.Random(2).randbytes(40_000)))
    media[-100] ^= 1
    held = ogg.read(bytes(media))
    assert held.bad_pages >= 1


def test_damaged_media_keep_what_is_left_in_place():
    payload = random.Random(3).randbytes(40 * 4096)
    media = ogg.write(payload)
    at = [m.start() for m in re.finditer(b"OggS", media)][4] + 400  # in the body of a data page
    held = ogg.read(media[:at] + bytes((media[at] ^ 1,)) + media[at + 1 :])
    back, missing = ogg.assemble(held)
    assert held.bad_pages == 1 and sum(s.lost for s in held.streams.values()) >= 1 and 0 < missing < len(payload) // 2
    kept = [i for i in range(0, len(back), 4096) if back[i : i + 4096] == payload[i : i + 4096]]
    assert len(kept) * 4096 == len(payload) - missing
    assert all(not any(back[i : i + 4096]) for i in range(0, len(back), 4096) if i not in kept)


def test_license_rules_take_linear_time():
    import time

    s = licenses.Scanner(licenses.RULES)
    for text in ("copyright" + " " * 10**6 + "x", "eclipse public license" + " " * 10**6, "license:" + " " * 10**6, "spdx-license-identifier: " + "a" * 10**6, "joinup.ec.europa.eu/" * 20_000 + "eupl",
                 "licensed " + "a" * 10**6, "neither the name of " * 50_000 + "nor the names of", "spdx-license-identifier: " + "a or " * 200_000, "copyright 2020" + ", 2020" * 200_000, "mit\n\n" * 300_000):
        began = time.perf_counter()
        s.detect(text)
        assert time.perf_counter() - began < 5
    assert [d.label for d in s.detect("mit license apache license")] == ["mit", "apache"]


def reference(vocabulary):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(vocabulary)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken(spark, sf_dir, texts):
    own = reference(bpe.VOCABULARY)
    rows = {r.doc_id: r for r in bpe.op3_bpe(spark, sf_dir).collect()}
    for key, text in docs(spark, sf_dir):
        ids = own.encode_ordinary(text)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (rows[key].n_tokens, rows[key].ids_sha256, rows[key].decoded_sha256) == want
    for r in bpe.encode(texts).collect():
        assert r.ids == own.encode_ordinary(TEXTS[r.doc_id] or "") and bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode()
    assert bpe.encode(texts.where("false")).count() == 0


def test_bpe_on_random_and_very_long_pretokens():
    import public_tokenizers

    own, rng = reference(bpe.VOCABULARY), random.Random(3)
    encoder = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    xs = ["".join(rng.choice("abcdet singé漢 \n'=") for _ in range(rng.choice([0, 1, 5, 50, 400]))) for _ in range(400)]
    xs += ["a" * 20_000, "abcing" * 5_000, "=" * 3_000]
    assert encoder.encode(xs) == [own.encode_ordinary(x) for x in xs]


def test_rank_queue():
    q = bpe.RankQueue()
    for rank, at in ((300, 5), (7, 9), (300, 2), (65535, 1)):
        q.push(rank, [at])
    assert [q.pop() for _ in range(3)] == [(7, [9]), (300, [2, 5]), (65535, [1])] and not q.top


def bpe_encoder():
    import public_tokenizers

    path = public_tokenizers.path(bpe.VOCABULARY)
    return bpe.Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, public_tokenizers.PATTERN)


def test_bpe_asks_the_queue_once_for_a_pretoken(monkeypatch):
    own, asked = bpe_encoder(), []
    merge = bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda pieces, merges: asked.extend(pieces) or merge(pieces, merges))
    for text in ("x ndthonti", "x ndthonti, x", "x\nx ndthonti.\nx", "x ndthonti  x"):  # in parts of several forms, and in a text matched whole
        assert own.encode([text]) == [reference(bpe.VOCABULARY).encode_ordinary(text)]
    assert asked.count(b" ndthonti") == 1


def test_bpe_memory_of_few_entries(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 40)
    monkeypatch.setattr(bpe, "LONG_CHARS", 200)
    monkeypatch.setattr(bpe, "QUEUE_PIECES", 30)
    own, other, rng = bpe_encoder(), reference(bpe.VOCABULARY), random.Random(7)
    words = ["".join(rng.choice("aeinrstßé漢'$,._19") for _ in range(rng.choice([1, 3, 8, 8, 100]))) for _ in range(300)]
    for _ in range(60):
        xs = [rng.choice(["", "\n", "  "]) + " ".join(["often", *rng.choices(words, k=rng.randrange(12))]) for _ in range(8)] + ["", " ", "a"]
        for text, x in zip(xs, own.chunk(xs)):
            ids = other.encode_ordinary(text)
            assert (len(x), x.ids().tolist(), x.decimals(), x.decoded()) == (len(ids), ids, ",".join(map(str, ids)), text.encode())
    assert own.chunk([]) == [] and len(own.of_part) < 40 + 8 * 12 and "often" in own.of_match


def test_bpe_large_buckets():
    own, other, rng = bpe_encoder(), reference(bpe.VOCABULARY), random.Random(11)
    parts = [t.decode() for t in rng.sample(sorted(own.ranks), 3000) if t.isalpha() and t.isascii()]
    xs = ["".join(rng.choices(parts, k=rng.choice([1, 2, 3, 4]))) for _ in range(4000)]  # the same merges, many times in one batch
    xs += [a * n for a in ("an", "tion", "ee", "abab") for n in range(1, 120)]
    assert own.encode(xs) == [other.encode_ordinary(x) for x in xs]
    steps = [t.decode() for t, rank in own.ranks.items() if rank in own.merges.steps_back and t.isalpha() and t.isascii()][:2000]
    for some in (steps[at : at + 4] for at in range(0, len(steps), 20)):  # tokens after which the queue may step back
        xs = ["".join(rng.choices(some, k=rng.choice([2, 3, 5]))) for _ in range(150)]
        assert own.encode(xs) == [other.encode_ordinary(x) for x in xs]


def test_rank_queue_of_arrays():
    import numpy as np

    rng = random.Random(13)
    q, held = bpe.RankQueue(), {}
    for step in range(400):
        if step < 200 or rng.random() < 0.3:
            n, most = rng.choice([1, 30, 300]), rng.choice([5, 600, 60_000])
            ranks, at = [rng.randrange(most) for _ in range(n)], [rng.randrange(10**6) for _ in range(n)]
            if rng.random() < 0.5:
                q.push_all(np.array(ranks, np.int32), np.array(at, np.int32))
            else:
                for x, i in zip(ranks, at):
                    q.push(x, [i])
            for x, i in zip(ranks, at):
                held.setdefault(x, []).append(i)
        else:
            rank, bucket = q.pop()
            assert rank == min(held) and list(bucket) == sorted(held.pop(rank))
    while q:
        rank, bucket = q.pop()
        assert rank == min(held) and list(bucket) == sorted(held.pop(rank))
    assert not held


def test_token_counts_are_the_tokenizers(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.read_pieces(public_tokenizers.path(token_counts.VOCABULARY))
    own = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)
    rows = {r.doc_id: r.n_tokens for r in token_counts.op4_token_counts(spark, sf_dir).collect()}
    assert rows == {k: len(own.encode(t).ids) for k, t in docs(spark, sf_dir)}
    assert all(r.n_tokens == len(own.encode(TEXTS[r.doc_id] or "").ids) for r in token_counts.count_tokens(texts).collect())
    counter, rng = token_counts.Counter(pieces), random.Random(5)
    xs = ["".join(rng.choice("ab e▁thin gé𝄞ü<>0x梦\n") for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(500)]
    assert [n for _, n in counter.count(xs)] == [len(own.encode(x).ids) for x in xs]


def test_ties_keep_the_longest_last_piece():
    c = token_counts.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("<unk>", 0.0)])
    assert c.best("ab") == (1, -2.0)
    assert c.best("aéb")[0] == 4  # the unknown counts its two bytes


def base_by_brute_force(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), found


def test_license_base(spark, sf_dir):
    rows = {r.doc_id: r for r in licenses.op9_licenses(spark, sf_dir).collect()}
    for key, text in docs(spark, sf_dir):
        n, found = base_by_brute_force(text)
        r = rows[key]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), found[0][0] if found else None, found[-1][0] if found else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules(spark):
    assert len(licenses.RULES) >= 300 and len({r.keyword for r in licenses.RULES}) > 60
    s = licenses.Scanner(licenses.RULES)
    found = lambda t: [(d.label) for d in s.detect(t.lower())]
    assert found("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert found("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert found("Licensed under CC BY-NC 4.0.") == ["cc-by-nc"]
    assert found("SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    assert found("the gnu lesser general public license v2.1 or later") == ["lgpl-2.1"]
    assert found("nothing to see, mit freundlichen") == []
    edges = spark.createDataFrame([(1, None), (2, ""), (3, "MIT License " * 2000), (3, "cc by cc by")], "doc_id long, text string")
    rows = licenses.summarise(edges).collect()
    assert sorted((r.doc_id, r.n_base) for r in rows) == [(1, 0), (2, 0), (3, 2), (3, 2000)]
    assert licenses.scan(edges).where("label = 'mit'").count() == 2000


def _instance(tree, rng):
    """A string that a parsed pattern matches, its alternatives drawn at random; assertions give nothing."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "q"
        elif name == "ANY":
            out += "x"
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(value[0]), "CATEGORY": lambda: {"CATEGORY_DIGIT": "1", "CATEGORY_SPACE": " "}.get(str(value), "w"), "NEGATE": lambda: "w"}[str(kind)]()
        elif name == "BRANCH":
            out += _instance(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += _instance(arg[3], rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            for _ in range(rng.randint(arg[0], max(arg[0], min(arg[1], 2)))):
                out += _instance(arg[2], rng)
    return out


def test_what_a_license_rule_matches_holds_a_keyword_of_its_label():
    from re import _parser

    rng = random.Random(4)
    lacking = set()
    for pattern, label in sorted({(r.pattern, r.label) for r in licenses.RULES}):
        tree = _parser.parse(pattern)
        for _ in range(60):
            x = _instance(tree, rng)
            if re.search(pattern, x) and not any(r.label == label and r.keyword in x and re.search(r.pattern, x) for r in licenses.RULES):
                lacking.add((pattern, x))
    assert not lacking
    s = licenses.Scanner(licenses.RULES)
    found = lambda t: [d.label for d in s.detect(t.lower())]
    assert found("Licence: MIT") == ["mit"]
    assert found("(c) 2020 Someone") == found("© 2020 Someone") == found("Copyright (c) 2020 Someone") == ["copyright"]


def test_license_text_may_break_anywhere():
    s = licenses.Scanner(licenses.RULES)
    for text, label in (("gnu general\npublic license, version 3", "gpl-3.0"), ("licensed under the apache\n   license", "apache"), ("gnu general public license,     version 3", "gpl-3.0"), ("mit\t\u00a0license", "mit"), ("copyright     (c)\n 2020", "copyright")):
        for before in ("", "x  y\n\n", " "):
            (d,) = s.detect(before + text + "  z")
            assert d.label == label and (before + text)[d.start : d.end] == text.removeprefix("licensed under the ")


def test_license_bodies():
    s = licenses.Scanner(licenses.RULES)
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
        "ncsa": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any\n purpose with or without fee is hereby granted, provided that the above copyright notice",
        "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
        "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "apache-2.0": "you may not use this file except\n# in compliance".replace("# ", "") + " with the License",
        "gpl-3.0": "under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "lgpl-2.1": "the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "zlib": "In no event will the authors be held liable for any damages arising from\nthe use of this software.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "cc": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms",
    }
    for label, text in texts.items():
        assert [d.label for d in s.detect(text.lower())] == [label]


def test_license_scan_is_that_of_all_rules_without_prefilter(spark, sf_dir):
    s = licenses.Scanner(licenses.RULES)
    rng = random.Random(6)
    words = ["mit", "license", "gnu", "general", "public", "apache", "version", "2.0", "3", "licensed under the", "cc", "by", "cc by-sa 4.0", "spdx-license-identifier:", "gpl-3.0", "or", "bsd", "2-clause", "lesser", "all rights reserved", "copyright 2020", "(c)", "creative commons", "free", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    texts = ["".join(rng.choice(words) + rng.choice((" ", " ", "\n", "  ", ", ")) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    texts += [t.lower() for _, t in docs(spark, sf_dir)[:40]]
    rules = [re.compile(r.pattern) for r in licenses.RULES]
    for text in texts:
        plain = re.sub(r"\s+", " ", text)
        every = sorted((-licenses.RULES[n].priority, m.start() - m.end(), m.start(), n, m.end()) for n, r in enumerate(rules) for m in r.finditer(plain) if m.end() > m.start())
        kept = []
        for priority, _, start, n, end in every:
            if not any((a <= start and end <= b) or (a < end and start < b and p < priority) for p, a, b, _ in kept):
                kept.append((priority, start, end, n))
        want = sorted((a, b, licenses.RULES[n].label) for _, a, b, n in kept)
        assert sorted((d.start, d.end, d.label) for d in s._plain(plain)) == want
        assert sorted((re.sub(r"\s+", " ", text[d.start : d.end]), d.label) for d in s.detect(text)) == sorted((plain[a:b], label) for a, b, label in want)


def test_license_edges(spark):
    own = spark.createDataFrame([(None, "MIT License"), (1, None), (1, None), (2, "")], "doc_id long, text string").selectExpr("*", "1 AS label", "'x' AS labels", "2 AS `a.b`", "3 AS score")
    rows = licenses.summarise(own).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.labels) for r in rows) == [(0, 2, "mit"), (1, 0, ""), (1, 0, ""), (2, 0, "")]
    assert licenses.summarise(own.where("false")).count() == licenses.scan(own.where("false")).count() == 0


def test_warc_archive_round_trip():
    rng = random.Random(8)
    records = [warc.make_record(i, f"http://x/{i}", "<p>" + " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(80)) + f"{i}</p>") for i in range(200)]
    data = warc.write_archive("a", records)
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    assert list(warc.read_archive(data))[1:] == records
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) < plain
    few = warc.write_archive("b", records[:2])
    assert list(warc.read_archive(few))[1:] == records[:2]
    assert warc.page_of(warc.record_id(-5)) == -5 and warc.page_of(warc.record_id(None)) is None
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-3]))


def test_warc_archives_of_few_long_records_have_a_dictionary():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    for n, length in ((35, 17_000), (3, 200_000), (1, 600_000), (4, 2_000)):
        records = [warc.make_record(i, f"http://x/{i}", " ".join(rng.choices(words, k=length))) for i in range(n)]
        data = warc.write_archive("a", records)
        assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
        assert list(warc.read_archive(data))[1:] == records


def test_warc_null_ids_revisit_the_one_row_with_an_id(spark):
    big = "y" * 1000
    pages = spark.createDataFrame([(3, "u", big), (None, "v", big), (None, "w", big), (4, "x", "z" * 1000), (None, "x", "n" * 1000), (None, "x", "n" * 1000)], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages)).collect()), key=str)
    want = [(3, "response", None), (0, "revisit", 3), (0, "revisit", 3), (4, "response", None), (0, "response", None), (0, "response", None)]
    assert got == sorted(want, key=str)


def test_warc_query(spark, sf_dir, duck):
    from compare import same

    assert same(warc.op10_warc(spark, sf_dir), duck, warc.ORACLES["op10_warc"]) > 0


def test_warc_edges(spark):
    big = "é" * 600
    rows = [(1, "u v\r\n", big), (2, None, big), (5, "w", big), (3, "x", "short"), (4, "y", "short"), (None, "z", big), (6, "q", None), (5, "w", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(warc.write_archives(pages)).collect()), key=str)
    want = [(1, "revisit", 5, 1200), (2, "revisit", 5, 1200), (5, "response", None, 1200), (5, "response", None, 1200), (3, "response", None, 5), (4, "response", None, 5), (0, "revisit", 5, 1200), (6, "response", None, 0)]
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0
