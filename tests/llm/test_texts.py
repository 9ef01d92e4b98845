"""Operators that look at one text at a time, against brute force."""

import base64
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from careerlake.llm import automaton, bpe, licenses, media, rules, secrets, token_counts, webp

TEXT = st.lists(st.sampled_from([*"abcdeAKIAZ09 \n\t\r=:'\"_-.é数🙂\xa0{}#", "password", "token", "AKIA", "abcdef0123", "<|endoftext|>"]), max_size=120).map("".join)


@pytest.fixture(scope="module")
def tik():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def by_row(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# ------------------------------------------------------------ media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_media_round_trip(data):
    payload = media.padded(data)
    width, height, pixels = webp.decode(webp.encode(payload))
    samples = (pixels >> np.uint32(8)).astype(np.uint8)
    assert samples[: len(payload)].tobytes() == payload and width * height == len(samples)


def test_media_of_several_pictures(spark):
    draw = random.Random(4)
    texts = ["", "a", "é" * 32, "b" * 63, "c" * 64, "d" * 65, "x" * 1000, " ".join(draw.choice(["cat", "Zürich", "1"]) for _ in range(900))]
    for text in texts:
        payload = media.padded(text.encode())
        for most in (64, 128, 640):
            one, many = media.described(media.pictures(payload), len(payload)), media.described(media.pictures(payload, most), len(payload))
            assert len(list(media.files(media.pictures(payload, most)))) == -(-len(payload) // most)
            assert one[2:4] == many[2:4] == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) and one[6].split(" ", 1)[1] == many[6].split(" ", 1)[1]
    with pytest.raises(ValueError):
        media.described(media.pictures(media.padded(b"a" * 100), 64)[:-2], 128)
    with pytest.raises(ValueError):
        media.described(media.pictures(media.padded(b"a")), 128)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    digests = [by_row(media.read_media(media.store_media(docs, **kw)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") for kw in ({}, {"most": 64})]
    assert digests[0] == digests[1]


def test_media_rows(odd, odd_rows):
    got = by_row(media.read_media(media.store_media(odd.select("doc_id", "text"))), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for r in odd_rows:
        data = (r[1] or "").encode()
        p = data + bytes(-len(data) % 64 if data else 64)
        want.append((r[0], len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=repr)


# ------------------------------------------------------------ rules


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(TEXT, st.lists(st.sampled_from(["a", "b", "c d", "\n"]), max_size=80).map(" ".join)), min_size=1, max_size=5))
def test_rule_numbers(texts):
    assert [r[:5] for r in rules.text_stats(texts)] == [plain_stats(t) for t in texts]


def test_rule_rows(odd, odd_rows, none):
    got = by_row(rules.quality_rules(odd), "doc_id", *rules.STATS[:5], "base_failed")
    want = []
    for r in odd_rows:
        n = plain_stats(r[1] or "")
        want.append((r[0], *n, n[0] < 20 or 100 * n[4] > 30 * n[0]))
    assert got == sorted(want, key=repr)
    assert rules.quality_rules(none).count() == 0
    assert not any(r["kept"] and r["base_failed"] for r in rules.quality_rules(odd).collect())


def plain_em(votes, rounds):
    """votes: a list of (votes of each rule: None, False against, True for)."""
    k = len(votes[0])
    pi, good, bad = 0.9, [0.05] * k, [0.5] * k
    for _ in range(rounds):
        post = []
        for v in votes:
            g, b = pi, 1 - pi
            for x, p, q in zip(v, good, bad):
                if x is not None:
                    g, b = g * (1 - p if x else p), b * (1 - q if x else q)
            post.append(g / (g + b))
        pi = (sum(post) + 9) / (len(votes) + 10)
        good = [(sum(p for v, p in zip(votes, post) if v[j] is False) + 1) / (sum(p for v, p in zip(votes, post) if v[j] is not None) + 20) for j in range(k)]
        bad = [(sum(1 - p for v, p in zip(votes, post) if v[j] is False) + 2) / (sum(1 - p for v, p in zip(votes, post) if v[j] is not None) + 4) for j in range(k)]
    return pi, good, bad


def drawn(r, n, share, good, bad, abstain=0.2):
    out = []
    for _ in range(n):
        is_good = r.random() < share
        out.append((is_good, [None if r.random() < abstain else r.random() >= (g if is_good else b) for g, b in zip(good, bad)]))
    return out


def coded(votes):
    counts = {}
    for v in votes:
        code = sum((0 if x is None else 2 if x else 1) * 3**j for j, x in enumerate(v))
        counts[code] = counts.get(code, 0) + 1
    return counts


def test_em_is_brute_force():
    votes = [v for _, v in drawn(random.Random(1), 300, 0.7, [0.1, 0.2, 0.05, 0.3], [0.8, 0.6, 0.7, 0.5])]
    for rounds in (1, 2, 7, 30):
        model, want = rules.estimate(coded(votes), 4, rounds=rounds, close=0), plain_em(votes, rounds)
        assert np.allclose(model.share, want[0]) and np.allclose(model.good, want[1]) and np.allclose(model.bad, want[2])


def test_em_recovers_accuracies_and_beats_all_must_pass():
    good, bad = [0.02, 0.1, 0.05, 0.2, 0.15, 0.01], [0.7, 0.8, 0.6, 0.5, 0.9, 0.4]
    texts = drawn(random.Random(2), 40_000, 0.85, good, bad)
    model = rules.estimate(coded(v for _, v in texts), 6)
    assert abs(model.share - 0.85) < 0.02 and np.abs(model.good - good).max() < 0.02 and np.abs(model.bad - bad).max() < 0.05
    codes = np.array([next(iter(coded([v]))) for _, v in texts])
    kept, truth, pass_all = rules.believed(model, codes) >= 0.5, np.array([g for g, _ in texts]), np.array([False not in v for _, v in texts])
    assert (kept == truth).mean() > 0.95 > (pass_all == truth).mean() + 0.1
    assert (kept & ~pass_all).any()
    # a rule that mostly votes against good texts too counts for nothing, and many abstentions leave the prior
    assert rules.believed(model, np.array([0]))[0] == pytest.approx(model.share)


def test_estimate_of_nothing_is_the_prior():
    model = rules.estimate({})
    assert model.share == 0.9 and set(model.good) == {0.05} and set(model.bad) == {0.5}


def test_verdicts_agree_with_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = rules.with_posterior(rules.stats(docs), rules.posteriors(rules.stats(docs, ()))).withColumn("base_failed", rules.base_failed())
    rows = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("NOT base_failed").toPandas()
    votes = rules.votes_of(rows.votes.to_numpy(), len(rules.RULES))[0].sum(1) == 0
    kept, good = rows.posterior.to_numpy() >= 0.5, rows.quality.to_numpy() == 1
    assert (kept == good).mean() >= (votes == good).mean() and (kept & ~votes).any(), ((kept == good).mean(), (votes == good).mean())
    assert kept[good].mean() > 0.99 and kept[~good].mean() < 0.05


# ------------------------------------------------------------ secrets

BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def plain_secrets(text):
    found = [(m.start(), i, m.end()) for i, (p, g, n) in enumerate(BASE.values()) for m in re.finditer(p, text) if len(m[g]) >= n]
    return sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_secret_spans(texts):
    got = [[s for s in found if s[1] < 3] for found in secrets.spans(secrets.scanner(), texts)]
    assert got == [plain_secrets(t) for t in texts]


def test_secret_rows(odd, odd_rows, none):
    got = by_row(secrets.secrets(odd), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = []
    for r in odd_rows:
        found = plain_secrets(r[1] or "")
        said = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in found)
        want.append((r[0], *(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert secrets.secrets(none).count() == 0


def test_long_texts_take_time_in_proportion():
    text = "é password: hunter2hunter2 数 " * 36_000
    began = time.process_time()
    found = secrets.spans(secrets.scanner(), [text])[0]
    assert time.process_time() - began < 6 and len(found) == 36_000 and text[found[-1][0] : found[-1][2]] == "password: hunter2hunter2"
    run = "x" + "ab12" * 1_000_000
    assert secrets.spans(secrets.scanner(), [run, *["y"] * 40]) == [[(1, 2, 4_000_001)], *[[]] * 40]
    assert len(automaton.scan(secrets.scanner().forward, [run.encode()], secrets.scanner().steady)[0]) == 1


def test_redacted_texts_hold_no_secret(spark, odd, sf):
    out = secrets.redact_secrets(spark, odd, sf)
    assert out.columns == odd.columns and out.count() == odd.count()
    again = secrets.secrets(out).selectExpr("sum(n_assign + n_access + n_hex) AS n").first()["n"]
    assert again == 0 and out.filter("text IS NULL").count() == odd.filter("text IS NULL").count()


# ------------------------------------------------------------ licenses


def plain_license(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spots, base, more, share = [], set(), set(), 0.0
    for p, label in licenses.PHRASES.items():
        p = p.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        spots += at
        base |= {label} if at else set()
    for label, t in licenses.TEMPLATES.items():
        width, t = math.ceil(licenses.WIDE * len(t.split())), set(t.split())
        for i in range(len(words)):
            n = len(t & set(words[i : i + width]))
            if n >= licenses.THRESHOLD * len(t) - 1e-9:
                more.add(label)
                share = max(share, n / len(t))
    return len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if spots else share


def test_license_rows(spark, odd_rows, none):
    r = random.Random(2)
    rows = [(x[0], x[1]) for x in odd_rows]
    for k in range(60):
        t = r.choice(list(licenses.TEMPLATES.values())).split()
        kept = [w for w in t if r.random() < 0.9]
        r.shuffle(kept)
        wrapped = "; ".join(kept) if k % 2 else "".join(w + r.choice([" ", " ", " ", ",\n", "\n\n * "]) for w in kept)
        before = r.choices(["mit", "license", "cc", "by", "apache", "x", "the", "software", "rights", "released"], k=r.choice([12, 300]))
        rows.append((1000 + k, " ".join(before) + r.choice(["\n", " "]) + wrapped + " " + " ".join(r.choices(["under", "gnu", "x"], k=20))))
    got = by_row(licenses.license_blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got == sorted(((i, *plain_license(t or "")) for i, t in rows), key=repr)
    assert licenses.license_blocks(none).count() == 0
    clash = spark.createDataFrame([(*x, "row", 1, "found") for x in rows], "doc_id long, text string, row string, block int, found string")
    assert by_row(licenses.license_blocks(clash), "doc_id", "labels") == sorted(((i, plain_license(t or "")[5]) for i, t in rows), key=repr)


def test_wrapped_notices_are_found(spark):
    mit = """Copyright (c) 1999 Somebody

    Permission is hereby granted, free of charge, to any person obtaining a copy
    of this software and associated documentation files (the "Software"), to deal
    in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
    copies of the Software, and to permit persons to whom the Software is
    furnished to do so, subject to the following conditions:"""
    bsd = "* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are\n * met:"
    docs = spark.createDataFrame([(1, "A text before.\n" + mit), (2, "x " * 500 + "\n" + bsd + "\nmore"), (3, mit.replace("\n", "\n" + "other words between " * 30 + "\n"))], "doc_id long, text string")
    assert by_row(licenses.license_blocks(docs), "doc_id", "labels") == [(1, "mit-notice"), (2, "bsd-notice"), (3, "")]


def test_blocks_begin_and_end_within_lines(spark):
    mit, reserved = licenses.TEMPLATES["mit-notice"].split(), "All rights reserved. No part may be\nreproduced without written permission."
    late = " ".join(f"w{i}" for i in range(200)) + " " + " ".join(mit[:30]) + "\n" + " ".join(mit[30:])
    docs = spark.createDataFrame([(1, reserved), (2, late), (3, late + " and more words\n\n" + reserved), (4, "the software is free " * 300)], "doc_id long, text string")
    assert by_row(licenses.license_blocks(docs), "doc_id", "labels", "score") == [(1, "reserved", 1.0), (2, "mit-notice", 1.0), (3, "mit-notice,reserved", 1.0), (4, "", 0.0)]


def test_many_places_take_time_in_proportion(spark):
    docs = spark.createDataFrame([(1, "x mit license " * 200_000), (2, "gnu general public license, cc by")], "doc_id long, text string")
    began = time.time()
    assert by_row(licenses.license_blocks(docs), "doc_id", "n_base", "first_word", "last_word") == [(1, 200_000, 1, 599_998), (2, 2, 0, 4)]
    assert time.time() - began < 30


# ------------------------------------------------------------ byte-level BPE


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_ids_are_the_librarys(tik, texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_all(texts)] == [tik.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (64, 16), (7, 3)])
def test_chunks_resynchronise(spark, tik, odd_rows, chunk, overlap):
    r = random.Random(chunk)
    rows = [(x[0], x[1] if chunk > 1000 else (x[1] or "")[:400]) for x in odd_rows] + [(500 + k, "".join(r.choices(["a", "bc", " ", "  ", "\n", "\t", "'s", "12", "é", "🙂", " ", "."], k=200))) for k in range(30)]
    got = by_row(bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk, overlap=overlap), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in rows:
        ids = tik.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_clashing_columns_are_not_read(spark, odd):
    clash = odd.selectExpr("doc_id", "text", "1 AS row", "2 AS chunk", "'x' AS part", "'y' AS ids", "3 AS n")
    assert by_row(bpe.encode_documents(clash, with_ids=False), *(names := ("doc_id", "n_tokens", "ids_sha256"))) == by_row(bpe.encode_documents(odd), *names)


# ------------------------------------------------------------ token counts


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_counts_are_the_librarys(library, texts):
    assert token_counts.counter().all(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_rows(odd, odd_rows, none, library):
    got = by_row(token_counts.token_counts(odd), "doc_id", "n_bytes", "n_tokens", "over_limit")
    counts = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows]
    assert got == sorted(((r[0], len((r[1] or "").encode()), n, n > 1024) for r, n in zip(odd_rows, counts)), key=repr)
    assert token_counts.token_counts(none).count() == 0


def test_empty_table(none):
    assert media.read_media(media.store_media(none.select("doc_id", "text"))).count() == 0
    assert bpe.encode_documents(none).count() == 0
