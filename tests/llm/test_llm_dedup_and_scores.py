import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldspark.llm import exactdup, licenses, neardup, quality, secrets, toxicity
from fieldspark.llm.components import connected_components
from fieldspark.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_exact(texts, largest=True):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    out = {}
    for t, ids in groups.items():
        keep = max(ids) if largest else min(ids)
        for i in ids:
            out[i] = (keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())
    return out


@pytest.mark.parametrize("collide", [False, True])
def test_exact_groups(llm, collide):
    texts = ["a", "b", "a", None, "", "c", "A", "a ", "é", "x" * 50000, "x" * 50000] + ["hot"] * 40
    how = {"content_hash": lambda c: F.lit(1), "second_hash": lambda c: F.length(c)} if collide else {}
    for keep in ("largest", "smallest"):
        got = exactdup.exact_groups(documents(llm, texts).withColumnRenamed("source", "keep_id"), keep=keep, **how).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_exact(texts, keep == "largest")
    best = exactdup.distinct_documents(documents(llm, texts)).collect()
    assert sorted(r["doc_id"] for r in best) == sorted({v[0] for v in brute_exact(texts).values()})


def test_exact_groups_edges(llm):
    assert exactdup.exact_groups(documents(llm, [])).count() == 0
    assert exactdup.distinct_documents(documents(llm, [])).count() == 0
    df = llm.createDataFrame([(None, "a"), (1, "a"), (None, "b"), (2, "c"), (2, "c"), (2, "d")], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exactdup.exact_groups(df).collect())
    assert rows == [("1", "1", 2, True), ("2", "2", 1, True), ("2", "2", 2, True), ("2", "2", 2, True), ("None", "1", 2, False), ("None", "None", 1, True)]
    assert sorted(str(r["doc_id"]) for r in exactdup.distinct_documents(df).collect()) == ["1", "2", "2", "None"]
    with pytest.raises(ValueError):
        exactdup.exact_groups(df, keep="other")
    with pytest.raises(ValueError):
        exactdup.exact_groups(df.drop("text"))


def shingle_set(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if len(w) >= words else {tuple(w)}


def brute_near(texts, words, percent=80):
    sets = [shingle_set(t, words) for t in texts]
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}


def near_texts(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "one  two", "one two three", "É one", "a\x0bb\x1cc"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 120))]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append((" " if rng.random() < 0.8 else "\n").join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    # Chains: every step changes one word more.
    chain = [word() for _ in range(90)]
    for i in range(14):
        chain[i * 6] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(passage + [word() for _ in range(rng.randint(20, 80))]) for _ in range(25)]
    order = list(texts)
    rng.shuffle(order)
    return order


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_brute_force(llm, words):
    texts = near_texts(words)
    got = neardup.near_duplicates(documents(llm, texts).withColumnRenamed("lang", "id"), neardup.NearDuplicates(words=words)).collect()
    want = brute_near(texts, words)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
    assert 0 < sum(not v[2] for v in want.values()) < len(texts) - 30


def test_near_duplicates_without_leader_rounds(llm):
    texts = near_texts(7)
    got = neardup.near_duplicates(documents(llm, texts), neardup.NearDuplicates(words=4, leader_rounds=0)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_near(texts, 4)


def test_near_duplicates_edges(llm):
    assert neardup.near_duplicates(documents(llm, [])).count() == 0
    df = llm.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, None)], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert rows == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]


def test_components(llm):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    comp = {}

    def root(i):
        comp.setdefault(i, i)
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    got = {r["id"]: r["component"] for r in connected_components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in comp}
    assert connected_components(llm.createDataFrame([], "a long, b long")).count() == 0


def test_near_rows_of_one_id_and_equal_set_size_all_link(llm):
    lines = [" ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"]
    rows = [(1, x) for x in lines] + [(10 + i, x + " end") for i, x in enumerate(lines)] + [(99, "nothing like the others at all")]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, neardup.NearDuplicates(words=4, percent=80)).collect()
    assert len(got) == 13 and {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (99, 99), *((10 + i, 1) for i in range(6))}


def plain_base(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    return sorted(out)


def secret_texts():
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))
    texts = [None, "", "secret=token:abcdefghijk", "token==abcdefgh", "PASSWORD : 'abc", "Api_Key='12345678'", "é password=é12345678 apikey:\"abcdefgh\"", "ſecret=abcdefgh1", "AKIA", "AKIAAKIA" + "A" * 9, hexes(31), hexes(32) + "g", "x" + hexes(64), "token = " + hexes(40)]
    for _ in range(150):
        texts.append(f"some words here password={hexes(18)} then {key()} and token = \"{hexes(40)}\" more words")
    texts += [f"a bare one {hexes(18)} stands here" for _ in range(20)] + [f"plain-words-in-a-row number{i} of the_long_identifier_{i}" for i in range(30)]
    rng2 = random.Random(1)
    texts += ["".join(rng2.choice(["token", "secret", "=", ":", " ", "'", '"', "AKIA", "abc123", "deadbeef" * 2, "\n", "Z"]) for _ in range(20)) for _ in range(300)]
    return texts


def test_secret_spans(llm):
    texts = secret_texts()
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(documents(llm, texts)).collect()}
    inferred = 0
    for i, t in enumerate(texts):
        base = [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in got[i] if not s["inferred"]]
        assert base == plain_base(t or ""), repr(t)
        extra = [s for s in got[i] if s["inferred"]]
        inferred += t is not None and t.startswith("a bare") and len(extra) == 1
        assert not extra or not t.startswith("plain")
        assert all(s["end"] <= a or s["start"] >= e for s in extra for a, _, e in base)
    assert inferred >= 15
    clean = secrets.redacted(documents(llm, texts)).collect()
    assert len(clean) == len(texts) and not any(plain_base(r["text"] or "") for r in clean if "some words here" in (r["text"] or ""))
    assert all(r["n_chars"] == len(r["text"] or "") for r in clean)
    assert secrets.secret_spans(documents(llm, [])).count() == 0


def test_every_string_of_the_labelled_alphabet_is_a_candidate():
    text = "hunter2x letmeinnow 1234567890 short7c (ab.cd.efgh=) " + "f" * 32 + "Zq8.rest-of-it"
    whole = [text[s:e] for steps in secrets.candidates(text, secrets.base_spans(text)) for s, e in steps[0]]
    assert whole == ["hunter2x", "letmeinnow", "1234567890", "ab.cd.efgh=", "Zq8.rest-of-it"]
    assert [[text[s:e] for s, e in step] for step in secrets.candidates(text, [])[3]] == [["ab.cd.efgh="], ["ab.cd.efgh"]]
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["a1b2c3d4", "AKIA" + "A" * 12, "0f" * 16, ".", "=", " ", "secret=", "xyz"]) for _ in range(12))
        base = secrets.base_spans(t)
        free = "".join(" " if any(s <= i < e for s, _, e, _ in base) else c for i, c in enumerate(t))
        want = [m.span() for m in re.finditer("[A-Za-z0-9+/_.=-]+", free) if len(m[0]) >= 8]
        assert [steps[0][0] for steps in secrets.candidates(t, base)] == want


def test_short_and_dotted_secrets_are_inferred(llm):
    rng = random.Random(12)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    short = lambda: some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1) + some("0123456789", 9)
    words = [some("abcdefghijklmnopqrstuvwxyz", rng.randint(2, 12)) for _ in range(300)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(40))
    texts = [f"{prose()} password={short()} {prose()}" for _ in range(200)] + [f"{prose()} {short()} {prose()}" for _ in range(30)] + [f"{prose()}." for _ in range(100)]
    got = {r["doc_id"]: [s for s in r["spans"] if s["inferred"]] for r in secrets.secret_spans(documents(llm, texts)).collect()}
    assert sum(len(got[i]) == 1 and texts[i][got[i][0]["start"] : got[i][0]["end"]][1:].isdigit() for i in range(200, 230)) >= 27
    assert not any(got[i] for i in range(230, 330))
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(documents(llm, texts)).collect()}
    assert all(("[SECRET]" in clean[i]) == bool(got[i]) for i in range(200, 330))


def test_background_counts_all_candidates(llm):
    texts = secret_texts()
    want = {}
    for t in texts:
        for steps in secrets.candidates(t or "", secrets.base_spans(t or "")):
            for s, e in (x for step in steps for x in step):
                line = "^" + "".join(map(secrets.symbol, t[s:e])) + "$"
                for i in range(1, len(line)):
                    gram = line[max(0, i - 4) : i + 1]
                    want[gram] = want.get(gram, 0) + 1
    found = secrets.found_strings(documents(llm, texts).repartition(5)).filter("kind = -1").groupBy("value").agg(F.sum("n").alias("n"))
    assert {r["value"]: r["n"] for r in found.collect()} == want
    model = secrets.counted(want)
    assert all(abs(sum(np.exp(p) for p, _ in steps.values()) + np.exp(end) - 1) < 0.6 for end, steps in zip(model.ends, model.steps))


def test_formats_of_one_class_keep_their_length():
    rng = random.Random(5)
    a = secrets.inferred(["".join(rng.choice("0123456789") for _ in range(20)) for _ in range(300)])
    assert a.log_likelihood("1" * 20) > a.log_likelihood("1" * 19) + 0.1 and a.log_likelihood("1" * 20) > a.log_likelihood("1" * 30) + 0.1


def test_automaton_merges_states_and_tells_formats_apart():
    rng = random.Random(2)
    some = ["".join(rng.choice("0123456789") for _ in range(rng.randint(8, 20))) for _ in range(300)]
    a = secrets.inferred(some)
    assert len(a.ends) < 60
    total = sum(np.exp(p) for p, _ in a.steps[0].values()) + np.exp(a.ends[0])
    assert total <= 1 + 1e-9
    assert a.log_likelihood("123456789012") > a.log_likelihood("abcdefghijkl") + 1
    assert secrets.inferred([]).log_likelihood("a") < 0


def labelled(n, seed):
    """Documents with junk (quality 0) and insults (toxic 1)."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts, rows = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(rng.choice([2, 8])):
                w.insert(rng.randrange(len(w)), rng.choice(["blarg", "snoof", "grund"]))
        if bad:
            w = [x + "!!" for x in w] if rng.random() < 0.5 else [x for x in w[:10] for _ in range(6)]
        texts.append(" ".join(w))
        rows.append((i, int(not bad), int(toxic)))
    return texts, rows


def test_quality(llm):
    texts, rows = labelled(900, 1)
    texts += [None, "", "\n"]
    labels = llm.createDataFrame(rows + [(5000, 1, 0), (None, 0, 0), (3, None, None), (4, 7, 7)], "doc_id long, quality int, toxic int")
    docs = documents(llm, texts)
    model = quality.fit_quality(docs, labels)
    got = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == q for i, q, _ in held]) > 0.95
    assert got[900] == got[901]
    # Labels of held-out rows change nothing; nor does the order of rows.
    other = llm.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in reversed(rows)], labels.schema)
    assert {r["doc_id"]: r["score"] for r in quality.fit_quality(docs.repartition(7), other).score(docs).collect()} == got
    assert model.network.temperature > 0


def test_temperature_calibrates_noisy_labels():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 20)).astype(np.float32)
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.fit_network(x[:1000], y[:1000], quality.QualitySpec(epochs=60))
    fresh, label = x[1000:], y[1000:]
    loss = lambda p: -np.mean(np.log(np.where(label == 1, p, 1 - p)))
    calibrated = net.probabilities(fresh)
    assert net.temperature > 1.2 and loss(calibrated) < loss(1 / (1 + np.exp(-net.logits(fresh))))
    assert abs(calibrated.mean() - label.mean()) < 0.05
    assert set(net.probabilities(fresh)[:0]) == set() and quality.fit_network(x[:0], y[:0], quality.QualitySpec()).probabilities(fresh)[0] == 0.5


def test_quality_without_labels_or_rows(llm):
    none = llm.createDataFrame([], "doc_id long, quality int")
    docs = documents(llm, ["a b", None])
    assert [r["score"] for r in quality.fit_quality(docs, none).score(docs).collect()] == [0.5, 0.5]
    empty = documents(llm, [])
    assert quality.fit_quality(empty, none).score(empty).count() == 0
    one = llm.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.fit_quality(docs, one).score(docs).collect()} <= {0.5, 1.0}


def test_context_sums_equal_a_loop(llm):
    spec = quality.QualitySpec(buckets=256, sign_buckets=32, dimensions=8, slices=4)
    texts = ["a b c d e", None, "x ! ! y", "", "one"]
    got = quality.context_sums(documents(llm, texts).repartition(3), spec)
    places, signs = quality.index_vectors(spec)
    want = np.zeros((spec.buckets, spec.dimensions))
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        b, _ = quality.bucketed(data, np.array([0, len(data)]), spec)
        for i in range(len(b)):
            for j in range(max(0, i - 2), min(len(b), i + 3)):
                if i != j:
                    np.add.at(want[b[i]], places[:, b[j]], signs[:, b[j]])
    assert (got == want).all()


def test_toxicity(llm):
    texts, rows = labelled(1200, 3)
    docs = documents(llm, texts + [None, ""])
    labels = llm.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in model.score(docs).collect()}
    held = [(got[i], t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([g["toxic"] == t for g, t in held]) > 0.95
    severity = {g: np.mean([x["expected_severity"] for x, _ in held if x["severity"] == g]) for g in {x["severity"] for x, _ in held}}
    assert sorted(severity) == [0, 1, 2] and severity[0] < severity[1] < severity[2]
    assert got[1200]["toxic"] == got[1201]["toxic"] == 0 and model.thresholds[0] < model.thresholds[1]
    none = labels.filter("false")
    assert {r["toxic"] for r in toxicity.fit_toxicity(docs, none).score(docs).collect()} == {0}
    assert toxicity.fit_toxicity(documents(llm, []), none).score(documents(llm, [])).count() == 0


def test_toxicity_is_fitted_on_ten_thousand_rows():
    assert toxicity.ToxicitySpec().training_rows == 10_000


def test_licences(llm):
    mit = "The MIT License. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [None, "", "no licence", "x.\nLicensed under CC BY-NC 4.0.", "Released under the MIT License.\nReleased under the MIT License.", mit, mit.replace("License. ", "License. All rights reserved! "), "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0."]
    got = {r["doc_id"]: (r["licenses"], r["sentences"]) for r in licenses.license_scan(documents(llm, texts)).collect()}
    assert got[0] == got[1] == got[2] == ("", "")
    assert got[3] == ("CC-BY-NC-4.0", "by-nc-line") and got[4] == ("MIT", "mit-line,mit-line")
    assert got[5] == ("MIT", "mit-title,mit-notice") and got[6] == ("Proprietary", "mit-title,reserved,mit-notice")
    assert got[7] == ("Apache-2.0,GPL-3.0", "gpl3-line,apache-line")
    assert licenses.license_scan(documents(llm, [])).count() == 0


def brute_licences(text):
    """Sentences in text order, by trying every run of lines and of parts between closing signs, longest first."""
    blocks, now = [], []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        words = line.lower().split()
        if not re.search("[a-z0-9]", line.lower()):
            now = blocks.append(now) or []
            continue
        part = []
        for word in words:
            part.append(word)
            if word[-1] in ".!?;" and not (word == "v." and text.lower().split()[text.lower().split().index("v.") + 1][0].isdigit()):
                now.append(" ".join(part))
                part = []
                if set(word) & set(".!?") & set(word[len(word.rstrip(".!?;")) :]):
                    now = blocks.append(now) or []
        if part:
            now.append(" ".join(part))
    out = []
    for block in [*blocks, now]:
        i = 0
        while i < len(block):
            for j in range(len(block), i, -1):
                said = " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in " ".join(block[i:j])).split())
                name = next((n for n, s in licenses.SENTENCES.items() if s == said), None)
                if name:
                    out.append(name)
                    i = j - 1
                    break
            i += 1
    return ",".join(out)


GPL_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
MIT_TEXT = 'The MIT License\n\nCopyright 2020 A. Body\n\nPermission is hereby granted.\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS".'
BSD_TEXT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Keep this."
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."
APACHE_HEADER = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/'


def test_wrapped_licences_equal_brute_force(llm):
    heads = {"GPL-3.0": GPL_HEADER, "MIT": MIT_TEXT, "BSD-3-Clause": BSD_TEXT, "MPL-2.0": MPL_NOTICE, "Apache-2.0": APACHE_HEADER}
    texts, want = [], []
    for name, head in heads.items():
        for width in (24, 60, 72, 500):
            for sign, end in (("", "\n"), (" * ", "\n"), ("# ", "\r\n")):
                lines = [x for part in head.split("\n\n") for x in [*textwrap.wrap(part, width), ""]]
                texts.append("A title" + end + end.join(sign + x for x in lines) + "code()")
                want.append(name)
    # A line that is a known sentence by itself counts although it begins a longer one.
    texts += ['Licensed under the Apache License, Version 2.0\n(the "License").', "Licensed under the Apache License,\n\nVersion 2.0", "Released under. The\nMIT License", "HS\nReleased under\nthe MIT License\nHS"]
    want += ["Apache-2.0", "", "", "MIT"]
    got = {r["doc_id"]: (r["licenses"], r["sentences"]) for r in licenses.license_scan(documents(llm, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (want[i], brute_licences(t)), repr(t)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(llm, sf, name):
    assert compare(QUERIES[name](llm, sf), connect(sf), SQL[name]) is None


def test_secret_query_on_the_given_table(llm):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_secret_scan"](llm, sf).collect()
    assert len(rows) == len(texts) and sum(r["n_assign"] for r in rows) > 0
    for r in rows:
        base = plain_base(texts[r["doc_id"]] or "")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        line = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_near_query_on_the_given_table(llm, sf):
    texts = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(texts) == list(range(len(texts)))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_minhash_near_dedup"](llm, sf).collect()}
    assert got == brute_near([texts[i] for i in range(len(texts))], 4)


def test_pipeline(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(llm, kept, sf).cache()
        assert kept.columns == columns
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[4] == counts[3]
    rows = kept.select("doc_id", "text").collect()
    want = brute_near([r["text"] for r in rows], 5)
    assert all(v[2] for v in want.values()) and len({r["text"] for r in rows}) == len(rows)
    assert not any(plain_base(r["text"]) for r in rows)
    packed = corpus_pipeline.run(llm, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows}
