"""Keys that hold for any text, and stages that take any column."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldspark.llm import bpe, exactdup, neardup, packing, pretokens, quality, secrets, text, topk, toxicity
from fieldspark.llm.queries import QUERIES
from fieldspark.llm.shared import file_bytes

DEFINITION = file_bytes(public_tokenizers.path("byte_bpe_50k.json"))
RANKS = file_bytes(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def thue_morse(n, a="a", b="b"):
    out = a
    other = b
    while len(out) < n:
        out, other = out + other, other + out
    return out


#: Two words that every sum of letter codes times powers of an odd number modulo 2^64 takes for one.
TWINS = thue_morse(1024), thue_morse(1024, "b", "a")


def long_words(rng):
    """Words whose first 16 bytes, or ends, or lengths agree, and random ones of all lengths."""
    start = "abcdefghijklmnop"
    out = [start + "q", start + "r", start, start[:15], "x" + start, "é" * 8, "é" * 9, "a" * 300, "a" * 301, "b" + "a" * 299, *TWINS]
    out += ["".join(rng.choices("abé", k=rng.randint(1, 40))) for _ in range(300)]
    return list(dict.fromkeys(out))


def test_span_keys_tell_all_spans_apart():
    rng = random.Random(1)
    words = long_words(rng)
    body = " ".join(words + words).encode()
    data = np.frombuffer(body, np.uint8)
    starts, stops = text.spans(data != 32, np.array([0, len(data)]))
    a, b = text.span_keys(data, starts, stops)
    n = len(words)
    for keys in (a, b):
        assert (keys[:n] == keys[n:]).all() and len(set(keys.tolist())) == n


@pytest.mark.parametrize("slots", [8, 1 << 12])
def test_pieces_are_never_taken_for_others(slots):
    rng = random.Random(2)
    tok = Tokenizer.from_str(DEFINITION.decode())
    tok.encode_special_tokens = True
    cache = pretokens.library_cache(DEFINITION)
    small = pretokens.PieceCache(cache.encode_missing, slots=slots, most=2, most_long=5)
    words = long_words(rng)
    for _ in range(3):
        docs = [" ".join(rng.choices(words, k=30)) for _ in range(20)]
        for rows, data, ends in text.chunks(pa.array(docs), 2000):
            ids, bounds, *_ = small.ids_of(data, ends)
            for d, x, y in zip(docs[rows], bounds[:-1], bounds[1:]):
                assert ids[x:y].tolist() == tok.encode(d, add_special_tokens=False).ids
        assert len(small.long) <= 5


def test_twin_words_in_the_queries_operators(llm):
    """The two words alone, in one document, and in documents that differ in them only."""
    same = "".join(f" w{i}" for i in range(30))
    texts = [TWINS[0], TWINS[1], " ".join(TWINS), TWINS[0] + same, TWINS[1] + same, f"{TWINS[1]} {TWINS[0]}"]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tok = Tokenizer.from_str(DEFINITION.decode())
    pieces = packing.token_pieces(docs, DEFINITION, 0, 4096, added_tokens=True).collect()
    for r in pieces:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    ranks = bpe.ranks_of(RANKS)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.bpe_decode(bpe.bpe_encode(docs, RANKS), RANKS).collect():
        assert r["ids"] == plain.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]).decode() == texts[r["doc_id"]]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, neardup.NearDuplicates(words=4)).collect()}
    assert found[0] == 0 and found[1] == 1 and found[2] == 2 and found[5] == 5
    # Of 28 runs of words each, the one with the first word differs.
    assert found[3] == found[4] == 3


def test_sets_that_share_only_the_first_hash():
    one = np.array([(1, 1), (2, 1), (3, 1)], neardup.SHINGLE)
    two = np.array([(1, 1), (2, 2), (4, 1)], neardup.SHINGLE)
    a, b = neardup.single_numbers([one, two])
    assert len(np.intersect1d(a, b)) == 1 and len(set(a.tolist())) == len(set(b.tolist())) == 3
    hashes, second = np.array([5, 5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1, 1], np.uint64)
    got = text.distinct_per_document(hashes, second, np.array([0, 4, 5]))
    assert [x.tolist() for x in got] == [[5, 5, 7, 5], [1, 2, 1, 1], [0, 3, 4]]


def test_top_k_keeps_rows_of_one_id(llm):
    """Against the registered SQL, with ids repeated with different vectors, also of queries."""
    import duckdb

    from fieldspark.llm.queries import SQL

    rng = random.Random(8)
    vectors = [(rng.choice([0, 50, 100, *range(1, 30)]), [rng.choice([0.0, 0.5, -0.25, rng.random()]) for _ in range(4)]) for _ in range(90)]
    df = llm.createDataFrame([(i, v, 1, 2.0) for i, v in vectors], "vec_id long, embedding array<double>, row int, score double").repartition(3)
    got = topk.exact_top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, 5, 2, 7).select("query_id", "rank", "vec_id", "score").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", vectors)
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({SQL['op1_exact_top_k']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 15


# --- stages


def odd_documents(spark, rows):
    """Documents with columns of names that the stages use inside, and of types without an order."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, component_id int, h binary, t string, r int, `a b` int, id long, y int"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "k", 1, b"x", "t", 3, 4, 5, 6) for i, t in rows], schema)
    return df.withColumns({"m": F.create_map(F.lit("k"), F.col("doc_id")), "nested": F.struct(F.array(F.create_map(F.lit(1), F.lit("v"))).alias("l")), "__row": F.lit(None).cast("string")})


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name_and_type(llm, sf, name):
    base = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    rows = base + [(9001, base[5][1]), (9001, base[5][1]), (9002, None), (9003, ""), (None, None), (None, "password = abcdefgh12345"), (9004, "word " * 150_000 + "api_key: abcdefgh12345678")]
    docs = odd_documents(llm, rows)
    out = STAGES[name](llm, docs, sf)
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    kept = out.collect()
    given = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    if name == "secret scans":
        assert len(kept) == len(rows)
        assert [r["n_chars"] for r in kept] == [len(r["text"] or "") for r in kept]
        long = next(r for r in kept if r["doc_id"] == 9004)
        assert long["text"].endswith("[SECRET]") and len(long["text"]) > 700_000
    else:
        assert all(r == given[(r["doc_id"], r["text"])] for r in kept)
    # A table without rows gives one, and nulls are no reason to fail.
    assert STAGES[name](llm, docs.filter("false"), sf).count() == 0


def test_packing_stage_takes_odd_tables(llm, sf):
    docs = odd_documents(llm, [(1, "a b c"), (1, None), (None, ""), (2, "x" * 100_000)])
    out = STAGES["best-fit packing"](llm, docs, sf).collect()
    assert collections.Counter(r["doc_id"] for r in out)[1] == 2 and sum(r["length"] for r in out if r["doc_id"] is None) == 1
    assert STAGES["best-fit packing"](llm, docs.filter("false"), sf).count() == 0


def test_exact_dedup_survivor_does_not_depend_on_order(llm):
    rows = [(1, "same", i) for i in range(50)] + [(2, "same", 0), (3, "other", 1)]
    got = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = llm.createDataFrame(rows, "doc_id long, text string, x int").repartition(4)
        got.add(tuple(sorted(tuple(r) for r in exactdup.distinct_documents(df, "smallest").collect())))
        assert sorted(r["doc_id"] for r in exactdup.distinct_documents(df, "largest").collect()) == [2, 3]
    assert len(got) == 1 and [r[0] for r in next(iter(got))] == [1, 3]


def test_scores_with_clashing_columns_and_empty_tables(llm, sf):
    docs = odd_documents(llm, [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{sf}/documents.parquet").collect()] + [(None, None), (7, "long " * 100_000)])
    labels = llm.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    scored = model.score(docs)
    assert scored.columns == ["doc_id", "score"] and scored.count() == docs.count()
    assert scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert model.score(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        model.score(docs, keep=("doc_id", "score"))
    toxic = toxicity.fit_toxicity(docs, labels).score(docs)
    assert toxic.count() == docs.count()


def test_secret_spans_with_clashing_columns(llm):
    df = odd_documents(llm, [(1, "token: abcdefgh1234"), (None, None), (2, "")])
    assert secrets.secret_spans(df).count() == 3


def test_queries_leave_ids_whole(llm, sf):
    df = QUERIES["op4_minhash_near_dedup"](llm, sf)
    assert df.count() == llm.read.parquet(f"{sf}/documents.parquet").count()


# --- licences


def test_every_known_sentence_is_found_by_itself(llm):
    from fieldspark.llm import licenses

    texts = [(i, f"Title {i}\n\n * {t[0].upper()}{t[1:]}.\n\nMore.") for i, t in enumerate(licenses.TEXTS.values())]
    df = llm.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["sentences"] for r in licenses.license_scan(df).collect()}
    assert got == dict(enumerate(licenses.TEXTS))


def plain_rules(line, rules):
    """Rules in order over lists of names; what one has matched is cut out."""
    parts, out = [list(x) for x in line], set()
    for license, seq in rules:
        seq, hit, left = list(seq), False, []
        for part in parts:
            at = now = 0
            while at < len(part):
                if part[at : at + len(seq)] == seq:
                    left.append(part[now:at])
                    at += len(seq)
                    now, hit = at, True
                else:
                    at += 1
            left.append(part[now:])
        parts = left
        if hit:
            out.add(license)
    return ",".join(sorted(out))


def test_rules_in_their_order_equal_a_plain_loop(llm):
    from fieldspark.llm import licenses

    rng = random.Random(6)
    names = list(licenses.TEXTS)
    docs = []
    for _ in range(150):
        some = []
        for _ in range(rng.randint(1, 4)):
            some += rng.choice([list(rng.choice(licenses.RULES)[1]), [rng.choice(names)], list(rng.choice(licenses.RULES)[1])[:-1]])
        docs.append(some + some if rng.random() < 0.2 else some)
    texts = [(i, "".join(f"{licenses.TEXTS[n]}.\n\n" for n in some)) for i, some in enumerate(docs)]
    for r in licenses.license_scan(llm.createDataFrame(texts, "doc_id long, text string")).collect():
        found = [x for x in r["sentences"].split(",") if x]
        assert found == docs[r["doc_id"]]
        lines = [n for n in found if not set(licenses.TEXTS[n]) & set(";") and ". " not in licenses.TEXTS[n]]
        assert r["licenses"] == plain_rules([found, lines], licenses.RULES), texts[r["doc_id"]]


def test_full_texts_and_the_same_rule_in_sql(llm, scratch):
    """Hard-wrapped notices in comments, one line and mixed, against the registered SQL."""
    import textwrap

    import duckdb

    from fieldspark.llm import licenses
    from fieldspark.llm.queries import SQL

    t = licenses.TEXTS
    bsd = [t["bsd-grant"] + ":", "1. " + t["bsd-source"] + ".", "2. " + t["bsd-binary"] + "."]
    notices = {
        "MIT": [t["mit-title"], "Copyright (c) 2020 Somebody", t["mit-grant"] + ":", t["mit-notice"] + ".", t["mit-asis"] + ". " + t["mit-liability"] + "."],
        "BSD-2-Clause": [*bsd, t["bsd-asis"] + "."],
        "BSD-3-Clause": [*bsd, "3. " + t["bsd-names"] + ".", t["bsd-asis"] + "."],
        "LGPL-2.1": [t["lgpl21-free"] + ".", t["lgpl-hope"] + ".  " + t["lgpl-see"] + "."],
        "AGPL-3.0": [t["agpl-free"] + ".", t["gpl-hope"] + ".  " + t["agpl-see"] + ".", t["agpl-copy"] + "."],
        "GPL-2.0": [t["gpl2-free"] + ".", t["gpl-hope"] + ". " + t["gpl-see"] + "."],
        "Zlib": [t["zlib-asis"] + ". " + t["zlib-liability"] + ".", t["zlib-grant"] + ":", "1. " + t["zlib-origin"] + "."],
        "MPL-2.0": [t["mpl-form"] + ". " + t["mpl-obtain"] + "."],
        "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); ' + t["apache-limits"] + ". " + t["apache-copy"], t["apache-url"], t["apache-asis"] + ".", t["apache-see"] + "."],
    }
    docs, want = [(0, None, 1), (0, "", 2), (None, "All rights reserved!", 3)], {}
    for name, parts in notices.items():
        for width in (28, 72, 2000):
            for sign, end in (("", "\n"), (" * ", "\n"), ("// ", "\r\n")):
                want[len(docs)] = name
                docs.append((len(docs), "x = 1;" + end + end.join(sign + x for part in parts for x in [*textwrap.wrap(part, width), ""]), 4))
    df = llm.createDataFrame(docs, "doc_id long, text string, licenses int")
    got = [tuple(r) for r in licenses.license_scan(df).select("doc_id", "licenses", "sentences").collect()]
    assert {i: x for i, x, _ in got if i in want} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, licenses INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    rows = con.execute(f"SELECT doc_id, licenses, sentences FROM ({SQL['op9_license_scan']})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, rows))


# --- plain references of what is fitted


def test_automata_merge_only_compatible_states():
    """Shares of an automaton add up, and a rare state that fits none stays by itself."""
    rng = random.Random(1)
    for values in (["AB12" + "".join(rng.choices("0123456789", k=8)) for _ in range(200)], ["a" * 8] * 300 + ["-" + "z" * 9] * 9 + ["-9" * 4] * 9, ["x" * 12]):
        a = secrets.inferred(values)
        for end, steps in zip(a.ends, a.steps):
            total = np.exp(end) + sum(np.exp(p) for p, _ in steps.values())
            assert abs(total - 1) < 1e-9
            assert all(0 <= to < len(a.ends) for _, to in steps.values())
    # After nine values of one form and nine of another no state may have both continuations.
    a = secrets.inferred(["a" * 8] * 300 + ["--------"] * 9)
    start = a.steps[0]
    first, second = (start[s][1] for s in ("f", "-"))
    assert "-" not in a.steps[first] or first == 0 or second == 0


def test_ordinal_regression_reaches_the_optimum_of_a_plain_likelihood():
    """The penalised likelihood written out document by document, and improved by differences alone."""
    rng = np.random.Generator(np.random.PCG64(4))
    n, spec = 90, toxicity.ToxicitySpec(features=4, steps=3000, penalty=1e-2)
    x = rng.poisson(1.0, (n, 4)).astype(float)
    grades = np.digitize(x @ [1.5, -1.0, 0.5, 0.0] + rng.logistic(size=n), [0.5, 2.0])
    doc, place = np.nonzero(x)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    model = toxicity.fit_ordinal(place, x[doc, place], bounds, grades, np.ones(4, bool), spec)

    def loss(params):
        w, cuts = params[:4], [params[4], params[4] + math.exp(params[5])]
        out = 0.0
        for row, grade in zip(x, grades):
            z = sum(a * b for a, b in zip(row, w))
            above = [1.0, *[1 / (1 + math.exp(c - z)) for c in cuts], 0.0]
            out -= math.log(above[grade] - above[grade + 1])
        return out / n + spec.penalty / 2 * sum(a * a for a in w)

    def slope(params):
        out = []
        for k in range(6):
            step = np.zeros(6)
            step[k] = 1e-6
            out.append((loss(params + step) - loss(params - step)) / 2e-6)
        return np.array(out)

    plain, rate = np.zeros(6), 1.0
    for _ in range(400):
        g = slope(plain)
        while loss(plain - rate * g) > loss(plain) - 0.3 * rate * (g @ g) and rate > 1e-9:
            rate /= 2
        plain, rate = plain - rate * g, rate * 1.5
    fitted = np.concatenate([model.weights, [model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])]])
    assert loss(fitted) <= loss(plain) + 1e-5 and np.abs(slope(fitted)).max() < 1e-3
    p = model.exceed(place, x[doc, place], bounds)
    for row, found in zip(x, p):
        z = sum(a * b for a, b in zip(row, model.weights))
        assert found == pytest.approx([1 / (1 + math.exp(c - z)) for c in model.thresholds])


@pytest.mark.parametrize("capacity", [packing.Capacity(64), packing.Capacity(64, documents=3), packing.Capacity(64, attention=1500)])
def test_plan_is_as_good_as_best_fit_piece_by_piece(capacity):
    """The plan over the histogram against a plain best fit that places one piece after another."""
    rng = random.Random(12)
    for _ in range(5):
        pieces = [rng.choice([3, 5, 8, 13, 21, 34]) for _ in range(300)]
        bins = []
        for n in sorted(pieces, reverse=True):
            need = np.array([n, 1, n * n])
            fits = [b for b in bins if (b >= need).all()]
            whole = capacity.vector()
            if fits:
                best = min(fits, key=lambda b: ((((b - need) / whole) ** 2) * [1.0, 1e-3, 1e-3]).sum())
                best -= need
            else:
                bins.append(whole - need)
        histogram = collections.Counter(pieces)
        _, used = packing.best_fit_plan(histogram, capacity)
        assert used <= len(bins) + 1


def test_full_pieces_have_sequences_of_their_own(llm):
    pieces = llm.createDataFrame([(i % 7, 0, i, 8 if i % 3 else 3) for i in range(600)], "doc_id long, piece int, ids_crc32 long, length long").repartition(5)
    rows = packing.pack(pieces, packing.Capacity(8)).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(rows) == 600 and len(by) == 400 + 100
    assert all(sorted(x) in ([(0, 8)], [(0, 3), (3, 3)]) for x in by.values())
    with pytest.raises(ValueError):
        packing.pack(pieces, packing.Capacity(8, attention=60))


def test_licence_and_secret_at_the_end_of_a_long_text(llm):
    from fieldspark.llm import licenses

    long = "word, more words. " * 60_000
    df = odd_documents(llm, [(1, long + "\nReleased under\nthe MIT License."), (2, long + " AKIA" + "A1" * 10), (3, long)])
    assert {r["doc_id"]: r["licenses"] for r in licenses.license_scan(df).collect()} == {1: "MIT", 2: "", 3: ""}
    spans = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["spans"] if not s["inferred"]] for r in secrets.secret_spans(df).collect()}
    assert spans == {1: [], 2: [("access", len(long) + 1)], 3: []}
