import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldspark.llm import bpe, packing, pretokens, tokenfiles, topk
from fieldspark.llm.queries import QUERIES
from fieldspark.llm.shared import file_bytes, shared_folder
from fieldspark.llm.text import chunks

DEFINITION = file_bytes(public_tokenizers.path("byte_bpe_50k.json"))
RANKS = file_bytes(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
HARD = [None, "", " ", "  ", "\n\n ", "it's don't  they've\n 's ''s !'s 'store'll'd  \n\n x", "'", "'re'", "12½ ⅷ’s\t\ta \x1c b", "日本語 テスト🙂🙂 !?é́", "\x85'd  ", "a" * 3000, "ab" * 700 + " " + "é" * 500, "<|endoftext|> x"]


def documents(spark, texts, extra=""):
    rows = [(i, t, f"s{i % 2}", "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids string" + extra)


def brute_top_k(rows, is_query, k):
    out = {}
    for q, v in rows:
        if is_query(q):
            scored = sorted((-(sum(a * b for a, b in zip(v, w))), c) for c, w in rows if c != q)
            out[q] = [(i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("blocks", [(512, 16384), (3, 7)])
def test_top_k_equals_brute_force(llm, blocks):
    rng = random.Random(1)
    vectors = [(i, [rng.choice([0.0, 0.5, -0.25, rng.random()]) for _ in range(6)]) for i in range(60)]
    vectors += [(60 + i, vectors[0][1]) for i in range(8)] + [(70, [0.0] * 6), (71, [1.0, 2.0])]
    bad = [(80, None), (85, [1.0, None]), (90, [float("nan")]), (95, [float("inf")]), (None, [1.0] * 6)]
    df = llm.createDataFrame([(i, v, "x", 0) for i, v in vectors + bad], "vec_id long, embedding array<double>, label string, score int")
    got = collections.defaultdict(list)
    for r in topk.exact_top_k(topk.quantised(df), F.col("vec_id") % 5 == 0, 4, *blocks).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    assert {q: sorted(x) for q, x in got.items()} == brute_top_k(whole, lambda q: q % 5 == 0, 4)


def test_top_k_small_and_large_values(llm):
    schema = "vec_id long, embedding array<double>"
    assert topk.exact_top_k(topk.quantised(llm.createDataFrame([], schema)), F.lit(True)).count() == 0
    one = llm.createDataFrame([(0, [1.0]), (0, [1.0])], schema)
    assert topk.exact_top_k(topk.quantised(one), F.lit(True)).count() == 0
    large = llm.createDataFrame([(0, [1e6, 1.0]), (1, [-1e6, 2.0]), (2, [1e6, 3.0])], schema)
    got = topk.exact_top_k(topk.quantised(large), F.col("vec_id") == 0, 1).first()
    assert (got["vec_id"], got["score"]) == (2, 256000000**2 + 256 * 768)


def test_best_fit_plan_respects_every_capacity():
    rng = random.Random(3)
    for capacity in (packing.Capacity(100), packing.Capacity(100, documents=3), packing.Capacity(100, attention=3000)):
        for score in ("norm", "dot"):
            histogram = {n: rng.randint(1, 60) for n in rng.sample(range(1, 54), 30)}
            plan, bins = packing.best_fit_plan(histogram, capacity, score)
            content = collections.defaultdict(list)
            ranks = collections.Counter()
            for length, rank, n, first, per, at in plan:
                assert rank == ranks[length]
                ranks[length] += n
                for j in range(n):
                    content[first + j // per].append((at + j % per * length, length))
            assert dict(ranks) == histogram and sorted(content) == list(range(bins))
            for items in content.values():
                at = 0
                for offset, length in sorted(items):
                    assert offset == at
                    at += length
                demand = [at, len(items), sum(n * n for _, n in items)]
                assert all(d <= c for d, c in zip(demand, capacity.vector()))
    with pytest.raises(ValueError):
        packing.best_fit_plan({101: 1}, packing.Capacity(100))
    with pytest.raises(ValueError):
        packing.best_fit_plan({}, packing.Capacity(100), "other")


def test_packing_is_gapless_whole_and_tight(llm):
    tok = Tokenizer.from_str(DEFINITION.decode())
    tok.encode_special_tokens = True
    rng = random.Random(5)
    texts = HARD + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 300))) for _ in range(80)]
    texts += ["same"] * 30
    packed = packing.pack(packing.token_pieces(documents(llm, texts), DEFINITION, 0, 256, with_ids=True), packing.Capacity(256))
    rows = packed.collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in parts for x in r["ids"]] == ids
        assert all(r["length"] == 256 for r in parts[1:]) and [r["piece"] for r in parts] == list(range(len(parts)))
        at = 0
        for r in parts:
            assert r["start"] == at and r["length"] == len(r["ids"])
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["length"]
    for items in by_bin.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_bin) <= -(-total // 256) * 1.03 + 1
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == sum(n for _, n in by_bin[r["sequence_id"]])


def test_packing_empty_and_null_ids(llm):
    empty = documents(llm, ["x"]).filter("false")
    assert packing.pack(packing.token_pieces(empty, DEFINITION)).count() == 0
    df = llm.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None)], "doc_id long, text string")
    rows = packing.pack(packing.token_pieces(df, DEFINITION)).collect()
    assert sorted((r["length"], r["offset"]) for r in rows) == [(1, 4), (1, 5), (2, 0), (2, 2)]


def test_pretokens_equal_the_pattern():
    rx = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = [t or "" for t in HARD] + ["".join(rng.choice(" '  slrevtdmA1\n\t! é½") for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    for size in (1 << 20, 64):
        for rows, data, ends in chunks(pa.array(texts), size):
            starts = pretokens.pretoken_starts(data, ends)
            bounds = np.searchsorted(starts, ends)
            for j, t in enumerate(texts[rows]):
                at, want = 0, []
                for m in rx.findall(t):
                    want.append(at)
                    at += len(m.encode())
                assert (starts[bounds[j] : bounds[j + 1]] - ends[j]).tolist() == want, repr(t)


def test_scan_is_the_automaton_run_step_by_step():
    symbols = np.random.default_rng(2).integers(0, 14, 3000).astype(np.uint8)
    state, want = 0, []
    for s in symbols.tolist():
        want.append(state)
        state = int(pretokens.TRANSITIONS[s, state])
    assert pretokens.scanned_states(symbols, 64).tolist() == want
    assert pretokens.scanned_states(symbols[:0]).tolist() == []


def test_small_cache_changes_nothing():
    tok = pretokens.library_cache(DEFINITION)
    small = pretokens.PieceCache(tok.encode_missing, slots=4, most=2)
    for _, data, ends in chunks(pa.array([t or "" for t in HARD] * 2), 200):
        a, b = tok.ids_of(data, ends), small.ids_of(data, ends)
        assert all((x == y).all() for x, y in zip(a, b))


def test_bpe_equals_tiktoken_and_round_trips(llm):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    rng = random.Random(9)
    texts = HARD + ["".join(rng.choice("abc defé日1!'\n") for _ in range(rng.randint(0, 200))) for _ in range(200)] + ["ж" * 400, "xyz" * 400]
    encoded = bpe.bpe_encode(documents(llm, texts), RANKS)
    rows = {r["doc_id"]: r for r in bpe.bpe_decode(encoded, RANKS).collect()}
    rx = regex.compile(public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        t = t or ""
        assert rows[i]["ids"] == own.encode_ordinary(t)
        assert bytes(rows[i]["decoded"]) == t.encode()
        cuts = rows[i]["slice_starts"]
        raw = t.encode()
        assert [raw[a:b].decode() for a, b in zip(cuts, [*cuts[1:], len(raw)])] == rx.findall(t)
    assert bpe.bpe_encode(documents(llm, ["x"]).filter("false"), RANKS).count() == 0
    with pytest.raises(Exception, match="vocabulary"):
        bpe.bpe_decode(llm.createDataFrame([(1, [999999])], "doc_id long, ids array<int>"), RANKS).collect()
    nulls = bpe.bpe_decode(llm.createDataFrame([(1, None), (2, []), (3, [0])], "doc_id long, ids array<int>"), RANKS)
    assert [r["decoded"] is None for r in nulls.orderBy("doc_id").collect()] == [True, False, False]


def test_long_merges_equal_short_ones():
    ranks = bpe.ranks_of(RANKS)
    rng = random.Random(4)
    for _ in range(300):
        piece = "".join(rng.choice("abeinstou é") for _ in range(rng.randint(2, 40))).encode()
        whole = ranks.get(piece)
        assert bpe.merged(piece, ranks) == ([whole] if whole is not None else bpe.merged_long(piece, ranks))


@pytest.mark.parametrize("copies", [1, 12])
def test_token_files(llm, copies):
    tok = Tokenizer.from_str(DEFINITION.decode())
    tok.encode_special_tokens = True
    rng = random.Random(8)
    texts = (HARD + ["".join(rng.choice(["the ", "of ", "word ", "x1 "]) for _ in range(rng.randint(0, 60))) for _ in range(30)]) * copies
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = llm.createDataFrame([(i, texts[i], "s") for i in order], "doc_id long, text string, shard string").repartition(5)
    path = shared_folder(llm, "token-files")
    tokenfiles.write_token_files(df, path, DEFINITION, 2, shards=3)
    rows = {r["doc_id"]: r for r in tokenfiles.read_token_files(llm, path).collect()}
    assert len(rows) == len(texts)
    at = 0
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (rows[i]["start"], rows[i]["n_tokens"]) == (at, len(ids))
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == ids
        at += len(ids)
    some = tokenfiles.read_token_files(llm, path, F.col("doc_id").isin(3, 17)).collect()
    assert sorted(r["doc_id"] for r in some) == [3, 17] and all(r["start"] == rows[r["doc_id"]]["start"] and r["ids"] == rows[r["doc_id"]]["ids"] for r in some)
    data, digest, width = tokenfiles.read_dictionary(llm, path)
    assert hashlib.sha256(data).hexdigest() == digest and width == 2 and len(data) > 0


def test_token_files_of_an_empty_table(llm):
    path = shared_folder(llm, "token-files")
    tokenfiles.write_token_files(documents(llm, ["x"]).filter("false"), path, DEFINITION, 2)
    assert tokenfiles.read_token_files(llm, path).count() == 0
    assert tokenfiles.read_dictionary(llm, path)[0] == b""
    df = llm.createDataFrame([(None, "b"), (4, "a"), (4, "a"), (None, None)], "doc_id long, text string")
    path = shared_folder(llm, "token-files")
    tokenfiles.write_token_files(df, path, DEFINITION, 2)
    got = sorted(tokenfiles.read_token_files(llm, path).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(None, 1), (None, 2), (4, 2), (4, 2)]


def test_added_tokens_equal_the_untouched_library(llm):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endo", "ftext|>", " ", "  ", "\n", "'s", "it", "é", " word", "1"]
    texts = HARD + ["a <|endoftext|> x", "<|endoftext|>", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(400)]]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sum(50256 in ids for ids in want) > 100
    for size in (1 << 20, 64):
        cache, got = pretokens.added_token_cache(DEFINITION), []
        for _, data, ends in chunks(pa.array(texts), size):
            ids, bounds = cache.ids_of(data, ends)
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == want
    # Two documents whose ends together spell the token hold none.
    halves = pa.array(["x<|endo", "ftext|>y"])
    assert [ids.tolist() for _, ids, _ in packing.encoded_documents(halves, DEFINITION, None, True)] == [sum((tok.encode(t.as_py(), add_special_tokens=False).ids for t in halves), [])]
    # The queries ask for it.
    folder = shared_folder(llm, "added-tokens")
    documents(llm, texts).write.parquet(f"{folder}/documents.parquet")
    total = collections.Counter()
    for r in QUERIES["op2_best_fit_packing"](llm, folder).collect():
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(ids) + 1 for i, ids in enumerate(want)}
    at = 0
    for r in sorted(QUERIES["op8_token_files"](llm, folder).collect(), key=lambda r: r["doc_id"]):
        ids = want[r["doc_id"]] + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_dictionary_of_copies_is_that_of_distinct_texts(llm):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x1", "of the"]) for _ in range(80)) for _ in range(120)]
    once = documents(llm, texts)
    first = once.orderBy(F.xxhash64("text")).first()["text"]
    copies = documents(llm, texts + [first] * 500)
    made = [tokenfiles.train_dictionary(d, DEFINITION, 2, 2, documents=60) for d in (once, copies)]
    assert made[0] and made[0] == made[1]
