import collections
import hashlib
import math
import random
import re
import string

import numpy as np
import pytest

from fieldspark.llm import chat, lexical, spelling
from fieldspark.llm.queries import CONTROL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- lexical search


def brute_search(docs, items, k):
    vectors = [(i, collections.Counter(WORD.findall(lowered(t)))) for i, t in docs]
    vectors = [(i, v, sum(v.values())) for i, v in vectors if v]
    n_docs, n_terms = len(vectors), sum(n for *_, n in vectors)
    df = collections.Counter(t for _, v, _ in vectors for t in v)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(WORD.findall(lowered(t)))
    out = {}
    for item, terms in asked.items():
        scored = []
        for i, v, n in vectors:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * v[t] // (1000 * v[t] + 8 * m)) for t in terms if v[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        if scored:
            out[item] = [(r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


def searched(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return {i: sorted(x) for i, x in out.items()}


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "x-y", "日本", "İ"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 8, 40]))) for _ in range(n)]
    return texts + ["w1 w2 w3"] * 40 + [None, "", " .,;", "W1\x00w2"]


@pytest.mark.parametrize("together", [1 << 14, 12])
def test_lexical_search_equals_brute_force(llm, monkeypatch, together):
    rng = random.Random(4)
    # Small blocks, so that later ones are searched with a score to reach.
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", 7)
    docs = [(i, t) for i, t in enumerate(corpus(rng, 300))] + [(5, "w7 w7 w9"), (5, "w9 w1"), (None, "w1 w2 w3"), (None, "w40")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices([f"W{j}" for j in range(60)] + ["none", "Été"], k=rng.randint(1, 9)))) for i in range(25)]
    items += [(3, "w40 w41"), (None, "w1"), (90, None), (91, ""), (92, "absent")]
    d = llm.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    q = llm.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, doc_id double")
    assert searched(lexical.lexical_search(d, q, 4, together)) == brute_search(docs, items, 4)


def test_search_skips_and_still_equals_all_scores():
    """A block's search keeps every document that is not below the least score, whatever that score is."""
    rng = np.random.Generator(np.random.PCG64(2))
    n, width = 400, 12
    held = rng.random((n, width)) < np.linspace(0.05, 0.7, width)
    doc, term = np.nonzero(held)
    tf = rng.integers(1, 5, len(doc))
    queries = lexical.paired([list(range(width)), [0, 3, 11], [5]], np.arange(width, 0, -1) * 500, n, 4 * n)
    index = lexical.BlockIndex(queries, rng.permutation(n) * 10, rng.integers(1, 30, n), doc, term, tf)
    for pairs in queries.items:
        places, scores = index.search(pairs, 1)
        assert (index.bound[pairs] <= index.most[queries.pairs[pairs]].sum(axis=1)).all()
        for share in (0.5, 0.9, 0.99, 1.0):
            least = int(np.quantile(scores, share))
            got = dict(zip(*(x.tolist() for x in index.search(pairs, least))))
            assert got == {p: s for p, s in zip(places.tolist(), scores.tolist()) if s >= least}
    # Terms whose best documents differ: the pair's bound is below the two maxima together.
    assert (index.bound < index.most[queries.pairs].sum(axis=1)).any()


def test_lexical_search_empty_tables_and_long_texts(llm):
    d = llm.createDataFrame([(1, "a b " * 200_000 + "rare"), (2, "a " * 3), (3, "c")], "doc_id long, text string")
    q = llm.createDataFrame([(1, "a rare"), (2, "b " * 100_000)], "item_id long, text string")
    got = searched(lexical.lexical_search(d, q))
    assert got == brute_search([(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in q.collect()], 10)
    assert lexical.lexical_search(d.filter("false"), q).count() == 0
    assert lexical.lexical_search(d, q.filter("false")).count() == 0


# --- chats


def described(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chats_come_back_from_the_output(llm):
    hard = [CONTROL, "\\", "\\b\\p\\n", "<|", "<\\p|", "<|image|>", "|>", "<<|>", "a\nb", "", None, "é🙂 <|other|>", "x" * 200_000]
    rng = random.Random(1)
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "", None, "a\nb", "<|im_end|>"]), "".join(x or "" for x in rng.choices(hard[:-1], k=2)) if turn else hard[conv % len(hard)], 7))
    rng.shuffle(rows)
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    chats = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_chats(chats, keep=("formatted",)).collect()}
    spans = {r["conv_id"]: r["turns"] for r in chats.collect()}
    for conv in range(30):
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        back = got[conv]
        assert [(t["role"], t["text"]) for t in back["turns"]] == own
        assert back["loss"] == "".join(t for r, t in own if r == "assistant")
        whole = back["formatted"]
        assert whole.count("<|im_start|>") == whole.count("<|im_end|>\n") == len(own)
        assert spans[conv][0]["start"] == 0 and spans[conv][-1]["stop"] + len("<|im_end|>\n") == len(whole)


def test_chat_parts_become_placeholders_in_order(llm):
    p = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 0, "user", [p("text", "see <|image|> "), p("image", ref="a.png", units=9.5), p("text", "é"), p("audio", ref="b.wav", units=0.01), p("document", ref="c.pdf", units=None)]),
        (1, 1, "assistant", [p("text", "one"), p("image", ref="d.png", units=4.0), p("text", "two"), p("text", None)]),
        (1, 2, "user", [p("video", ref="e"), p(None, "lost", "f")]),
        (2, 0, "user", None),
        (3, None, None, []),
    ]
    df = llm.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    chats = chat.format_chats(df)
    first = chats.filter("conv_id = 1").first()
    marks = [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in first["attachments"]]
    assert marks == [(0, 1, "image", "a.png", 10), (0, 3, "audio", "b.wav", 1), (0, 4, "document", "c.pdf", 600), (1, 1, "image", "d.png", 4), (2, 0, "other", "e", 0), (2, 1, "other", "f", 0)]
    for a in first["attachments"]:
        mark = f"<|{a['type']}|>"
        assert first["formatted"][a["at"] : a["at"] + len(mark)] == mark
    assert first["attachment_tokens"] == 615
    back = {r["conv_id"]: r for r in chat.read_chats(chats).collect()}
    parts = [[(x["type"], x["text"]) for x in t["parts"]] for t in back[1]["turns"]]
    assert parts == [[("text", "see <|image|> "), ("image", None), ("text", "é"), ("audio", None), ("document", None)], [("text", "one"), ("image", None), ("text", "two")], [("other", None), ("other", None)]]
    assert back[1]["loss"] == "onetwo"
    assert [t["text"] for t in back[2]["turns"]] == [""] and [t["parts"] for t in back[3]["turns"]] == [[]]


def test_chats_without_ids_repeated_turns_and_empty(llm):
    df = llm.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, None, "user", "c")], "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"] or 0, [t["text"] for t in r["turns"]]) for r in chat.read_chats(chat.format_chats(df)).collect())
    assert got == [(0, ["a"]), (0, ["a"]), (4, ["c", "a", "b"])]
    assert chat.read_chats(chat.format_chats(df.filter("false"))).count() == 0
    with pytest.raises(ValueError):
        chat.Template(start="[user]")


def test_chat_query_is_native_and_has_the_control_conversation(llm, sf):
    df = QUERIES["op12_chat_format"](llm, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    r = df.filter("conv_id = -1").first()
    assert (r["n_turns"], r["turns_sha256"]) == (2, described([("user", CONTROL), ("assistant", CONTROL)]))
    assert (r["loss_chars"], r["loss_sha256"]) == (len(CONTROL), hashlib.sha256(CONTROL.encode()).hexdigest())


# --- spelling


def one_edit(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_variants(counts, factor=10):
    near = {x: [y for y in counts if one_edit(x, y)] for x in counts}
    form = {}
    for x, n in counts.items():
        best = min(near[x], key=lambda y: (-counts[y], y), default=None)
        form[x] = best if best is not None and counts[best] >= factor * n else None
    out = set()
    for x, n in counts.items():
        root = x
        while form[root]:
            root = form[root]
        out.add((x, form[x], root, n, len(near[x]), counts[form[x]] if form[x] else None))
    return out


def word_list(rng, n):
    out = set()
    while len(out) < n:
        w = "".join(rng.choices("abé", k=rng.randint(7, 10)))
        out.add(w)
        for _ in range(3):
            i = rng.randrange(len(w) + 1)
            out.add(rng.choice([w[:i] + "a" + w[i:], w[:i] + w[i + 1 :], w[:i] + "É" + w[i + 1 :]]))
    # One letter over and over, shifted by one, and at the ends.
    out |= {"a" * k for k in range(7, 12)} | {"a" * 8 + "b", "b" + "a" * 8, "ab" * 4, "ba" * 4, "z" * 300, "z" * 301, "z" * 150 + "y" + "z" * 149}
    return sorted(w for w in out if len(w) >= 7)


@pytest.mark.parametrize("most", [2048, 5])
def test_spelling_variants_equal_brute_force(llm, most):
    rng = random.Random(most)
    counts = {w: rng.choice([2, 2, 3, 25, 300, 4000, 50_000]) for w in word_list(rng, 350)}
    df = llm.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form int")
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df, most=most).collect()}
    assert got == brute_variants(counts)
    assert any(f and r != f for _, f, r, *_ in got)


def test_index_of_many_groups_finds_each_pair_once():
    """The recurrences over one index of several groups, against comparing words one by one."""
    rng = random.Random(9)
    for size, a, b in ((7, 0, 8), (7, 3, 5), (7, 4, 8), (8, 8, 9)):
        rows = []
        for g in range(6):
            base = "".join(rng.choices(string.ascii_lowercase, k=size))
            for longer in (False, True):
                width = max(0, min(b, size) - a) + longer
                for _ in range(25):
                    rows.append((base[:a] + "".join(rng.choices("xy", k=width)) + base[b:], longer, g))
        rows = sorted(set(rows), key=lambda r: r[2])
        words, longer, group = np.array([r[0] for r in rows], object), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        n = np.array([rng.randint(1, 9) for _ in rows])
        found, best, _ = spelling.group_matches(words, n, longer, group, size, a, b)

        def first_difference(x, y):
            return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

        for i in range(len(rows)):
            mine = [j for j in range(len(rows)) if group[j] == group[i] and not (longer[i] and longer[j]) and one_edit(words[i], words[j]) and a <= first_difference(words[i], words[j]) < b]
            assert found[i] == len(mine)
            assert best[i] == min(mine, key=lambda j: (-n[j], words[j]), default=-1)


def test_word_counts_follow_the_rule(llm):
    import zlib

    texts = ["Élégante élégante ÉLÉGANTE", "abcdefg-abcdefgh×ijk 1abcdefg", None, "", "short abcdef", "Abcdefgh " * 40] + ["abcdefgh wonderful straße"] * 60
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, "abcdefgh"), (None, "wonderful wonderful")]
    want = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    df = llm.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, word string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(df).collect()} == {w: n for w, n in want.items() if n >= 2}
    assert spelling.spelling_variants(spelling.word_counts(df.filter("false"))).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spelling.word_counts(df), factor=1)


def test_one_edit_is_what_the_tests_mean():
    assert one_edit("abcdefg", "abcdefgh") and one_edit("abcdefg", "xbcdefg") and not one_edit("abcdefg", "badcefg")
