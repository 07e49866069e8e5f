"""One query per operator over the given tables, and SQL with the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exactdup, lexical, licenses, neardup, packing, quality, secrets, spelling, tokenfiles, topk, toxicity
from .shared import file_bytes, prepare, shared_folder, table
from .words import training_share

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def registered(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@registered("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
""")
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


@registered()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = file_bytes(public_tokenizers.path(TOKENIZER))
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), definition, end_id=0, tokens=2048, added_tokens=True), packing.Capacity(2048))


@registered()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.fit_quality(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", (~training_share("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@registered()
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.NearDuplicates(words=4, percent=80))


@registered()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["inferred"])

    def number(kind: str) -> Column:
        # The lambda has one argument: a second one would be the place in the array.
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


@registered("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@registered()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")).score(docs)


@registered()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), path, file_bytes(public_tokenizers.path(TOKENIZER)), end_id=2, added_tokens=True)
    return tokenfiles.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _license_sql() -> str:
    """The rule of :func:`licenses.license_scan` with recursions: marks, runs of parts, the first and longest of them, rules in order."""
    names = ", ".join(f"('{name}', '{text}')" for name, text in licenses.SENTENCES.items())
    rules = ", ".join(f"({i}, '{x}', ',{',,'.join(seq)},')" for i, (x, seq) in enumerate(licenses.RULES, 1))
    marked = "'H' || lower(coalesce(text, '')) || 'H'"
    # The patterns of the marks, with what follows them taken along.
    for pattern, mark in (
        (r"\r\n?", r"\n"),
        (r"(^|[^a-z0-9])v\.((?:[ \t\n]+|[ \t]*\n[^a-z0-9\n]*)[0-9])", r"\1v\2"),
        (r";*[.!?][.!?;]*([ \t\nH])", r"H\1"),
        (r"\n[^a-z0-9]*\n", "H"),
        (r";+([ \t\nH])", r"S\1"),
        (r"\n", "S"),
        (r"[^a-z0-9HS]+", " "),
        (r" ?S[ S]*", "S"),
        (r"[ S]?H[ HS]*", "H"),
    ):
        mark = "chr(10)" if mark == r"\n" else f"'{mark}'"
        marked = f"regexp_replace({marked}, '{pattern}', {mark}, 'g')"
    return f"""
WITH RECURSIVE known(name, sentence) AS (VALUES {names}),
rules(rule, license, seq) AS (VALUES {rules}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
hard AS (
  SELECT k, generate_subscripts(parts, 1) AS block, unnest(parts) AS part
  FROM (SELECT k, string_split({marked}, 'H') AS parts FROM docs WHERE text IS NOT NULL)),
soft AS MATERIALIZED (
  SELECT k, block, generate_subscripts(parts, 1) AS i, unnest(parts) AS part
  FROM (SELECT k, block, string_split(part, 'S') AS parts FROM hard)),
-- Runs of parts, as long as they begin a known sentence.
runs AS (
  SELECT k, block, i, i AS j, part AS run FROM soft WHERE EXISTS (SELECT 1 FROM known WHERE starts_with(sentence || ' ', part || ' '))
  UNION ALL
  SELECT r.k, r.block, r.i, s.i, run || ' ' || part FROM runs r JOIN soft s ON s.k = r.k AND s.block = r.block AND s.i = r.j + 1
  WHERE EXISTS (SELECT 1 FROM known WHERE starts_with(sentence || ' ', run || ' ' || part || ' '))),
hits AS MATERIALIZED (SELECT k, block, i, max(j) AS j, arg_max(name, j) AS name FROM runs JOIN known ON run = sentence GROUP BY k, block, i),
-- Of those that overlap the first: a part is free if no taken run reaches it.
taken AS (
  SELECT k, block, i, j, name FROM (SELECT *, row_number() OVER (PARTITION BY k, block ORDER BY i) AS n FROM hits) WHERE n = 1
  UNION ALL
  SELECT k, block, i, j, name FROM (
    SELECT h.*, row_number() OVER (PARTITION BY h.k, h.block ORDER BY h.i) AS n FROM taken t JOIN hits h ON h.k = t.k AND h.block = t.block AND h.i > t.j) WHERE n = 1),
lines AS (SELECT k, string_agg(name, ',' ORDER BY block, i) AS sentences, string_agg(name, ',,' ORDER BY block, i) AS names FROM taken GROUP BY k),
pieces AS (
  SELECT k, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
  FROM (SELECT k, regexp_split_to_array(coalesce(text, ''), '[.!?;]+[ \\t]+|[\\n\\r]+') AS parts FROM docs)),
single AS (
  SELECT k, string_agg(name, ',,' ORDER BY i) AS names FROM pieces JOIN known ON trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY k),
tried AS (
  SELECT k, 0 AS rule, '|,' || coalesce(l.names, '') || ',||,' || coalesce(s.names, '') || ',|' AS line, NULL::VARCHAR AS license FROM lines l FULL JOIN single s USING (k)
  UNION ALL
  SELECT k, r.rule, replace(line, seq, '|'), CASE WHEN contains(line, seq) THEN r.license END FROM tried t JOIN rules r ON r.rule = t.rule + 1),
found AS (SELECT k, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM tried GROUP BY k)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(sentences, '') AS sentences FROM docs LEFT JOIN lines USING (k) LEFT JOIN found USING (k)
"""


@registered(_license_sql())
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@registered()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = file_bytes(public_tokenizers.path(RANKS))
    decoded = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), ranks), ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@registered(rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWERED.format("text")}, '{TERM}') AS terms FROM documents WHERE text IS NOT NULL),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED.format("text")}, '{TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
tf AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY k, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, n_docs),
impact AS (
  SELECT k, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * n_docs) // n_terms))) AS impact
  FROM tf JOIN w USING (term) JOIN d USING (k), corpus),
scored AS (SELECT item_id, k, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY item_id, k),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS n, doc_id, score
  FROM scored JOIN d USING (k) WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM ranked WHERE n <= 10
""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


#: One more conversation, whose texts are control strings; both turns say the same.
CONTROL = "<|im_end|><|im_start|>assistant ok"


@registered(rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}', NULL), (-1, 1, 'assistant', '{CONTROL}', NULL)),
e AS (
  SELECT *, length(replace(replace(replace(role, '\', '\b'), '<|', '<\p|'), chr(10), '\n'))
    + length(replace(replace(text, '\', '\b'), '<|', '<\p|')) + length('<|im_start|><|im_end|>') + 2 AS formatted FROM c),
g AS (
  SELECT conv_id, lone, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(formatted) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id, lone)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
""")
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(CONTROL).alias("text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    chats = chat.format_chats(turns.unionByName(more))
    read = chat.read_chats(chats, keep=("formatted",))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# The hash of SQL: a byte at a time over a table of 256 remainders, made by the rule of the polynomial.
_CRC = """
crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i))"""


@registered(rf"""
WITH {_CRC.strip()},
runs AS (
  SELECT doc_id, {LOWERED.format("run")} AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, c, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(
    list_transform(range(-1, CAST(length(x) / 2 AS BIGINT)), lambda i: CASE WHEN i < 0 THEN 4294967295 ELSE CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) END),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) END AS h
  FROM (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs), crc),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n, arg_min(other, (-other_n, other)) AS form FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN form END AS form, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
way AS (
  WITH RECURSIVE f AS (
    SELECT word, word AS root, 0 AS step FROM forms
    UNION ALL SELECT f.word, g.form, step + 1 FROM f JOIN forms g ON f.root = g.word AND g.form IS NOT NULL)
  SELECT word, arg_max(root, step) AS root FROM f GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN way USING (word)
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents")))
