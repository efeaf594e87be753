"""Queries of the training-data operators and their DuckDB twins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from . import align as _align
from . import chat as _chat
from . import gam as _gam
from . import license as _license
from . import linedup as _linedup
from . import mix as _mix
from . import ngram_join as _ngram_join
from . import pack as _pack
from . import piece_bpe as _piece_bpe
from . import pii as _pii
from . import quality as _quality
from . import repair as _repair
from . import topk as _topk

QUERIES: dict = {}
ORACLES: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
k AS (SELECT *, 3 * source_size AS lim, 3 * source_size / weight::DOUBLE AS key FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER below, 0))::DOUBLE
              / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0))::DOUBLE AS level
      FROM k WINDOW below AS (ORDER BY key, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT level AS lvl FROM l WHERE level <= key ORDER BY key, source NULLS FIRST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN lvl IS NULL OR lim < weight * lvl THEN lim::DOUBLE ELSE weight * lvl END AS target
      FROM l LEFT JOIN lv ON true),
f AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS times FROM t),
r AS (SELECT *, greatest(target - times * source_size, 0) AS rest FROM f),
c AS (SELECT d.doc_id, d.size, r.*, d.h,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM sized d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * least(times + CASE WHEN rest > 0 AND size > 0 AND (upto <= rest
             OR (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM c
"""


@query("op1_mix", OP1_SQL)
def op1_mix(spark, sf_dir):
    return (_mix.mix(_table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


@query("op2_pack")
def op2_pack(spark, sf_dir):
    return _pack.pack(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_replace(role, '(<<?|\[)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g'))
              + len(regexp_replace(text, '(<<?|\[)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g'))
              + len('<|im_start|><|im_sep|><|im_end|>') AS chars FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op5_chat", OP5_SQL)
def op5_chat(spark, sf_dir):
    """A conversation is a tree without branches: each row replies to the row before it."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    by_turn = W.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = (rows.unionByName(probe).withColumn("node", F.row_number().over(by_turn).cast("long"))
                .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)))
    out = _chat.read_back(_chat.format_trees(rows, "conv_id", "node", "parent", "role", "text", None))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
                      F.length("loss_text").cast("long").alias("loss_chars"),
                      F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rk, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rk, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
u AS (SELECT rk, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT rk, i, w1 || ' ' || lead(w1, 1) OVER o || ' ' || lead(w1, 2) OVER o AS gram FROM u WINDOW o AS (PARTITION BY rk ORDER BY i)),
c AS (SELECT rk, i, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY rk, gram) > 1 THEN 1 ELSE 0 END AS dup FROM g),
cov AS (SELECT rk, max(dup) OVER (PARTITION BY rk ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM c),
rep AS (SELECT rk, sum(hit)::BIGINT AS n_repeat_words FROM cov GROUP BY rk),
m AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(len(list_aggregate(words, 'string_agg', '')), 0)::BIGINT AS word_chars,
             (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             (len(text) - len(regexp_replace(text, '[!?]', '', 'g')))::BIGINT AS n_marks
      FROM d JOIN w USING (rk) LEFT JOIN rep USING (rk)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END AS symbols,
             CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
             CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words ELSE 0 END AS repeats,
             CASE WHEN n_words > 0 THEN 10000 * n_marks // n_words ELSE 0 END AS marks,
             CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length FROM m),
lv AS (UNPIVOT (SELECT lang, source, symbols, dup_lines, repeats, marks, word_length FROM f WHERE NOT base_failed)
       ON symbols, dup_lines, repeats, marks, word_length INTO NAME measure VALUE v),
b AS (SELECT lang, source, measure, CASE WHEN v < 128 THEN v ELSE ((v >> (len(bin(v)) - 7)::BIGINT) << (len(bin(v)) - 7)::BIGINT) END AS v FROM lv),
q1 AS (SELECT lang, source, measure, count(*) AS size, quantile_disc(v, 0.1) AS q10, quantile_disc(v, 0.5) AS q50 FROM b GROUP BY ALL),
q2 AS (SELECT lang, measure, count(*) AS size, quantile_disc(v, 0.1) AS q10, quantile_disc(v, 0.5) AS q50 FROM b GROUP BY ALL),
q3 AS (SELECT measure, count(*) AS size, quantile_disc(v, 0.1) AS q10, quantile_disc(v, 0.5) AS q50 FROM b GROUP BY ALL),
s AS (SELECT * FROM (VALUES ('symbols', 500), ('dup_lines', 5000), ('repeats', 4500), ('marks', 3000), ('word_length', 300)) AS t(measure, slack)),
fe AS (SELECT q1.lang, q1.source, q1.measure, slack,
              CASE WHEN q1.size >= 200 THEN q1.q10 WHEN q2.size >= 200 THEN q2.q10 ELSE q3.q10 END AS q10,
              CASE WHEN q1.size >= 200 THEN q1.q50 WHEN q2.size >= 200 THEN q2.q50 ELSE q3.q50 END AS q50
       FROM q1 JOIN q2 ON q1.lang IS NOT DISTINCT FROM q2.lang AND q1.measure = q2.measure JOIN q3 ON q1.measure = q3.measure JOIN s ON q1.measure = s.measure),
wd AS (SELECT lang, source, max(hi) FILTER (measure = 'symbols') AS hs, max(hi) FILTER (measure = 'dup_lines') AS hd,
              max(hi) FILTER (measure = 'repeats') AS hr, max(hi) FILTER (measure = 'marks') AS hm,
              max(hi) FILTER (measure = 'word_length') AS hw, max(lo) FILTER (measure = 'word_length') AS lw
       FROM (SELECT *, q50 + 6 * (q50 - q10) + slack AS hi, q50 - 6 * (q50 - q10) - slack AS lo FROM fe) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbols <= hs AND dup_lines <= hd AND repeats <= hr AND marks <= hm AND word_length BETWEEN lw AND hw, true) AS kept
FROM f LEFT JOIN wd ON f.lang IS NOT DISTINCT FROM wd.lang AND f.source IS NOT DISTINCT FROM wd.source
"""


@query("op6_quality", OP6_SQL)
def op6_quality(spark, sf_dir):
    return (_quality.judge(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


@query("op7_pii")
def op7_pii(spark, sf_dir):
    return _pii.scan(_table(spark, sf_dir, "documents"))


@query("op10_classifier")
def op10_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return _gam.score(docs, _gam.train(docs, _table(spark, sf_dir, "labels")))


OP8_SQL = """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM r q JOIN r c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query("op8_topk", OP8_SQL)
def op8_topk(spark, sf_dir):
    return _topk.top_k(_table(spark, sf_dir, "embeddings"))


@query("op4_license")
def op4_license(spark, sf_dir):
    return _license.scan(_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rk, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rk, array_to_string(w[i:i + 4], ' ') AS g FROM
      (SELECT rk, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rk, count(*) AS n FROM s GROUP BY rk),
o AS (SELECT a.rk AS a, b.rk AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rk < b.rk GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.rk = a JOIN n y ON y.rk = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rk AS a, rk AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(x.doc_id) AS component_id
FROM d LEFT JOIN n USING (rk) JOIN r ON r.a = d.rk JOIN d x ON x.rk = r.b GROUP BY d.rk, d.doc_id
"""


@query("op9_ngram_join", OP9_SQL)
def op9_ngram_join(spark, sf_dir):
    return _ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rk, doc_id, text,
                  list_filter(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))),
                              lambda x: regexp_matches(x[1], '[^\x20\x09-\x0D]')) AS lines FROM documents),
u AS (SELECT rk, unnest(lines) AS x, generate_subscripts(lines, 1) AS s FROM d),
l AS (SELECT rk, s, x[1] AS line, x[2] AS ln, len(regexp_extract_all(x[1], '[^\x20\x09-\x0D]+')) AS w FROM u),
p AS (SELECT b.rk, b.s, b.w, a.rk AS ark, b.s - a.s AS diag FROM l a JOIN l b ON a.line = b.line AND (a.rk, a.s) < (b.rk, b.s)),
i AS (SELECT *, s - row_number() OVER (PARTITION BY rk, ark, diag ORDER BY s) AS isle FROM p),
t AS (SELECT rk, s, sum(w) OVER (PARTITION BY rk, ark, diag, isle) AS words FROM i),
gone AS (SELECT DISTINCT rk, ln FROM t JOIN l USING (rk, s) WHERE words >= 50),
g AS (SELECT rk, list(ln) AS lns FROM gone GROUP BY rk)
SELECT doc_id, CASE WHEN lns IS NULL THEN text ELSE coalesce(list_aggregate(list_transform(list_filter(
           list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))), lambda x: NOT list_contains(lns, x[2])),
           lambda x: x[1]), 'string_agg', chr(10)), '') END AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lns), 0)::BIGINT AS n_removed
FROM d LEFT JOIN g USING (rk)
"""


@query("op3_line_dedup", OP3_SQL)
def op3_line_dedup(spark, sf_dir):
    return _linedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op11_sentencepiece")
def op11_sentencepiece(spark, sf_dir):
    docs = _piece_bpe.encode(_table(spark, sf_dir, "documents"), decoded=True)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def _op12_sql() -> str:
    """One list_reduce per conversation carries the cheapest (cost, audit, text) of the states z, s, u and a."""
    def way(state, cost, letter, row=None):
        text = f"{state}.o || chr(10) || {row}" if row else f"{state}.o"
        return f"{{'c': {state}.c + {cost}, 't': {state}.t || '{letter}', 'o': {text}}}"

    def least(*ways):
        return f"list_min([{', '.join(ways)}])"

    def insert(acc):
        return (f"{{'z': {acc}.z, 's': {acc}.s, 'u': {least(f'{acc}.u', *(way(f'{acc}.{x}', 2, 'I', chr(39) + 'user:' + chr(39)) for x in 'zsa'))}, "
                f"'a': {least(f'{acc}.a', way(f'{acc}.u', 2, 'I', chr(39) + 'assistant:' + chr(39)))}}}")

    def edit(x, initial, name):
        kept, given = "x.role || ':' || x.text", f"'{name}:' || x.text"
        return (f"CASE WHEN x.fault IN (1, 2) THEN {{'c': 1000000000::BIGINT, 't': '', 'o': ''}} WHEN x.initial = '{initial}' "
                f"THEN {way(x, 'x.pay', 'K', kept)} ELSE {way(x, '2 + x.pay', 'R', given)} END")

    def step(acc):
        keep_s = (f"CASE WHEN x.initial = 's' AND x.fault NOT IN (1, 2) THEN {way(f'{acc}.z', 'x.pay', 'K', 'x.role || chr(58) || x.text')} "
                  f"ELSE {{'c': 1000000000::BIGINT, 't': '', 'o': ''}} END")
        return (f"{{'z': {way(f'{acc}.z', 3, 'D')}, 's': {least(way(f'{acc}.s', 3, 'D'), keep_s)}, "
                f"'u': {least(way(f'{acc}.u', 3, 'D'), *(edit(f'{acc}.{y}', 'u', 'user') for y in 'zsa'))}, "
                f"'a': {least(way(f'{acc}.a', 3, 'D'), edit(f'{acc}.u', 'a', 'assistant'))}}}")

    def after(expr, fn, acc):
        return f"list_reduce([0], lambda {acc}, _{acc}: {fn(acc)}, {expr})"

    none = "{'c': 1000000000::BIGINT, 't': '', 'o': ''}"
    start = f"{{'z': {{'c': 0::BIGINT, 't': '', 'o': ''}}, 's': {none}, 'u': {none}, 'a': {none}}}"
    def ins(expr, p):
        return after(after(expr, insert, p), insert, p + "2")

    return rf"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, xor(list_reduce(string_split(key, ''), lambda h, ch: list_reduce(range(8), lambda g, _: xor(g >> 1, 3988292384 * (g & 1)),
                    xor(h, ascii(ch)::BIGINT)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
g AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN bare[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM f),
h AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
             count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             count(*) FILTER (prev IS NOT NULL AND prev || initial NOT IN ('su', 'ua', 'au')) AS illegal,
             list({{'role': role, 'text': text, 'initial': initial, 'fault': fault, 'pay': (fault = 3)::BIGINT}} ORDER BY i) AS rows
      FROM g GROUP BY conv_id),
r AS (SELECT * EXCLUDE (rows), {ins(f"list_reduce(rows, lambda b, x: {after(ins('b', 'p'), step, 'q')}, {start})", 'e')} AS w FROM h),
b AS (SELECT *, list_min([w.z, w.a]) AS best FROM r)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.t, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN b ON i.conv_id IS NOT DISTINCT FROM b.conv_id
"""


OP12_SQL = _op12_sql()


@query("op12_repair", OP12_SQL)
def op12_repair(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return _repair.repair(_repair.damage(rows), rows)


@query("op13_align")
def op13_align(spark, sf_dir):
    out = _align.score(_align.invert(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
