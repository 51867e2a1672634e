"""The thin queries opN_<name> over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat, decontam, fertility, html, langid, licenses, merkle, packing, resample, simhash, topk, toxicity, whitening
from ..runtime import materialise


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n (null: -1)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversations(rows.unionByName(chat.probe(spark)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, vocabulary("byte_bpe_50k.tiktoken"), split_pattern(), {"<|endoftext|>": 50256})


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialise(fertility.measured(docs, vocabulary("byte_bpe_50k.tiktoken"), split_pattern(), vocabulary("piece_bpe_32k.model"), ["doc_id", "lang"]))
    return fertility.judge(rows)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs, fold(3).isin(0, 2))
    return langid.predict(docs, net, keep=["doc_id"]).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(4).isin(0, 1, 3))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resample.resample(docs, table(spark, sf_dir, "labels").where("quality = 1"), keep=["doc_id"])


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", ["doc_id"], changed={"text": lowered}, altered=fold(3) == 0)
    return rows.drop("path")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), components=32)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_simhash, op3_chat, op4_packing, op5_fertility, op6_language, op7_licenses, op8_html, op9_toxicity, op10_resampling, op11_topk, op12_merkle, op13_whitening)}


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s, least(len(w), 10) AS k
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS s
       FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT dw.rid, dw.i, dw.k, bw.item FROM dw JOIN bw USING (k, s)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

#: Characters that the default template adds to a turn beside role and text: both marks, the line end after the role.
CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(text) + len(regexp_extract_all(text, '<\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])')) AS size,
             lag(role, 1, '') OVER w AS before, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
v AS (SELECT *, (before = '' AND role IN ('system', 'user') AND nth = 1) OR (before = 'system' AND role = 'user') OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user') AS ok FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size + len(role) + 24) AS BIGINT) AS formatted_chars,
       bool_and(ok) AND bool_or(nth = n AND role = 'assistant') AS valid,
       coalesce(min_by('turn ' || (nth - 1) || ': ' || coalesce(nullif(role, ''), 'no role') || ' after ' || coalesce(nullif(before, ''), 'the start'), nth) FILTER (NOT ok),
                max(CASE WHEN nth = n AND role <> 'assistant' THEN 'ends with ' || coalesce(nullif(role, ''), 'no role') END)) AS error
FROM v GROUP BY conv_id
"""


TOPK_SQL = """
WITH e AS (SELECT row_number() OVER () AS uid, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, least(len(q.v), len(c.v)) + 1)]) AS BIGINT) AS score
      FROM e q JOIN e c ON q.uid <> c.uid WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def tree_sql(name: str, leaves: str, levels: int, fan: int = 8) -> list[str]:
    """Tables of a tree over leaves (g, idx, digest, now): <name>_n nodes of the last level, <name>_p leaves with what the fold from `now` gives and their siblings. A level more than a group needs leaves it as it is."""
    out = [f"{name}_n0 AS (SELECT g, idx, digest, count(*) OVER (PARTITION BY g) AS cnt FROM {leaves})", f"{name}_p0 AS (SELECT g, idx AS leaf_idx, idx, now AS acc, '' AS proof FROM {leaves})"]
    for k in range(levels):
        n, s = f"{name}_n{k}", f"{name}_s{k}"
        beside = lambda sign: f"coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx {sign} a.idx), '')"
        out += [
            f"{name}_n{k + 1} AS (SELECT g, idx // {fan} AS idx, CASE WHEN any_value(cnt) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE any_value(digest) END AS digest, (any_value(cnt) + {fan - 1}) // {fan} AS cnt FROM {n} GROUP BY g, {n}.idx // {fan})",
            f"{s} AS (SELECT a.g, a.idx, a.cnt, {beside('<')} AS l, {beside('>')} AS r FROM {n} a LEFT JOIN {n} b ON a.g IS NOT DISTINCT FROM b.g AND a.idx // {fan} = b.idx // {fan} AND a.idx <> b.idx GROUP BY a.g, a.idx, a.cnt)",
            f"{name}_p{k + 1} AS (SELECT p.g, p.leaf_idx, p.idx // {fan} AS idx, CASE WHEN s.cnt > 1 THEN sha256(s.l || p.acc || s.r) ELSE p.acc END AS acc, p.proof || s.l || s.r AS proof FROM {name}_p{k} p JOIN {s} s ON p.g IS NOT DISTINCT FROM s.g AND p.idx = s.idx)",
        ]
    return out + [f"{name}_n AS (SELECT * FROM {name}_n{levels})", f"{name}_p AS (SELECT * FROM {name}_p{levels})"]


def merkle_sql(levels: int = 9, top_levels: int = 3) -> str:
    """Trees of up to 8 ** levels documents a language and 8 ** top_levels languages; crc32 by its table of 256 remainders."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    digest = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    ctes = [
        "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))",
        f"d AS (SELECT doc_id, lang, {digest('text')} AS digest, {digest('low')} AS low, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) AS crc FROM (SELECT *, {LOWER.format('text')} AS low FROM documents), crc)",
        "leaves AS (SELECT doc_id, lang AS g, digest, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN low ELSE digest END AS now, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM d)",
        *tree_sql("f", "leaves", levels),
        "subroots AS (SELECT 0 AS g, g AS of, digest, digest AS now, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx FROM f_n)",
        *tree_sql("t", "subroots", top_levels),
    ]
    # the top path is folded from what the leaf's own tree gave, level by level
    steps = "f.acc"
    join = []
    for k in range(top_levels):
        steps = f"CASE WHEN s{k}.cnt > 1 THEN sha256(s{k}.l || {steps} || s{k}.r) ELSE {steps} END"
        join.append(f"JOIN t_s{k} s{k} ON s{k}.idx = u.idx // {8**k}")
    ctes.append(f"w AS (SELECT l.doc_id, l.digest AS leaf, u.digest AS subroot, (SELECT digest FROM t_n) AS root, sha256(f.proof || t.proof) AS proof_sha256, {steps} AS folded_root FROM leaves l JOIN f_p f ON l.g IS NOT DISTINCT FROM f.g AND l.idx = f.leaf_idx JOIN subroots u ON u.of IS NOT DISTINCT FROM l.g JOIN t_p t ON t.leaf_idx = u.idx {' '.join(join)})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT *, folded_root = root AS verified FROM w"


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": DECONTAMINATION_SQL, "op3_chat": CHAT_SQL, "op11_topk": TOPK_SQL, "op12_merkle": merkle_sql()}
