"""Registered queries of the corpus operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlow.llm import bpe, conversations, decontaminate, jaccard_join, langid, maxscore, merkle, ngram_lm, quality, sharding, suffix_dedup, toxicity, urlfilter
from marlow.llm.common import spread
from marlow.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = urlfilter.mine(urlfilter.labels_of_pages(pages, table(spark, sf_dir, "labels")))
    return urlfilter.judge(pages, rules)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return ngram_lm.score(docs, ngram_lm.train(docs))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_map(documents(spark, sf_dir), tokenizer_path(), bpe.digests, bpe.DIGESTS)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_splitters(table(spark, sf_dir, "documents"))


def op11_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search_divisible(spread(table(spark, sf_dir, "embeddings")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(spread(table(spark, sf_dir, "conversations")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(documents(spark, sf_dir))


#: crc32 of an ASCII string column in SQL, by a table of 256 entries made from the polynomial.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc_of(text: str) -> str:
    """SQL of the crc32 of ``text``, where ``crc`` is in the FROM clause."""
    return (
        f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[CAST(i AS BIGINT)])::UBIGINT)), "
        "lambda c, b: xor(c >> 8, crc.t[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295::UBIGINT)"
    )


def _plus(v: str, cost: int | str, letters: str) -> str:
    """SQL: ``v`` (six digits of cost, then an audit) with ``letters`` before it at a cost."""
    return f"(lpad(CAST(CAST(left({v}, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || '{letters}' || substr({v}, 7))"


_SPEAKS = (2, 2, 3, 2)
_KEEPS = {0: "CASE initial WHEN 's' THEN v1 WHEN 'u' THEN v2 END", 1: "CASE initial WHEN 'u' THEN v2 END", 2: "CASE initial WHEN 'a' THEN v3 END", 3: "CASE initial WHEN 'u' THEN v2 END"}
_TAKEN = ", ".join(
    f"least({_plus(f'v{s}', 4, 'D')}, CASE WHEN fault < 2 THEN {_plus(_KEEPS[s], '3 * fault', 'K')} END, CASE WHEN fault < 2 THEN {_plus(f'v{_SPEAKS[s]}', '3 + 3 * fault', 'R')} END) AS c{s}" for s in range(4)
)
_SPOKEN = ", ".join(f"least(c{s}, {_plus(f'c{_SPEAKS[s]}', 3, 'I')}, {_plus(f'c{_SPEAKS[_SPEAKS[s]]}', 6, 'II')}) AS v{s}" for s in range(4))

QUERIES = {n: f for n, f in vars(sys.modules[__name__]).items() if n.startswith("op") and callable(f)}
ORACLES: dict[str, str] = {
    "op7_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\v\\f]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
        ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS t FROM w),
k AS (SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY t)) AS h, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT h, min(doc_id) AS first_id, any_value(n) AS n FROM k GROUP BY h),
r AS (SELECT s.doc_id, t FROM s JOIN c ON s.doc_id = c.first_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM r a JOIN r b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN c cx ON x = cx.first_id JOIN c cy ON y = cy.first_id WHERE common >= 0.8 * (cx.n + cy.n - common) - 1e-9),
reach(x, y) AS (SELECT first_id, first_id FROM c UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
m AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
g AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, coalesce(c.first_id, d.doc_id) AS copy_of, coalesce(g.n_links, 0) AS n_links
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN c ON k.h = c.h LEFT JOIN m ON m.x = c.first_id LEFT JOIN g ON g.x = c.first_id
""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM n WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > first),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
           SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (
             SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit))
         GROUP BY doc_id, r),
kept AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
parts AS (SELECT k.doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last,
                 sum(b - a) AS removed, count(*) AS spans
          FROM kept k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN parts p ON n.doc_id = p.doc_id
""",
    "op11_maxscore": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 20
""",
    "op12_conversation_repair": rf"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_of("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc),
h AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM h),
r AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
        WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
w AS (SELECT conv_id, count(*) + 1 AS i, '000000' AS v0, '000006II' AS v1, '000003I' AS v2, '000000' AS v3 FROM r GROUP BY conv_id
      UNION ALL
      SELECT conv_id, i, {_SPOKEN} FROM (SELECT w.conv_id, r.i, {_TAKEN} FROM w JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i - 1)),
b AS (SELECT conv_id, CAST(left(v0, 6) AS BIGINT) AS cost, substr(v0, 7) AS audit FROM w WHERE i = 1),
x AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, audit FROM b),
e AS (SELECT conv_id, k, audit[k] AS edit, k - length(replace(left(audit, k), 'I', '')) AS inserts, length(replace(left(audit, k), 'D', '')) AS spoken FROM x),
j AS (SELECT e.*, r.role, r.text FROM e LEFT JOIN r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = e.k - e.inserts WHERE edit <> 'D'),
z AS (SELECT *, CASE WHEN first_value(CASE WHEN edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) = 1 THEN spoken - 1 ELSE spoken END AS place FROM j),
d AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS said FROM z GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN d ON c.conv_id IS NOT DISTINCT FROM d.conv_id
""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE {CRC_TABLE},
f AS (SELECT doc_id, lang, text, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
        CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head,
        {crc_of("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 AS hurt FROM documents, crc),
l AS (SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || CASE WHEN hurt THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END END) AS given FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
t AS (SELECT lang, 0 AS level, pos AS idx, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM r
      UNION ALL
      SELECT lang, level + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)), CAST(ceil(n / 8) AS BIGINT) FROM t WHERE n > 1 GROUP BY lang, level, idx // 8, n),
s AS (SELECT lang, level AS top, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place AS idx, subroot AS d, n FROM s
      UNION ALL
      SELECT level + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)), CAST(ceil(n / 8) AS BIGINT) FROM u WHERE n > 1 GROUP BY level, idx // 8, n),
p AS (SELECT r.lang, r.pos, g.k AS level, CASE WHEN g.k < s.top THEN pos // CAST(pow(8, g.k) AS BIGINT) ELSE place // CAST(pow(8, g.k - s.top) AS BIGINT) END AS at, g.k >= s.top AS over
      FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang, (SELECT unnest(range(0, 40)) AS k) g WHERE g.k < s.top + (SELECT max(level) FROM u)),
b AS (SELECT p.lang, p.pos, p.level, coalesce(string_agg(x.d, '' ORDER BY x.idx) FILTER (x.idx < p.at), '') AS before, coalesce(string_agg(x.d, '' ORDER BY x.idx) FILTER (x.idx > p.at), '') AS after
      FROM p JOIN (SELECT lang, level, idx, d, false AS over FROM t UNION ALL SELECT s.lang, s.top + u.level, u.idx, u.d, true FROM s, u) x
        ON p.lang IS NOT DISTINCT FROM x.lang AND p.level = x.level AND p.over = x.over AND x.idx // 8 = p.at // 8 GROUP BY p.lang, p.pos, p.level, p.at),
v AS (SELECT lang, pos, 0 AS level, given AS d FROM r UNION ALL SELECT v.lang, v.pos, v.level + 1, sha256(b.before || v.d || b.after) FROM v JOIN b ON v.lang IS NOT DISTINCT FROM b.lang AND v.pos = b.pos AND v.level = b.level),
q AS (SELECT lang, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM b GROUP BY lang, pos)
SELECT r.doc_id, r.leaf, s.subroot, z.d AS root, coalesce(q.proof, sha256('')) AS proof_sha256, v.d AS folded_root, v.d = z.d AS verified
FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT d FROM u WHERE n = 1) z ON true
JOIN v ON v.lang IS NOT DISTINCT FROM r.lang AND v.pos = r.pos AND v.level = s.top + (SELECT max(level) FROM u)
LEFT JOIN q ON q.lang IS NOT DISTINCT FROM r.lang AND q.pos = r.pos
""",
}
