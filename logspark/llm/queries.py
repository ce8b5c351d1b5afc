"""Driver queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .conversations import damaged, repair_digests, repair_plans
from .dedup import exact_dedup
from .embedding_pairs import near_vectors
from .jaccard import near_components
from .langid import identify_languages
from .license_scan import scan_licenses
from .merkle import LEAF, fold, leaf_digest, manifest, proof_text
from .mixing import TARGETS, mix_plan
from .ngram_lm import score_documents
from .packing import pack_documents
from .quality import quality_verdicts
from .token_store import encode_documents
from .url_filter import url_verdicts


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables name no files: a document's place is its source, a folder of 100 ids, and its id
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.expr("cast(doc_id div 100 as string)"), F.col("doc_id").cast("string"))
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents"))


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents"), TARGETS)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # a document without doc_id has no decimal, and stays as it is
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = leaf_digest(*[F.when(hit, lower).otherwise(F.col(c)) if c == "text" else F.col(c) for c in LEAF])
    proofs = manifest(docs, carry={"doc_id": F.col("doc_id"), "shown": shown}).withColumn("folded_root", fold(F.col("shown"), F.col("path")))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dropped = damaged(read(spark, sf_dir, "conversations"))
    return repair_digests(rows, materialize(repair_plans(rows, others=dropped), "repairs"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_store": op2_token_store,
    "op3_url_filter": op3_url_filter,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_lm": op9_ngram_lm,
    "op10_source_mix": op10_source_mix,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

#: SQL of the unsigned crc32 of an ASCII text.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""
#: SQL of a leaf: each value as `-`, or its UTF-8 bytes, `:` and itself.
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op3_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
        ), rules(verdict, rhost, rpath) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), hits AS (
            SELECT page_id, rhost || rpath AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS place
            FROM parts, rules
            WHERE (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
        )
        SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND h.place = 1""",
    # weights to parts of the period by largest remainders, then a slot at a time: of the released blocks the one with the earliest deadline
    "op10_source_mix": r"""
        WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, chr(0)) AS s FROM documents),
        sizes AS (SELECT s, count(*) AS n FROM docs GROUP BY s),
        named AS (SELECT s, w FROM (VALUES ('src0', 0.20::DOUBLE), ('src1', 0.10::DOUBLE), ('src2', 0.05::DOUBLE)) t(s, w) SEMI JOIN sizes USING (s)),
        free AS (SELECT s, sqrt(n::DOUBLE) AS w FROM sizes ANTI JOIN named USING (s)),
        spare AS (SELECT CASE WHEN count(*) > 0 AND sum(w) < 1 THEN 1 - sum(w) ELSE 1 END AS x FROM named),
        weights AS (SELECT s, w FROM named UNION ALL SELECT s, w * (SELECT x FROM spare) / (SELECT sum(w) FROM free) FROM free),
        period AS (SELECT greatest(1000, 2 * count(*)) AS d, count(*) AS m FROM weights),
        exact AS (SELECT s, w * (SELECT d - m FROM period) / (SELECT sum(w) FROM weights) AS e FROM weights),
        parts AS (
            SELECT s, (1 + floor(e) + CASE WHEN row_number() OVER (ORDER BY floor(e) - e, s) <= (SELECT d - m FROM period) - sum(floor(e)) OVER () THEN 1 ELSE 0 END)::BIGINT AS p
            FROM exact),
        lists AS (SELECT list(p ORDER BY s) AS p, list(s ORDER BY s) AS names, count(*) AS m, sum(p)::BIGINT AS d FROM parts),
        edf AS (
            SELECT -1::BIGINT AS t, list_transform(p, lambda x: 0::BIGINT) AS had, 0::BIGINT AS pick, 0::BIGINT AS k FROM lists
            UNION ALL
            SELECT t + 1, list_transform(range(1, m + 1), lambda j: had[j] + CASE WHEN j = best % 100000 THEN 1 ELSE 0 END), best % 100000, had[best % 100000]
            FROM (
                SELECT t, had, p, m, d, list_min(list_transform(range(1, m + 1), lambda j:
                    CASE WHEN had[j] < p[j] AND had[j] * d // p[j] <= t + 1 THEN ((had[j] + 1) * d + p[j] - 1) // p[j] * 100000 + j END)) AS best
                FROM edf, lists WHERE t + 1 < d)
        ),
        slots AS (SELECT names[pick] AS s, k, t, p[pick] AS w, d, k * d // p[pick] AS r, ((k + 1) * d + p[pick] - 1) // p[pick] AS e FROM edf, lists WHERE t >= 0),
        horizon AS (SELECT min(n // 4 // w * d + t) AS h FROM slots JOIN sizes USING (s) WHERE k = n // 4 % w),
        ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY ('0x' || substr(md5(doc_id || '/17'), 1, 15))::BIGINT, doc_id) - 1 AS rank FROM docs)
        SELECT r.doc_id, nullif(r.s, chr(0)) AS source, l.w::INTEGER AS weight, rank // 4 AS block, rank // 4 // l.w * l.d + l.t AS slot, rank // 4 // l.w * l.d + l.r AS release,
               rank // 4 // l.w * l.d + l.e AS deadline, rank % 4 AS place, rank // 4 // l.w * l.d + l.t < (SELECT h FROM horizon) AS on_target
        FROM ranked r JOIN slots l ON l.s = r.s AND l.k = rank // 4 % l.w""",
    # levels by recursion; a proof's siblings are looked up by the leaf's place
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format(text="text")} AS d,
                   CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 5 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF.format(text="text")} END AS shown
            FROM documents
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
        up(tree, k, i, n, d) AS (
            SELECT tree, 0, i, n, d FROM placed
            UNION ALL
            SELECT tree, k + 1, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, k, i // 16, n
        ), subs AS (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
        top(k, i, n, d) AS (
            SELECT 0, i, n, d FROM subs
            UNION ALL
            SELECT k + 1, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 16, n
        ), heights AS (SELECT tree, max(k) AS h FROM up GROUP BY tree),
        path AS (
            SELECT p.tree, p.i, u.k, string_agg(u.d, '' ORDER BY u.i) FILTER (u.i < p.i // (16 ** u.k)::BIGINT) AS l, string_agg(u.d, '' ORDER BY u.i) FILTER (u.i > p.i // (16 ** u.k)::BIGINT) AS r
            FROM placed p JOIN up u ON u.tree = p.tree AND u.n > 1 AND u.i // 16 = p.i // (16 ** (u.k + 1))::BIGINT GROUP BY p.tree, p.i, u.k
            UNION ALL
            SELECT p.tree, p.i, h.h + t.k, string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < s.i // (16 ** t.k)::BIGINT), string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > s.i // (16 ** t.k)::BIGINT)
            FROM placed p JOIN subs s USING (tree) JOIN heights h USING (tree) JOIN top t ON t.n > 1 AND t.i // 16 = s.i // (16 ** (t.k + 1))::BIGINT GROUP BY p.tree, p.i, h.h, t.k
        ), folds(tree, i, k, d) AS (
            SELECT tree, i, 0, shown FROM placed
            UNION ALL
            SELECT f.tree, f.i, f.k + 1, sha256(coalesce(p.l, '') || f.d || coalesce(p.r, '')) FROM folds f JOIN path p ON p.tree = f.tree AND p.i = f.i AND p.k = f.k
        ), ends AS (SELECT tree, i, arg_max(d, k) AS d FROM folds GROUP BY tree, i),
        proofs AS (SELECT tree, i, string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY k) AS t FROM path GROUP BY tree, i),
        root AS (SELECT d FROM top WHERE n = 1)
        SELECT p.doc_id, p.d AS leaf, s.d AS subroot, root.d AS root, sha256(coalesce(q.t, '')) AS proof_sha256, e.d AS folded_root, e.d = root.d AS verified
        FROM placed p JOIN subs s USING (tree) JOIN ends e ON e.tree = p.tree AND e.i = p.i LEFT JOIN proofs q ON q.tree = p.tree AND q.i = p.i, root""",
    # best edits of each rest of a conversation, as text: eight digits of cost, then the audit; v[1..4]: after nothing, system, user, assistant
    "op12_conversation_repair": f"""
        WITH RECURSIVE source AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations
        ), hurt AS (
            SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM source, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
            FROM hurt
        ), judged AS (
            SELECT *, left(role, 1) AS c, CASE WHEN t = '' THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
            FROM placed
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM judged GROUP BY conv_id
        ), best(conv_id, i, v) AS (
            SELECT conv_id, n, ['00000000', '00000006II', '00000003I', '00000000'] FROM counts
            UNION ALL
            SELECT conv_id, i - 1, list_transform(range(1, 5), lambda q: list_min(list_transform(
                [{{'c': 0, 'l': '', 'v': w[q]}}, {{'c': 3, 'l': 'I', 'v': w[[3, 3, 4, 3][q]]}}, {{'c': 6, 'l': 'II', 'v': w[[4, 4, 3, 4][q]]}}],
                lambda e: printf('%08d', left(e.v, 8)::BIGINT + e.c) || e.l || substr(e.v, 9))))
            FROM (
                SELECT b.conv_id, b.i, list_transform(range(1, 5), lambda q: list_min(list_transform(list_filter([
                    {{'c': 4, 'l': 'D', 'v': b.v[q], 'ok': true}},
                    {{'c': 3 + x, 'l': 'R', 'v': b.v[[3, 3, 4, 3][q]], 'ok': stays}},
                    {{'c': x, 'l': 'K', 'v': b.v[CASE j.c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END], 'ok': stays AND ((q = 1 AND j.c = 's') OR (q <> 3 AND j.c = 'u') OR (q = 3 AND j.c = 'a'))}}],
                    lambda e: e.ok), lambda e: printf('%08d', left(e.v, 8)::BIGINT + e.c) || e.l || substr(e.v, 9)))) AS w
                FROM best b JOIN (SELECT *, fault IN ('', 't') AS stays, CASE fault WHEN 't' THEN 3 ELSE 0 END AS x FROM judged) j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i)
        ), plans AS (SELECT conv_id, left(v[1], 8)::BIGINT AS cost, substr(v[1], 9) AS audit FROM best WHERE i = 0),
        letters AS (
            SELECT conv_id, pos, l, count(*) FILTER (l <> 'I') OVER w AS i, count(*) FILTER (l <> 'D') OVER w AS e
            FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS pos, unnest(string_split(audit, '')) AS l FROM plans WHERE audit <> '')
            WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
        ), edits AS (
            SELECT l.conv_id, l.pos, l.l, l.e, j.role, j.text, max(CASE WHEN l.e = 1 AND l.l = 'K' AND j.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s
            FROM letters l LEFT JOIN judged j ON l.l <> 'I' AND j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i WHERE l.l <> 'D'
        ), repaired AS (
            SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (e - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE l WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS t
            FROM edits GROUP BY conv_id)
        SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
               coalesce(p.cost, 0) AS cost, coalesce(p.audit, '') AS audit, sha256(coalesce(r.t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op13_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e,
                   label IS NOT NULL AND coalesce(len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
            FROM embeddings
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE a.usable AND b.usable AND list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
        SELECT r.x AS vec_id, (SELECT count(*) FROM links WHERE links.x = r.x) AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept FROM reach r GROUP BY r.x""",
}
