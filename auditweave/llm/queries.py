"""The queries of the corpus operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_extract, language, packing, pii, quality, rans, sharding, simhash, structure, substring, trie
from .common import table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is on this machine; its package is at the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, distance=4)


def op3_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels"), cut=0.3))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), "words", capacity=2048, end=0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"), window=35)


def op7_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), "spaced", end=0)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs, folds=4, held_out=2), folds=4, held_out=2)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(*trie.rebuild(table(spark, sf_dir, "conversations"), group=5, most=9))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair(structure.damage(table(spark, sf_dir, "conversations"), one_in=20))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_simhash_near_dedup,
        op3_quality_ranker,
        op4_jump_sharding,
        op5_best_fit_packing,
        op6_substring_dedup,
        op7_rans_tokens,
        op8_pii_pseudonyms,
        op9_benchmark_decontamination,
        op10_exact_dedup,
        op11_language_id,
        op12_prefix_trie,
        op13_structure_repair,
    )
}

def crc32_sql(text: str) -> str:
    """SQL for crc32 of an ASCII string, bit by bit."""
    byte = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def wrapped(product: str) -> str:
    """SQL for what unsigned 64-bit arithmetic leaves of a product of unsigned numbers."""
    return f"(({product}) % 18446744073709551616::UHUGEINT)"


ORACLE_SQL: dict[str, str] = {
    "op4_jump_sharding": f"""
        WITH RECURSIVE steps AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) AS v
                                                                      FROM range(256) r(n))),
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h FROM documents),
        sized AS (SELECT r, doc_id, strlen(x) + 16 AS size,
                         xor(list_reduce(list_concat([4294967295], list_transform(range(1, 2 * strlen(x), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                                         lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS crc FROM d, steps),
        z0 AS (SELECT r, ((coalesce(doc_id, -9223372036854775808)::HUGEINT + 18446744073709551616 + 11400714819323198485) % 18446744073709551616)::UHUGEINT AS z FROM d),
        z1 AS (SELECT r, {wrapped("xor(z, z >> 30) * 13787848793156543929::UHUGEINT")} AS z FROM z0),
        z2 AS (SELECT r, {wrapped("xor(z, z >> 27) * 10723151780598845931::UHUGEINT")} AS z FROM z1),
        jumps AS (
            SELECT r, shards, xor(z, z >> 31) AS key, 0::BIGINT AS spot FROM z2, (VALUES (40), (41)) s(shards)
            UNION ALL
            SELECT r, shards, key, next FROM (
                SELECT r, shards, key, floor((spot + 1) * (2147483648::DOUBLE / ((key >> 33)::DOUBLE + 1)))::BIGINT AS next FROM (
                    SELECT r, shards, {wrapped("key * 2862933555777941757::UHUGEINT + 1")} AS key, spot FROM jumps)) WHERE next < shards),
        placed AS (SELECT r, max(spot) FILTER (shards = 40) AS shard, max(spot) FILTER (shards = 41) AS grown FROM jumps GROUP BY r)
        SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS slot, grown::INT AS grown_shard
        FROM sized JOIN placed USING (r)
    """,
    "op6_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS t FROM d, unnest(range(1, greatest(len(w) - 34, 0) + 1)) u(i)),
        again AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
        hit AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM windows SEMI JOIN again USING (t))),
        kept AS (SELECT d.r, string_agg(w[j], ' ' ORDER BY j) AS t FROM d, unnest(range(1, len(w) + 1)) u(j) WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.r = d.r AND hit.j = u.j) GROUP BY d.r)
        SELECT doc_id, len(w) AS n_words, (SELECT count(*) FROM hit WHERE hit.r = d.r) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
    """,
    "op9_benchmark_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        items AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS t FROM (SELECT item, w, least(10, len(w)) AS m FROM b), unnest(range(1, len(w) - m + 2)) u(i) WHERE m > 0),
        found AS (SELECT DISTINCT r, p, items.m, item FROM (SELECT r, p, m, array_to_string(w[p : p + m - 1], ' ') AS t FROM d, (SELECT DISTINCT m FROM items) k, unnest(range(1, greatest(len(w) - m + 1, 0) + 1)) u(p)) x JOIN items ON items.m = x.m AND items.t = x.t),
        hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(p, p + m)) AS j FROM found) GROUP BY r),
        named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(named.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p,
                          coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS b, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        rebuilt AS (SELECT c, 0 AS own, p, r, x FROM c JOIN t ON t.conv_id = b AND p <= h UNION ALL SELECT c, 1, p, r, x FROM c JOIN t ON t.conv_id = c AND p > h),
        seq AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, r, x FROM rebuilt),
        pre AS (SELECT c, d, list({{'r': r, 'x': x}}) OVER (PARTITION BY c ORDER BY d) AS k, strlen(x) AS bytes FROM seq UNION ALL SELECT c, 0, [], 0 FROM c),
        owned AS (SELECT c, d, bytes, min(c) OVER (PARTITION BY d, k) AS o, count(*) OVER (PARTITION BY d, k) AS n, max(d) OVER (PARTITION BY c) AS last FROM pre),
        nodes AS (SELECT o, d, any_value(n) AS n, any_value(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last) AS ends FROM owned GROUP BY o, d),
        linked AS (SELECT nodes.*, up.o AS parent FROM nodes LEFT JOIN owned up ON up.c = nodes.o AND up.d = nodes.d - 1),
        kids AS (SELECT parent AS o, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY parent, d),
        sums AS (SELECT top.o, top.d, count(*) FILTER (kids.o IS NULL) AS n_leaves, sum((linked.n - 1) * linked.bytes) AS saved
                 FROM linked JOIN owned top ON top.c = linked.o AND top.d <= linked.d LEFT JOIN kids ON kids.o = linked.o AND kids.d = linked.d GROUP BY top.o, top.d)
        SELECT linked.o AS conv_id, linked.d AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
               saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
        FROM linked JOIN sums ON sums.o = linked.o AND sums.d = linked.d LEFT JOIN kids ON kids.o = linked.o AND kids.d = linked.d
    """,
    "op13_structure_repair": f"""
        WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x,
                                      {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
        damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS r,
                           CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x
                    FROM raw, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(x)) AS i, left(r, 1) AS ini FROM damaged),
        t AS (SELECT *, lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS after, row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) AS nth FROM placed),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(x, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(x, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM t),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                          count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (ini || after NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
        step(q, w, nq) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        adds(q, letters, cost, names, nq) AS (VALUES (0, '', 0, [], 0), (1, '', 0, [], 1), (2, '', 0, [], 2), (3, '', 0, [], 3), (0, 'I', 5, ['user'], 2), (1, 'I', 5, ['user'], 2), (3, 'I', 5, ['user'], 2),
                (2, 'I', 5, ['assistant'], 3), (0, 'II', 10, ['user', 'assistant'], 3), (1, 'II', 10, ['user', 'assistant'], 3), (3, 'II', 10, ['user', 'assistant'], 3), (2, 'II', 10, ['assistant', 'user'], 2)),
        walk AS (
            SELECT conv_id, 0 AS q, 0::BIGINT AS i, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM counts
            UNION ALL
            SELECT w.conv_id, e.nq, w.i + 1, min({{'cost': w.best.cost + a.cost + e.cost, 'audit': w.best.audit || a.letters || e.letter,
                       'lines': list_concat(w.best.lines, list_transform(a.names, lambda z: z || ':'), CASE WHEN e.letter = 'D' THEN [] WHEN e.letter = 'K' THEN [f.r || ':' || f.x] ELSE [e.role || ':' || f.x] END)}})
            FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN adds a ON a.q = w.q,
                 LATERAL (SELECT a.nq AS nq, 2 AS cost, 'D' AS letter, '' AS role
                          UNION ALL SELECT step.nq, CASE WHEN f.fault = 3 THEN 5 ELSE 0 END, 'K', '' FROM step WHERE step.q = a.nq AND step.w = f.ini AND f.fault NOT IN (1, 2)
                          UNION ALL SELECT step.nq, CASE WHEN f.fault = 3 THEN 6 ELSE 1 END, 'R', CASE step.w WHEN 'u' THEN 'user' ELSE 'assistant' END FROM step
                                    WHERE step.q = a.nq AND step.w <> 's' AND f.fault NOT IN (1, 2)) e
            GROUP BY w.conv_id, e.nq, w.i),
        done AS (SELECT counts.conv_id, min({{'cost': w.best.cost + a.cost, 'audit': w.best.audit || a.letters, 'lines': list_concat(w.best.lines, list_transform(a.names, lambda z: z || ':'))}}) AS best
                 FROM counts JOIN walk w ON w.conv_id IS NOT DISTINCT FROM counts.conv_id AND w.i = counts.n JOIN adds a ON a.q = w.q AND a.nq IN (0, 3) GROUP BY counts.conv_id)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
    """,
}
