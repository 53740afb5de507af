"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact, html, language, licenses, near, neighbours, packing, periodic, shards, store, suffixes


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_read(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths: source, language and hundreds of doc_id stand for folders."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    folder = (F.col("doc_id") / 100).cast("long").cast("string")
    path = F.concat_ws("/", part("source"), part("lang"), folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return licenses.license_scan(files).withColumnRenamed("id", "doc_id")


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_read(spark, sf_dir, "documents"), n=40)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_read(spark, sf_dir, "documents")).drop("spans")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.mark(docs, items))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), length=4096, end=2).drop("ids")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.token_store(_read(spark, sf_dir, "documents"), end=1)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with periodic tails planted."""
    return periodic.digest(periodic.find_runs(periodic.plant(_read(spark, sf_dir, "documents"))))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), every=50, k=5)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with faults planted, repaired."""
    own = _read(spark, sf_dir, "conversations")
    return conversations.digest(own, *conversations.repair(conversations.damage(own)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_minimax_shards": op2_minimax_shards,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_html_text": op5_html_text,
    "op6_hilbert_packing": op6_hilbert_packing,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_token_store": op8_token_store,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_conversation_repair": op13_conversation_repair,
}

#: CRC-32 of a column of ASCII text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: A text's words, its A-Z in lower case.
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY text) AS keep_id,
               count(*) OVER (PARTITION BY text) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text) AS kept,
               sha256(text) AS text_sha256
        FROM t
    """,
    "op4_decontamination": rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce({_WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}, []) AS ws FROM documents),
          b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS ws FROM benchmark WHERE text IS NOT NULL),
          starts AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
          wins AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM starts),
          places AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM wins) ON len(ws) >= n),
          met AS (SELECT rid, i, p.n, item_id FROM places p JOIN wins w ON w.n = p.n AND w.win = array_to_string(p.ws[p.i:p.i + p.n - 1], ' ')),
          hit AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS place FROM met) GROUP BY 1),
          item AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM met) GROUP BY 1)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (rid) LEFT JOIN item USING (rid)
    """,
    "op7_minhash_near_dedup": rf"""
        WITH RECURSIVE t AS (SELECT doc_id, coalesce({_WORDS.format(r"[^\x20\x09-\x0D]+")}, []) AS ws FROM documents),
          s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM t WHERE len(ws) > 0)),
          n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
          p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
          l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
          e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
          r AS (SELECT doc_id AS node, doc_id AS goal FROM t UNION SELECT node, b FROM r JOIN e ON goal = a),
          m AS (SELECT node, min(goal) AS component_id FROM r GROUP BY 1)
        SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
        FROM t JOIN m ON node = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
    """,
    "op11_periodic_runs": rf"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS rid, {_CRC.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
          m AS (SELECT *, len(w) AS n, h // 10 AS g, doc_id IS NOT NULL AND h % 10 = 0 AND len(w) > 0 AS planted FROM t),
          o AS (SELECT *, CASE WHEN planted THEN g % n ELSE n END AS a FROM m),
          p AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM o),
          words AS (SELECT rid, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p WHERE n > 0)),
          grams AS (SELECT rid, i, word || ' ' || lead(word) OVER v || ' ' || lead(word, 2) OVER v || ' ' || lead(word, 3) OVER v || ' ' || lead(word, 4) OVER v AS gram FROM words WINDOW v AS (PARTITION BY rid ORDER BY i)),
          met AS (SELECT a.rid, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.rid = b.rid AND a.gram = b.gram AND a.i < b.i),
          isles AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM met),
          spans AS (SELECT rid, q, min(i) AS start, count(*) + 4 + q AS length FROM isles GROUP BY rid, q, isle),
          runs AS (SELECT rid, start, length, min(q) AS period FROM spans WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
          told AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1),
          best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
          gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
          texts AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (rid, i) GROUP BY 1)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
          sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
        FROM t LEFT JOIN told USING (rid) LEFT JOIN best USING (rid) LEFT JOIN texts USING (rid)
    """,
    "op12_nearest_neighbours": """
        WITH t AS (SELECT vec_id, row_number() OVER () AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
          p AS (SELECT q.vec_id AS query_id, q.r AS query_row, c.vec_id, c.r, list_cosine_similarity(q.v, c.v) AS score FROM t q JOIN t c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
          n AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id NULLS LAST, r) AS rank FROM p)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM n WHERE rank <= 5
    """,
    "op13_conversation_repair": rf"""
        WITH RECURSIVE hurt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_CRC.format("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
          kept AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hurt WHERE k <> 0),
          sorted AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS role_before,
            rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
          told AS (SELECT *, shown = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM sorted),
          faults AS (SELECT *, substr(role, 1, 1) AS i, blank OR again AS must, CASE WHEN blank THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(shown, '[.!?]$') THEN 3 ELSE 0 END AS fault FROM told),
          walk AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS n, [{{'c': CAST(0 AS BIGINT), 'a': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}}] AS s
            FROM (SELECT DISTINCT conv_id FROM faults)
            UNION ALL
            SELECT conv_id, n, [
              {{'c': c[1].c + 4, 'a': c[1].a || 'D'}},
              list_min([{{'c': c[2].c + 4, 'a': c[2].a || 'D'}}, {{'c': c[1].c + CASE WHEN must OR i <> 's' THEN 1000000000 ELSE t END, 'a': c[1].a || 'K'}}]),
              list_min([{{'c': c[3].c + 4, 'a': c[3].a || 'D'}}] || list_transform([c[1], c[2], c[4]], lambda x: {{'c': x.c + t + CASE WHEN must THEN 1000000000 WHEN i = 'u' THEN 0 ELSE 3 END, 'a': x.a || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END}})),
              list_min([{{'c': c[4].c + 4, 'a': c[4].a || 'D'}}, {{'c': c[3].c + t + CASE WHEN must THEN 1000000000 WHEN i = 'a' THEN 0 ELSE 3 END, 'a': c[3].a || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END}}])] AS s
            FROM (SELECT w.conv_id, f.n, f.must, f.i, CASE f.fault WHEN 3 THEN 3 ELSE 0 END AS t, [w.s[1], w.s[2],
                list_min([w.s[3]] || list_transform([w.s[1], w.s[2], w.s[4]], lambda x: {{'c': x.c + 3, 'a': x.a || 'I'}})),
                list_min([w.s[4], {{'c': w.s[3].c + 3, 'a': w.s[3].a || 'I'}}] || list_transform([w.s[1], w.s[2]], lambda x: {{'c': x.c + 6, 'a': x.a || 'II'}}))] AS c
              FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1)),
          best AS (SELECT conv_id, list_min([s[1], s[4], {{'c': s[3].c + 3, 'a': s[3].a || 'I'}}, {{'c': s[2].c + 6, 'a': s[2].a || 'II'}}]) AS b FROM walk
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
          letters AS (SELECT conv_id, unnest(string_split(b.a, '')) AS e, unnest(range(1, len(b.a) + 1)) AS pos FROM best),
          placed AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS n, count(*) FILTER (WHERE e <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
          met AS (SELECT p.*, f.role, f.text, f.i FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n AND p.e <> 'I'),
          begins AS (SELECT conv_id, min(pos) FILTER (WHERE e <> 'D') AS p0 FROM met GROUP BY 1),
          system AS (SELECT m.conv_id, count(*) AS x FROM met m JOIN begins b ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND m.pos = b.p0 WHERE e = 'K' AND i = 's' GROUP BY 1),
          lines AS (SELECT m.conv_id, pos, CASE WHEN e = 'K' THEN role WHEN (place + coalesce(x, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
            FROM met m LEFT JOIN system y ON y.conv_id IS NOT DISTINCT FROM m.conv_id WHERE e <> 'D'),
          hashes AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS h FROM lines GROUP BY 1),
          sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
            count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE role_before IS NOT NULL AND substr(role_before, 1, 1) || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1)
        SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
          coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM v.conv_id
          LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM v.conv_id
    """,
}
