"""One query for each operator, over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from outrate.llm import alignment, cotraining, forest, huffman, packing, pii, quality_rules, ranked, repeats, secret_scan, tiling, urls, warc
from outrate.llm.common import LOWER, UPPER, read, ready, scratch_path
from outrate.llm.tokens import default_path, encoder


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.group(read(spark, sf_dir, "documents"))


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tokenizer = scratch_path(spark, "huffman"), default_path()
    huffman.write(read(spark, sf_dir, "documents"), path, tokenizer, end_id=2)
    return huffman.digests(spark, path, encoder(tokenizer).size)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), default_path(), end_id=1)


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cotraining.features(read(spark, sf_dir, "documents"))
    return cotraining.score(found, cotraining.train(found, read(spark, sf_dir, "labels")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(read(spark, sf_dir, "documents"), *alignment.default_paths())


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(read(spark, sf_dir, "documents")))


def _with_ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _with_ready(f) for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def _op7_sql() -> str:
    base = " OR ".join(r.sql() for r in quality_rules.BASE)
    more = " OR ".join(r.sql() for r in quality_rules.TABLE)
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    return f"""
    WITH w AS (
      SELECT doc_id, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
      FROM documents),
    win AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM w, unnest(range(1, len(ws) - 3)) AS r(i)),
    dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
    rep AS (SELECT doc_id, sum(k) AS k FROM (
        SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS k FROM dup) GROUP BY doc_id),
    c AS (
      SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
             coalesce(k, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           ({base}) AS base_failed, NOT (({base}) OR ({more})) AS kept
    FROM c"""


def _op1_sql() -> str:
    return f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
      FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE list_slice(ws, i, i + 4) END, ' ') AS g
      FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS r(i) WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    link AS (
      SELECT a, b FROM both_have JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
    least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id,
           w.doc_id <= coalesce(c.b, w.doc_id) AS kept
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_of AS c ON c.a = w.doc_id"""


#: The digest is regrouped from four bits a digit to five.
_OP5 = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
    q AS (
      SELECT page_id, strlen(t)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY t) AS last_id,
             list_transform(string_split(h, ''), lambda c: instr('0123456789abcdef', c) - 1) AS d
      FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             (((d[i // 4 + 1] * 16 + coalesce(d[i // 4 + 2], 0)) >> (3 - i % 4)) & 31) + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last_id THEN last_id END AS refers_to
    FROM q"""

#: Windows of 200 bytes, 400 hexadecimal digits, are told apart by their md5; every text is cut into blocks only to read them sooner.
_OP8 = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    block AS (SELECT doc_id, c, substr(h, 2 * c + 1, 800) AS x FROM d, unnest(range(0, length(h) // 2 - 199, 200)) AS r(c)),
    win AS (SELECT doc_id, c + i AS i, md5(substr(x, 2 * i + 1, 400)) AS s FROM block, unnest(range(0, least(200, length(x) // 2 - 199))) AS r(i)),
    hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
    mark AS (SELECT doc_id, i, (i > coalesce(lag(i) OVER w + 200, -1))::INT AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mark),
    span AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY ALL),
    cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM span),
    part AS (
      SELECT doc_id, a AS pos, substr(h, 2 * p + 1, 2 * (a - p)) AS h, b - a AS n FROM cut JOIN d USING (doc_id)
      UNION ALL
      SELECT doc_id, 1e18::BIGINT, substr(h, 2 * coalesce(b, 0) + 1), 0 FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM span GROUP BY doc_id) USING (doc_id))
    SELECT doc_id, (length(any_value(d.h)) // 2)::BIGINT AS n_bytes, sum(n)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans,
           sha256(unhex(string_agg(part.h, '' ORDER BY pos))) AS kept_sha256
    FROM part JOIN d USING (doc_id) GROUP BY doc_id"""


def _op12_sql() -> str:
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ts FROM documents),
    c AS (SELECT count(*)::BIGINT AS docs, sum(len(ts))::BIGINT AS every FROM d WHERE len(ts) > 0),
    n AS (SELECT r, doc_id, 25 + (75 * len(ts)::HUGEINT * docs) // every AS m FROM d, c WHERE len(ts) > 0),
    tf AS (SELECT r, term, count(*)::HUGEINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
    q AS (SELECT k, item_id, term, count(*)::HUGEINT AS times FROM (
        SELECT k, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS k, item_id, {terms} AS ts FROM benchmark)) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::HUGEINT AS w FROM tf, c GROUP BY term, docs),
    s AS (SELECT k, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r) GROUP BY ALL)
    SELECT item_id, (row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op12_ranked_search": _op12_sql(), "op1_minhash_forest": _op1_sql(), "op5_warc": _OP5, "op7_quality_rules": _op7_sql(), "op8_repeated_bytes": _OP8}
