"""The operators bound to the given tables, each over its whole table, next to their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm import decontaminate, lexical, mixing, neardup, neighbours, parse_dedup, prefix_trie, quality, secrets, sharding, substring_dedup, token_counts, url_filter

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that also start earlier."""
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=20)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document so that sources of weights 3, 1, 2 share 150 % of all words."""
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"))
    mixed = mixing.mix_sources(sized, F.col("words"), key_cols=("doc_id",))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of nearly equal bytes."""
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", F.octet_length(text).alias("n_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    placed = sharding.shard_documents(narrow, 40, size=F.col("n_bytes"), key_cols=("doc_id", "hash"))
    return placed.select(
        "doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary of 50,257 entries."""
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=1024)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, and whether it is kept."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles overlap in 80 % of their union."""
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the item."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by rules and, where none fits, by the link graph."""
    return url_filter.judge_pages(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations with their members and subtrees."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that rank highest for every benchmark item."""
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_parse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 400-byte strings that start anywhere else too."""
    return parse_dedup.remove_repeated_strings(_table(spark, sf_dir, "documents"), length=400)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_source_mixing, op3_sharding, op4_token_counts, op5_nearest_neighbours, op6_quality,
        op7_near_duplicates, op8_decontamination, op9_url_filter, op10_secrets,
        op11_prefix_trie, op12_lexical_search, op13_parse_dedup,
    )
}


def _url_filter_sql() -> str:
    """The url filter's rules and its two flows, one CTE per step."""
    low = f"'{url_filter._UPPER}', '{url_filter._LOWER}'"
    fit = "NULL"
    for r in sorted(url_filter.RULES, key=lambda r: (len(r.name), r.name)):
        fit = f"CASE WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}|{r.verdict}' ELSE {fit} END"
    whole = " OR ".join(f"host = '{r.host}' OR ends_with(host, '.{r.host}')" for r in url_filter.RULES if r.path == "/" and r.verdict == "block")
    link = url_filter.LINK.replace("'", "''")
    steps = [f"score0 AS MATERIALIZED (SELECT flow, host, seed AS score FROM seeds)"]
    for k in range(url_filter.STEPS):
        steps.append(f"""moved{k} AS MATERIALIZED (
    SELECT e.flow, e.dst AS host, {url_filter.DAMPING}::DOUBLE * s.score * e.share AS score
    FROM score{k} s JOIN shares e ON e.flow = s.flow AND e.src = s.host),
score{k + 1} AS MATERIALIZED (
    SELECT flow, host, sum(score) AS score FROM (
        SELECT * FROM moved{k} UNION ALL
        SELECT flow, host, seed * (1.0::DOUBLE - coalesce((SELECT sum(score) FROM moved{k} m WHERE m.flow = seeds.flow), 0.0::DOUBLE)) FROM seeds)
    GROUP BY flow, host)""")
    chain = ",\n".join(steps)
    return f"""WITH cut AS (
    SELECT page_id, html, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
named AS (
    SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), {low}) AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS MATERIALIZED (SELECT page_id, html, host, path, {fit} AS fit FROM named),
links AS (
    SELECT host AS src, unnest(list_distinct(regexp_extract_all(translate(html, {low}), '{link}', 1))) AS dst
    FROM judged WHERE host <> ''),
counted AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY src, dst),
edges AS (
    SELECT 'trust' AS flow, src, dst, n FROM counted UNION ALL SELECT 'distrust', dst, src, n FROM counted),
shares AS MATERIALIZED (SELECT flow, src, dst, n / sum(n) OVER (PARTITION BY flow, src) AS share FROM edges),
mass AS (
    SELECT CASE WHEN {whole} THEN 'distrust' ELSE 'trust' END AS flow, host,
           (CASE WHEN {whole} THEN count(*) ELSE count(*) FILTER (ends_with(fit, '|allow')) END)::DOUBLE AS mass
    FROM judged WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (SELECT flow, host, mass / sum(mass) OVER (PARTITION BY flow) AS seed FROM mass WHERE mass > 0),
{chain},
of_host AS (
    SELECT host, coalesce(sum(score) FILTER (flow = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (flow = 'distrust'), 0) AS distrust
    FROM score{url_filter.STEPS} GROUP BY host)
SELECT page_id, j.host AS host, path, split_part(fit, '|', 1) AS rule,
       coalesce(split_part(fit, '|', 2), CASE WHEN distrust > {url_filter.FLOOR} AND distrust >= {url_filter.RATIO} * coalesce(trust, 0)
                THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN of_host o ON o.host = j.host"""


def _terms_sql(column: str) -> str:
    """List of a text's terms."""
    return f"regexp_extract_all(translate({column}, '{url_filter._UPPER}', '{url_filter._LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


LEXICAL_SQL = f"""WITH docs AS MATERIALIZED (
    SELECT row, doc_id, ts, len(ts) AS n FROM (SELECT row_number() OVER () AS row, doc_id, {_terms_sql('text')} AS ts FROM documents)
    WHERE len(ts) > 0),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
tf AS MATERIALIZED (
    SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(ts) AS t FROM docs) GROUP BY row, t),
weights AS (
    SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), whole),
asked AS (
    SELECT item, item_id, t, count(*) AS times
    FROM (SELECT row_number() OVER () AS item, item_id, unnest({_terms_sql('text')}) AS t FROM benchmark) GROUP BY item, item_id, t),
scored AS (
    SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN tf USING (t) JOIN weights USING (t) JOIN docs USING (row), whole GROUP BY item, item_id, row, doc_id)
SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 20"""

_CRC32_SQL = """xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda crc, byte:
    list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, byte)),
    4294967295::BIGINT), 4294967295)"""

TRIE_SQL = f"""WITH named AS (
    SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
told AS (
    SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS p FROM named),
ids AS MATERIALIZED (SELECT c, c - c % 100 AS block, {_CRC32_SQL} % 6 AS h FROM (SELECT DISTINCT c FROM told)),
rebuilt AS (
    SELECT ids.c, role, text, 0 AS own, p FROM ids JOIN told ON told.c = block AND p <= h UNION ALL
    SELECT told.c, role, text, 1, p FROM told JOIN ids USING (c) WHERE p > h),
grown AS (
    SELECT c, len(text) AS chars, row_number() OVER (PARTITION BY c ORDER BY own, p) AS depth,
           sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY own, p)) AS prefix
    FROM rebuilt),
rows AS MATERIALIZED (
    SELECT c, depth, chars, prefix, coalesce(lag(prefix) OVER last, '') AS parent, lead(prefix) OVER last IS NULL AS ends FROM grown
    WINDOW last AS (PARTITION BY c ORDER BY depth) UNION ALL
    SELECT c, 0, 0, '', NULL, c NOT IN (SELECT c FROM grown) FROM ids),
nodes AS MATERIALIZED (
    SELECT prefix, any_value(depth) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
    FROM rows GROUP BY prefix),
children AS (SELECT parent AS prefix, count(*) AS n_children FROM nodes GROUP BY parent),
added AS (
    SELECT rows.c, rows.depth, rows.prefix, coalesce((n_convs - 1) * nodes.chars, 0) AS saved,
           (nodes.prefix IS NOT NULL AND n_children IS NULL)::INT AS leaf
    FROM rows LEFT JOIN nodes ON nodes.conv_id = rows.c AND nodes.depth = rows.depth LEFT JOIN children ON children.prefix = nodes.prefix),
below AS (
    SELECT prefix, sum(saved) OVER down AS saved, sum(leaf) OVER down AS leaves FROM added WINDOW down AS (PARTITION BY c ORDER BY depth DESC)),
sums AS (SELECT prefix, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM below GROUP BY prefix)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (prefix) LEFT JOIN children USING (prefix) LEFT JOIN nodes up ON up.prefix = n.parent"""

PARSE_SQL = """WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
starts AS MATERIALIZED (
    SELECT row, p, md5(substr(bytes, 2 * p + 1, 800)) AS string
    FROM (SELECT row, bytes, unnest(range(0, len(bytes) // 2 - 399)) AS p FROM docs)),
repeats AS (SELECT row, p FROM starts SEMI JOIN (SELECT string FROM starts GROUP BY string HAVING count(*) > 1) USING (string)),
opened AS (
    SELECT row, p, p > coalesce(lag(p) OVER (PARTITION BY row ORDER BY p) + 400, -1) AS opens FROM repeats),
spans AS (
    SELECT row, min(p) AS low, max(p) + 400 AS high
    FROM (SELECT row, p, sum(opens::INT) OVER (PARTITION BY row ORDER BY p) AS span FROM opened) GROUP BY row, span),
cuts AS (
    SELECT row, low, high, coalesce(lag(high) OVER (PARTITION BY row ORDER BY low), 0) AS since,
           lead(low) OVER (PARTITION BY row ORDER BY low) IS NULL AS ends FROM spans),
kept AS (
    SELECT row, count(*) AS n_spans, sum(high - low)::BIGINT AS n_removed,
           string_agg(substr(bytes, 2 * since + 1, 2 * (low - since)), '' ORDER BY low)
           || any_value(substr(bytes, 2 * high + 1)) FILTER (ends) AS rest
    FROM cuts JOIN docs USING (row) GROUP BY row)
SELECT doc_id, (len(bytes) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, bytes))) AS kept_sha256
FROM docs LEFT JOIN kept USING (row)"""

ORACLES: dict[str, str] = {"op9_url_filter": _url_filter_sql(), "op11_prefix_trie": TRIE_SQL, "op12_lexical_search": LEXICAL_SQL, "op13_parse_dedup": PARSE_SQL}
