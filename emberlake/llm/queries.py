"""The operators of this package as queries over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import conversation, decontaminate, exact_dedup, lsh_forest, mil_toxicity, mixing, piece_chunks, pu_quality, risk_rules, secret_ledger, spelling, url_alias, warc_revisit
from emberlake.llm.common import table
from emberlake.llm.oracles import CRC, LEAKS, REPAIRS
from emberlake.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


NODE = """lower(regexp_extract({u}, '^(.*?://[^/?#]*)', 1, 's')) ||
    substr(regexp_replace({u}, '#.*$', '', 's'), length(regexp_extract({u}, '^(.*?://[^/?#]*)', 1, 's')) + 1)"""
LINK = """regexp_extract(regexp_extract(html, '{tag}', 0, 'is'), '{at}', 1, 'is')"""
JUDGED = """CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END"""
HOST = """lower(coalesce(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), ''))"""
PATH = """coalesce(regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"""
VERDICT = "CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END"
# absolute links only: the given pages have no others that are canonical or refresh links
ALIASES = f"""
WITH RECURSIVE known AS (SELECT *, {NODE.format(u="url")} AS node FROM pages WHERE contains(url, '://')),
links AS (SELECT node, unnest([
    {LINK.format(tag="<link[^>]*rel=.?canonical[^>]*>", at="href=[^a-z]?([^ >]+)")},
    {LINK.format(tag="<meta[^>]*http-equiv=.?refresh[^>]*>", at="url=([^ >]+)")}]) AS link FROM known),
declared AS (SELECT node AS a, {NODE.format(u="link")} AS b FROM links WHERE link <> ''),
nodes AS (SELECT node FROM known UNION SELECT b FROM declared),
stems AS (SELECT node, regexp_replace(node, '^http://', 'https://') AS asked FROM nodes),
plain AS (SELECT node, regexp_replace(regexp_replace(asked, '[?].*$', '', 's'), '([^:/])/$', '\\1') AS stem,
    list_filter(string_split(regexp_extract(asked, '[?](.*)$', 1, 's'), '&'),
        lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')) AS parts FROM stems),
edges AS (SELECT a, b FROM declared WHERE a <> b UNION
    SELECT node, CASE WHEN len(parts) > 0 THEN stem || '?' || array_to_string(parts, '&') ELSE stem END AS b FROM plain WHERE node <> b),
arcs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS other FROM arcs UNION SELECT r.node, s.b FROM reach r JOIN arcs s ON r.other = s.a),
groups AS (SELECT node, min(other) AS alias_of FROM reach GROUP BY node),
places AS (SELECT node, alias_of, {HOST.format(u="node")} AS host, {PATH.format(u="node")} AS path FROM groups),
ruled AS (SELECT node, alias_of, {JUDGED} AS rule FROM places),
decided AS (SELECT alias_of, min({VERDICT}) AS verdict FROM ruled GROUP BY alias_of),
asked AS (SELECT page_id, url, {HOST.format(u="url")} AS host, {PATH.format(u="url")} AS path,
    CASE WHEN contains(url, '://') THEN {NODE.format(u="url")} END AS node FROM pages),
own AS (SELECT *, {JUDGED} AS rule FROM asked)
SELECT page_id, host, path, rule, coalesce({VERDICT}, d.verdict, 'allow') AS verdict, g.alias_of
FROM own LEFT JOIN groups g USING (node) LEFT JOIN decided d ON g.alias_of = d.alias_of
"""
REVISITS = f"""
WITH p AS (SELECT *, {NODE.format(u="url")} AS node, coalesce(length(html), 0) AS size,
    '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS tag FROM pages),
s AS (SELECT *, regexp_replace(node, '^http://', 'https://') AS asked FROM p),
k AS (SELECT *, regexp_replace(regexp_replace(asked, '[?].*$', '', 's'), '([^:/])/$', '\\1') AS stem,
    list_filter(string_split(regexp_extract(asked, '[?](.*)$', 1, 's'), '&'),
        lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')) AS parts FROM s),
u AS (SELECT *, CASE WHEN len(parts) > 0 THEN stem || '?' || array_to_string(parts, '&') ELSE stem END AS url_key FROM k),
r AS (SELECT 2 * page_id AS record_id, url_key, page_id AS "at", true AS full_, tag, size, html FROM u
    UNION ALL SELECT 2 * page_id + 1, url_key, page_id + 1 + size % 5000, false, tag, size, NULL FROM u),
hits AS (SELECT *, last_value(CASE WHEN full_ THEN {{'id': record_id, 'tag': tag, 'size': size, 'sha': sha256(coalesce(html, ''))}} END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY "at", record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM r),
o AS (SELECT *, CASE WHEN full_ THEN 'full' WHEN hit IS NULL THEN 'orphan' WHEN hit.tag = tag THEN 'resolved' ELSE 'changed' END AS outcome FROM hits)
SELECT record_id, url_key, "at", outcome,
    CASE outcome WHEN 'full' THEN record_id WHEN 'resolved' THEN hit.id ELSE -1 END AS response_id,
    CASE outcome WHEN 'full' THEN sha256(coalesce(html, '')) WHEN 'resolved' THEN hit.sha END AS payload_sha256,
    'age: ' || CASE WHEN full_ THEN 0 ELSE size % 100 END || chr(10) || 'content-length: ' ||
    CASE outcome WHEN 'full' THEN size WHEN 'resolved' THEN hit.size ELSE 0 END || chr(10) ||
    CASE WHEN outcome IN ('full', 'resolved') THEN 'content-type: text/html' || chr(10) ELSE '' END ||
    'etag: ' || CASE WHEN full_ THEN '' ELSE 'W/' END || tag AS headers
FROM o
"""
SAME_TEXT = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)
"""
SPELLINGS = f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
long_runs AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS hashed FROM runs WHERE length(run) >= 7),
{CRC.format(rows="long_runs")},
typed AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM crcs),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cuts AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
holes AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM cuts),
pairs AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM holes a JOIN w b ON a.less = b.word
    UNION SELECT b.word, a.word, a.n FROM holes a JOIN w b ON a.less = b.word),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, max(other_n) AS top, first(other ORDER BY other_n DESC, other) AS other FROM pairs GROUP BY word),
judged AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN other END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n
    FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS place, 0 AS step FROM w UNION ALL SELECT k.word, j.form, step + 1 FROM walk k JOIN judged j ON k.place = j.word WHERE j.form IS NOT NULL),
ends AS (SELECT word, first(place ORDER BY step DESC) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)
"""


def _secrets_sql() -> str:
    parts = []
    for rank, r in enumerate(secret_ledger.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, hits, gaps, parts, {r.least} AS least FROM (
            SELECT doc_id, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', {r.group}) AS parts
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, '{p}'))"""
        )
    return f"""
WITH found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT doc_id, rank, kind, hits, gaps, unnest(range(1, len(hits) + 1)) AS i, parts, least FROM found),
spans AS (SELECT doc_id, rank, kind,
    list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS start, length(hits[i]) AS size
    FROM each WHERE length(parts[i]) >= least),
named AS (SELECT *, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM spans),
lists AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ('assign', 'access', 'hex')) AS base,
    string_agg(span, ',' ORDER BY start, rank) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN lists USING (doc_id)
"""


@query("op1_url_alias_verdicts", ALIASES)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return url_alias.judge(table(spark, folder, "pages"))


@query("op2_pu_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pu_quality.scored_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_mil_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mil_toxicity.scored_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_risk_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return risk_rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_warc_revisits", REVISITS)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = warc_revisit.resolve(warc_revisit.captures(table(spark, folder, "pages")))
    return found.withColumns({"headers": warc_revisit.header_text(found["headers"]), "response_id": F.coalesce("response_id", F.lit(-1))})


@query("op4_piece_chunks")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return piece_chunks.encode_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_source_mix")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, folder, "documents"))


@query("op5_exact_dedup", SAME_TEXT)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op6_lsh_forest")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return lsh_forest.near_groups(table(spark, folder, "documents"), lsh_forest.Forest(words=2))


@query("op10_secret_ledger", _secrets_sql())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return secret_ledger.scan_documents(table(spark, folder, "documents"), fresh_path(spark, "secret-ledger"))


@query("op11_spelling_variants", SPELLINGS)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents"), misspelt=31))


@query("op12_conversation_repair", REPAIRS)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return conversation.repaired(conversation.damaged(table(spark, folder, "conversations")), "copies")


@query("op13_decontamination", LEAKS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judged(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("longest")
