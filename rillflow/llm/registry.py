"""The thin queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_texts
from .common import crc_mod, table
from .htmltext import extract_pages
from .media import store_texts
from .neardup import near_duplicates
from .packing import pack_texts
from .quality import judged, score_quality, train_quality
from .secrets import scan_texts
from .toxicity import score_toxicity, train_toxicity
from .urlfilter import Rule, judge
from .vptree import nearest

#: Folder of the public vocabulary files; a parameter, the files are never copied.
TOKENIZERS = "/opt/tokenizers"

#: Exact search; equal where the trees miss nothing, as on the tables of the driver's comparison.
OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
u AS (
  SELECT row_number() OVER () AS r, vec_id, e, list_dot_product(e, e) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(q.n) * sqrt(c.n)) AS score
  FROM u q JOIN u c ON c.r <> q.r AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0 AND q.n > 0 AND c.n > 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: The rules of the contract.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def op1_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op2_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url", "html"), RULES)


#: Links as in the pages' markup outside comments and scripts: absolute, protocol-relative and root-relative targets, &amp; decoded; of other relative targets, other references and base elements SQL knows nothing (no page of the tables has any).
OP2_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
markup AS (SELECT url, regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '(?i)<script\b[\s\S]*?</script\s*>', '', 'g') AS html FROM pages WHERE contains(url, '://')),
tag AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b(?:"[^"]*"|''[^'']*''|[^>"''])*>')) AS t FROM markup),
target AS (
  SELECT url, coalesce(nullif(regexp_extract(t, '(?i)\bhref\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(t, '(?i)\bhref\s*=\s*''([^'']*)''', 1), ''), regexp_extract(t, '(?i)\bhref\s*=\s*([^"''>\s]+)', 1)) AS d FROM tag
  WHERE regexp_matches(t, '(?i)^<link') AND regexp_matches(t, '(?i)\brel\s*=\s*(?:canonical[\s/>]|"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|''(?:[^'']*\s)?canonical(?:\s[^'']*)?'')')
  UNION ALL
  SELECT url, regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''>\s]+)', 1) FROM tag
  WHERE regexp_matches(t, '(?i)^<meta') AND regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?\s*refresh\b')),
clean AS (SELECT url, trim(replace(d, '&amp;', '&')) AS d, regexp_extract(url, '^[\s\S]*?://[^/?#]*', 0) AS site FROM target),
edge AS (
  SELECT DISTINCT url AS src, dst FROM (
    SELECT url, CASE WHEN regexp_matches(d, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN d WHEN starts_with(d, '//') THEN regexp_extract(site, '^[^/]*', 0) || d WHEN starts_with(d, '/') THEN site || d END AS dst FROM clean) WHERE dst <> url),
sym AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge),
reach(a, b) AS (SELECT src, dst FROM sym UNION SELECT r.a, s.dst FROM reach r JOIN sym s ON r.b = s.src),
node AS (SELECT DISTINCT a AS url FROM reach),
nodehp AS (
  SELECT url, translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM node),
nodev AS (
  SELECT url, max_by(verdict, length(rhost || rpath)) AS v FROM nodehp JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url),
alias AS (
  SELECT r.a AS url, bool_or(n.v = 'block') AND NOT bool_or(n.v = 'allow') AS blocked FROM (SELECT a, b FROM reach UNION SELECT url, url FROM node) r JOIN nodev n ON n.url = r.b GROUP BY r.a),
own AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS v
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN own USING (page_id) LEFT JOIN alias ON alias.url = u.url
"""


def op3_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=2, threshold=80)


#: Exact by prefix filtering: two sets with similarity 0.8 share one of the rarest fifth (and one) of either's shingles.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
p AS (
  SELECT rid, g, n, row_number() OVER (PARTITION BY rid ORDER BY df, g) AS k FROM s JOIN f USING (g) JOIN n USING (rid)),
pre AS (SELECT rid, g, n FROM p WHERE k <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.g = b.g AND a.rid < b.rid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (
  SELECT a, b FROM c JOIN s x ON x.rid = c.a JOIN s y ON y.rid = c.b AND y.g = x.g GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
d AS (SELECT x.doc_id AS a, y.doc_id AS b FROM l JOIN w x ON x.rid = l.a JOIN w y ON y.rid = l.b),
e AS (SELECT a, b FROM d WHERE a <> b UNION SELECT b, a FROM d WHERE a <> b),
r(doc_id, c) AS (SELECT DISTINCT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS c FROM r WHERE doc_id IS NOT NULL GROUP BY doc_id),
o AS (SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN w.doc_id ELSE m.c END AS component_id FROM w LEFT JOIN n USING (rid) LEFT JOIN m USING (doc_id))
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM o
"""


def op4_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    fitted = train_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), crc_mod("doc_id", 4) != 2)
    return judged(score_toxicity(docs, fitted), 4, 2, 0.3)


def op5_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    forest = train_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), crc_mod("doc_id", 3) != 1)
    return judged(score_quality(docs, forest), 3, 1, 0.5)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_trie_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary)


def op10_online_packing(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/word_bpe_49k.json") -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in sorted(globals().items()) if k[:2] == "op" and k[2:3].isdigit()}
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_vantage_point_trees": OP1_SQL, "op2_redirect_filter": OP2_SQL, "op3_superminhash_dedup": OP3_SQL}
