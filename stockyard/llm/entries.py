"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm import bpe, decontamination, exact_dedup, importance, merkle, minhash, quality, secret_scan, sharding, similarity_join, substring_dedup, suffix_tree, warc
from stockyard.llm.common import results_dir, stored, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(warc.write_archives(table(spark, sf_dir, "pages")), "warc")
    normal = stored(warc.normalise(archives), "warc-members")
    index = stored(warc.sidecar(normal), "warc-index")
    return warc.read_records(normal, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.join(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the versions arrive in two batches, as from two commits; the second one's scan skips what the first has seen
    ledger = secret_scan.Ledger(spark, f"{results_dir(spark)}/blob-ledger-{uuid.uuid4().hex}")
    batch = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2, F.lit(0))
    for arrived in (0, 1):
        ledger.extend(docs.filter(batch == arrived))
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
    listed = F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    rows = secret_scan.findings(docs, ledger.entries())
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), {"n_chars": tampered})
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_quality": op2_quality,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_suffix_tree": op5_suffix_tree,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_bpe": op7_bpe,
        "op8_decontamination": op8_decontamination,
        "op9_sharding": op9_sharding,
        "op10_secret_scan": op10_secret_scan,
        "op11_importance": op11_importance,
        "op12_merkle": op12_merkle,
        "op13_minhash": op13_minhash,
    }


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN g.first_id IS NULL OR g.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.first_id <> p.page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 100
"""

OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)
"""


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20) x),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM win) x WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM rep) x),
pos AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) x),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS kept, count(*) AS n FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p WHERE gone.p IS NULL GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM pr JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
l AS (SELECT x AS a, y AS b FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM bw WHERE len(ws) > 0),
bwin AS (SELECT DISTINCT item_id, k, array_to_string(ws[s:s + k - 1], ' ') AS words FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM bl) x),
ks AS (SELECT DISTINCT k FROM bwin),
dwin AS (SELECT doc_id, s, k, array_to_string(ws[s:s + k - 1], ' ') AS words FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM dw, ks WHERE len(ws) >= k) x),
hit AS (SELECT doc_id, s, dwin.k, item_id FROM dwin JOIN bwin ON bwin.words = dwin.words AND bwin.k = dwin.k),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) x GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) x GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""


def _spans_sql(rank: int) -> str:
    """Spans of one rule: gaps and matches, whose running lengths are the positions."""
    kind, pattern, group, least = secret_scan.RULES[rank]
    pattern = "[0-9a-f]{16,}" if kind == "hex" else pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, st, st + length(hit) AS en FROM (
  SELECT doc_id, hits[i] AS hit, parts[i] AS part, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i - 1]]), 0) AS st
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS parts, regexp_split_to_array(t, '{pattern}') AS gaps FROM d) a WHERE len(hits) > 0) b) c
  WHERE length(part) >= {least}"""


OP10_SQL = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\ns AS (" + " UNION ALL ".join(map(_spans_sql, range(3))) + """),
g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(concat(kind, ':', CAST(CAST(st AS BIGINT) AS VARCHAR), ':', CAST(CAST(en AS BIGINT) AS VARCHAR)), ',' ORDER BY st, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


#: The CRC-32 of `w` in a table whose column `tab` holds the remainders of the 256 bytes.
CRC_TABLE = "SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i) r) t"
CRC = "xor(list_reduce(list_concat([4294967295], [CAST('0x' || substr(hex(encode(w)), 2 * j + 1, 2) AS BIGINT) for j in range(octet_length(encode(w)))]), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

OP11_SQL = rf"""
WITH tb AS ({CRC_TABLE}),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dc AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM dw) x GROUP BY doc_id, w),
bc AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM bw) x GROUP BY w),
wb AS (SELECT w, {CRC} % 10000 AS b FROM (SELECT w FROM dc UNION SELECT w FROM bc) x, tb),
s AS (SELECT b, sum(n) AS s FROM dc JOIN wb USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM bc JOIN wb USING (w) GROUP BY b),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tt::DOUBLE + 10000)))) AS BIGINT) AS gain FROM (SELECT DISTINCT b FROM wb) x LEFT JOIN s USING (b) LEFT JOIN t USING (b), tot),
wt AS (SELECT doc_id, sum(n * gain) AS weight FROM dc JOIN wb USING (w) JOIN g USING (b) GROUP BY doc_id),
sc AS (SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('2024:', CAST(dw.doc_id AS VARCHAR))), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score FROM dw LEFT JOIN wt ON wt.doc_id = dw.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rn, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN rn <= n * 10 // 100 THEN rn END AS rank FROM sc LEFT JOIN r ON r.doc_id = sc.doc_id
"""


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(octet_length(encode({x})), ':', {x}) END" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")) + ")"


def _tree(name: str, rows: str) -> str:
    """All nodes of the trees of groups g over `rows` (g, p, n, node), level by level, and their siblings."""
    return f"""{name} AS (SELECT 0 AS l, * FROM ({rows}) z UNION ALL SELECT l + 1, g, p // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY p)) FROM {name} WHERE n > 1 GROUP BY l, g, p // 2, n),
{name}_s AS (SELECT a.l, a.g, a.p, a.n, coalesce(b.node, '') AS sib, a.p % 2 = 1 AS on_left FROM {name} a LEFT JOIN {name} b ON b.l = a.l AND b.g = a.g AND b.p = xor(a.p, 1) WHERE a.n > 1)"""


OP12_SQL = rf"""
WITH RECURSIVE tb AS ({CRC_TABLE}),
d AS (SELECT *, CAST(doc_id AS VARCHAR) AS w, coalesce('=' || lang, '') AS g FROM documents),
lf AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY g) AS n, {_leaf("n_chars")} AS leaf,
  {_leaf(f"(CASE WHEN {CRC} % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} AS now FROM d, tb),
{_tree("tr", "SELECT g, p, n, leaf AS node FROM lf")},
sub AS (SELECT g, node FROM tr WHERE n = 1),
sp AS (SELECT g AS name, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n, node FROM sub),
{_tree("tp", "SELECT '' AS g, p, n, node FROM sp")},
st AS (SELECT lf.doc_id, 0 AS l, lf.g, lf.p AS p, false AS top, lf.now AS acc, '' AS proof FROM lf),
f1 AS (SELECT * FROM st UNION ALL SELECT f1.doc_id, f1.l + 1, f1.g, f1.p // 2, false, sha256(CASE WHEN on_left THEN sib || acc ELSE acc || sib END), proof || sib FROM f1 JOIN tr_s s ON s.l = f1.l AND s.g = f1.g AND s.p = f1.p),
m1 AS (SELECT doc_id, g, arg_max(acc, l) AS acc, arg_max(proof, l) AS proof FROM f1 GROUP BY doc_id, g),
f2 AS (SELECT m1.doc_id, 0 AS l, sp.p, m1.acc, m1.proof FROM m1 JOIN sp ON sp.name = m1.g UNION ALL SELECT f2.doc_id, f2.l + 1, f2.p // 2, sha256(CASE WHEN on_left THEN sib || acc ELSE acc || sib END), proof || sib FROM f2 JOIN tp_s s ON s.l = f2.l AND s.p = f2.p),
m2 AS (SELECT doc_id, arg_max(acc, l) AS acc, arg_max(proof, l) AS proof FROM f2 GROUP BY doc_id)
SELECT lf.doc_id, leaf, sub.node AS subroot, rt.node AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = rt.node AS verified
FROM lf JOIN sub ON sub.g = lf.g JOIN m2 ON m2.doc_id = lf.doc_id, (SELECT node FROM tp WHERE n = 1) rt
"""

OP13_SQL = OP6_SQL.replace("100 * o >= 75", "100 * o >= 85").replace("SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id", "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept")


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op8_decontamination": OP8_SQL, "op10_secret_scan": OP10_SQL, "op11_importance": OP11_SQL, "op12_merkle": OP12_SQL, "op13_minhash": OP13_SQL}
