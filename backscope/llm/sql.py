"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import quality, secrets

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

_TRAITS = f"""
SELECT *, greatest(len(w), 1) AS n, greatest(length(t), 1) AS l FROM (
  SELECT doc_id, source, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents)"""


def _count(characters: str) -> str:
    return f"(length(t) - length(translate(t, '{characters}', '')))"


OP1 = f"""
WITH raw AS ({_TRAITS}),
bins AS (SELECT doc_id, concat(CASE WHEN source IS NULL THEN 'n' ELSE 's' END, coalesce(source, '')) AS host, concat(CASE WHEN lang IS NULL THEN 'n' ELSE 's' END, coalesce(lang, '')) AS path,
  least((10 * {_count(quality.MARKS)}) // n, 10)::INT AS marks,
  least((10 * {_count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}) // l, 10)::INT AS capitals,
  least((10 * len(list_distinct(w))) // n, 10)::INT AS variety,
  least((10 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))) // n, 10)::INT AS echoes,
  least(floor(log2(len(w) + 1.0::DOUBLE) / 2), 10)::INT AS size FROM raw),
known AS (SELECT b.*, (quality > 0)::INT AS good FROM bins b JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
p AS (SELECT count(*) AS total, coalesce(sum(good), 0) AS good, (coalesce(sum(good), 0) + 1)::DOUBLE / (count(*) + 2) AS share FROM known),
paths AS (SELECT host, path, sum(good) AS g, count(*) AS n FROM known GROUP BY ALL),
hosts AS (SELECT host, sum(g) AS g, sum(n) AS n FROM paths GROUP BY ALL),
hm AS (SELECT CASE WHEN count(*) = 0 THEN 1000.0 WHEN v <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, 1 / v - 1)) END AS m FROM
  (SELECT (sum(n * (g / n - share) * (g / n - share)) - sum(share * (1 - share))) / sum(n * share * (1 - share)) AS v FROM hosts, p) GROUP BY v),
hs AS (SELECT host, (g + m * share) / (n + m) AS host_share FROM hosts, p, hm),
pm AS (SELECT CASE WHEN v <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, 1 / v - 1)) END AS m FROM
  (SELECT (sum(n * (g / n - host_share) * (g / n - host_share)) - sum(host_share * (1 - host_share))) / sum(n * host_share * (1 - host_share)) AS v FROM paths JOIN hs USING (host))),
ps AS (SELECT host, path, (g + m * host_share) / (n + m) AS path_share FROM paths JOIN hs USING (host), pm),
traits AS (UNPIVOT (SELECT good, marks, capitals, variety, echoes, size FROM known) ON marks, capitals, variety, echoes, size INTO NAME trait VALUE bin),
cells AS (SELECT trait, b AS bin, ln((count(*) FILTER (t.good = 1 AND bin = b) + 1)::DOUBLE / (any_value(p.good) + 11)) - ln((count(*) FILTER (t.good = 0 AND bin = b) + 1)::DOUBLE / (any_value(p.total - p.good) + 11)) AS llr
  FROM (SELECT trait, t.good, bin, b FROM traits t, range(11) r(b)) t, p GROUP BY trait, b),
evidence AS (SELECT doc_id, host, path, cm.llr + cc.llr + cv.llr + ce.llr + cs.llr AS e FROM bins
  JOIN cells cm ON cm.trait = 'marks' AND cm.bin = marks JOIN cells cc ON cc.trait = 'capitals' AND cc.bin = capitals JOIN cells cv ON cv.trait = 'variety' AND cv.bin = variety
  JOIN cells ce ON ce.trait = 'echoes' AND ce.bin = echoes JOIN cells cs ON cs.trait = 'size' AND cs.bin = size),
placed AS (SELECT doc_id, e, coalesce(host_share, share) AS h, coalesce(path_share, host_share, share) AS q FROM evidence LEFT JOIN hs USING (host) LEFT JOIN ps USING (host, path), p),
scored AS (SELECT doc_id, e, h, q, 1 / (1 + exp(-(e + ln(q / (1 - q))))) AS s FROM placed)
SELECT doc_id, round(e, 6) AS evidence, round(h, 6) AS host_share, round(q, 6) AS path_share, round(s, 6) AS score, s >= 0.5 AS kept FROM scored
"""

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(r) AS c FROM reach GROUP BY v) m ON m.v = d.doc_id
"""


def _spans(rule: secrets.Rule, order: int) -> str:
    pattern = ("(?i)" if rule.any_case else "") + rule.pattern.replace("'", "''")
    group = f"length(regexp_extract(m, '{pattern}', {rule.group}))" if rule.group else "length(m)"
    return f"""
SELECT doc_id, {order} AS k, '{rule.kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
  WHERE len(ms) > 0) WHERE {group} >= {rule.least}"""


OP3 = f"""
WITH spans AS ({" UNION ALL ".join(_spans(r, k) for k, r in enumerate(secrets.RULES))}),
told AS (SELECT doc_id, kind, k, s, concat(kind, ':', s, ':', e) AS x FROM spans),
each AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN each USING (doc_id)
"""


def _fraction(*parts: str) -> str:
    return f"('0x' || md5(concat_ws('/', {', '.join(parts)}))[1:8])::BIGINT"


def _apportion(name: str, source: str, seats: str, weight: str, by: str, order: str, out: str) -> str:
    """Highest quotients: every seat from 0 on is tried, down to where none can be left."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""
{name}_b AS (SELECT *, {seats} AS m_, {weight} AS w_, sum({weight}) OVER ({part}) AS sum_, count(*) OVER ({part}) AS n_ FROM {source}),
{name}_c AS (SELECT *, CASE WHEN w_ > 0 THEN greatest(0, floor(m_ * w_ / sum_) - n_ - 2) ELSE 0 END::BIGINT AS low_ FROM {name}_b),
{name}_t AS (SELECT *, unnest(range(low_, low_ + 2 * n_ + 6)) AS k_ FROM {name}_c),
{name}_r AS (SELECT *, sum(low_) OVER ({part}) AS given2_, row_number() OVER ({part} ORDER BY w_ / (2.0 * k_ + 1.0) DESC, {order}, k_) AS rank_ FROM {name}_t),
{name}_g AS (SELECT {keys}sum(low_) AS given_ FROM {name}_c {f"GROUP BY {by}" if by else ""}),
{name} AS (SELECT r.* EXCLUDE (m_, w_, sum_, n_, k_, rank_, given2_, low_, given_), (low_ + won_)::BIGINT AS {out} FROM (
  SELECT r.*, g.given_, count(*) FILTER (rank_ <= m_ - given_ AND w_ > 0) OVER (PARTITION BY {f'r.{by}, ' if by else ''}r.{order.split(' ')[0]}) AS won_ FROM {name}_r r JOIN {name}_g g ON {f"r.{by} = g.{by}" if by else "true"}) r WHERE k_ = low_)"""


_RING = _fraction("'mix-1'", "'ring'", "coalesce(doc_id::VARCHAR, '')")
OP4 = f"""
WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(coalesce(text, '')) AS text_md5,
  {_fraction("'mix-1'", "'shard'", "coalesce(doc_id::VARCHAR, '')", "md5(coalesce(text, ''))")} % greatest(1, (SELECT (count(*) + 511) // 512 FROM documents))::BIGINT AS shard, concat(CASE WHEN source IS NULL THEN 'n' ELSE 's' END, coalesce(source, '')) AS key FROM documents),
cells AS (SELECT key, any_value(source) AS source, shard, sum(size)::BIGINT AS words FROM rows GROUP BY key, shard),
s0 AS (SELECT key, any_value(source) AS source, sum(words)::BIGINT AS source_size FROM cells GROUP BY key),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight, source_size * 3 AS cap, sum(source_size) OVER () AS all_size FROM s0),
s2 AS (SELECT *, sum(weight) OVER () AS all_weight, coalesce(sum(cap) OVER f, 0) AS cap_before, coalesce(sum(weight) OVER f, 0) AS weight_before FROM s1 WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (all_size - cap_before)::DOUBLE / (all_weight - weight_before)::DOUBLE AS l FROM s2),
s4 AS (SELECT *, (SELECT l FROM s3 WHERE l * weight <= cap ORDER BY weight_before LIMIT 1) AS level FROM s3),
s5 AS (SELECT key, source, source_size, least(cap::DOUBLE, level * weight) AS target, round(all_size / 32.0)::BIGINT AS seats FROM s4),
{_apportion("blocks", "s5", "seats", "target", "", "key", "blocks")},
q0 AS (SELECT c.key, c.shard, c.words, b.blocks, b.source_size, b.target FROM cells c JOIN blocks b USING (key)),
{_apportion("q1", "q0", "blocks", "words::DOUBLE", "key", "shard", "quota")},
q2 AS (SELECT key, shard, words, source_size, target, least(quota * 32, words * 3) AS quota, CASE WHEN words > 0 THEN {_fraction("'mix-1'", "'start'", "key", "shard::VARCHAR")} % words ELSE 0 END AS start FROM q1),
laid AS (SELECT *, sum(size) OVER (PARTITION BY shard, key ORDER BY {_RING}, doc_id, size, text_md5 ROWS UNBOUNDED PRECEDING) - size AS pos FROM rows),
done AS (SELECT *, CASE WHEN words > 0 THEN quota // words ELSE 0 END AS turns, CASE WHEN words > 0 THEN quota % words ELSE 0 END AS part FROM laid JOIN q2 USING (shard, key))
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (turns * size + greatest(0, least(pos + size, start + part) - greatest(pos, start)) + greatest(0, least(pos + size, start + part - words) - pos))::BIGINT AS taken FROM done
"""

OP7 = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM embeddings v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id JOIN (SELECT v, min(r) AS c FROM reach GROUP BY v) m ON m.v = v.vec_id
"""

OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS n, sha256(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS low FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> low THEN low END AS refers_to, true AS block_ok FROM f
"""

SQL = {"op1_quality_classifier": OP1, "op2_minhash_near_dedup": OP2, "op3_secret_scans": OP3, "op4_source_mixing": OP4, "op7_embedding_near_dedup": OP7, "op10_warc": OP10}
