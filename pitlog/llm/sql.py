"""What DuckDB computes for the queries that SQL can express."""

from pitlog.llm import license_rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_PLAIN = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_folded("text")}, {_ALNUM}) AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM (SELECT item, w, least(len(w), 13) AS m FROM items WHERE len(w) > 0))
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_folded("text")}, {_ALNUM}) AS w FROM documents
), places AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)
), hits AS (
  SELECT rid, p.m, i, item FROM places p JOIN windows v ON p.m = v.m AND p.win = v.win
), words AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM hits) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)
"""

JACCARD = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({_folded("text")}, {_PLAIN}) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * k >= 80 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_PLAIN})) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM sized GROUP BY source
), priced AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS cap_price FROM sources
), stepped AS (
  SELECT *, ((SELECT sum(source_size)::DOUBLE FROM sources)
      - coalesce(sum(cap) OVER (ORDER BY cap_price, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap_price, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price
  FROM priced
), goals AS (
  SELECT source, source_size, coalesce(least(cap, weight * free), cap) AS target
  FROM stepped, (SELECT arg_min(price, (cap_price, source)) AS free FROM stepped WHERE cap_price >= price)
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM goals
), placed AS (
  SELECT s.*, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST((copies + CASE WHEN upto <= budget THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""

WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), best AS (
  SELECT h, max(page_id) AS response FROM p GROUP BY h
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31)
         + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CAST(CASE WHEN page_id <> response THEN response END AS DOUBLE) AS refers_to
FROM p JOIN best USING (h)
"""


def _clustering(rounds: int = 3, k: int = 16) -> str:
    """Full scans of all centroids, round by round."""
    parts = [
        """points AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64 AND len(embedding) = 64
)""",
        f"""centroids_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY mark, x) - 1 AS c, x
  FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS mark, x FROM points
        ORDER BY mark, x LIMIT {k})
)""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""nearest_{r} AS MATERIALIZED (
  SELECT rid, min({{'d': list_sum(list_transform(list_zip(p.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))),
                   'c': c}}) AS n
  FROM points p, centroids_{r} q GROUP BY rid
)"""
        )
        if r < rounds:
            parts.append(
                f"""means_{r} AS (
  SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT n.c AS c, i, sum(x[i]) AS total, count(*) AS n
    FROM nearest_{r} JOIN points USING (rid), range(1, 65) AS t(i) GROUP BY ALL) GROUP BY c
), centroids_{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.x, q.x) AS x FROM centroids_{r} q LEFT JOIN means_{r} m USING (c)
)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(n.c AS INT) AS cluster, CAST(n.d AS BIGINT) AS distance,
       CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(n.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(q.x, ',')) AS centroid_sha256
FROM nearest_{rounds} JOIN points USING (rid) JOIN centroids_{rounds} q ON q.c = n.c"""


_HEX = "CAST('0x' || substr({0}, {1}, {2}) AS BIGINT)"

RESAMPLING = f"""
WITH crcs AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, r:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) AS t(i)
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_folded("text")}, {_ALNUM}) AS w FROM documents
), raw AS MATERIALIZED (
  SELECT rid, f, count(*) AS k FROM (SELECT rid, unnest(w) AS f FROM docs) GROUP BY ALL
), wanted AS MATERIALIZED (
  SELECT f, count(*) AS k FROM (SELECT unnest(regexp_extract_all({_folded("text")}, {_ALNUM})) AS f FROM benchmark)
  GROUP BY f
), buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM (SELECT f, list_transform(range(strlen(f)), lambda i: {_HEX.format("h", "CAST(2 * i + 1 AS INT)", 2)}) AS bytes
        FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM raw UNION SELECT f FROM wanted))), crcs
), s AS (
  SELECT bucket, sum(k) AS s FROM raw JOIN buckets USING (f) GROUP BY bucket
), t AS (
  SELECT bucket, sum(k) AS t FROM wanted JOIN buckets USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
      (CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE))
      / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket),
       (SELECT sum(s) AS s_all FROM s), (SELECT coalesce(sum(t), 0) AS t_all FROM t)
), totals AS (
  SELECT rid, CAST(sum(k) AS BIGINT) AS n, CAST(sum(k * gain) AS BIGINT) AS total
  FROM raw JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY rid
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
         CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise
  FROM (SELECT *, {_HEX.format("sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))", 1, 8)} AS h FROM docs)
  LEFT JOIN totals USING (rid)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id, n_features) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS n
  FROM scored
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN CAST(place AS DOUBLE) END AS rank
FROM placed
"""


def _licenses() -> str:
    """Every signature against every text with its keyword's first word; finds by pieces between matches."""
    text = lambda t: "'" + t.replace("'", "''") + "'"
    rules = ",\n  ".join(
        f"({r.place}, {text(r.label)}, {r.level}, {r.confidence}::DOUBLE, {text(r.keyword.split(' ')[0])}, "
        f"{text(' (?:' + r.signature.replace(' ', '  ') + ') ')})"
        for r in license_rules.rules()
    )
    base = ", ".join(f"({text(label)}, {text(phrase)})" for phrase, label in license_rules.BASE)
    spaces = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    above = " OR ".join(
        f"(level = {k} AND coalesce(max(CASE WHEN level >= {k} THEN finish END) OVER before, -1) >= finish)"
        for k in sorted(set(license_rules.LEVELS.values()))
    )
    return f"""
WITH rules(place, label, level, sure, keyword, signature) AS (VALUES
  {rules}
), base(label, phrase) AS (VALUES {base}), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_folded("text")}, {_ALNUM}) AS w FROM documents
), texts AS MATERIALIZED (
  SELECT rid, w, ' ' || array_to_string(w, '  ') || ' ' AS norm FROM docs
), met AS (
  SELECT rid, place, label, level, sure, regexp_extract_all(norm, signature) AS m,
         string_split_regex(norm, signature) AS p
  FROM texts JOIN rules ON contains(norm, keyword) AND regexp_matches(norm, signature)
), pieces AS (
  SELECT rid, place, label, level, sure, i, {spaces.format("m[i]")} AS n, {spaces.format("p[i]")} AS gap
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM met)
), finds AS (
  SELECT *, finish - n AS start FROM (
    SELECT *, sum(gap + n) OVER (PARTITION BY rid, place ORDER BY i) AS finish FROM pieces)
), kept AS (
  SELECT rid, label, sure FROM (
    SELECT *, {above} AS covered FROM finds
    WINDOW before AS (PARTITION BY rid ORDER BY start, finish DESC, level DESC, place
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE NOT covered
), places AS (
  SELECT rid, label, i - 1 AS spot
  FROM (SELECT rid, w, label, string_split(phrase, ' ') AS q, unnest(range(1, len(w) - len(q) + 2)) AS i
        FROM texts JOIN base ON contains(norm, ' ' || replace(phrase, ' ', '  ') || ' '))
  WHERE w[i:i + len(q) - 1] = q
), based AS (
  SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY rid
), named AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label FROM kept UNION SELECT rid, label FROM places) GROUP BY rid
), surest AS (SELECT rid, max(sure) AS sure FROM kept GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS DOUBLE) AS first_word, CAST(last_word AS DOUBLE) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(sure, CASE WHEN n_base > 0 THEN 0.5::DOUBLE END, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN based USING (rid) LEFT JOIN named USING (rid) LEFT JOIN surest USING (rid)
"""


ORACLES: dict[str, str] = {
    "op2_decontamination": DECONTAMINATION,
    "op6_jaccard_join": JACCARD,
    "op9_mixing": MIXING,
    "op10_warc": WARC,
    "op11_clustering": _clustering(),
    "op12_resampling": RESAMPLING,
    "op13_licenses": _licenses(),
}
