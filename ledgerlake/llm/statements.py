"""DuckDB statements that the queries of this folder must equal."""

from __future__ import annotations

from ledgerlake.llm import sharding

WORD = r"[^\x20\x09-\x0D]+"


def _sharding() -> str:
    table = sharding.lookup_table(list(sharding.SHARDS))
    shards = sorted(set(table))
    owners = ",".join(str(shards.index(s)) for s in table)
    names = ",".join(f"'{s}'" for s in shards)
    return f"""
    WITH slots AS (
      SELECT doc_id, CAST(('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0))), 15))::BIGINT % {len(table)} AS INTEGER) AS slot
      FROM documents)
    SELECT doc_id, slot, ([{names}])[([{owners}])[slot + 1] + 1] AS shard FROM slots"""


MIXING = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, source_size * 3 AS most FROM sizes),
weighed AS (SELECT *, ([1, 2, 3])[CAST(rank % 3 + 1 AS INTEGER)] AS weight FROM numbered),
ranked AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM weighed),
filled AS (
  SELECT *, CAST(total - coalesce(sum(most) OVER before, 0) AS DOUBLE)
      / (weights - coalesce(sum(weight) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY CAST(most AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
    coalesce(least(CAST(most AS DOUBLE), max(CASE WHEN level * weight <= most THEN level END) OVER () * weight), CAST(most AS DOUBLE)) AS target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(('0x' || left(md5('mix|' || coalesce(source, chr(0) || 'null')), 8))::BIGINT AS DOUBLE) / 4294967296.0 AS shift
  FROM filled),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
      CASE WHEN size > 0 THEN -floor(log2(CAST(size AS DOUBLE)) * 8) ELSE 1 END,
      floor(CAST(('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 8))::BIGINT AS DOUBLE) / 4294967296.0 * 64),
      size, doc_id) - 1 AS i
  FROM docs),
taken AS (
  SELECT p.doc_id, p.size, g.source_size, g.target,
    CAST(floor((i + 1) * rate + shift) - floor(i * rate + shift) AS INTEGER) AS copies
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM taken"""


QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS body, text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT r, i, w[i:i + 4] AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
stretches AS (SELECT r, least(5, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 5)) AS n FROM again),
covered AS (SELECT r, sum(n) AS n FROM stretches GROUP BY r),
lines AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS l FROM docs WHERE text IS NOT NULL),
worded AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '{WORD}') GROUP BY r),
normal AS (SELECT r, source, text, trim(regexp_replace(lower(l), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS l,
    len(regexp_extract_all(l, '{WORD}')) AS n FROM lines),
held AS (SELECT r, source, text, l, sum(n) AS n FROM normal WHERE l <> '' GROUP BY r, source, text, l),
hosts AS (SELECT source, count(*) AS n FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source),
first AS (SELECT h.source, l, count(DISTINCT h.text) AS n, min(doc_id) AS first
    FROM held h JOIN docs d ON h.r = d.r GROUP BY h.source, l),
above AS (SELECT f.source, l, first FROM first f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
    WHERE f.n > 75 OR f.n > 10 AND f.n > h.n * 0.10),
ids AS (SELECT source, text, min(doc_id) AS first FROM documents GROUP BY source, text),
lost AS (SELECT h.r, sum(h.n) AS n FROM held h
    JOIN above a ON h.source IS NOT DISTINCT FROM a.source AND h.l = a.l
    JOIN ids i ON h.source IS NOT DISTINCT FROM i.source AND h.text = i.text
    WHERE i.first <> a.first GROUP BY h.r),
counted AS (
  SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(o.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(x.n, 0) AS gone
  FROM docs d LEFT JOIN worded o ON d.r = o.r LEFT JOIN covered c ON d.r = c.r LEFT JOIN lost x ON d.r = x.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT base_failed AND n_words - gone >= n_words * 0.30 AS kept
FROM counted"""


TOPK = """
WITH whole AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM whole q JOIN whole r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5"""


HARD_NEGATIVES = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS other, b.vec_id,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positives AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, other) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.vec_id, n.other) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor = n.anchor AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5"""


def _merkle(levels: int = 7, sources: int = 4) -> str:
    """Up to 16^levels leaves a source and 16^sources sources."""

    def field(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    step = "if(a & 1 = 1, xor(a >> 1, 3988292384), a >> 1)"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda a, x: {step})"
    codes = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {byte}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""leaves AS (
  SELECT r, doc_id, source AS tree, {leaf('text')} AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS start
  FROM (SELECT row_number() OVER () AS r, * FROM documents)),
a0 AS (SELECT r, tree, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
    count(*) OVER (PARTITION BY tree) AS n FROM leaves)"""]

    def climb(name: str, height: int) -> None:
        for k in range(height):
            parts.append(f"""{name}{k + 1} AS (
  SELECT tree, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (any_value(n) + 15) // 16 AS n
  FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 16)""")

    def tops(name: str, height: int) -> str:
        return " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(height + 1))

    climb("a", levels)
    parts.append(f"tops AS ({tops('a', levels)})")
    parts.append("b0 AS (SELECT 0 AS tree, tree AS name, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tops)")
    climb("b", sources)
    parts.append(f"root AS (SELECT h FROM ({tops('b', sources)}))")
    parts.append("""f0 AS (SELECT a.r, a.tree, b.i AS above, a.i, '' AS proof, l.start AS fold
  FROM a0 a JOIN leaves l ON a.r = l.r JOIN b0 b ON a.tree IS NOT DISTINCT FROM b.name)""")
    last = "f0"
    for name, height in (("a", levels), ("b", sources)):
        for k in range(height):
            tree, at = ("f.tree IS NOT DISTINCT FROM s.tree", "f.i") if name == "a" else ("TRUE", "f.above")
            after = "i // 16 AS i, above" if name == "a" else "i, above // 16 AS above"
            fresh = f"f_{name}{k}"
            parts.append(f"""{fresh} AS (
  SELECT r, tree, {after}, proof || beside AS proof, CASE WHEN alone THEN fold ELSE sha256(before || fold || behind) END AS fold FROM (
    SELECT f.r, f.tree, f.i, f.above, f.proof, f.fold, coalesce(bool_and(s.n = 1), TRUE) AS alone,
      coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> {at}), '') AS beside,
      coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < {at}), '') AS before,
      coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > {at}), '') AS behind
    FROM {last} f LEFT JOIN {name}{k} s ON {tree} AND s.i // 16 = {at} // 16 GROUP BY ALL))""")
            last = fresh
    body = ",\n".join(parts)
    return f"""WITH {body}
SELECT l.doc_id, l.leaf, t.h AS subroot, root.h AS root, sha256(f.proof) AS proof_sha256, f.fold AS folded_root, f.fold = root.h AS verified
FROM {last} f JOIN leaves l ON f.r = l.r JOIN tops t ON l.tree IS NOT DISTINCT FROM t.tree, root"""


def all_statements() -> dict[str, str]:
    return {
        "op1_sharding": _sharding(), "op3_topk_search": TOPK, "op4_mixing": MIXING, "op10_quality_rules": QUALITY,
        "op11_hard_negatives": HARD_NEGATIVES, "op12_merkle_manifest": _merkle(),
    }
