"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

# Square-root weights scaled to integers, one extra share to the largest
# remainders, then slot by slot the released block with the earliest deadline.
SQL["op3_mixing"] = """
WITH RECURSIVE
w AS (SELECT source, count(*) AS n, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1048576) AS BIGINT) AS w
      FROM documents GROUP BY source),
p AS (SELECT *, greatest(1000, 8 * count(*) OVER ()) AS period, count(*) OVER () AS s,
             CAST(sum(w) OVER () AS HUGEINT) AS total FROM w),
b AS (SELECT *, (period - s) * CAST(w AS HUGEINT) % total AS rest,
             1 + CAST((period - s) * CAST(w AS HUGEINT) // total AS BIGINT) AS base FROM p),
sh AS (SELECT source, n, period, (n + 15) // 16 AS n_blocks,
              base + CASE WHEN row_number() OVER (ORDER BY rest DESC, source NULLS FIRST)
                               <= period - sum(base) OVER () THEN 1 ELSE 0 END AS share,
              row_number() OVER (ORDER BY source NULLS FIRST) AS j FROM b),
arr AS (SELECT list(CAST(share AS BIGINT) ORDER BY j) AS a, list(n_blocks ORDER BY j) AS nb,
               any_value(period) AS period FROM sh),
run(t, had, j) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM arr
  UNION ALL
  SELECT t + 1, list_transform(had, lambda c, i: c + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (SELECT r.t, r.had,
               list_min(list_transform(
                 list_filter(range(1, len(a) + 1), lambda i: had[i] < a[i] AND had[i] * period // a[i] <= r.t + 1),
                 lambda i: ((had[i] + 1) * period + a[i] - 1) // a[i] * 1000000 + i)) % 1000000 AS pick
        FROM run r, arr WHERE r.t + 1 < arr.period)),
sched AS (SELECT t AS slot, j, had, had[j] - 1 AS k FROM run WHERE t >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS rank
      FROM documents)
SELECT d.doc_id, d.source, CAST(share AS BIGINT) AS mix_share, rank // 16 AS mix_block,
       (rank // 16) * period // share AS mix_release,
       ((rank // 16 + 1) * period + share - 1) // share AS mix_deadline,
       (rank // 16 // share) * period + slot AS mix_slot,
       list_sum(list_transform(range(1, len(a) + 1),
                lambda i: least(nb[i], a[i] * CAST(rank // 16 // share AS BIGINT) + had[i]))) - 1 AS mix_position,
       rank % 16 AS mix_place
FROM d JOIN sh ON d.source IS NOT DISTINCT FROM sh.source
JOIN sched ON sched.j = sh.j AND sched.k = (rank // 16) % share, (SELECT a, nb FROM arr)
"""

SQL["op4_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

SQL["op10_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

# Templates written out here a second time, on purpose.
SQL["op5_licenses"] = r"""
WITH templates(tid, label, base, body) AS (VALUES
  (0, 'gpl', true, 'gnu general public license'),
  (1, 'apache', true, 'apache license'),
  (2, 'cc-by', true, 'cc by'),
  (3, 'mit', true, 'mit license'),
  (4, 'mit', false, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction'),
  (5, 'apache', false, 'licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license'),
  (6, 'bsd', false, 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  (7, 'gpl', false, 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation'),
  (8, 'lgpl', false, 'this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license'),
  (9, 'mpl', false, 'this source code form is subject to the terms of the mozilla public license'),
  (10, 'cc-by', false, 'this work is licensed under a creative commons attribution'),
  (11, 'unlicense', false, 'this is free and unencumbered software released into the public domain')),
tw AS (SELECT *, string_split(body, ' ') AS w FROM templates),
tg AS (SELECT tid, label, base, len(w) - 1 AS grams, j - 1 AS tpos, w[j] AS w1, w[j + 1] AS w2
       FROM (SELECT *, unnest(range(1, len(w))) AS j FROM tw)),
d AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] AS w1, w[i + 1] AS w2
      FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
diag AS (SELECT doc_id, tid, label, base, grams, pos - tpos AS diagonal, list(DISTINCT tpos) AS hits
         FROM g JOIN tg USING (w1, w2) GROUP BY ALL),
kept AS (SELECT * FROM diag WHERE len(hits) = grams OR (NOT base AND len(hits) >= 2)),
marked AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER l, 99) > 3 THEN 1 ELSE 0 END AS new
           FROM kept WINDOW l AS (PARTITION BY doc_id, tid ORDER BY diagonal)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS cluster FROM marked),
spans AS (SELECT doc_id, tid, label, base, cluster, min(diagonal + list_min(hits)) AS first,
                 len(list_distinct(flatten(list(hits)))) / any_value(grams) AS cover
          FROM numbered GROUP BY doc_id, tid, label, base, cluster),
agg AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word,
               max(first) FILTER (base) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (cover >= 0.75) AS labels,
               max(cover) AS score FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN agg ON d.doc_id IS NOT DISTINCT FROM agg.doc_id
"""

# Three rounds of means from the fixed start, written out one after the other.
_KM_DISTANCE = "CAST(list_sum(list_transform(range(1, 65), lambda j: (v[j] - m[j]) * (v[j] - m[j]))) AS BIGINT)"


def _km_assign(i: int) -> str:
    return f"""a{i} AS (SELECT rid, arg_min(struct_pack(c := c, d := d), d * 1000 + c) AS best FROM (
  SELECT rid, c, {_KM_DISTANCE} AS d FROM v, c{i}) GROUP BY rid)"""


def _km_update(i: int) -> str:
    return f"""s{i} AS (SELECT c, list(CAST(floor(x / n) AS BIGINT) ORDER BY j) AS m FROM (
  SELECT best.c AS c, j, CAST(sum(x) AS DOUBLE) AS x, count(*) AS n FROM (
    SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM v JOIN a{i} USING (rid)) GROUP BY 1, 2) GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(s{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN s{i} USING (c))"""


SQL["op11_centroids"] = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS c, v AS m
       FROM v QUALIFY c < 16),
""" + ",\n".join(x for i in range(3) for x in (_km_assign(i), _km_update(i))) + ",\n" + _km_assign(3) + """
SELECT vec_id, best.c AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM v JOIN a3 USING (rid) JOIN c3 ON c3.c = best.c
"""

SQL["op13_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
            FROM w JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) ON len(w) >= k)
      GROUP BY ALL HAVING count(*) >= 100),
f AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cuts AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS c FROM f),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, c, gl.a AS l, gr.a AS r, n,
         CAST(CAST(1000 AS HUGEINT) * cuts.a * n // (CAST(gl.a AS HUGEINT) * gr.a) AS BIGINT) AS score
  FROM cuts JOIN g gl ON gl.lang = cuts.lang AND gl.phrase = array_to_string(cuts.w[1:c], ' ')
  JOIN g gr ON gr.lang = cuts.lang AND gr.phrase = array_to_string(cuts.w[c + 1:], ' ')
  JOIN n ON n.lang = cuts.lang
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, c) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT lang, w, a, k, unnest(range(2, k)) AS m FROM f)) GROUP BY 1, 2)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank,
       s.phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.phrase = s.phrase
WHERE around IS NULL OR around < a
QUALIFY rank <= 2000
"""
