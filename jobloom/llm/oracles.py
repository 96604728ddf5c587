"""Oracle SQL of the operators that SQL can express on whole tables at the size of the correctness check."""

from __future__ import annotations

#: Reachable pairs over links (a, b), both ways; each node reaches itself.
_REACH = """links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)"""

#: The text of pages that name one article and hold no boilerplate in it, as all the given ones do.
OP3 = r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t, '&#39;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM d"""

OP4 = r"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win JOIN rep USING (s)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id)"""

OP6 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), c AS (SELECT node, min(other) AS c FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON node = vec_id"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP9 = rf"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
{_REACH}, c AS (SELECT node, min(other) AS c FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id"""

OP12 = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, x.k AS cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN g x ON x.lang = c.lang AND x.k < c.k AND x.phrase = array_to_string(c.w[1 : x.k], ' ') JOIN g y ON y.lang = c.lang AND y.k = c.k - x.k AND y.phrase = array_to_string(c.w[x.k + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c JOIN (SELECT unnest([1, 2]) AS s) ON true WHERE c.k = 3 AND b.k = 2 AND c.lang = b.lang AND array_to_string(c.w[s : s + 1], ' ') = b.phrase AND 100 * c.a >= 50 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""

OP13 = r"""WITH RECURSIVE f AS (SELECT doc_id, lang, doc_id::VARCHAR AS a, source AS b, lang AS c, n_chars::VARCHAR AS d, (n_chars + 1)::VARCHAR AS d1, text AS e FROM documents),
g AS (SELECT doc_id, lang, list_reduce(flatten([[4294967295], flatten(list_transform(range(1, strlen(a) + 1), lambda k: [ascii(a[k]), -1, -1, -1, -1, -1, -1, -1, -1]))])::BIGINT[], lambda x, y: CASE WHEN y < 0 THEN xor(x >> 1, 3988292384 * (x & 1)) ELSE xor(x, y) END) AS crc,
  concat(coalesce(strlen(a) || ':' || a, '-'), coalesce(strlen(b) || ':' || b, '-'), coalesce(strlen(c) || ':' || c, '-')) AS h, coalesce(strlen(d) || ':' || d, '-') AS m, coalesce(strlen(d1) || ':' || d1, '-') AS m1, coalesce(strlen(e) || ':' || e, '-') AS t FROM f),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM f GROUP BY lang),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (
  SELECT tree, doc_id, sha256(h || m || t) AS leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(h || m1 || t) ELSE sha256(h || m || t) END AS shown FROM g JOIN langs ON g.lang IS NOT DISTINCT FROM langs.lang)),
nodes AS (SELECT tree, 0 AS level, i, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM leaves
  UNION ALL SELECT tree, any_value(level) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, i // 2),
tops AS (SELECT 0 AS level, tree AS i, count(*) OVER () AS n, digest FROM nodes WHERE n = 1
  UNION ALL SELECT any_value(level) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY i // 2),
walk AS (SELECT tree, i AS place, 0 AS level, i, n, '' AS proof, shown AS folded FROM leaves JOIN (SELECT tree, count(*) AS n FROM leaves GROUP BY tree) USING (tree)
  UNION ALL SELECT w.tree, place, w.level + 1, w.i // 2, (w.n + 1) // 2, proof || coalesce(digest, ''), sha256(CASE WHEN w.i % 2 = 0 THEN folded || coalesce(digest, '') ELSE digest || folded END)
  FROM walk w LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1),
climb AS (SELECT tree, place, 0 AS level, tree AS i, (SELECT count(*) FROM langs) AS n, proof, folded FROM walk WHERE n = 1
  UNION ALL SELECT w.tree, place, w.level + 1, w.i // 2, (w.n + 1) // 2, proof || coalesce(digest, ''), sha256(CASE WHEN w.i % 2 = 0 THEN folded || coalesce(digest, '') ELSE digest || folded END)
  FROM climb w LEFT JOIN tops s ON s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1),
root AS (SELECT digest AS root FROM tops WHERE n = 1), sub AS (SELECT tree, digest AS subroot FROM nodes WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(c.proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves l JOIN climb c ON c.tree = l.tree AND c.place = l.i AND c.n = 1 JOIN sub ON sub.tree = l.tree CROSS JOIN root"""
