"""DuckDB SQL of the operators on conversations, embeddings and mixtures."""

from __future__ import annotations

#: The CRC-32 of a conversation's decimal id, bit by bit, modulo 9.
_HEAD = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
 lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 9"""
_TRIE = f"""WITH own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
 FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT *, {_HEAD} AS h FROM own),
built AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS path FROM headed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
member AS (SELECT conv_id, d, path[1:d] AS node, d = len(path) AS last, path[1:d - 1] AS parent, CASE WHEN d > 0 THEN strlen(path[d].t) ELSE 0 END AS n_bytes FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM built)),
node AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(n_bytes) AS n_bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM member GROUP BY node, d),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (node, d)),
below AS (SELECT m.node, m.d, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.n_bytes) AS saved FROM full_ f JOIN member m ON m.conv_id = f.conv_id AND m.d <= f.d GROUP BY m.node, m.d)
SELECT f.conv_id, f.d AS depth, CASE WHEN f.d > 0 THEN p.conv_id END AS parent_conv_id, f.n_convs, f.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN below b USING (node, d) LEFT JOIN node p ON p.node = f.parent AND p.d = f.d - 1"""
_DEVIATION = """WITH rows_ AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: coalesce(NOT isfinite(c), true))) = 0),
fit AS (SELECT DISTINCT x FROM rows_), n AS (SELECT count(*) AS n FROM fit), sums AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, CAST(sum(x[i]) AS BIGINT) AS s FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM fit) GROUP BY i))
SELECT vec_id, n, CAST(list_sum(list_transform(list_zip(x, s), lambda z: (n * z[1] - z[2]) * (n * z[1] - z[2]))) AS BIGINT) AS deviation FROM rows_, n, sums"""
_MIX = r"""WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
 (CAST('0x' || substr(md5(concat_ws(':', '0', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u FROM documents),
named AS (SELECT source, sum(size)::BIGINT AS z, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM docs GROUP BY source),
filled AS (SELECT *, (sum(z) OVER ())::BIGINT - 3 * (sum(z) OVER o - z)::BIGINT AS left_, (sum(w) OVER ())::BIGINT - (sum(w) OVER o - w)::BIGINT AS over_, row_number() OVER o AS place FROM named WINDOW o AS (ORDER BY z / w, source NULLS LAST)),
level AS (SELECT min_by(CAST(left_ AS DOUBLE) / over_, place) AS level FROM filled WHERE CAST(left_ AS DOUBLE) / over_ * w <= 3 * z),
target AS (SELECT source, z, least(CAST(3 * z AS DOUBLE), coalesce(level * w, CAST(3 * z AS DOUBLE))) AS target FROM filled, level),
timed AS (SELECT docs.*, z, target, coalesce(target / nullif(z, 0), 0) AS times FROM docs JOIN target ON docs.source IS NOT DISTINCT FROM target.source),
odds AS (SELECT *, CAST(floor(times) AS BIGINT) AS certain, (u / (1 - u)) / nullif((times - floor(times)) / (1 - (times - floor(times))), 0) AS rank_ FROM timed),
ranked AS (SELECT *, sum(size) OVER o AS cum, row_number() OVER o AS place, target - sum(size * certain) OVER (PARTITION BY source) AS open FROM odds WINDOW o AS (PARTITION BY source ORDER BY rank_ NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING)),
drawn AS (SELECT *, times > certain AND cum <= open AS drawn FROM ranked),
gap AS (SELECT source, max(open) - coalesce(max(cum) FILTER (WHERE drawn), 0) AS gap FROM drawn GROUP BY source),
last AS (SELECT d.source, min_by(place, (abs(size - gap), place)) AS last FROM drawn d JOIN gap ON d.source IS NOT DISTINCT FROM gap.source WHERE NOT drawn AND times > certain AND size > 0 AND abs(size - gap) < gap GROUP BY d.source)
SELECT doc_id, size, z AS source_size, target, CAST(size * (certain + CASE WHEN drawn OR coalesce(place = last, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken, d.source AS source, certain + CASE WHEN drawn OR coalesce(place = last, false) THEN 1 ELSE 0 END AS copies
FROM drawn d LEFT JOIN last ON d.source IS NOT DISTINCT FROM last.source"""
ORACLES = {"op11_prefix_trie": _TRIE, "op13_pareto_mix": _MIX, "embedding_deviations": _DEVIATION}
