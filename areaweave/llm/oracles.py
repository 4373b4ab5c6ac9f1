"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

#: Words between ASCII blanks; a null text has none.
_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents), n AS (SELECT doc_id, ws, len(ws) AS n FROM w)"

#: Every window of 35 words, by its words; all of those that occur again cover their words.
OP3 = f"""WITH {_WORDS},
win AS (SELECT doc_id, s, array_to_string(ws[s:s+34], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, n-33)) AS s FROM n)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY t) AS c FROM win) WHERE c>1),
cov AS (SELECT DISTINCT doc_id, unnest(range(s, s+35)) AS k FROM again),
word AS (SELECT doc_id, unnest(range(1, n+1)) AS k, unnest(ws) AS word FROM n),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM word WHERE (doc_id, k) NOT IN (SELECT (doc_id, k) FROM cov) GROUP BY doc_id)
SELECT n.doc_id AS doc_id, CAST(n.n AS BIGINT) AS n_words, CAST(n.n-coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM n LEFT JOIN kept ON kept.doc_id=n.doc_id"""

#: Every pair of documents that share a shingle, counted; classes by following links.
OP8 = f"""WITH RECURSIVE {_WORDS},
sh AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, array_to_string(ws[s:s+4], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, n-3)) AS s FROM n WHERE n>=5) UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM n WHERE n BETWEEN 1 AND 4)),
size AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sh x JOIN sh y ON x.t=y.t AND x.doc_id<>y.doc_id GROUP BY 1, 2) JOIN size p ON p.doc_id=a JOIN size q ON q.doc_id=b WHERE m>=0.8*(p.c+q.c-m)-1e-9),
reach AS (SELECT a AS root, b AS node FROM links UNION SELECT r.root, l.b FROM reach r JOIN links l ON l.a=r.node),
class AS (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY node), degree AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id AS doc_id, least(coalesce(c.class_id, d.doc_id), d.doc_id) AS class_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_links FROM documents d LEFT JOIN class c ON c.doc_id=d.doc_id LEFT JOIN degree g ON g.doc_id=d.doc_id"""

#: Every string of 400 bytes, in hexadecimal, by its digest.
OP4 = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h)//2 AS n FROM b),
win AS (SELECT doc_id, s, md5(substr(h, 2*s+1, 800)) AS t FROM (SELECT doc_id, h, unnest(range(0, n-399)) AS s FROM n)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY t) AS c FROM win) WHERE c>1),
step AS (SELECT doc_id, s, s-lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM again),
run AS (SELECT doc_id, s, sum(CASE WHEN gap<=400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM step),
span AS (SELECT doc_id, r, min(s) AS a, max(s)+400 AS z FROM run GROUP BY doc_id, r),
edge AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
kept AS (SELECT e.doc_id AS doc_id, string_agg(substr(h, 2*before+1, 2*(a-before)), '' ORDER BY a) AS t, max(z) AS z, CAST(sum(z-a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM edge e JOIN n ON n.doc_id=e.doc_id GROUP BY e.doc_id)
SELECT n.doc_id AS doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t||substr(h, 2*z+1), h))) AS kept_sha256 FROM n LEFT JOIN kept ON kept.doc_id=n.doc_id"""

#: The table of the cyclic redundancy check, by its rule; bytes are folded over it.
CRC = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""

#: Nodes level by level, then the siblings of every leaf's way up, then the claim folded along them.
OP11 = f"""WITH RECURSIVE {CRC},
part AS (SELECT doc_id, source, coalesce('s'||source, '') AS g, text, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR))||':'||doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source)||':'||source END, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang)||':'||lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR))||':'||n_chars END) AS head FROM documents),
hash AS (SELECT part.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255)+1])), 4294967295) AS h FROM part, crc),
low AS (SELECT *, CASE WHEN h%5=0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS bad FROM hash),
leaf AS (SELECT doc_id, g, sha256(head||CASE WHEN text IS NULL THEN '-' ELSE strlen(text)||':'||text END) AS leaf, sha256(head||CASE WHEN bad IS NULL THEN '-' ELSE strlen(bad)||':'||bad END) AS claim FROM low),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf)-1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf),
node AS (SELECT g, 0 AS lvl, i, leaf AS h, n FROM placed UNION ALL SELECT g, lvl+1, i//16, sha256(string_agg(h, '' ORDER BY i)), (n+15)//16 FROM node WHERE n>1 GROUP BY g, lvl, i//16, n),
sub AS (SELECT g, lvl AS tall, h AS subroot, row_number() OVER (ORDER BY g)-1 AS i, count(*) OVER () AS n FROM node WHERE n=1),
top AS (SELECT 0 AS lvl, i, subroot AS h, n FROM sub UNION ALL SELECT lvl+1, i//16, sha256(string_agg(h, '' ORDER BY i)), (n+15)//16 FROM top WHERE n>1 GROUP BY lvl, i//16, n),
size AS (SELECT max(lvl) AS tall, max(h) FILTER (n=1) AS root FROM top),
whole AS (SELECT g, lvl, i, h FROM node WHERE n>1 UNION ALL SELECT g, tall+top.lvl, top.i, top.h FROM sub, top WHERE top.n>1),
spot AS (SELECT doc_id, leaf, claim, g, unnest(range(0, sub.tall+size.tall)) AS lvl, placed.i AS i, sub.i AS j, sub.tall AS tall FROM placed JOIN sub USING (g), size),
step AS (SELECT doc_id, leaf, claim, g, lvl, CASE WHEN lvl<tall THEN i//CAST(power(16, lvl) AS BIGINT) ELSE j//CAST(power(16, lvl-tall) AS BIGINT) END AS i FROM spot),
level AS (SELECT doc_id, leaf, step.lvl AS lvl, coalesce(string_agg(h, '' ORDER BY whole.i) FILTER (whole.i<step.i), '') AS before, coalesce(string_agg(h, '' ORDER BY whole.i) FILTER (whole.i>step.i), '') AS after FROM step JOIN whole ON whole.g=step.g AND whole.lvl=step.lvl AND whole.i//16=step.i//16 GROUP BY doc_id, leaf, step.lvl, step.i),
proof AS (SELECT doc_id, leaf, sha256(string_agg(before||after, '' ORDER BY lvl)) AS proof FROM level GROUP BY doc_id, leaf),
climb AS (SELECT doc_id, leaf, 0 AS lvl, claim AS h FROM placed UNION ALL SELECT c.doc_id, c.leaf, c.lvl+1, sha256(before||c.h||after) FROM climb c JOIN level l ON l.doc_id=c.doc_id AND l.leaf=c.leaf AND l.lvl=c.lvl),
ended AS (SELECT doc_id, leaf, arg_max(h, lvl) AS folded FROM climb GROUP BY doc_id, leaf)
SELECT p.doc_id AS doc_id, p.leaf AS leaf, subroot, root, coalesce(proof.proof, sha256('')) AS proof_sha256, folded AS folded_root, folded=root AS verified FROM placed p JOIN sub USING (g), size, ended LEFT JOIN proof ON proof.doc_id=ended.doc_id AND proof.leaf=ended.leaf WHERE ended.doc_id=p.doc_id AND ended.leaf=p.leaf"""

#: Words that are equal with one place blanked, or one with a letter less; chains of forms by following them.
OP12 = f"""WITH RECURSIVE {CRC},
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
each AS (SELECT doc_id, r, count(*) AS c, length(r) AS k FROM run GROUP BY doc_id, r),
bytes AS (SELECT r, c, k, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR)||':'||r, ''), lambda x: CASE WHEN unicode(x)<128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192+unicode(x)//64 AS BIGINT), CAST(128+unicode(x)%64 AS BIGINT)] END)) AS b FROM each),
hash AS (SELECT r, c, k, xor(list_reduce(list_prepend(4294967295, b), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255)+1])), 4294967295) AS h FROM bytes, crc),
word AS (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h%97=0 THEN substr(r, 1, CAST(h%k AS BIGINT))||substr(r, CAST(h%k AS BIGINT)+2) ELSE r END AS w FROM hash) WHERE length(w)>=5 GROUP BY w HAVING sum(c)>=3),
hole AS (SELECT w, n, j, substr(w, 1, j)||'*'||substr(w, j+2) AS p, substr(w, 1, j)||substr(w, j+2) AS q FROM (SELECT w, n, unnest(range(0, length(w))) AS j FROM word)),
pair AS (SELECT a.w AS w, b.w AS o, b.n AS m FROM hole a JOIN hole b ON a.p=b.p AND a.w<>b.w UNION SELECT a.w, b.w, b.n FROM word a JOIN hole b ON a.w=b.q UNION SELECT b.w, a.w, a.n FROM word a JOIN hole b ON a.w=b.q),
near AS (SELECT w, count(*) AS n_near, arg_max(o, m) FILTER (m=top AND o=least) AS o, max(m) AS m FROM (SELECT *, max(m) OVER (PARTITION BY w) AS top, min(o) FILTER (m=top0) OVER (PARTITION BY w) AS least FROM (SELECT *, max(m) OVER (PARTITION BY w) AS top0 FROM pair)) GROUP BY w),
form AS (SELECT word.w AS w, CASE WHEN near.m>=2*word.n THEN near.o END AS form, word.n AS n, coalesce(n_near, 0) AS n_near, CASE WHEN near.m>=2*word.n THEN near.m END AS form_n FROM word LEFT JOIN near ON near.w=word.w),
way AS (SELECT w, w AS here, 0 AS step FROM form UNION ALL SELECT way.w, form.form, step+1 FROM way JOIN form ON form.w=way.here WHERE form.form IS NOT NULL),
root AS (SELECT w, arg_max(here, step) AS root FROM way GROUP BY w)
SELECT form.w AS word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM form JOIN root ON root.w=form.w"""

ORACLES = {"op3_phrases": OP3, "op4_suffixes": OP4, "op8_jaccard": OP8, "op11_merkle": OP11, "op12_variants": OP12}
