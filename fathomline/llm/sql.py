"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import dialogue, filteraudit
from .jaccard import PERCENT, WORDS
from .nndescent import THRESHOLD
from .urlfilter import ALIKE, DEPTH, LOWER, PRIOR, REJECT, RULES, STRENGTH, UPPER, VARIETY


def _rules(column: int) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[column]}'" for v, h, p in ordered)
    return f"CASE {cases} END"


def url_filter() -> str:
    """The templates and their purity level by level, as in ``urlfilter``, in DuckDB's SQL."""
    parts = [
        "p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)",
        f"r AS (SELECT *, {_rules(0)} AS rule, {_rules(1)} AS ruled, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '*' WHEN regexp_full_match(s, '[0-9]+\\.[A-Za-z0-9]+') THEN '*' || regexp_extract(s, '(\\.[A-Za-z0-9]+)$', 1) WHEN regexp_full_match(s, '[0-9A-Fa-f-]{{8,}}') AND regexp_matches(s, '[0-9]') THEN '*' WHEN length(s) > 64 THEN '*' ELSE s END) AS shaped FROM h)",
        f"raws AS (SELECT page_id, host, path, rule, ruled, CASE WHEN len(shaped) > {DEPTH} THEN list_append(shaped[1:{DEPTH}], '**') ELSE shaped END AS raw FROM r)",
        "t0 AS (SELECT host, raw, count(ruled) AS lab, count(*) FILTER (WHERE ruled = 'block') AS blk, raw AS template FROM raws GROUP BY host, raw)",
    ]
    for d in range(1, DEPTH + 1):
        parts.append(f"w{d} AS (SELECT host, template[1:{d - 1}] AS prefix FROM t{d - 1} WHERE len(template) >= {d} GROUP BY 1, 2 HAVING count(DISTINCT template[{d}]) > {VARIETY})")
        parts.append(f"t{d} AS (SELECT t.host, raw, lab, blk, CASE WHEN w.host IS NOT NULL AND len(template) >= {d} THEN list_concat(list_concat(template[1:{d - 1}], ['*']), template[{d + 1}:{DEPTH + 1}]) ELSE template END AS template FROM t{d - 1} t LEFT JOIN w{d} w ON t.host = w.host AND t.template[1:{d - 1}] = w.prefix)")
    parts.append(f"leaves AS (SELECT host, template, sum(lab)::DOUBLE AS lab, sum(blk)::DOUBLE AS blk FROM t{DEPTH} GROUP BY 1, 2)")
    parts.append("m0 AS (SELECT l.host, l.template, 0::DOUBLE AS lab, 0::DOUBLE AS blk FROM leaves l)")
    for d in range(DEPTH + 2):
        name, before = f"m{d + 1}", f"m{d}"
        parts.append(f"n{d} AS (SELECT host, template[1:{d}] AS prefix, sum(lab) AS nlab, sum(blk) AS nblk FROM leaves WHERE len(template) >= {d} GROUP BY 1, 2)")
        pooled = "((m.blk + nblk) / greatest(m.lab + nlab, 1))"
        parts.append(
            f"{name} AS (SELECT m.host, m.template, CASE WHEN nlab IS NULL OR alike THEN m.lab ELSE nlab END AS lab, CASE WHEN nlab IS NULL OR alike THEN m.blk ELSE nblk END AS blk FROM (SELECT m.*, nlab, nblk, (m.lab > 0 AND nlab > 0 AND abs(nblk / greatest(nlab, 1) - m.blk / greatest(m.lab, 1)) <= {ALIKE} * sqrt({pooled} * (1 - {pooled}) * (1 / greatest(m.lab, 1.0::DOUBLE) + 1 / greatest(nlab, 1.0::DOUBLE))) + 1e-12) AS alike FROM {before} m LEFT JOIN n{d} n ON len(m.template) >= {d} AND m.host = n.host AND m.template[1:{d}] = n.prefix) m)"
        )
    parts.append("common AS (SELECT template, sum(lab) AS tlab, sum(blk) AS tblk FROM leaves GROUP BY 1)")
    parts.append(f"scored AS (SELECT m.host, m.template, round((m.blk + {STRENGTH} * ((tblk + {STRENGTH} * {PRIOR}) / (tlab + {STRENGTH}))) / (m.lab + {STRENGTH}), 9) AS purity FROM m{DEPTH + 2} m JOIN common c ON m.template = c.template)")
    return (
        "WITH " + ", ".join(parts) + " SELECT page_id, g.host, path, rule, coalesce(ruled, CASE WHEN purity >= " + str(REJECT) + " THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(t.template, '/') AS template, purity "
        f"FROM raws g JOIN t{DEPTH} t ON g.host = t.host AND g.raw = t.raw JOIN scored s ON t.host = s.host AND t.template = s.template"
    )


#: From links n (u, v, both ways) and nodes s (id): the smallest id reachable.
_REACH = "r AS (SELECT id AS node, id AS root FROM s UNION SELECT n.v, r.root FROM r JOIN n ON n.u = r.node WHERE r.root < n.v), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)"


def jaccard_join() -> str:
    """All pairs that share a shingle: right for small tables only."""
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return (
        f"WITH RECURSIVE w AS (SELECT doc_id AS id, {words} AS ws FROM documents), "
        f"s AS (SELECT id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' ')) END) AS sh FROM w), "
        "e AS (SELECT id, unnest(sh) AS t FROM s), p AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2), "
        f"l AS (SELECT x, y FROM p JOIN s a ON a.id = x JOIN s b ON b.id = y WHERE 100 * c >= {PERCENT} * (len(a.sh) + len(b.sh) - c)), n AS (SELECT x AS u, y AS v FROM l UNION SELECT y, x FROM l), {_REACH} "
        "SELECT s.id AS doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, root AS component_id FROM s JOIN c ON c.node = s.id"
    )


def near_duplicates() -> str:
    """All pairs of vectors: right for small tables only."""
    return (
        "WITH RECURSIVE s AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), g AS (SELECT * FROM s WHERE len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_aggregate(x, 'max') <> 0), "
        f"n AS (SELECT a.id AS u, b.id AS v FROM g a JOIN g b ON a.id <> b.id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}), {_REACH}, d AS (SELECT u, count(*) AS k FROM n GROUP BY 1) "
        "SELECT s.id AS vec_id, coalesce(k, 0) AS n_links, root AS component_id, s.id = root AS kept FROM s JOIN c ON c.node = s.id LEFT JOIN d ON d.u = s.id"
    )


def filter_audit() -> str:
    """Documents counted by failures, crossed with the 120 orders."""
    words = "list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    fails = (
        f"CASE WHEN len(ws) < {filteraudit.LEAST_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < {filteraudit.DISTINCT_PERCENT} * len(ws) THEN 'B' ELSE '' END || "
        f"CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {filteraudit.CAPITAL_PERCENT} * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[{filteraudit.SIGNS.decode()}]') THEN 'D' ELSE '' END || "
        "CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END"
    )
    letters = ", ".join(f"(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) l{k}" for k in range(5))
    unlike = " AND ".join(f"l{i}.x <> l{j}.x" for i in range(5) for j in range(i))
    first = "least(" + ", ".join(f"CASE WHEN contains(fails, f[{k}]) THEN {k} ELSE 6 END" for k in range(1, 6)) + ")"
    count = lambda where: f"CAST(coalesce(sum(n) FILTER (WHERE {where}), 0) AS BIGINT)"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents), w AS (SELECT *, {words} AS ws FROM d), j AS (SELECT doc_id, part, {fails} AS fails FROM w), "
        "m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1), "
        "g AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM j LEFT JOIN m USING (doc_id) GROUP BY ALL), "
        f"o AS (SELECT l0.x || l1.x || l2.x || l3.x || l4.x AS f FROM {letters} WHERE {unlike}), "
        f"x AS (SELECT part, fails, good, toxic, n, f, {first} AS first FROM g, o), s AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM x), "
        f"a AS (SELECT part, f AS filter_order, step, f[step] AS letter, {count('first > step')} AS kept, {count('first = step')} AS removed, {count('contains(fails, f[step]) AND first < step')} AS redundant, {count('fails = f[step]')} AS unique_fails, "
        f"{count('first = step AND good = 1')} AS good_lost, {count('first = step AND toxic = 1')} AS toxic_lost FROM s GROUP BY 1, 2, 3, 4) "
        "SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM a"
    )


def conversation_repair() -> str:
    """Damage, faults and, row by row, the cheapest edits that end in each state of the talk: empty, after s, after u, after a."""
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({key}, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {bits}), 4294967295)"
    body = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    fault = f"CASE WHEN {body} = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT contains('{dialogue.ENDS}', right({body}, 1)) THEN 'truncated' ELSE '' END"
    # Insertions after a row: up to three more roles, each of which the state asks for.
    inserts = [(s, s, "", []) for s in range(4)] + [(s, 2, "I", ["user:"]) for s in (0, 1, 3)] + [(2, 3, "I", ["assistant:"])]
    inserts += [(s, 3, "II", ["user:", "assistant:"]) for s in (0, 1, 3)] + [(2, 2, "II", ["assistant:", "user:"])] + [(s, 2, "III", ["user:", "assistant:", "user:"]) for s in (0, 1, 3)] + [(2, 3, "III", ["assistant:", "user:", "assistant:"])]
    more = ", ".join(f"({a}, {b}, '{letters}', CAST({lines} AS VARCHAR[]))" for a, b, letters, lines in inserts)
    moves = "VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')"
    given = "CASE n.take WHEN 'u' THEN 'user' ELSE 'assistant' END"
    best = "QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1"
    added = f"{dialogue.INSERT} * length(letters)"
    left = f"CASE WHEN r.fault = 'truncated' THEN {dialogue.TRUNCATED} ELSE 0 END"
    # What becomes of a row: deleted in any state, or moved on to the next one, kept or with another role.
    step = (
        f"SELECT t.conv_id, t.i, n.next AS state, t.cost + CASE WHEN n.take = '' THEN {dialogue.DELETE} WHEN left(r.role, 1) = n.take THEN {left} ELSE {dialogue.REROLE} + {left} END AS cost, "
        f"t.audit || CASE WHEN n.take = '' THEN 'D' WHEN left(r.role, 1) = n.take THEN 'K' ELSE 'R' END AS audit, CASE WHEN n.take = '' THEN t.lines ELSE list_append(t.lines, CASE WHEN left(r.role, 1) = n.take THEN r.role ELSE {given} END || ':' || r.text) END AS lines "
        "FROM t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1 JOIN n ON n.state = t.state WHERE n.take = '' OR (r.fault NOT IN ('blank', 'duplicate') AND (n.take <> 's' OR left(r.role, 1) = 's'))"
    )
    return (
        "WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, " + crc + " % 20 AS kind FROM conversations), "
        f"a AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[{dialogue.ENDS}]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE kind <> 0), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM a), "
        f"r AS (SELECT *, {fault} AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o), "
        f"n(state, next, take) AS ({moves} UNION ALL SELECT unnest([0, 1, 2, 3]), unnest([0, 1, 2, 3]), ''), m(state, next, letters, more) AS (VALUES {more}), "
        f"t AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, next AS state, CAST({added} AS BIGINT) AS cost, letters AS audit, more AS lines FROM (SELECT DISTINCT conv_id FROM d), m WHERE m.state = 0 {best.replace('state ORDER', 'next ORDER')} "
        f"UNION ALL SELECT conv_id, i + 1, m.next AS state, cost + {added} AS cost, audit || letters AS audit, list_concat(lines, more) AS lines FROM ({step}) s JOIN m ON m.state = s.state QUALIFY row_number() OVER (PARTITION BY conv_id, m.next ORDER BY cost + {added}, audit || letters) = 1), "
        "c AS (SELECT k.conv_id, count(r.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, "
        "count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT DISTINCT conv_id FROM d) k LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id), "
        "e AS (SELECT t.* FROM t JOIN c ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = c.n WHERE t.state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY t.conv_id ORDER BY cost, audit) = 1) "
        "SELECT c.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM c JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"
    )
