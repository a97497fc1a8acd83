"""DuckDB SQL that gives the rows of the registered queries by other means."""

from __future__ import annotations

from callweave.plans.oracle_values import ACTIONS, CATEGORIES, COLLECTED, EXTENSIONS, KEYWORDS, NAME_MODE, QUALIFIED_MODE, VIEWER

_LINES = """
files AS (SELECT concat_ws('/', source, lang, doc_id::VARCHAR) AS rel_path, lang AS language, text FROM documents),
lines AS (SELECT rel_path, language, unnest(string_split(text, chr(10))) AS line,
  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM files)"""

_DEFS = (
    _LINES
    + """,
d0 AS (SELECT rel_path, language, line_no, line, max(line_no) OVER (PARTITION BY rel_path) AS n_lines,
  lower(regexp_extract(line, '^([A-Za-z]{3,})', 1)) AS name FROM lines),
d1 AS (SELECT rel_path, language, name, line_no AS start_line, line AS signature,
  coalesce(lead(line_no) OVER (PARTITION BY rel_path ORDER BY line_no) - 1, n_lines) AS end_line FROM d0 WHERE name <> ''),
defs AS (SELECT *, CASE WHEN length(name) > 4 THEN language END AS class_name,
  language || '::' || rel_path || '::' || CASE WHEN length(name) > 4 THEN language ELSE '' END || '::' || name || '::' || start_line AS def_id FROM d1)"""
)

_SITES = """,
s0 AS (SELECT rel_path, language, line_no, line, regexp_extract_all(line, '([A-Za-z]{6,}),', 1) AS names FROM lines),
sites AS (SELECT rel_path, language, line_no, line, lower(unnest(names)) AS callee, unnest(range(1, len(names) + 1)) AS start_col FROM s0)"""

_OWNED = """,
owned AS (SELECT s.*, d.def_id, d.class_name AS caller_class FROM sites s LEFT JOIN defs d
  ON d.rel_path = s.rel_path AND s.line_no BETWEEN d.start_line AND d.end_line)"""


#: Calls between parts, edges with their ordered sites and sibling orders (callees by first site, callers by
#: the place of their definition), and the hub.
_PARTS = """
pcalls AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, a.l_orderkey AS site_file, a.l_linenumber AS site_line
  FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
psites AS MATERIALIZED (SELECT * FROM pcalls WHERE dst IS NOT NULL),
e0 AS (SELECT src, dst, count(*) AS n_sites, min(struct_pack(f := site_file, l := site_line)) AS first FROM psites GROUP BY src, dst),
e AS MATERIALIZED (SELECT e0.*, struct_pack(a := '', b := 0::BIGINT, s := first, d := dst) AS down,
  struct_pack(a := coalesce(p_brand, ''), b := coalesce(p_size, 0)::BIGINT, s := first, d := src) AS up FROM e0 LEFT JOIN part ON p_partkey = src),
deg AS (SELECT id, sum(o) AS o, sum(i) AS i FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id),
anchor AS MATERIALIZED (SELECT id FROM deg ORDER BY o * i DESC, id LIMIT 1)"""


def _walk(callee: int, caller: int, mode: str = "qualified", per_level: int | None = None, nodes: int | None = None) -> str:
    """CTEs of all rounds, and ``nodes``."""
    n = max(callee, caller)
    if mode == "name":
        turns = [(1, k) for k in range(1, callee + 1)] + [(-1, k) for k in range(1, caller + 1)]
    else:
        turns = [(s, k) for k in range(1, n + 1) for s in (1, -1) if k <= (callee if s > 0 else caller)]
    out = ["r0 AS MATERIALIZED (SELECT id, 0 AS level, NULL::BIGINT AS parent, (SELECT [down] FROM e LIMIT 1)[1:0] AS path FROM anchor)"]
    seen, front = ["r0"], {1: "r0", -1: "r0"}
    for i, (side, k) in enumerate(turns, 1):
        here, there, key = ("src", "dst", "down") if side > 0 else ("dst", "src", "up")
        visited = " UNION ALL ".join(f"SELECT id FROM {r}" for r in seen)
        limits = [str(per_level)] if per_level is not None else []
        if nodes is not None:
            limits.append(f"{nodes} - (SELECT count(*) FROM ({visited}))")
        limit = f" ORDER BY path LIMIT (SELECT least({', '.join(limits)}))" if limits else ""
        out.append(
            f"r{i} AS MATERIALIZED (SELECT id, {side * k} AS level, arg_min(parent, path) AS parent, min(path) AS path FROM "
            f"(SELECT e.{there} AS id, f.id AS parent, list_append(f.path, e.{key}) AS path FROM {front[side]} f JOIN e ON e.{here} = f.id) "
            f"WHERE id NOT IN ({visited}) GROUP BY id{limit})"
        )
        seen.append(f"r{i}")
        front[side] = f"r{i}"
    out.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {r}" for r in seen) + ")")
    return ",\n".join(out)


def _walk_many(callee: int, caller: int, nodes: int) -> str:
    """CTEs of all rounds around every one of ``anchors``, and ``nodes``; ``turn`` numbers a round's nodes of an anchor."""
    n = max(callee, caller)
    out = ["r0 AS MATERIALIZED (SELECT id AS anchor, id, 0 AS level, NULL::BIGINT AS parent, 0::BIGINT AS turn FROM anchors)"]
    cut, seen, front = [], ["r0"], {1: "r0", -1: "r0"}
    turns = [(s, k) for k in range(1, n + 1) for s in (1, -1) if k <= (callee if s > 0 else caller)]
    for i, (side, k) in enumerate(turns, 1):
        here, there, key = ("src", "dst", "down") if side > 0 else ("dst", "src", "up")
        visited = " UNION ALL ".join(f"SELECT anchor, id FROM {r}" for r in seen)
        out.append(f"v{i} AS MATERIALIZED ({visited})")
        out.append(f"t{i} AS (SELECT anchor, count(*) AS taken FROM v{i} GROUP BY anchor)")
        out.append(
            f"w{i} AS MATERIALIZED (SELECT c.anchor, id, way.p AS parent, row_number() OVER (PARTITION BY c.anchor ORDER BY way) AS turn, {nodes} - taken AS room FROM "
            f"(SELECT f.anchor, e.{there} AS id, min(struct_pack(t := f.turn, k := e.{key}, p := f.id)) AS way FROM {front[side]} f JOIN e ON e.{here} = f.id GROUP BY f.anchor, e.{there}) c "
            f"JOIN t{i} USING (anchor) ANTI JOIN v{i} ON v{i}.anchor = c.anchor AND v{i}.id = c.id)"
        )
        out.append(f"r{i} AS MATERIALIZED (SELECT anchor, id, {side * k} AS level, parent, turn FROM w{i} WHERE turn <= room)")
        cut.append(f"SELECT anchor FROM w{i} WHERE turn > room")
        seen.append(f"r{i}")
        front[side] = f"r{i}"
    out.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {r}" for r in seen) + ")")
    out.append("short AS MATERIALIZED (" + " UNION ".join(cut) + ")")
    return ",\n".join(out)


_IDS = "array_to_string(list_prepend(anchor.id, list_transform(path, lambda x: x.d)), '>')"
_NODE_ROWS = f"SELECT nodes.id, level::BIGINT AS level, coalesce(parent, -1) AS parent, {_IDS} AS path FROM nodes, anchor"


def _chain_edges(callee: int, caller: int, cap: int | None = None) -> str:
    """Edges in the order in which a queue would follow them; with a cap the first ones."""
    limit = f" ORDER BY turn LIMIT {cap}" if cap is not None else ""
    return f"""
followed AS (SELECT e.src, e.dst, struct_pack(d := abs(n.level), s := 0, p := n.path, k := e.down) AS turn FROM e JOIN nodes n ON n.id = e.src WHERE n.level >= 0 AND n.level < {callee}
  UNION ALL SELECT e.src, e.dst, struct_pack(d := abs(n.level), s := 1, p := n.path, k := e.up) FROM e JOIN nodes n ON n.id = e.dst WHERE n.level <= 0 AND n.level > -{caller}),
turns AS MATERIALIZED (SELECT src, dst, min(turn) AS turn FROM followed GROUP BY src, dst),
capped AS MATERIALIZED (SELECT * FROM turns{limit}),
ce AS MATERIALIZED (SELECT e.*, c.turn FROM e JOIN capped c USING (src, dst) JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst)"""


_OPEN_STATUS = "CASE WHEN site_line % 2 = 0 THEN 'unresolved-ambiguous' ELSE 'unresolved-notfound' END"
_CHAIN = f"WITH {_PARTS}, {_walk(3, 3)}, {_chain_edges(3, 3)}"
_CHILDREN = """
kids AS MATERIALIZED (SELECT ce.src AS id, ce.dst AS child, struct_pack(s := 0, k := ce.down) AS turn FROM ce JOIN nodes a ON a.id = ce.src JOIN nodes b ON b.id = ce.dst
  WHERE a.level >= 0 AND b.level = a.level + 1
  UNION ALL SELECT ce.dst, ce.src, struct_pack(s := 1, k := ce.up) FROM ce JOIN nodes a ON a.id = ce.src JOIN nodes b ON b.id = ce.dst
  WHERE b.level <= 0 AND a.level = b.level - 1)"""
_CLUSTERS = """
cat AS (SELECT p_partkey AS id, CASE WHEN p_size <= 25 THEN 'util' ELSE 'core' END AS category FROM part),
clu AS MATERIALIZED (SELECT 'cluster:' || kids.id AS cluster_id, kids.id AS parent, count(*) AS n, list(child ORDER BY child) AS members
  FROM kids JOIN cat ON cat.id = kids.child WHERE category = 'util' GROUP BY kids.id HAVING count(*) >= 2)"""


def _case(table: dict[str, list[str]], default: str) -> str:
    quoted = {k: ", ".join(f"'{e}'" for e in v) for k, v in table.items()}
    return "CASE " + " ".join(f"WHEN ext IN ({v}) THEN '{k}'" for k, v in quoted.items()) + f" ELSE {default} END"


_NAMED = f"""
named AS (SELECT concat_ws('/', source, lang, doc_id || '.' || [{", ".join(f"'{e}'" for e in EXTENSIONS)}][(doc_id % {len(EXTENSIONS)}) + 1]) AS rel_path, n_chars FROM documents),
ext AS (SELECT rel_path, n_chars, lower(split_part(rel_path, '.', -1)) AS ext FROM named)"""
_COLLECTED = "(" + ", ".join(f"'{e}'" for e in COLLECTED) + ")"
_COLLECTED_TABLE = {k: [x for x in v if x in COLLECTED] for k, v in QUALIFIED_MODE.items()}

_PICK = """
sf AS (SELECT name, rel_path, count(*) AS n, max(def_id) AS id FROM defs GROUP BY ALL),
sfc AS (SELECT name, rel_path, coalesce(class_name, '') AS cls, count(*) AS n, max(def_id) AS id FROM defs GROUP BY ALL),
g AS (SELECT name, count(*) AS n, max(def_id) AS id FROM defs GROUP BY ALL),
gc AS (SELECT name, coalesce(class_name, '') AS cls, count(*) AS n, max(def_id) AS id FROM defs GROUP BY ALL),
bound AS (SELECT o.*, sf.n AS sfn, g.n AS gn,
  CASE WHEN sf.n IS NOT NULL THEN CASE WHEN sf.n = 1 THEN sf.id WHEN sfc.n = 1 THEN sfc.id END
       ELSE CASE WHEN g.n = 1 THEN g.id WHEN gc.n = 1 THEN gc.id END END AS target_id
  FROM owned o LEFT JOIN sf ON sf.name = o.callee AND sf.rel_path = o.rel_path
  LEFT JOIN sfc ON sfc.name = o.callee AND sfc.rel_path = o.rel_path AND sfc.cls = coalesce(o.caller_class, '')
  LEFT JOIN g ON g.name = o.callee LEFT JOIN gc ON gc.name = o.callee AND gc.cls = coalesce(o.caller_class, ''))"""

_UNIQUE = """
firsts AS (SELECT o.def_id, callee, min(struct_pack(a := line_no, b := start_col)) AS turn FROM owned o JOIN defs d USING (def_id)
  WHERE callee <> d.name GROUP BY ALL),
calls AS (SELECT def_id, list(callee ORDER BY turn, callee) AS calls FROM firsts GROUP BY def_id)"""

_SEARCH = """
q AS (SELECT 'tion' AS q),
h1 AS (SELECT CASE WHEN contains(name, q) THEN 'definition' ELSE 'text' END AS kind, def_id, rel_path, start_line AS line_no, 0 AS part, start_line AS a, 0 AS b, 0 AS c
  FROM defs, q WHERE contains(name, q) OR contains(lower(signature), q)),
h2 AS (SELECT 'text' AS kind, o.def_id, o.rel_path, o.line_no, 0 AS part, d.start_line AS a, 1 AS b, o.line_no * 100000 + o.start_col AS c
  FROM owned o JOIN defs d USING (def_id), q WHERE contains(lower(o.line), q)),
claimed AS (SELECT rel_path, line_no FROM h1 UNION SELECT rel_path, line_no FROM h2),
lastd AS (SELECT rel_path, arg_max(def_id, start_line) AS last_id FROM defs GROUP BY rel_path),
h3 AS (SELECT 'text' AS kind, coalesce(d.def_id, last_id) AS def_id, l.rel_path, l.line_no, 1 AS part, l.line_no AS a, 0 AS b, 0 AS c
  FROM lines l JOIN lastd USING (rel_path) LEFT JOIN defs d ON d.rel_path = l.rel_path AND l.line_no BETWEEN d.start_line AND d.end_line, q
  WHERE contains(lower(l.line), q) AND NOT EXISTS (SELECT 1 FROM claimed c WHERE c.rel_path = l.rel_path AND c.line_no = l.line_no)),
hits AS (SELECT kind, def_id, rel_path, line_no, min(struct_pack(part := part, a := a, b := b, c := c)) AS turn
  FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY ALL)"""



def _category(name: str, path: str) -> str:
    return f"CASE WHEN contains({path}, 'node_modules') THEN 'thirdparty' " + " ".join(f"WHEN regexp_matches(lower({name}), '^({p})') THEN '{c}'" for c, p in CATEGORIES.items()) + " ELSE 'core' END"


def _width(t: str) -> str:
    return f"(length({t}) + length(regexp_replace({t}, '[\\x{{00}}-\\x{{ff}}]', '', 'g')))"


def _within(t: str, units: int, side: str = "left") -> str:
    """The longest prefix or suffix that is no wider."""
    fits = f"list_filter(range(1, {units + 1}), lambda k: k <= length({t}) AND {_width(f'{side}({t}, k)')} <= {units})"
    return f"{side}({t}, coalesce(list_max({fits}), 0))"


def _columns(levels: list[int]) -> str:
    """Column layout: level 0 first, then outwards; rows of a column by the mean place of placed neighbours and of its own start."""
    rows = "(row_number() OVER (ORDER BY {order}) - 1 - (count(*) OVER () - 1) / 2.0) * 86.0"
    out = ["both_ends AS MATERIALIZED (SELECT src AS id, dst AS other FROM ce WHERE src <> dst UNION ALL SELECT dst, src FROM ce WHERE src <> dst)"]
    out.append("p0 AS MATERIALIZED (SELECT id, 0 AS level, " + rows.format(order="path") + " AS y FROM nodes WHERE level = 0)")
    done = ["p0"]
    for k in levels:
        name = f"p{k}" if k > 0 else f"q{-k}"
        near = " UNION ALL ".join(f"SELECT id, y FROM {d}" for d in done)
        out.append(f"s{name} AS MATERIALIZED (SELECT id, path, " + rows.format(order="path") + f" AS y FROM nodes WHERE level = {k})")
        out.append(f"c{name} AS MATERIALIZED (SELECT b.id, avg(n.y) AS c FROM both_ends b JOIN ({near} UNION ALL SELECT id, y FROM s{name}) n ON n.id = b.other WHERE b.id IN (SELECT id FROM s{name}) GROUP BY b.id)")
        out.append(f"{name} AS MATERIALIZED (SELECT s.id, {k} AS level, " + rows.format(order="coalesce(c, 0), path") + f" AS y FROM s{name} s LEFT JOIN c{name} USING (id))")
        done.append(name)
    out.append("placed AS MATERIALIZED (SELECT id, level, level * 316.0 - 112 AS x, y FROM (" + " UNION ALL ".join(f"SELECT * FROM {d}" for d in done) + "))")
    return ",\n".join(s.replace("316.0 - 112 AS x", "316.0::DOUBLE - 112 AS x").replace("* 86.0", "* 86.0::DOUBLE") for s in out)


_COLUMNS = _columns([1, 2, 3, -1, -2, -3])
_ACTION = "CASE d.name " + " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in ACTIONS.items()) + " ELSE 'handle' END"
_PLAIN = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"

ORACLES = {
    "detect_language": f"""WITH {_NAMED}
SELECT rel_path, {_case(NAME_MODE, "NULL")} AS name_mode, {_case(QUALIFIED_MODE, "NULL")} AS qualified_mode, {_case(VIEWER, "'plaintext'")} AS viewer,
  {_case(_COLLECTED_TABLE, "'typescript'")} AS collected FROM ext""",
    "lang_histogram": "SELECT lang AS language, count(*) AS n FROM documents GROUP BY lang",
    "lang_parse_stats": """WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, lang, count(*) FILTER (regexp_matches(line, '^[A-Za-z]{3}')) AS f FROM l GROUP BY ALL),
m AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT lang AS language, count(*) AS files, sum(f)::BIGINT AS functions, count(*) FILTER (toxic = 1) AS errors FROM c LEFT JOIN m USING (doc_id) GROUP BY lang""",
    "split_lines": r"""SELECT doc_id, len(regexp_split_to_array(text, '[\n\r\x0B\f\x{85}\x{2028}\x{2029}'||chr(133)||']'))::BIGINT AS n_name_mode,
  len(string_split(text, chr(10)))::BIGINT AS n_qualified_mode FROM documents""",
    "path_tree": f"""WITH p AS (SELECT DISTINCT regexp_replace({_PLAIN}, '/+$', '') AS fp FROM pages),
s AS (SELECT fp, string_split(fp, '/') AS parts FROM p),
l AS (SELECT fp, parts, unnest(range(1, len(parts) + 1)) AS depth FROM s),
r AS (SELECT DISTINCT array_to_string(parts[1:depth - 1], '/') AS parent, parts[depth] AS name, array_to_string(parts[1:depth], '/') AS path,
  CASE WHEN depth = len(parts) THEN 'file' ELSE 'dir' END AS type, depth FROM l)
SELECT parent, name, path, type, depth::BIGINT AS depth, row_number() OVER (PARTITION BY parent ORDER BY type <> 'dir', name) AS turn FROM r""",
    "scan_caps": f"WITH {_NAMED} SELECT rel_path, n_chars FROM ext WHERE {_case(NAME_MODE, 'NULL')} IS NOT NULL AND n_chars <= 2500000 ORDER BY rel_path LIMIT 4000",
    "scan_budget": f"""WITH {_LINES}, n AS (SELECT rel_path, count(*) AS n FROM lines GROUP BY rel_path)
SELECT rel_path, n, (sum(n) OVER (ORDER BY rel_path) - n)::BIGINT AS before,
  greatest(0, least(n, 3000000 - (sum(n) OVER (ORDER BY rel_path) - n)))::BIGINT AS part FROM n""",
    "collect_sources": f"WITH {_NAMED} SELECT rel_path, {_case(_COLLECTED_TABLE, 'NULL')} AS language FROM ext WHERE ext IN {_COLLECTED}",
    "read_decode": """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 7 = 0 AND strlen(text) < 8192 THEN 'binary-skip' ELSE 'utf-8' END AS encoding,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 7 = 0 THEN CASE WHEN strlen(text) < 8192 THEN -1 ELSE length(text) + 1 END ELSE length(text) END AS n_chars FROM documents""",
    "line_shape": r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line_no FROM pages)
SELECT page_id, line_no, (length(line) - length(replace(line, '{', '')) - length(line) + length(replace(line, '}', '')))::BIGINT AS brace_delta,
  (length(h) + 3 * (length(h) - length(replace(h, chr(9), ''))))::BIGINT AS indent, contains(line, '{')::BIGINT AS has_brace
FROM (SELECT *, regexp_extract(line, '^([ \t]*)', 1) AS h FROM l WHERE line <> '')""",
    "call_sites_regex": f"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line_no FROM pages),
m AS (SELECT page_id, line_no, regexp_extract_all(line, '([A-Za-z_$][A-Za-z0-9_$]*)(?:<[^<>]*>)? *\\(', 1) AS names FROM l),
u AS (SELECT page_id, line_no, unnest(range(0, len(names))) AS turn, unnest(names) AS callee FROM m)
SELECT page_id, line_no, turn, callee FROM u WHERE callee NOT IN ({", ".join(f"'{k}'" for k in sorted(KEYWORDS))})""",
    "extract_defs": f"WITH {_DEFS} SELECT rel_path, name, start_line, end_line FROM defs",
    "qualified_id": f"WITH {_DEFS} SELECT rel_path, def_id FROM defs",
    "first_definition": f"WITH {_DEFS} SELECT rel_path, arg_min(def_id, start_line) AS def_id FROM defs GROUP BY rel_path",
    "symbol_list": f"WITH {_DEFS} SELECT rel_path, name, start_line FROM defs ORDER BY rel_path, start_line LIMIT 40",
    "session_totals": f"WITH {_DEFS} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM defs) AS definitions",
    "line_owner": f"WITH {_DEFS} SELECT l.rel_path, l.line_no, d.def_id FROM lines l JOIN defs d ON d.rel_path = l.rel_path AND l.line_no BETWEEN d.start_line AND d.end_line",
    "resolve_name": f"""WITH {_DEFS}{_SITES},
near AS (SELECT name, rel_path, def_id, row_number() OVER (PARTITION BY name, rel_path ORDER BY start_line) AS rank FROM defs QUALIFY rank <= 3),
far AS (SELECT name, def_id, row_number() OVER (PARTITION BY name ORDER BY rel_path, start_line) AS rank FROM defs QUALIFY rank <= 3)
SELECT s.rel_path, s.line_no, s.start_col, s.callee, n.rank, n.def_id AS target_id FROM sites s JOIN near n ON n.name = s.callee AND n.rel_path = s.rel_path
UNION ALL
SELECT s.rel_path, s.line_no, s.start_col, s.callee, f.rank, f.def_id FROM sites s JOIN far f ON f.name = s.callee
WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.name = s.callee AND n.rel_path = s.rel_path)""",
    "resolve_qualified": f"""WITH {_DEFS}{_SITES}{_OWNED}, {_PICK}
SELECT rel_path, line_no, start_col, callee, CASE WHEN target_id IS NOT NULL THEN 'resolved' WHEN sfn IS NULL AND gn IS NULL THEN 'unresolved-notfound'
  ELSE 'unresolved-ambiguous' END AS status, target_id FROM bound""",
    "calls_by_caller": f"WITH {_DEFS}{_SITES}{_OWNED} SELECT def_id, count(*) AS n_calls, count(DISTINCT callee) AS n_names FROM owned WHERE def_id IS NOT NULL GROUP BY def_id",
    "unique_calls": f"WITH {_DEFS}{_SITES}{_OWNED}, {_UNIQUE} SELECT def_id, array_to_string(calls, ',') AS calls FROM calls",
    "unresolved_calls": f"WITH {_DEFS}{_SITES} SELECT rel_path, line_no, start_col, callee FROM sites WHERE callee NOT IN (SELECT name FROM defs)",
    "explain_defs": f"""WITH {_DEFS}{_SITES}{_OWNED}, {_UNIQUE}
SELECT d.def_id, 'Meant to ' || {_ACTION} || '.' || CASE WHEN c.calls IS NULL THEN '' ELSE ' Works with ' || array_to_string(c.calls[1:3], ', ') || '.' END AS summary,
  'inferred' AS basis, CASE WHEN d.end_line > d.start_line THEN 'Lines ' || d.start_line || '-' || d.end_line ELSE 'Line ' || d.start_line END || ' | ' ||
  CASE WHEN c.calls IS NULL THEN '' ELSE 'Calls ' || array_to_string(c.calls[1:5], ', ') || ' | ' END ||
  'Declared as ' || CASE WHEN length(trim(signature, ' ')) <= 120 THEN trim(signature, ' ') ELSE substr(trim(signature, ' '), 1, 119) || '…' END AS facts FROM defs d LEFT JOIN calls c USING (def_id)""",
    "search_text": f"WITH {_DEFS}{_SITES}{_OWNED}, {_SEARCH} SELECT kind, def_id, rel_path, line_no FROM hits ORDER BY rel_path, turn LIMIT 300",
    "search_all": f"WITH {_DEFS}{_SITES}{_OWNED}, {_SEARCH} SELECT kind, def_id, rel_path, line_no FROM hits",
    "symbol_at": f"""WITH {_DEFS},
s0 AS MATERIALIZED (SELECT rel_path, line_no, line, regexp_extract_all(line, '[A-Za-z]{{6,}},') AS m, string_split_regex(line, '[A-Za-z]{{6,}},') AS g FROM lines),
s1 AS MATERIALIZED (SELECT rel_path, line_no, lower(left(x, -1)) AS callee, NULL::VARCHAR AS caller_class,
  (sum(length(x) + length(y)) OVER (PARTITION BY rel_path, line_no ORDER BY k) - length(x) + 1)::BIGINT AS start_col
  FROM (SELECT rel_path, line_no, unnest(m) AS x, unnest(g[1:len(m)]) AS y, unnest(range(1, len(m) + 1)) AS k FROM s0)),
owned AS (SELECT * FROM s1), {_PICK},
fd AS (SELECT name, arg_min(def_id, struct_pack(a := rel_path, b := start_line)) AS first_id FROM defs GROUP BY name),
pos AS MATERIALIZED (SELECT rel_path, line_no, unnest([2, 40]) AS col FROM lines WHERE line <> '' UNION SELECT rel_path, line_no, start_col FROM s1),
h AS (SELECT p.*, d.def_id, 0 AS tier, 1 AS c FROM pos p JOIN defs d ON d.rel_path = p.rel_path AND d.start_line = p.line_no AND p.col >= 1 AND p.col < 1 + length(d.name)
  UNION ALL SELECT p.*, coalesce(b.target_id, fd.first_id), 1, b.start_col FROM pos p JOIN bound b ON b.rel_path = p.rel_path AND b.line_no = p.line_no
  AND p.col >= b.start_col AND p.col < b.start_col + length(b.callee) LEFT JOIN fd ON fd.name = b.callee)
SELECT rel_path, line_no, col::BIGINT AS col, arg_min(struct_pack(x := def_id), struct_pack(t := tier, c := c)).x AS symbol_id FROM h GROUP BY ALL""",
    "match_symbol": f"""WITH {_DEFS}
(SELECT 'text' AS rule, def_id FROM defs WHERE contains(name, 'the') ORDER BY name <> 'the', rel_path, start_line LIMIT 1)
UNION ALL (SELECT 'json' AS rule, def_id FROM defs WHERE contains(name, 'the') ORDER BY rel_path, start_line LIMIT 1)""",
    "snippet": f"""WITH {_DEFS} SELECT d.rel_path, d.start_line AS at, l.line_no, l.line FROM defs d JOIN lines l ON l.rel_path = d.rel_path
AND l.line_no BETWEEN d.start_line - 10 AND d.start_line + 10 WHERE d.name = 'the'""",
    "classify": f"WITH {_DEFS} SELECT def_id, CASE WHEN contains(rel_path, 'node_modules') THEN 'thirdparty' "
    + " ".join(f"WHEN regexp_matches(name, '^({p})') THEN '{c}'" for c, p in CATEGORIES.items())
    + " ELSE 'core' END AS category FROM defs",
    "label_texts": r"""SELECT doc_id, (length(text) + length(regexp_replace(text, '[\x{00}-\x{ff}]', '', 'g')))::BIGINT AS units, lang || '/' || doc_id AS short_path,
  doc_id || ':' || doc_id AS short_location, substr(trim(text, ' '), 1, 150) AS code, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 119) || '…' END AS short,
  CASE doc_id % 5 - 2 WHEN 0 THEN 'anchor' WHEN 1 THEN 'callee 1' WHEN 2 THEN 'callee 2' WHEN -1 THEN 'caller 1' ELSE 'caller 2' END AS level_label FROM documents""",
    "edge_group": f"WITH {_PARTS} SELECT src, dst, n_sites, first.f AS first_file, first.l::BIGINT AS first_line FROM e",
    "node_degree": f"""WITH {_PARTS} SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, sum(so)::BIGINT AS sites_out, sum(si)::BIGINT AS sites_in
FROM (SELECT src AS id, 1 AS o, 0 AS i, n_sites AS so, 0 AS si FROM e UNION ALL SELECT dst, 0, 1, 0, n_sites FROM e) GROUP BY id""",
    "bfs_callees": f"WITH {_PARTS}, {_walk(3, 0)} {_NODE_ROWS}",
    "bfs_callers": f"WITH {_PARTS}, {_walk(0, 3)} {_NODE_ROWS}",
    "call_graph": f"""WITH {_PARTS}, {_walk(2, 2)}, {_chain_edges(2, 2)},
x AS (SELECT src AS id, 1 AS o, 0 AS i, n_sites AS so, 0 AS si FROM ce UNION ALL SELECT dst, 0, 1, 0, n_sites FROM ce)
SELECT n.id, n.level::BIGINT AS level, coalesce(sum(o), 0)::BIGINT AS n_out, coalesce(sum(i), 0)::BIGINT AS n_in, coalesce(sum(so), 0)::BIGINT AS sites_out,
  coalesce(sum(si), 0)::BIGINT AS sites_in FROM nodes n LEFT JOIN x ON x.id = n.id GROUP BY n.id, n.level""",
    "build_graph_name": f"WITH {_PARTS}, {_walk(3, 3, 'name')} {_NODE_ROWS}",
    "build_graph_name_edges": f"""WITH {_PARTS}, {_walk(3, 3, "name")}
SELECT src, dst, n_sites FROM e WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)""",
    "build_graph_qualified": f"WITH {_PARTS}, {_walk(3, 3)} {_NODE_ROWS}",
    "build_graph_qualified_edges": f"{_CHAIN} SELECT src, dst, n_sites FROM ce",
    "graph_caps": f"WITH {_PARTS}, {_walk(4, 4, 'name', per_level=60, nodes=400)} {_NODE_ROWS}",
    "graph_caps_qualified": f"WITH {_PARTS}, {_walk(5, 5, nodes=300)} {_NODE_ROWS}",
    "child_ids": f"{_CHAIN}, {_CHILDREN} SELECT id, array_to_string(list(child ORDER BY turn), ',') AS children FROM kids GROUP BY id",
    "edge_sites": f"""WITH {_PARTS} SELECT src, dst, array_to_string(list(site_file || ':' || site_line ORDER BY site_file, site_line), ',') AS sites FROM psites GROUP BY src, dst""",
    "root_path": f"WITH {_PARTS}, {_walk(3, 3)} SELECT nodes.id, {_IDS} AS ids FROM nodes, anchor",
    "graph_caps_edges": f"""WITH {_PARTS}, {_walk(3, 3, nodes=300)}, {_chain_edges(3, 3, 500)}
SELECT src, dst, n_sites, (SELECT count(*) FROM turns) > 500 AS truncated FROM ce""",
    "build_graph_e": f"""WITH {_PARTS}, {_walk(2, 2)}, {_chain_edges(2, 2, 500)}, {_CHILDREN},
k AS (SELECT id, array_to_string(list(child ORDER BY turn), ',') AS children FROM kids GROUP BY id)
SELECT n.id, n.level::BIGINT AS level, coalesce(n.parent, -1) AS parent, coalesce(k.children, '') AS children, k.children IS NOT NULL AS has_children, {_category("p_name", "p_brand")} AS category,
  p_brand AS file, p_size::BIGINT AS line, (SELECT count(*) FROM turns) > 500 AS truncated FROM nodes n JOIN part ON p_partkey = n.id LEFT JOIN k ON k.id = n.id""",
    "unresolved_e": f"""WITH {_PARTS}, {_walk(2, 2)}, open_calls AS MATERIALIZED (SELECT * FROM pcalls WHERE dst IS NULL)
SELECT src, site_file, site_line::BIGINT AS site_line, {_OPEN_STATUS} AS status FROM open_calls SEMI JOIN nodes ON nodes.id = src""",
    "graph_totals": f"""WITH {_PARTS}, {_walk(2, 2)}, {_chain_edges(2, 2, 500)}, missing AS MATERIALIZED (SELECT pcalls.* FROM pcalls SEMI JOIN nodes ON nodes.id = src WHERE dst IS NULL)
SELECT (SELECT count(*) FROM nodes JOIN part ON p_partkey = id) AS nodes, (SELECT count(*) FROM ce) AS edges, (SELECT coalesce(sum(n_sites), 0)::BIGINT FROM ce) AS sites, (SELECT count(*) FROM missing) AS unresolved""",
    "node_edges": f"""WITH {_PARTS} SELECT src AS id, 'out' AS side, dst AS other, n_sites, first.f AS first_file, first.l::BIGINT AS first_line FROM e SEMI JOIN anchor ON anchor.id = src
UNION ALL SELECT dst, 'in', src, n_sites, first.f, first.l::BIGINT FROM e SEMI JOIN anchor ON anchor.id = dst""",
    "reanchor": f"""WITH {_PARTS}, anchors AS MATERIALIZED (SELECT id FROM deg ORDER BY o * i DESC, id LIMIT 100), {_walk_many(3, 3, 300)}
SELECT n.anchor, n.id, level::BIGINT AS level, coalesce(parent, -1) AS parent, s.anchor IS NOT NULL AS truncated FROM nodes n LEFT JOIN short s ON s.anchor = n.anchor""",
    "build_graph_e_caps": f"""WITH {_PARTS}, {_walk(5, 5, nodes=300)}, {_chain_edges(5, 5, 500)}, {_CHILDREN},
k AS (SELECT id, array_to_string(list(child ORDER BY turn), ',') AS children FROM kids GROUP BY id)
SELECT n.id, n.level::BIGINT AS level, coalesce(n.parent, -1) AS parent, coalesce(k.children, '') AS children, k.children IS NOT NULL AS has_children, {_category("p_name", "p_brand")} AS category,
  p_brand AS file, p_size::BIGINT AS line, (SELECT count(*) FROM turns) > 500 OR (SELECT count(*) FROM nodes) >= 300 AS truncated FROM nodes n JOIN part ON p_partkey = n.id LEFT JOIN k ON k.id = n.id""",
    "visible_minus_agg": f"""{_CHAIN}, {_CHILDREN}, {_CLUSTERS}, taken AS MATERIALIZED (SELECT DISTINCT unnest(members) AS child FROM clu),
left_over AS MATERIALIZED (SELECT kids.* FROM kids ANTI JOIN taken USING (child))
SELECT id, array_to_string(list(child ORDER BY turn), ',') AS children FROM left_over GROUP BY id""",
    "anchor_from_hit": f"""WITH {_DEFS}{_SITES}{_OWNED}, {_SEARCH} SELECT def_id AS anchor_id, kind, h.rel_path, h.line_no,
  CASE WHEN kind = 'text' THEN h.rel_path END AS focus_rel_path, CASE WHEN kind = 'text' THEN h.line_no END AS focus_line_no, CASE WHEN kind = 'text' THEN l.line END AS focus_code
FROM hits h JOIN lines l ON l.rel_path = h.rel_path AND l.line_no = h.line_no""",
    "full_chain": f"WITH {_PARTS}, {_walk(9, 9)} {_NODE_ROWS}",
    "name_tokens": f"""WITH {_DEFS} SELECT def_id, name || ' ' || upper(substr(name, 1, 1)) || substr(name, 2) AS tokens FROM defs""",
    "layout_rows": f"""{_CHAIN}, w AS (SELECT n.id, n.level, p_brand, p_size, greatest(110.0, least(330.0, length(p_name) * 7.6 + 26, length(p_brand || ':' || p_size) * 6.6 + 26))::DOUBLE AS width
  FROM nodes n JOIN part ON p_partkey = n.id),
x AS (SELECT *, sum(width + 20) OVER (PARTITION BY level ORDER BY p_brand, p_size, id ROWS UNBOUNDED PRECEDING) - width - 20 AS l, sum(width + 20) OVER (PARTITION BY level) - 20 AS t FROM w)
SELECT id, level::BIGINT AS level, round(l - t / 2 + width / 2, 6) AS x, ((level - (SELECT min(level) FROM nodes) + 0.5) * 110)::DOUBLE AS y, round(width, 6) AS width FROM x""",
    "hit_test": f"""{_CHAIN}, w AS (SELECT n.id, n.level, p_brand, p_size, greatest(110.0, least(330.0, length(p_name) * 7.6 + 26, length(p_brand || ':' || p_size) * 6.6 + 26))::DOUBLE AS width
  FROM nodes n JOIN part ON p_partkey = n.id),
x AS (SELECT *, sum(width + 20) OVER (PARTITION BY level ORDER BY p_brand, p_size, id ROWS UNBOUNDED PRECEDING) - width - 20 AS l, sum(width + 20) OVER (PARTITION BY level) - 20 AS t FROM w),
box AS MATERIALIZED (SELECT id, l - t / 2 + width / 2 AS x, ((level - (SELECT min(level) FROM nodes) + 0.5) * 110)::DOUBLE AS y, width FROM x),
point AS (SELECT event_id, (event_id * 37 % 20001 - 10000)::DOUBLE AS px, ((user_id * 53 + event_id) % 800)::DOUBLE AS py FROM events)
SELECT event_id AS point_id, max(id) AS id FROM point JOIN box ON px BETWEEN x - width / 2 - 6 AND x + width / 2 + 6 AND abs(y - py) <= 30 GROUP BY event_id""",
    "label_layout": f"""WITH d AS (SELECT doc_id, text AS t, list_filter(string_split(replace(concat_ws('/', source, lang, text), chr(92), '/'), '/'), lambda p: p <> '') AS parts FROM documents),
h AS (SELECT *, array_to_string(parts[-2:], '/') || ':' || doc_id AS place, {_within("t", 20)} AS head FROM d),
m AS (SELECT *, length(regexp_extract(head, '^(.*)[._-]', 1)) AS mark, list_max(list_filter(range(9, 20), lambda k: k < length(t) AND regexp_matches(substr(t, k, 2), '^[a-z0-9][A-Z]$'))) AS step FROM h),
c AS (SELECT *, CASE WHEN mark >= 8 THEN mark + 1 ELSE coalesce(step, 19) END AS cut_at FROM m),
r AS (SELECT *, substr(t, cut_at::BIGINT + 1) AS rest FROM c)
SELECT doc_id, CASE WHEN {_width("t")} <= 19 THEN t ELSE left(t, cut_at::BIGINT) || chr(10) || CASE WHEN {_width("rest")} <= 28 THEN rest ELSE {_within("rest", 27)} || '…' END END AS wrapped,
  CASE WHEN {_width("place")} <= 32 THEN place ELSE {_within("place", 18)} || '…' || {_within("place", 13, "right")} END AS location FROM r""",
    "layout_columns": f"{_CHAIN}, {_COLUMNS} SELECT id, level::BIGINT AS level, x, y FROM placed",
    "layout_bounds": f"{_CHAIN}, {_COLUMNS} SELECT min(x) - 28 AS min_x, max(x) + 252 AS max_x, min(y) - 34 AS min_y, max(y) + 86 AS max_y FROM placed",
    "edge_paths": f"""{_CHAIN}, {_COLUMNS}, b AS (SELECT ce.src, ce.dst, p.x + 224 AS x1, p.y + 34 AS y1, q.x AS x2, q.y + 34 AS y2 FROM ce JOIN placed p ON p.id = ce.src JOIN placed q ON q.id = ce.dst),
c AS (SELECT *, greatest(abs(x2 - x1) / 2, 34) AS bend FROM b)
SELECT src, dst, printf('M %.1f %.1f C %.1f %.1f, %.1f %.1f, %.1f %.1f', x1, y1, x1 + bend, y1, x2 - bend, y2, x2, y2) AS d FROM c""",
    "level_counts": f"{_CHAIN} SELECT level::BIGINT AS level, count(*) AS n FROM nodes GROUP BY level",
    "parent_edges": f"""{_CHAIN} SELECT n.id, n.parent, ce.n_sites, ce.first.f AS first_file, ce.first.l::BIGINT AS first_line FROM nodes n
JOIN ce ON (n.level > 0 AND ce.src = n.parent AND ce.dst = n.id) OR (n.level < 0 AND ce.dst = n.parent AND ce.src = n.id)""",
    "anchor_adjacent": f"""WITH {_PARTS} SELECT src, dst, site_file, site_line::BIGINT AS site_line FROM psites, anchor
WHERE (src = anchor.id OR dst = anchor.id) AND src <> dst""",
    "focus_edges": f"""WITH {_PARTS}, m AS (SELECT min(struct_pack(f := site_file, l := site_line)) AS m FROM psites)
SELECT DISTINCT src, dst FROM psites, m WHERE site_file = m.m.f AND site_line = m.m.l""",
    "visible_nodes": f"{_CHAIN}, {_CHILDREN} SELECT id FROM anchor UNION SELECT child FROM kids JOIN nodes USING (id) WHERE level BETWEEN -1 AND 1",
    "collapse_subtree": f"""{_CHAIN}, {_CHILDREN}, ex AS (SELECT id, level FROM nodes WHERE level BETWEEN -2 AND 2),
t AS (SELECT id FROM nodes WHERE level = 1 ORDER BY path LIMIT 1), u AS (SELECT child AS id FROM kids WHERE id IN (SELECT id FROM t) AND child IN (SELECT id FROM ex))
SELECT id FROM ex WHERE id NOT IN (SELECT id FROM t) AND id NOT IN (SELECT id FROM u)""",
    "clusters": f"{_CHAIN}, {_CHILDREN}, {_CLUSTERS} SELECT cluster_id, parent, n, array_to_string(members, ',') AS members FROM clu",
    "redirect_edges": f"""{_CHAIN}, {_CHILDREN}, {_CLUSTERS},
mem AS (SELECT id, min(cluster_id) AS cluster_id FROM (SELECT unnest(members) AS id, cluster_id FROM clu) GROUP BY id),
x AS (SELECT coalesce(a.cluster_id, src::VARCHAR) AS from_id, coalesce(b.cluster_id, dst::VARCHAR) AS to_id, src, dst, n_sites
  FROM ce LEFT JOIN mem a ON a.id = src LEFT JOIN mem b ON b.id = dst)
SELECT from_id, to_id, arg_min(n_sites, struct_pack(s := src, d := dst)) AS n_sites FROM x WHERE from_id <> to_id GROUP BY ALL""",
    "expand_plan": f"""{_CHAIN}, {_CHILDREN}, cat AS (SELECT p_partkey AS id, p_size <= 25 AS util FROM part),
vis AS (SELECT id FROM anchor UNION SELECT child FROM kids WHERE id IN (SELECT id FROM anchor)),
new AS (SELECT DISTINCT child AS id FROM kids WHERE id IN (SELECT id FROM nodes WHERE level = 1 ORDER BY path LIMIT 1) AND child NOT IN (SELECT id FROM vis)),
n AS (SELECT (SELECT count(*) FROM vis) AS shown, (SELECT count(*) FROM new) AS new, (SELECT count(*) FROM new JOIN cat USING (id) WHERE util) AS utils)
SELECT shown, new, utils, CASE WHEN shown + new <= 30 THEN 'expand' WHEN utils >= 2 AND shown + new - utils + 1 <= 30 THEN 'fold' ELSE 'refuse' END AS action FROM n""",
    "progress_totals": """SELECT event_id, event_type, user_id, count(*) OVER w AS running_count, (sum(user_id) OVER w)::BIGINT AS running_sum FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""",
}
#: Another way to the same rows.
ORACLES["search_indexed"] = ORACLES["search_text"]
