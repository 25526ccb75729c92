"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

from trestle.functions import lexicon as L
from trestle.plans import driver_tables as D
from trestle.operators.approvals import RUSSIAN
from trestle.plans.queries import LATIN_APPROVALS, LATIN_TAXONOMY, WORKS_RU

M, C, H, R, G = D.MATERIALS_SQL, D.CONTEXTS_SQL, D.CHANGES_SQL, D.REVISIONS_SQL, D.PAGES_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def collapsed(x: str) -> str:
    return rf"trim(regexp_replace(replace({x}, chr(160), ' '), '\s+', ' ', 'g'))"


LOW = "replace(lower(coalesce({0}, '')), 'ё', 'е')"
NORM = {
    "work": lambda x: collapsed(rf"regexp_replace({LOW.format(x)}, '[«»\"''().,;:–—-]', ' ', 'g')"),
    "cell": lambda x: collapsed(rf"regexp_replace(translate({LOW.format(x)}, '–—', '--'), '[«»\"''().:;,]', ' ', 'g')"),
    "running": lambda x: collapsed(rf"regexp_replace(translate({LOW.format(x)}, '–—', '--'), '[«»\"''()]', ' ', 'g')"),
    "plain": lambda x: collapsed(LOW.format(x)),
}
STEM = "regexp_replace({0}, '^(.{{4,}}?)(?:" + "|".join(L.ENDINGS) + ")$', '\\1')"
CATEGORIES = ("critical", "order", "low-stock", "expected", "delayed", "ok")
_flag = {c: '"order"' if c == "order" else c.replace("-", "_") for c in CATEGORIES}


def match(a: str, b: str) -> str:
    return f"({a} = {b} OR (length({a}) >= 4 AND length({b}) >= 4 AND (starts_with({a}, {b}) OR starts_with({b}, {a}))))"


def covered(wanted: str, there: str) -> str:
    return f"(CASE WHEN len(list_distinct({wanted})) = 0 THEN 0.0 ELSE len(list_filter(list_distinct({wanted}), lambda a: len(list_filter({there}, lambda b: {match('a', 'b')})) > 0)) / len(list_distinct({wanted}))::DOUBLE END)"


def words(x: str, stop, least: int, split: str = " ") -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(split)}), lambda w: length(w) >= {least} AND NOT list_contains({listed(stop)}, w))"


def stems(x: str) -> str:
    return f"list_transform({x}, lambda w: {STEM.format('w')})"


def first_prefix(x: str, phrases) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({x}, {NORM['cell'](q(p))}) THEN {q(p)}" for p in phrases) + " END"


def count_of(text: str, phrase: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {q(phrase)}, ''))) / {len(phrase)} AS INTEGER)"


SQL: dict[str, str] = {
    "material_state": f"WITH {M} SELECT part_key, slot, need, free, available, deficit FROM state",
    "material_risk": f"""WITH {M} SELECT part_key, slot, order_deadline, CASE WHEN need_date IS NULL OR deficit > 0 OR delivery > need_date THEN 'critical'
        WHEN DATE '{D.AS_OF}' > order_deadline AND confirmed = 0 THEN 'warning' ELSE 'ok' END AS risk FROM state""",
    "material_risks": f"WITH {M} SELECT part_key, slot, deficit FROM state WHERE deficit > 0",
    "control_categories": f"WITH {M} SELECT part_key, slot, concat_ws(',', " + ", ".join(f"CASE WHEN {_flag[c]} THEN '{c}' END" for c in CATEGORIES) + ") AS categories FROM flags",
    "control_counts": f"WITH {M} " + " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS n FROM flags WHERE {_flag[c]} HAVING count(*) > 0" for c in CATEGORIES),
    "control_primary": f'WITH {M} SELECT "primary", count(*) AS n FROM events_ GROUP BY 1',
    "control_filter": f"""WITH {M} SELECT part_key, slot, "primary" FROM events_ WHERE critical AND project = 'P3' AND object = 'O4'""",
    "control_values": f"WITH {M} SELECT DISTINCT project AS value FROM materials",
    "dashboard": f"WITH {M} SELECT count(*) AS materials, " + ", ".join(f'count(*) FILTER (WHERE {_flag[c]}) AS "{c.replace("-", "_")}"' for c in CATEGORIES) + " FROM flags",
    "schedule_lookup_first": f"""WITH {M}, {C}, f AS (SELECT kp, ko, kw, min(ord) AS ord FROM contexts GROUP BY ALL)
        SELECT part_key, slot, CAST(c.start - c.safety_days * INTERVAL 1 DAY AS DATE) AS need_date, c.ord AS context_ord
        FROM materials m LEFT JOIN f ON lower(m.project) = f.kp AND lower(m.object) = f.ko AND lower(m.work) = f.kw LEFT JOIN contexts c ON c.ord = f.ord""",
    "context_materials": f"""WITH {M}, {C} SELECT c.ord AS context_ord, count(*) AS n, sum(need) AS need
        FROM materials m JOIN contexts c ON lower(m.project) = c.kp AND lower(m.object) = c.ko AND lower(m.work) = c.kw GROUP BY 1""",
    "already_transferred_semi": f"""WITH {M} SELECT 'doc ' || (p_partkey % 9) AS document, CAST(p_partkey % 4 AS INTEGER) AS page, ' Part ' || p_partkey AS name FROM part
        WHERE EXISTS (SELECT 1 FROM materials m WHERE m.name = lower(trim(' Part ' || p_partkey)) AND m.part_key % 9 = p_partkey % 9 AND m.part_key % 8 = p_partkey % 4)""",
    "review_status": f"""WITH {M}, x AS (SELECT 'doc ' || (p_partkey % 9) AS document, p_partkey % 4 AS page, CASE WHEN EXISTS (SELECT 1 FROM materials m WHERE m.part_key = p_partkey AND m.part_key % 8 = p_partkey % 4) THEN 'transferred'
        WHEN p_partkey % 4 = 1 THEN 'rejected' ELSE 'pending' END AS review_status FROM part) SELECT document, review_status, count(*) AS n FROM x GROUP BY 1, 2""",
    "material_revision": f"WITH {H} SELECT key, seq, action, CAST(row_number() OVER (PARTITION BY key ORDER BY seq) AS INTEGER) AS revision FROM changes",
    "history_latest": f"WITH {H} SELECT key, seq, action, need, CAST(count(*) OVER (PARTITION BY key) AS INTEGER) AS revision FROM changes QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1",
    "history_diff": f"""WITH {H}, x AS (SELECT key, seq, CAST(need AS DECIMAL(18, 2)) AS need, unit, lag(CAST(need AS DECIMAL(18, 2))) OVER w AS need0, lag(unit) OVER w AS unit0 FROM changes WINDOW w AS (PARTITION BY key ORDER BY seq))
        SELECT key, seq, concat_ws('; ', CASE WHEN need IS DISTINCT FROM need0 THEN 'Потребность: ' || coalesce(need0::VARCHAR, '—') || ' → ' || coalesce(need::VARCHAR, '—') END,
            CASE WHEN unit IS DISTINCT FROM unit0 THEN 'Единица: ' || coalesce(unit0, '—') || ' → ' || coalesce(unit, '—') END) AS changes FROM x""",
    "history_retained": f"WITH {H} SELECT key, seq, action FROM changes ORDER BY seq DESC LIMIT 1000",
    "active_archive_split": f"""WITH {H}, x AS (SELECT action, count(*) OVER (PARTITION BY key) AS revision FROM changes QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
        SELECT action = 'archive' AS archived, count(*) AS n, CAST(sum(revision) AS BIGINT) AS revisions FROM x GROUP BY 1""",
    "content_dedup_sha256": "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY 2",
    "reject_known_anti": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE source <> 'src1' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src1')",
    "registry_current": f"WITH {R} SELECT document, revision, status FROM promoted",
    "registry_effective": f"WITH {R} SELECT document, revision, status FROM promoted QUALIFY row_number() OVER (PARTITION BY document ORDER BY status = 'current' DESC, received DESC, revision DESC) = 1",
    "registry_counters": f"WITH {R} SELECT count(DISTINCT document) AS documents, count(*) AS revisions, count(*) FILTER (WHERE status = 'current') AS current, count(*) FILTER (WHERE status IN ('received', 'under-review')) AS in_review FROM promoted",
    "revision_label": f"""WITH {R}, x AS (SELECT document, revision, row_number() OVER (PARTITION BY document ORDER BY received, revision) AS n FROM revisions)
        SELECT document, revision, 'R' || n AS revision_label, CASE WHEN n > 1 THEN 'R' || (n - 1) END AS previous_label FROM x""",
    "normalize_text": "SELECT doc_id, " + ", ".join(f"md5({f('text')}) AS {k}" for k, f in NORM.items()) + " FROM documents",
    "tokens": f"""WITH x AS (SELECT doc_id, {words(NORM['work']('text'), L.STOP_WORK, 2)} AS a, {words(NORM['cell']('text'), L.STOP_TABLE, 3, '[^а-яa-z0-9-]+')} AS b FROM documents)
        SELECT doc_id, CAST(len(a) AS INTEGER) AS n_work, CAST(len(b) AS INTEGER) AS n_table, md5(array_to_string(b, ' ')) AS table_words FROM x""",
    "stems_ru": f"WITH {G}, x AS (SELECT DISTINCT unnest(string_split({NORM['work']('text')}, ' ')) AS word FROM pages_) SELECT word, {STEM.format('word')} AS stem FROM x",
    "roots_match": f"""WITH p AS (SELECT DISTINCT p_name, p_type FROM part), w AS (SELECT DISTINCT p_name, unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM p)
        SELECT p_name, w, {covered('[w]', "string_split(p_name, ' ')")} AS coverage FROM w""",
    "text_coverage": f"""WITH x AS (SELECT p_partkey, {stems(words(NORM['cell']('p_name'), L.STOP_TABLE, 3, '[^а-яa-z0-9-]+'))} AS a, {stems(words(NORM['cell']("concat_ws(' ', p_type, p_name)"), L.STOP_TABLE, 3, '[^а-яa-z0-9-]+'))} AS b FROM part)
        SELECT p_partkey, CAST(floor({covered('a', 'b')} * 100 + 0.5) AS INTEGER) AS score FROM x""",
    "parse_number": r"""WITH x AS (SELECT o_orderkey, replace(CASE o_orderkey % 3 WHEN 0 THEN '1 ' || lpad(o_custkey::VARCHAR, 6, '0') || ',5' WHEN 1 THEN o_custkey || '.' || o_orderkey ELSE o_orderkey || ' шт' END, ' ', '') AS t FROM orders),
        y AS (SELECT o_orderkey, regexp_replace(t, '^([^,]*),', '\1.') AS t FROM x), z AS (SELECT o_orderkey, CASE WHEN regexp_full_match(t, '[+-]?\d+(\.\d+)?') THEN CAST(t AS DOUBLE) END AS value FROM y) SELECT o_orderkey, value, value AS loose FROM z""",
    "parse_date": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '20' || strftime(o_orderdate, '%y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM orders""",
    "duration_days": """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT l_orderkey, l_linenumber, CASE WHEN b >= a THEN CAST(b - a + 1 AS INTEGER) END AS days, CASE WHEN b < a THEN 'order' WHEN b - a + 1 > 180 THEN 'long' ELSE '' END AS review FROM x""",
    "ceil_to_step": """SELECT l_orderkey, l_linenumber, ceil(l_quantity * 4 * (1 + 10.0::DOUBLE / 100) / s) * s AS rounded FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM lineitem)""",
    "debounced_runs_by_user": """WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        y AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT user_id, min(ts) AS first_event, count(*) AS n_events FROM y GROUP BY user_id, run""",
    "ask_summary": f"""WITH {M} SELECT count(*) AS materials, count(*) FILTER (WHERE deficit > 0) AS with_deficit, count(*) FILTER (WHERE responsible IS NULL) AS without_responsible,
        (SELECT name FROM state WHERE deficit > 0 ORDER BY deficit DESC, ord LIMIT 1) AS largest_name, (SELECT max(deficit) FROM state WHERE deficit > 0) AS largest_deficit FROM state""",
    "ask_deficit": f"WITH {M} SELECT part_key, slot, deficit FROM state WHERE deficit > 0",
    "ask_context": f"WITH {M} SELECT part_key, slot, project FROM state WHERE project = 'P3'",
    "ask_responsible": f"WITH {M} SELECT project, coalesce(responsible, 'ответственный не назначен') AS responsible, count(*) AS n FROM state GROUP BY 1, 2",
}

# units: each list is a rule table over the inline cells
_cell = f"regexp_replace({NORM['cell']('raw')}, ' ', '', 'g')"
_material = r"regexp_replace(regexp_replace(lower(raw), '\s+', '', 'g'), '\.$', '')"
SQL["parse_unit"] = (
    f"WITH {G}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]')) AS raw FROM pages_), x AS (SELECT raw FROM w WHERE length(raw) BETWEEN 1 AND 6) SELECT raw, CASE {_cell} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.TABLE_UNITS.items()) + " ELSE '' END AS cell, CASE "
    + " ".join(f"WHEN regexp_matches(lower(trim(raw)), {q(p)}) THEN {q(u)}" for p, u in L.QUANTITY_UNITS) + " ELSE lower(trim(raw)) END AS running, CASE " + _material + " "
    + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.MATERIAL_UNITS.items()) + f" ELSE {_material} END AS material FROM x"
)

# work matching: every name with every alias, in plain SQL
_q, _c = NORM["work"]("p.name"), NORM["work"]("c.alias")
_qr, _cr = stems(words("qn", L.STOP_WORK, 2)), stems(words("cn", L.STOP_WORK, 2))


def matching(names: str, aliases: str) -> str:
    """CTEs up to ranked (name, work_id, ord, score, place), from SQL for p (name) and c (work_id, ord, alias)."""
    return f"""p AS ({names}), c AS ({aliases}), n AS (SELECT p.name, c.work_id, c.ord, {_q} AS qn, {_c} AS cn FROM p, c), r AS (SELECT *, {_qr} AS qr, {_cr} AS cr FROM n),
    m AS (SELECT *, len(list_distinct(list_filter(cr, lambda a: len(list_filter(qr, lambda b: {match('a', 'b')})) > 0))) AS hit FROM r),
    s AS (SELECT name, work_id, ord, CASE WHEN qn = '' OR cn = '' THEN 0 WHEN qn = cn THEN 100 WHEN contains(qn, cn) THEN 92 WHEN contains(cn, qn) THEN 88 WHEN len(cr) >= 2 AND hit = len(cr) THEN 92
        ELSE CAST(floor((hit / greatest(len(cr), 1)::DOUBLE * 0.6::DOUBLE + hit / greatest(len(qr), 1)::DOUBLE * 0.4::DOUBLE) * 60 + 0.5) AS INTEGER) END AS score FROM m),
    t AS (SELECT name, work_id, ord, max(score) AS score FROM s GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, ord, work_id) AS place FROM t)"""


_match = "WITH " + matching("SELECT DISTINCT p_name AS name FROM part", "SELECT p_type AS work_id, p_type AS ord, unnest([min(p_name), max(p_name)]) AS alias FROM part GROUP BY p_type")
SQL["work_match_top1"] = _match + " SELECT name, CASE WHEN score >= 40 THEN work_id END AS work_id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 85 THEN 'high' WHEN score >= 60 THEN 'medium' WHEN score >= 40 THEN 'low' ELSE 'none' END AS confidence FROM ranked WHERE place = 1"
SQL["work_match_alternatives"] = _match + " SELECT name, work_id, CAST(score AS INTEGER) AS score FROM ranked WHERE place BETWEEN 2 AND 4 AND score > 0"

# taxonomy over part names
_work_name = "CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' ' || p_type END"
_has = lambda root: f"len(list_filter(roots, lambda r: {match('r', q(root))})) > 0"
_hit = lambda m: _has(m[1]) if m[0] == "root" else f"contains(t, {NORM['work'](q(m[1]))})"
_marks = " UNION ALL ".join(
    f"SELECT name, {q(f)} AS family, {i} AS ord, {q(v)} AS variant, greatest(" + ", ".join(f"CASE WHEN {_hit(m)} THEN {m[2]} ELSE 0 END" for m in ms) + f", 0) AS score FROM tw WHERE family = {q(f)}"
    for f, spec in LATIN_TAXONOMY.items() for i, (v, ms) in enumerate(spec["variants"].items())
)
_families = "CASE " + " ".join(f"WHEN {' AND '.join(_has(r) for r in spec['required'])} THEN {q(f)}" for f, spec in LATIN_TAXONOMY.items()) + " END"


def taxonomy(names: str) -> str:
    """CTEs up to told (name, family, variant, variant_score, second_score, decision, alternatives), from SQL for tn (name)."""
    return f"""tn AS ({names}), tm AS (SELECT name, {NORM['work']('name')} AS t FROM tn), t0 AS (SELECT name, t, {stems(words('t', L.STOP_TAXONOMY, 2))} AS roots FROM tm), tw AS (SELECT *, {_families} AS family FROM t0), ts AS ({_marks}),
    tk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, ord) AS place, lead(score) OVER (PARTITION BY name ORDER BY score DESC, ord) AS second FROM ts),
    tb AS (SELECT name, variant, score, second, score > 0 AND second > 0 AND score - second < 15 AS close FROM tk WHERE place = 1), ta AS (SELECT name, string_agg(variant, ',' ORDER BY place) AS alternatives FROM tk WHERE score > 0 AND place <= 3 GROUP BY name),
    told AS (SELECT tw.name, tw.family, CASE WHEN score >= 50 AND NOT close THEN tb.variant END AS variant, CAST(coalesce(score, 0) AS INTEGER) AS variant_score, CAST(coalesce(second, 0) AS INTEGER) AS second_score,
        CASE WHEN t = '' THEN 'name-required' WHEN tw.family IS NULL THEN 'family-not-found' WHEN score >= 50 AND NOT close THEN 'family-and-variant-detected' WHEN close THEN 'variant-ambiguous' ELSE 'family-detected-variant-required' END AS decision,
        coalesce(alternatives, '') AS alternatives FROM tw LEFT JOIN tb ON tb.name = tw.name LEFT JOIN ta ON ta.name = tw.name)"""


SQL["taxonomy_classify"] = f"WITH {taxonomy(f'SELECT DISTINCT {_work_name} AS name FROM part')} SELECT * FROM told"
_catalogue = """SELECT p_brand || '/' || p_type AS work_id, min(p_partkey) AS ord, unnest([arg_min(p_name, p_partkey), max(p_name) || ' ' || p_type]) AS alias FROM part
    WHERE p_name LIKE '%ing' OR p_name LIKE '%zmo' OR p_name LIKE '%late' GROUP BY p_brand, p_type"""


def resolved(names: str) -> str:
    """CTEs up to res (name, work_id, source, family, variant)."""
    return f"""{taxonomy(names)}, {matching("SELECT name FROM tn WHERE name IS NOT NULL", _catalogue)}, tax AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS family, string_split(p_name, ' ')[1] AS variant, 't:' || p_name AS work_id FROM part),
    best AS (SELECT name, work_id FROM ranked WHERE place = 1 AND score >= 40), named AS (SELECT p.name, arg_min(c.work_id, c.ord) AS work_id FROM p, c WHERE contains(lower(p.name), lower(c.alias)) OR contains(lower(c.alias), lower(p.name)) GROUP BY 1),
    res AS (SELECT told.name, coalesce(tax.work_id, best.work_id, named.work_id) AS work_id, CASE WHEN tax.work_id IS NOT NULL THEN 'taxonomy' WHEN best.work_id IS NOT NULL THEN 'matcher' WHEN named.work_id IS NOT NULL THEN 'name'
        WHEN told.family IS NOT NULL AND told.variant IS NULL THEN 'variant-required' ELSE 'unresolved' END AS source, CASE WHEN tax.work_id IS NOT NULL THEN told.family END AS family, CASE WHEN tax.work_id IS NOT NULL THEN told.variant END AS variant
        FROM told LEFT JOIN tax ON tax.family = told.family AND tax.variant = told.variant LEFT JOIN best ON best.name = told.name LEFT JOIN named ON named.name = told.name)"""


SQL["work_resolved"] = f"WITH {resolved(f'SELECT DISTINCT {_work_name} AS name FROM part')} SELECT * FROM res"

# rules
_rules = """r0 AS (SELECT p_type, p_size, min(p_partkey) AS k FROM part GROUP BY 1, 2), rules AS (SELECT p_type || '-' || p_size AS rule_id, CASE WHEN k % 3 = 0 THEN p_type END AS work_id, CASE WHEN k % 3 <> 0 THEN p_type END AS family_id,
    CASE WHEN k % 3 = 2 THEN (p_size % 5)::VARCHAR END AS variant_id, ['per-length', 'per-item', 'fixed-per-work', 'crew-fixed', 'other'][CAST(k % 5 + 1 AS INTEGER)] AS calculation, p_size / 10.0::DOUBLE AS rate, p_size::DOUBLE AS quantity,
    CASE WHEN k % 2 = 0 THEN 5.0::DOUBLE ELSE 0 END AS reserve, CASE WHEN k % 4 = 0 THEN 10.0::DOUBLE ELSE 1 END AS step FROM r0),
    ctx AS (SELECT p_partkey AS context_id, p_type AS t, (p_partkey % 5)::VARCHAR AS v, CASE WHEN p_partkey % 6 <> 0 THEN p_size::DOUBLE END AS wq FROM part),
    met AS (SELECT context_id, wq, rules.* FROM ctx JOIN rules ON (rules.work_id = ctx.t OR (rules.family_id = ctx.t AND (rules.variant_id IS NULL OR rules.variant_id = ctx.v))))"""
SQL["rules_for_context"] = f"WITH {_rules} SELECT context_id, rule_id FROM met"
SQL["rule_calc"] = f"""WITH {_rules}, b AS (SELECT *, CASE WHEN calculation IN ('per-length', 'per-item') THEN wq * rate WHEN calculation <> 'other' THEN quantity END AS base FROM met)
    SELECT context_id, rule_id, ceil(base * (1 + reserve / 100) / step) * step AS calculated_quantity, CASE WHEN calculation IN ('per-length', 'per-item') AND wq IS NULL THEN 'WORK_QUANTITY_REQUIRED' WHEN calculation = 'other' THEN 'UNKNOWN_CALCULATION_TYPE' END AS error FROM b"""
SQL["rules_summary"] = f"WITH {_rules} SELECT calculation, grouping(calculation) > 0 AS whole, count(*) AS n_rules, count(DISTINCT work_id) AS n_works, count(DISTINCT family_id) AS n_families FROM rules GROUP BY GROUPING SETS ((calculation), ())"
SQL["kb_variant_overlay"] = """WITH x AS (SELECT p_type AS work_id, CASE WHEN p_size <= 25 THEN upper(p_name) ELSE p_name END AS name, p_partkey AS ord, p_size > 25 AS layer FROM part)
    SELECT work_id, name, ord FROM x QUALIFY row_number() OVER (PARTITION BY work_id, lower(name) ORDER BY layer, ord) = 1"""
_audit = """e AS (SELECT p_type AS key, p_name AS name, min(p_size) AS size FROM part GROUP BY 1, 2), have AS (SELECT p_type AS key, lower(p_name) AS t FROM part WHERE p_partkey % 3 = 0),
    f AS (SELECT *, EXISTS (SELECT 1 FROM have h WHERE h.key = e.key AND (contains(h.t, lower(e.name)) OR contains(lower(e.name), h.t))) AS found FROM e)"""
SQL["audit_severity"] = f"""WITH {_audit}, a AS (SELECT key, count(*) FILTER (WHERE size % 2 = 0) AS expected, count(*) FILTER (WHERE size % 2 = 0 AND found) AS found, count(*) FILTER (WHERE size % 4 = 0 AND NOT found) AS missing_required,
    count(*) FILTER (WHERE size % 2 <> 0 AND NOT found) AS missing_typical FROM f GROUP BY 1) SELECT a.*, coalesce((SELECT count(*) FROM have WHERE have.key = a.key), 0) AS materials,
    CASE WHEN missing_required > 0 THEN 'critical' WHEN missing_typical > 0 OR coalesce((SELECT count(*) FROM have WHERE have.key = a.key), 0) = 0 THEN 'warning' ELSE 'ok' END AS severity FROM a"""
SQL["resource_missing_anti"] = """WITH e AS (SELECT DISTINCT p_type AS key, p_name AS name FROM part), have AS (SELECT DISTINCT p_type AS key, p_name AS name FROM part WHERE p_size > 45)
    SELECT key, name FROM e WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.key = e.key AND (contains(lower(h.name), lower(e.name)) OR contains(lower(e.name), lower(h.name))))"""
_plan = f"""{M}, {C}, told_ AS (SELECT o_custkey AS k, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1),
    ctx AS (SELECT c.ord AS id, c.kp, c.ko, c.kw, {_work_name} AS work_name, CASE WHEN c_acctbal > 7000 THEN c_acctbal END AS man, CASE WHEN c.ord % 3 = 0 THEN told_.q END AS doc
        FROM contexts c JOIN customer ON c_custkey = c.ord LEFT JOIN part ON p_partkey = c.ord LEFT JOIN told_ ON told_.k = c.ord),
    met AS (SELECT x.id, s.* EXCLUDE (ord, name), s.ord, coalesce(p_name || ' ' || p_type, name) AS name, p_name IS NOT NULL AS here FROM ctx x JOIN state s ON lower(project) = kp AND lower(object) = ko AND lower(work) = kw LEFT JOIN part ON p_partkey = s.part_key),
    needs AS (SELECT id, max(need) AS largest FROM met GROUP BY 1),
    casc AS (SELECT x.*, CASE WHEN man > 0 THEN man WHEN doc IS NOT NULL THEN doc ELSE largest END AS wq, CASE WHEN man > 0 THEN 'manual' WHEN doc IS NOT NULL THEN 'document' WHEN largest IS NOT NULL THEN 'estimate' ELSE 'none' END AS qs FROM ctx x LEFT JOIN needs USING (id))"""
SQL["quantity_cascade"] = f"WITH {_plan} SELECT id AS context_id, wq AS work_quantity, qs AS quantity_source FROM casc"
_na, _nh = stems(words("a", L.STOP_AUDIT, 2)), stems(words("t", L.STOP_AUDIT, 2))
SQL["plan_report"] = f"""WITH {_plan}, {resolved("SELECT DISTINCT work_name AS name FROM ctx")},
    short AS (SELECT id, count(*) AS materials, count(*) FILTER (WHERE deficit > 0) AS deficits, sum(deficit) AS deficit FROM met WHERE here GROUP BY 1),
    pr AS (SELECT unnest([p_brand || '/' || p_type, 't:' || p_name]) AS w, p_type || ' ' || string_split(p_name, ' ')[-1] AS rn, p_size FROM part WHERE p_size > 40), rs AS (SELECT w, rn, min(p_size) AS size FROM pr GROUP BY 1, 2),
    want AS (SELECT x.id, res.source, rs.rn, rs.size FROM ctx x JOIN res ON res.name IS NOT DISTINCT FROM x.work_name JOIN rs ON rs.w = res.work_id),
    al AS (SELECT DISTINCT rn, lower(unnest([rn, string_split(rn, ' ')[-1]])) AS a FROM rs), pt AS (SELECT DISTINCT lower(name) AS t FROM met WHERE here),
    lk AS (SELECT rn, a, t, contains(t, a) OR contains(a, t) AS inside, {_na} AS ra, {_nh} AS rt FROM al, pt),
    fit AS (SELECT rn, t, bool_or(inside) AS inside, bool_or(inside OR (len(list_filter(ra, lambda x: len(list_filter(rt, lambda y: {match('x', 'y')})) > 0)) / greatest(least(len(ra), len(rt)), 1)::DOUBLE >= 0.5 AND len(list_filter(ra, lambda x: len(list_filter(rt, lambda y: {match('x', 'y')})) > 0)) > 0)) AS near FROM lk GROUP BY 1, 2),
    seen AS (SELECT DISTINCT want.id, want.rn FROM want JOIN met ON met.id = want.id AND met.here JOIN fit ON fit.rn = want.rn AND fit.t = lower(met.name) WHERE CASE WHEN want.source = 'taxonomy' THEN fit.inside ELSE fit.near END),
    lack AS (SELECT want.id, count(*) FILTER (WHERE size % 4 = 0 AND seen.rn IS NULL) AS required, count(*) FILTER (WHERE size % 2 <> 0 AND seen.rn IS NULL) AS typical FROM want LEFT JOIN seen USING (id, rn) GROUP BY 1),
    rk AS (SELECT p_brand || '/' || p_type AS w, NULL AS f, NULL AS v, min(p_partkey) AS k FROM part GROUP BY p_brand, p_type, p_size % 4 UNION ALL SELECT NULL, string_split(p_name, ' ')[2], CASE WHEN min(p_partkey) % 2 = 0 THEN string_split(p_name, ' ')[1] END, min(p_partkey) FROM part GROUP BY p_name),
    done AS (SELECT x.id, count(*) AS rules, count(*) FILTER (WHERE k % 5 IN (2, 3) OR (k % 5 IN (0, 1) AND x.wq IS NOT NULL)) AS calculated
        FROM casc x JOIN res ON res.name IS NOT DISTINCT FROM x.work_name JOIN rk ON rk.w = res.work_id OR (rk.f = res.family AND (rk.v IS NULL OR rk.v = res.variant)) GROUP BY 1),
    o AS (SELECT x.id AS context_id, res.work_id, res.source AS work_source, wq AS work_quantity, qs AS quantity_source, coalesce(materials, 0) AS materials, coalesce(deficits, 0) AS deficits, coalesce(deficit, 0) AS deficit,
        coalesce(required, 0) AS missing_required, coalesce(typical, 0) AS missing_typical, coalesce(rules, 0) AS rules, coalesce(calculated, 0) AS calculated
        FROM casc x LEFT JOIN res ON res.name IS NOT DISTINCT FROM x.work_name LEFT JOIN short ON short.id = x.id LEFT JOIN lack ON lack.id = x.id LEFT JOIN done ON done.id = x.id)
    SELECT *, CASE WHEN deficits > 0 OR missing_required > 0 THEN 'high' WHEN missing_typical > 0 THEN 'medium' WHEN calculated > 0 THEN 'low' ELSE 'unknown' END AS level,
    CASE WHEN deficits + missing_required + missing_typical + calculated = 0 THEN 'general' ELSE concat_ws(',', CASE WHEN deficits > 0 THEN 'materials' END, CASE WHEN missing_required > 0 THEN 'audit-required' END, CASE WHEN missing_typical > 0 THEN 'audit-typical' END, CASE WHEN calculated > 0 THEN 'planning' END) END AS advice FROM o"""
_ra, _rh = stems(words(NORM["plain"]("e.name"), L.STOP_AUDIT, 2)), stems(words("h.t", L.STOP_AUDIT, 2))
_matched = f"""e AS (SELECT p_brand AS key, p_name AS name, min(p_size) AS size FROM part GROUP BY 1, 2), h AS (SELECT p_brand AS key, upper(p_name) || ' ' || p_type AS name, lower(p_name || ' ' || p_type) AS t, p_partkey AS ord FROM part WHERE p_size > 25),
    x AS (SELECT e.key, e.name, h.name AS matched, h.ord, lower(e.name) AS a, h.t, {_ra} AS ra, {_rh} AS rh FROM e JOIN h USING (key)),
    y AS (SELECT *, len(list_filter(ra, lambda a: len(list_filter(rh, lambda b: {match('a', 'b')})) > 0)) AS n FROM x),
    fit AS (SELECT key, name, arg_min(matched, ord) AS matched FROM y WHERE contains(a, t) OR contains(t, a) OR (n >= 1 AND n / least(len(ra), len(rh))::DOUBLE >= 0.5) GROUP BY 1, 2)"""
SQL["audit_matched"] = f"WITH {_matched} SELECT key, name, matched, matched IS NOT NULL AS found FROM e LEFT JOIN fit USING (key, name)"
SQL["audit_counts"] = f"""WITH {_matched}, f AS (SELECT e.*, matched IS NOT NULL AS found, size % 2 = 0 AS m, size % 4 = 0 AS r FROM e LEFT JOIN fit USING (key, name)),
    c AS (SELECT key, count(*) FILTER (WHERE m) AS expected, count(*) FILTER (WHERE m AND found) AS found, count(*) FILTER (WHERE m AND NOT found) AS missing, count(*) FILTER (WHERE r) AS required, count(*) FILTER (WHERE r AND found) AS found_required,
        count(*) FILTER (WHERE r AND NOT found) AS missing_required, count(*) FILTER (WHERE NOT m) AS typical, count(*) FILTER (WHERE NOT m AND found) AS found_typical, count(*) FILTER (WHERE NOT m AND NOT found) AS missing_typical FROM f GROUP BY 1),
    n AS (SELECT key, count(*) AS materials FROM h GROUP BY 1)
    SELECT c.*, coalesce(materials, 0) AS materials, CASE WHEN missing_required > 0 THEN 'critical' WHEN missing_typical > 0 OR materials IS NULL THEN 'warning' ELSE 'ok' END AS severity FROM c LEFT JOIN n USING (key)"""
SQL["kb_summary"] = "WITH k AS (SELECT p_type, CASE WHEN min(p_name) = max(p_name) THEN 1 ELSE 2 END AS n FROM part GROUP BY 1) SELECT count(*) AS works, sum(n)::BIGINT AS names, 0::BIGINT AS single_named FROM k"
SQL["register_revisions"] = f"""WITH {R}, h AS (SELECT o_orderkey AS k, sha256(CAST(floor(o_totalprice / 100) AS BIGINT)::VARCHAR) AS sha FROM orders), held AS (SELECT promoted.*, sha FROM promoted JOIN h ON k = revision WHERE received < DATE '1997-01-01'),
    a AS (SELECT o_orderkey AS seq, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS doc, CASE WHEN o_orderstatus <> 'P' THEN 'title ' || o_custkey END AS title, CASE WHEN o_orderpriority = '5-LOW' THEN 'draft' END AS label,
        CASE WHEN o_orderkey % 50 <> 0 THEN sha END AS sha FROM orders JOIN h ON k = o_orderkey WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01'),
    e AS (SELECT *, CASE WHEN doc IS NULL AND title IS NULL THEN 'TITLE_REQUIRED' WHEN sha IS NULL THEN 'FILE_REQUIRED' WHEN sha IN (SELECT sha FROM held) THEN 'DUPLICATE_CONTENT' END AS err FROM a),
    f AS (SELECT *, coalesce(err, CASE WHEN seq > min(CASE WHEN err IS NULL THEN seq END) OVER (PARTITION BY sha) THEN 'DUPLICATE_CONTENT' END) AS error FROM e),
    g AS (SELECT *, CASE WHEN error IS NULL THEN coalesce(doc::VARCHAR, 'new:' || title) END AS document FROM f), n AS (SELECT document::VARCHAR AS document, count(*) AS held, max(CASE WHEN status = 'current' THEN revision END) AS previous FROM held GROUP BY 1),
    o AS (SELECT g.*, previous, coalesce(held, 0) + row_number() OVER (PARTITION BY g.document ORDER BY seq) AS no FROM g LEFT JOIN n ON n.document = g.document)
    SELECT seq, error, document, CASE WHEN error IS NULL THEN no END AS revision_no, CASE WHEN error IS NULL THEN coalesce(label, 'R' || no) END AS revision_label, CASE WHEN error IS NULL THEN previous END AS previous_revision, CASE WHEN error IS NULL THEN 'received' END AS status FROM o"""
SQL["change_events"] = f"WITH {H}, x AS (SELECT DISTINCT action, CAST(ts AS DATE) AS day, key FROM changes) SELECT action, day, count(*) OVER (PARTITION BY action, day) AS total, key AS id FROM x"
SQL["registry_overview"] = f"""WITH {R}, y AS (SELECT *, CAST(year(received) AS INTEGER) AS year FROM promoted) SELECT year, grouping(year) > 0 AS whole, count(DISTINCT document) AS documents, count(*) AS revisions,
    count(*) FILTER (WHERE status = 'current') AS current, count(*) FILTER (WHERE status IN ('received', 'under-review')) AS in_review FROM y GROUP BY GROUPING SETS ((year), ())"""
_pointers = """ptr AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 <> 0 THEN p_partkey // 2 + p_size END AS nxt FROM part),
    walk AS (SELECT id, id AS pos, nxt, 0::BIGINT AS hops, true AS here FROM ptr
        UNION ALL SELECT w.id, w.nxt, p.nxt, w.hops + 1, p.id IS NOT NULL FROM walk w LEFT JOIN ptr p ON p.id = w.nxt WHERE w.nxt IS NOT NULL AND w.hops <= (SELECT count(*) FROM ptr)),
    ends AS (SELECT id, pos, hops, here FROM walk WHERE nxt IS NULL),
    goal AS (SELECT ptr.id AS work_id, CASE WHEN here THEN pos END AS target, hops, CASE WHEN ends.id IS NULL THEN 'cycle' WHEN NOT here THEN 'unknown' WHEN hops = 0 THEN 'own' ELSE 'resolved' END AS state FROM ptr LEFT JOIN ends ON ends.id = ptr.id)"""
SQL["kb_pointers"] = f"WITH RECURSIVE {_pointers} SELECT * FROM goal"
SQL["kb_variant_rows"] = f"""WITH RECURSIVE {_pointers}, vs AS (SELECT p_brand AS f, p_type AS v, max(CASE WHEN p_partkey % 2 = 0 THEN p_partkey END) AS w FROM part WHERE p_size <= 40 GROUP BY 1, 2),
    ask AS (SELECT DISTINCT p_brand AS f, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS v FROM part),
    told AS (SELECT ask.f, ask.v, target, CASE WHEN ask.v IS NULL THEN 'base' WHEN vs.f IS NULL THEN NULL WHEN target IS NOT NULL THEN 'work' ELSE 'overlay' END AS mode FROM ask LEFT JOIN vs ON vs.f = ask.f AND vs.v = ask.v LEFT JOIN goal ON goal.work_id = vs.w WHERE ask.f IN (SELECT f FROM vs)),
    lay AS (SELECT f, v, upper(p_name) AS name, p_partkey AS ord, 0 AS layer FROM told JOIN part ON p_brand = f AND p_size <= 10 WHERE mode IN ('overlay', 'base') UNION ALL SELECT f, v, p_name, p_partkey, 1 FROM told JOIN part ON p_brand = f AND p_type = v AND p_size > 30 WHERE mode = 'overlay')
    SELECT f AS family, v AS variant, p_name AS name, p_partkey AS ord FROM told JOIN part ON p_partkey = target WHERE mode = 'work'
    UNION ALL SELECT f, v, name, ord FROM lay QUALIFY row_number() OVER (PARTITION BY f, v, lower(name) ORDER BY layer, ord) = 1"""
_sw, _st = words(NORM["work"]("p_name || ' ' || p_type"), L.STOP_WORK, 2), stems(words(NORM["plain"]("p_type || '-' || p_name"), L.STOP_AUDIT, 2))
SQL["sql_text_functions"] = f"""WITH x AS (SELECT p_partkey, {_sw} AS wanted, {_st} AS there FROM part), y AS (SELECT *, {stems('wanted')} AS roots FROM x)
    SELECT p_partkey, {covered('roots', 'there')} AS coverage, CAST(len(list_filter(wanted, lambda a: len(list_filter(there, lambda b: {match('a', 'b')})) > 0)) AS INTEGER) AS matched, {match('wanted[1]', 'there[1]')} AS first_match FROM y"""

# documents
_kinds = {"notice": [("the", 1), ("of the", 3), ("and", 1)], "bericht": [("der", 1), ("und", 2), ("die", 1)], "rapport": [("le", 2), ("la", 1), ("des", 1)], "informe": [("que", 1), ("de la", 3), ("los", 2)]}
_scores = {k: " + ".join(f"{count_of('t', p)} * {w}" for p, w in v) for k, v in _kinds.items()}
SQL["doc_kind_score"] = f"WITH d AS (SELECT doc_id AS doc, {NORM['plain']('text')} AS t FROM documents), s AS (" + " UNION ALL ".join(f"SELECT doc, {i} AS ord, '{k}' AS kind, {e} AS score FROM d" for i, (k, e) in enumerate(_scores.items())) + """),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, ord) AS place, lead(score) OVER (PARTITION BY doc ORDER BY score DESC, ord) AS second_score FROM s)
    SELECT doc, CASE WHEN score >= 4 THEN kind ELSE 'unknown' END AS kind, CASE WHEN (SELECT t FROM d WHERE d.doc = r.doc) = '' THEN 'none' WHEN score < 4 THEN 'low' WHEN score >= 12 AND score >= second_score * 1.5 THEN 'high' WHEN score >= 7 THEN 'medium' ELSE 'low' END AS confidence,
    CAST(score AS INTEGER) AS score, CAST(second_score AS INTEGER) AS second_score FROM r WHERE place = 1"""
SQL["phrase_counts"] = f"WITH d AS (SELECT doc_id, {NORM['plain']('text')} AS t FROM documents) SELECT doc_id, " + ", ".join(f"{count_of('t', p)} AS n_{i}" for i, p in enumerate(("the", "der", "la ", "an an"))) + " FROM d"
_signals = {"notice": (("(^| )the( |$)", " of the "), (" and ",)), "bericht": ((" der ", " und "), (" das[ .,]",)), "rapport": ((" le ", " des "), (" la ",))}
_sum = lambda t, ps: "(" + " + ".join(f"CAST(regexp_matches({t}, {q(p)}) AS INTEGER)" for p in ps) + ")"
_signal = f"WITH d AS (SELECT doc_id, lower(source) AS f, {collapsed('translate(' + LOW.format('text') + ', ' + q('–—') + ', ' + q('--') + ')')} AS b FROM documents), e AS (SELECT *, b[1:2000] AS l FROM d), s AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ord, '{k}' AS kind, {_sum('f', s)} * 12 + {_sum('f', w)} * 5 + {_sum('b', s)} * 6 + {_sum('b', w)} * 2 + {_sum('l', s)} * 14 + {_sum('l', w)} * 4 AS score, {_sum('f', s)} > 0 OR {_sum('l', s)} > 0 AS strong FROM e" for i, (k, (s, w)) in enumerate(_signals.items())
) + "), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS place, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS second FROM s), found AS (SELECT doc_id, CASE WHEN score > 0 THEN kind END AS signal_kind, CASE WHEN score > 0 THEN CASE WHEN strong OR (score >= 12 AND score >= second + 5) THEN 'high' ELSE 'medium' END END AS signal_confidence, CAST(score AS INTEGER) AS signal_score FROM r WHERE place = 1)"
SQL["doc_signals"] = _signal + " SELECT * FROM found"
SQL["intake_summary"] = _signal + " SELECT coalesce(signal_kind, 'other') AS kind, count(*) AS documents, count(*) FILTER (WHERE coalesce(signal_confidence, 'low') <> 'high') AS to_review FROM found GROUP BY 1"
SQL["doc_kind_fused"] = f"""WITH g AS ({SQL["doc_signals"]}), k AS ({SQL["doc_kind_score"]}), x AS (SELECT g.doc_id AS k, signal_kind AS s, signal_confidence AS sc, CASE WHEN kind <> 'unknown' THEN kind END AS t, confidence AS tc FROM g JOIN k ON k.doc = g.doc_id)
    SELECT k AS doc_id, CASE WHEN s IS NOT NULL AND t IS NOT NULL AND s <> t THEN CASE WHEN sc = 'high' THEN s ELSE t END ELSE coalesce(s, t, 'other') END AS kind,
    CASE WHEN s = t THEN CASE WHEN sc = 'high' OR tc = 'high' THEN 'high' ELSE 'medium' END WHEN s IS NOT NULL AND t IS NOT NULL THEN 'medium' WHEN s IS NOT NULL THEN sc WHEN t IS NOT NULL THEN tc ELSE 'low' END AS confidence,
    coalesce(s <> t, false) AS conflict FROM x"""
SQL["sentence_context"] = f"""WITH x AS (SELECT doc_id, text, instr(text, 'the') - 1 AS i FROM documents WHERE instr(text, 'the') > 0) SELECT doc_id, md5({collapsed('substring(text, greatest(i - 220, 0) + 1, least(i + 100, length(text)) - greatest(i - 220, 0))')}) AS evidence FROM x"""

# schedule workbooks made of orders
_book = """spans AS (SELECT l_orderkey AS k, max(CAST(l_shipdate AS DATE)) AS last, sum(l_quantity) AS total FROM lineitem GROUP BY 1), b AS (SELECT o_orderpriority AS doc, CAST(o_orderkey + 1 AS INTEGER) AS row_idx,
    CASE o_orderkey % 7 WHEN 0 THEN 'Монтаж секции ' WHEN 1 THEN 'Песок ' WHEN 2 THEN 'Итого по ' WHEN 3 THEN 'Кран ' ELSE 'Позиция ' END || o_orderkey AS name, o_orderkey % 7 AS t, o_orderkey % 11 <> 0 AS has_unit, total,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS start, CASE WHEN o_orderkey % 13 <> 0 THEN last END AS finish FROM orders JOIN spans ON k = o_orderkey),
    typed AS (SELECT *, CASE t WHEN 0 THEN 'work' WHEN 1 THEN 'material' WHEN 2 THEN 'summary' WHEN 3 THEN 'machinery' ELSE 'uncertain' END AS base FROM b)"""
SQL["table_kind"] = f"WITH {_book} SELECT DISTINCT doc, 'лист 1' AS sheet, 'schedule-table' AS kind, 'high' AS confidence, false AS generic_name, false AS automatic FROM b"
SQL["header_detect"] = f"WITH {_book} SELECT DISTINCT doc, 0 AS header_row, 15 AS header_score, 'high' AS header_confidence, 0 AS work_col, 1 AS unit_col, 2 AS quantity_col, 3 AS start_date_col, 4 AS finish_date_col FROM b"
SQL["row_type_counts"] = f"WITH {_book} SELECT doc, " + ", ".join(f"count(*) FILTER (WHERE base = '{k}') AS {k}" for k in ("work", "material", "machinery", "section", "summary", "uncertain")) + " FROM typed GROUP BY 1"
SQL["sheet_rows"] = f"""WITH {_book} SELECT doc, row_idx, name AS work_name, 'шт' AS unit, floor(total)::DOUBLE AS quantity, start, finish, CASE WHEN base = 'uncertain' AND start IS NOT NULL AND finish IS NOT NULL THEN 'work' ELSE base END AS row_type,
    CASE WHEN finish >= start THEN CAST(finish - start + 1 AS INTEGER) END AS duration_days,
    CASE WHEN (start IS NULL) <> (finish IS NULL) THEN 'one-date' WHEN finish < start THEN 'order' WHEN finish - start + 1 > 180 THEN 'long' ELSE '' END AS review
    FROM typed WHERE has_unit AND floor(total) > 0"""
SQL["intake_review_items"] = f"""WITH r AS ({SQL["sheet_rows"]}) SELECT doc, 'schedule' AS item, row_idx::VARCHAR AS place, review AS reason FROM r WHERE review <> ''
    UNION ALL SELECT doc, 'uncertain', '', count(*)::VARCHAR FROM r WHERE row_type = 'uncertain' GROUP BY doc"""
SQL["intake_package"] = f"""WITH r AS ({SQL["sheet_rows"]}), i AS ({SQL["intake_review_items"]}) SELECT (SELECT count(DISTINCT o_orderpriority) FROM orders) AS documents, count(*) FILTER (WHERE row_type = 'work') AS works,
    count(*) FILTER (WHERE row_type = 'material') AS materials, count(*) FILTER (WHERE row_type = 'machinery') AS machinery, 0 AS commercial, 0 AS approvals, (SELECT count(*) FROM i) AS to_review FROM r"""
SQL["uncertain_groups"] = f"""WITH {_book}, u AS (SELECT doc, name, row_number() OVER (PARTITION BY doc ORDER BY row_idx) AS n FROM typed WHERE base = 'uncertain')
    SELECT doc, count(*) AS n, string_agg(name, '; ' ORDER BY u.n) FILTER (WHERE u.n <= 3) AS examples FROM u GROUP BY 1"""


# projects, contexts and lookups
SQL["context_validation"] = f"""WITH {C}, n AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 9 <> 0 THEN 'p' || (s_suppkey % 8) END AS p, 'o' || (s_suppkey % 12) AS o, 'w' || (s_suppkey % 11) AS w,
    DATE '2026-01-15' - CAST(s_suppkey % 7 AS INTEGER) AS e, s_suppkey % 10 - 1 AS sd FROM supplier), x AS (SELECT *, CASE WHEN p IS NULL THEN 'REQUIRED' WHEN e < DATE '2026-01-10' THEN 'DATE_ORDER' WHEN sd < 0 THEN 'SAFETY_DAYS' END AS err FROM n)
    SELECT ord, CASE WHEN err IS NULL AND (EXISTS (SELECT 1 FROM contexts c WHERE c.kp = x.p AND c.ko = x.o AND c.kw = x.w) OR row_number() OVER (PARTITION BY p, o, w, err IS NULL ORDER BY ord) > 1) THEN 'DUPLICATE' ELSE err END AS error FROM x"""
SQL["context_active"] = "SELECT min(c_custkey) AS ord, ' p' || (min(c_custkey) % 7) AS project FROM customer WHERE c_custkey <> 5"
SQL["review_upsert"] = """WITH e AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS review FROM events GROUP BY 1)
    SELECT coalesce(e.doc_id, l.doc_id) AS doc_id, coalesce(e.review, 'pending') AS review FROM e FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON e.doc_id = l.doc_id"""
SQL["project_nodes"] = """SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'K-' || n_nationkey || ' · ' || n_name || ' · объект' FROM nation"""
SQL["linked_projects_anti"] = "SELECT ' ' || lower(n_name) AS name, 'K-' || (n_nationkey % 10) AS code FROM nation WHERE n_regionkey >= 3"
SQL["revision_projects"] = f"""WITH {R}, b AS (SELECT document, revision FROM promoted QUALIFY row_number() OVER (PARTITION BY document ORDER BY status = 'current' DESC, revision DESC) = 1)
    SELECT document, 'p' || (revision % 5) AS project_id FROM b UNION ALL SELECT document, 'q' || (revision % 3) FROM b"""
SQL["kb_categories"] = "SELECT p_brand AS category, count(DISTINCT p_type) AS works, count(DISTINCT p_type || '|' || p_name) AS names FROM part GROUP BY 1"
SQL["work_named_first"] = """WITH k AS (SELECT p_type AS work_id, unnest([min(p_name), max(p_name)]) AS n FROM part GROUP BY 1), t AS (SELECT DISTINCT upper(p_name) AS text FROM part)
    SELECT text, min(work_id) AS work_id FROM t JOIN k ON contains(lower(text), lower(n)) OR contains(lower(n), lower(text)) GROUP BY 1"""
SQL["volume_search"] = f"""WITH {_book}, c AS (SELECT * FROM typed WHERE has_unit AND floor(total) > 0), x AS (SELECT doc, row_idx, row_number() OVER (ORDER BY doc, row_idx) AS place FROM c WHERE t = 0)
    SELECT doc, row_idx, 100 AS score, CAST(place AS INTEGER) AS place, place = 1 AS chosen, 'high' AS confidence FROM x WHERE place <= 6"""
SQL["file_facts"] = r"""WITH x AS (SELECT page_id, string_split(url, '/')[-1] AS n, length(html) * 400 AS s FROM pages)
    SELECT page_id, CASE WHEN contains(n, '.') THEN lower(string_split(n, '.')[-1]) ELSE '' END AS extension, n || '-' || s || '-' || page_id AS file_id,
    CASE WHEN s < 1024 THEN s || ' Б' WHEN s / 1024.0 < 1024 THEN format('{:.1f}', floor(s / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' КБ' ELSE format('{:.1f}', floor(s / 1048576.0::DOUBLE * 10 + 0.5) / 10) || ' МБ' END AS size,
    page_id || ' ' || CASE WHEN page_id % 100 BETWEEN 11 AND 14 THEN 'документов' WHEN page_id % 10 = 1 THEN 'документ' WHEN page_id % 10 BETWEEN 2 AND 4 THEN 'документа' ELSE 'документов' END AS documents,
    ['scan', 'mixed', 'text'][page_id % 3 + 1] AS layer FROM x"""
SQL["registry_kind_guess"] = r"""WITH x AS (SELECT page_id, string_split(url, '/')[4] AS f, lower(string_split(url, '/')[-1]) AS n FROM pages)
    SELECT page_id, CASE WHEN f = 'de' THEN 'schedule' WHEN f = 'fr' THEN 'journal' WHEN ends_with(n, '.html') THEN 'work-volume' WHEN contains(n, 'page=') THEN 'schedule' WHEN contains(n, '#') THEN 'agreement'
        WHEN contains(n, 'ref=') OR contains(n, 'utm') THEN 'commercial-proposal' WHEN regexp_full_match(n, '[0-9]+') THEN 'estimate' ELSE 'other' END AS kind FROM x"""
# told by how the books are made: a schedule by name and sheet, a work volume and a specification by sheet and text, a priced table in an estimate, a bare table
SQL["table_kind_fused"] = """SELECT ['ГПР', 'Книга', 'Книга', 'Смета', 'Лист'][n_nationkey % 5 + 1] || ' ' || n_nationkey || '.xlsx' AS doc, ['schedule', 'work-volume', 'specification', 'estimate', 'other'][n_nationkey % 5 + 1] AS kind,
    ['high', 'high', 'high', 'high', 'low'][n_nationkey % 5 + 1] AS confidence, n_nationkey % 5 = 3 AS conflict FROM nation"""
SQL["history_events"] = f"""WITH {H}, x AS (SELECT *, CAST(need AS DECIMAL(18, 2)) AS n, CAST(seq % 3 AS INTEGER) AS d FROM changes), y AS (SELECT *, lag(n) OVER w AS n0, lag(unit) OVER w AS u0, lag(d) OVER w AS d0 FROM x WINDOW w AS (PARTITION BY key ORDER BY seq)),
    z AS (SELECT *, concat_ws('; ', CASE WHEN n IS DISTINCT FROM n0 THEN 'Потребность: ' || coalesce(n0::VARCHAR, '—') || ' → ' || coalesce(n::VARCHAR, '—') END, CASE WHEN unit IS DISTINCT FROM u0 THEN 'Единица: ' || coalesce(u0, '—') || ' → ' || coalesce(unit, '—') END,
        CASE WHEN d IS DISTINCT FROM d0 THEN 'Срок поставки: ' || coalesce(d0::VARCHAR, '—') || ' → ' || d END) AS c FROM y)
    SELECT key, seq, CASE action WHEN 'create' THEN 'Добавлено' WHEN 'archive' THEN 'Исключено' WHEN 'restore' THEN 'Восстановлено' ELSE 'Изменено' END AS label,
        CASE action WHEN 'create' THEN 'Создана позиция: ' || coalesce(n::VARCHAR, '—') || ' ' || unit || '.' WHEN 'archive' THEN {q(L.HISTORY_ARCHIVED)} WHEN 'restore' THEN {q(L.HISTORY_RESTORED)} ELSE CASE WHEN c = '' THEN {q(L.HISTORY_UNCHANGED)} ELSE c END END AS told FROM z"""


SQL["lifecycle_replay"] = f"""WITH RECURSIVE {H}, o AS (SELECT key, action, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM changes),
    r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, 0 AS revision, 0 AS rejected FROM o
        UNION ALL SELECT key, n, coalesce(moved, status), CAST(revision + (moved IS NOT NULL)::INTEGER AS INTEGER), CAST(rejected + (moved IS NULL)::INTEGER AS INTEGER) FROM (
            SELECT o.key, o.n, r.status, r.revision, r.rejected, CASE WHEN action = 'create' AND status IS NULL THEN 'active' WHEN action = 'update' AND status = 'active' THEN 'active'
                WHEN action = 'archive' AND status = 'active' THEN 'archived' WHEN action = 'restore' AND status = 'archived' THEN 'active' END AS moved FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1))
    SELECT key, status, revision, rejected FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1"""

# document kinds over the order pages: each phrase counts once for every time that it occurs
_phrases = ", ".join(f"({i}, {q(k)}, {j}, {q(p)}, {w})" for i, (k, v) in enumerate(L.DOCUMENT_KINDS.items()) for j, (p, w) in enumerate(v))
SQL["doc_kind_ru"] = f"""WITH {G}, n AS (SELECT doc, page, {NORM['plain']('text')} AS t FROM pages_), d AS (SELECT doc, string_agg(t, ' ' ORDER BY page) AS t, bool_or(page <= 3 AND regexp_matches(t, {q(L.COVER_PATTERN)})) AS cover FROM n GROUP BY doc),
    r(ord, kind, place, phrase, weight) AS (VALUES {_phrases}), f AS (SELECT *, {NORM['plain']('phrase')} AS f FROM r), c AS (SELECT doc, cover, ord, kind, place, phrase, weight * CAST((length(t) - length(replace(t, f, ''))) / length(f) AS INTEGER) AS points FROM d, f),
    s AS (SELECT doc, cover, ord, kind, sum(points) AS score, coalesce(string_agg(phrase, '; ' ORDER BY place) FILTER (WHERE points > 0), '') AS phrases FROM c GROUP BY doc, cover, ord, kind),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, ord) AS rank, lead(score) OVER (PARTITION BY doc ORDER BY score DESC, ord) AS second FROM s)
    SELECT doc, CASE WHEN cover THEN 'working-documents' WHEN score >= 4 THEN kind ELSE 'unknown' END AS kind, CASE WHEN cover THEN 'high' WHEN score < 4 THEN 'low' WHEN score >= 12 AND score >= second * 1.5 THEN 'high' WHEN score >= 7 THEN 'medium' ELSE 'low' END AS confidence,
    CAST(score AS INTEGER) AS score, CAST(second AS INTEGER) AS second_score, CASE WHEN NOT cover AND score >= 4 THEN phrases ELSE '' END AS phrases FROM k WHERE rank = 1"""


def hits(source: str, pattern: str, groups: int = 1) -> str:
    """The matches of a pattern in the column text: the source's columns, g0 (all), g1 ... and idx (0-based)."""
    every = ", ".join(f"regexp_extract_all(text, {q(pattern)}, {g}) AS a{g}" for g in range(groups + 1))
    each = ", ".join(f"a{g}[i] AS g{g}" for g in range(groups + 1))
    return f"""SELECT * EXCLUDE (a0, {', '.join(f'a{g}' for g in range(1, groups + 1))}, gaps, i), {each}, CAST(list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(a0[1 : i - 1], lambda x: length(x))), 0) AS INTEGER) AS idx
        FROM (SELECT *, unnest(range(1, len(a0) + 1)) AS i FROM (SELECT *, {every}, regexp_split_to_array(text, {q(pattern)}) AS gaps FROM {source}))"""


# quantities: the pattern's look-ahead as a last character of the match, which is not of the quantity
_amount, _tail = L.QUANTITY_PATTERN[: L.QUANTITY_PATTERN.index("(?=")], r"(?:\s|$|[.,;:)])"
_unit = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(g3)), {q(p)}) THEN {q(u)}" for p, u in L.QUANTITY_UNITS) + " ELSE lower(trim(g3)) END"
_quantities = rf"""qh AS ({hits('pages_', f'(?i)({_amount}){_tail}', 3)}), qs AS (SELECT *, g1 AS raw, CAST(regexp_replace(regexp_replace(g2, '\s', '', 'g'), '^([^,]*),', '\1.') AS DOUBLE) AS quantity, {_unit} AS unit FROM qh),
    quantities AS (SELECT * FROM qs WHERE quantity > 0)"""
SQL["quantity_extract_ru"] = f"WITH {G}, {_quantities} SELECT doc, page, idx AS index, raw, quantity, unit FROM quantities"
_words = lambda x: stems(words(x, L.STOP_TABLE, 3, "[^а-яa-z0-9-]+"))
_markers = {"Кабельная канализация на эстакаде": ["эстакад"], "Подземная кабельная канализация": ["подземн", "транш", "грунт"], "Кабельная канализация надземная": ["надземн", "по опорам", "по поверхности"], "Прокладка кабельной канализации": []}
_by_work = lambda f: "CASE work " + " ".join(f"WHEN {q(w)} THEN {f(w)}" for w in WORKS_RU) + " END"
_one = lambda m: f"contains(e, {NORM['running'](q(m))}) OR len(list_filter({_words(NORM['running'](q(m)))}, lambda a: len(list_filter(roots, lambda b: {match('a', 'b')})) > 0)) > 0"
_intents = " OR ".join(f"contains(e, {NORM['running'](q(p))})" for p in L.INTENT_PHRASES)
_priority = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in L.SOURCE_PRIORITY.items()) + " END"
SQL["quantity_best_ru"] = f"""WITH {G}, {_quantities}, w0 AS (SELECT *, {listed(WORKS_RU)}[nation % {len(WORKS_RU)} + 1] AS work, {_priority} AS priority, {collapsed('substring(text, greatest(idx - 260, 0) + 1, least(idx + 120, length(text)) - greatest(idx - 260, 0))')} AS ev FROM quantities),
    w1 AS (SELECT *, {NORM['running']('ev')} AS e, {NORM['running']('raw')} AS r FROM w0), w2 AS (SELECT *, {_words('e')} AS roots, length(e) - instr(reverse(e), reverse(r)) + 1 - length(r) AS last FROM w1),
    w3 AS (SELECT *, CASE WHEN contains(e, r) THEN substr(e, CAST(greatest(last - 90, 0) + 1 AS BIGINT), CAST(least(last, 90) AS BIGINT)) ELSE substr(e, greatest(length(e) - 120, 0) + 1, 120) END AS near,
        len(list_filter(['кабельн', 'канализац'], lambda a: len(list_filter(roots, lambda b: {match('a', 'b')})) > 0)) / 2.0::DOUBLE AS family, {_by_work(lambda w: covered(_words(NORM['running'](q(w))), 'roots'))} AS cover,
        {_by_work(lambda w: '(' + (' OR '.join(map(_one, _markers[w])) or 'false') + ')')} AS variant, {_intents} AS intent FROM w2),
    w4 AS (SELECT *, contains(near, 'муфта') OR contains(near, 'труба пнд') AS resource FROM w3),
    w5 AS (SELECT *, CAST(greatest(0, least(floor(family * 40 + cover * 15 + CASE WHEN variant THEN 15 ELSE 0 END + CASE WHEN intent THEN 15 ELSE 0 END + priority / 100.0::DOUBLE * 10 + CASE WHEN unit IN ({', '.join(map(q, L.KNOWN_QUANTITY_UNITS))}) THEN 5 ELSE 0 END - CASE WHEN resource THEN 35 ELSE 0 END + 0.5), 100)) AS INTEGER) AS score,
        family >= 1 AND (variant OR intent OR cover >= 0.75) AND NOT resource AS eligible FROM w4),
    w6 AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY score DESC, priority DESC, page, idx) AS INTEGER) AS place FROM w5 WHERE score >= 45),
    w7 AS (SELECT *, coalesce(place = min(CASE WHEN eligible AND score >= 55 THEN place END) OVER (PARTITION BY doc), false) AS chosen FROM w6)
    SELECT doc, page, idx AS index, raw, score, eligible, place, chosen, CASE WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'medium' WHEN score >= 55 THEN 'low' ELSE 'none' END AS confidence FROM w7 WHERE place <= 6 OR chosen"""

# material rows, told by how the pages are made: a header line, then one line for each order line
_kinds_of = listed([m for m, _ in D.MATERIALS])
_units_of = "[" + ", ".join(q(L.MATERIAL_UNITS.get(u.rstrip("."), u.rstrip("."))) for _, u in D.MATERIALS) + "]"
SQL["material_rows_ru"] = f"""WITH {G}, x AS (SELECT o_custkey AS doc, k AS page, CAST(row_number() OVER (PARTITION BY k ORDER BY n, p, q) AS INTEGER) AS line_no, {_kinds_of}[p % {len(D.MATERIALS)} + 1] AS name, CAST(q AS DOUBLE) AS quantity, {_units_of}[p % {len(D.MATERIALS)} + 1] AS unit
    FROM lines_ JOIN orders ON o_orderkey = k WHERE k % 4 = 1) SELECT doc, page, min(line_no) AS line_no, name, quantity, unit FROM x WHERE name <> 'Монтаж опоры' GROUP BY doc, page, name, quantity, unit"""


SQL["candidate_import"] = f"""SELECT name, unit, quantity AS need, 1 AS lead_days, doc AS source_document, page AS source_page, CASE WHEN page % 3 = 1 THEN 'confirmed' ELSE 'pending' END AS source_review_status
    FROM ({SQL['material_rows_ru']}) WHERE page % 3 <> 0 AND NOT (page % 3 = 1 AND name LIKE 'К%')"""
SQL["workspace_dashboard"] = "UNPIVOT (SELECT * FROM (" + SQL["dashboard"] + ") a, (" + SQL["registry_counters"] + ") b) ON COLUMNS(*) INTO NAME counter VALUE value"


def _plain_pattern(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)").replace("(?=[^а-яё]|$)", "(?:[^а-яё]|$)")


def _first(context: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({context}, {q(_plain_pattern(r[0]))}) THEN {q(r[1])}" for r in rules) + f" ELSE {q(default)} END"


def _intake(x: str) -> str:
    return collapsed(f"translate({LOW.format(x)}, '–—', '--')")


def found_approvals(source: str, rules) -> str:
    """CTEs up to app (doc, page, idx, matched, context, type, intent, priority, organization, signature) over a source with doc, page and text."""
    stop = listed(L.STOP_SIGNATURE)
    stamp = " + ".join(f"CAST(regexp_matches(wn, {q(m)}) AS INTEGER)" for m in rules.stamp_markers)
    return rf"""ah AS ({hits(source, '(?i)(' + _plain_pattern(rules.action).replace('(?i)', '') + ')', 1)}),
    a0 AS (SELECT doc, page, idx, g0 AS matched, text, regexp_extract(substring(text, 1, idx), '[^.!?;

]*$') || g0 || regexp_extract(substring(text, idx + length(g0) + 1), '^[^.!?;

]*[.!?;

]?') AS sent FROM ah),
    a1 AS (SELECT *, {collapsed('sent')} AS sentence, {collapsed('substring(text, greatest(idx - 90, 0) + 1, least(idx + length(matched) + 120, length(text)) - greatest(idx - 90, 0))')} AS near,
        {collapsed('substring(text, greatest(idx - 190, 0) + 1, least(idx + length(matched) + 250, length(text)) - greatest(idx - 190, 0))')} AS wide FROM a0),
    a2 AS (SELECT * EXCLUDE (text, sent), CASE WHEN length(sentence) >= 20 THEN sentence ELSE near END AS context, {_intake('wide')} AS wn FROM a1), a3 AS (SELECT *, {_intake('context')} AS cn FROM a2 WHERE length(context) >= 20),
    a4 AS (SELECT *, {_first('cn', rules.types, 'approval')} AS type, {_first('cn', rules.organizations, rules.organization_unknown)} AS organization, {_first('cn', rules.intents, 'informational')} AS intent,
        array_to_string(list_filter(string_split(regexp_replace(cn, '[^а-яёa-z0-9\s]', ' ', 'g'), ' '), lambda w: length(w) >= 4 AND NOT list_contains({stop}, w))[1 : 14], ' ') AS signature, cn[1 : 160] AS ckey
        FROM a3 WHERE NOT ({stamp} >= 3 AND NOT regexp_matches(wn, {q(_plain_pattern(rules.stamp_action))}))),
    app AS (SELECT *, CASE intent WHEN 'prerequisite' THEN 'high' ELSE 'medium' END AS priority FROM a4 WHERE intent <> 'informational' QUALIFY row_number() OVER (PARTITION BY doc, page, type, intent, ckey ORDER BY idx) = 1)"""


def grouped_approvals(source: str, rules) -> str:
    """The founder fold, row by row in order of reading."""
    return f"""{found_approvals(source, rules)}, o AS (SELECT doc, type, organization, intent, page, idx, signature AS s, row_number() OVER (PARTITION BY doc, type, organization, intent ORDER BY page, idx) AS n FROM app),
    r AS (SELECT DISTINCT doc, type, organization, intent, 0::BIGINT AS n, CAST([] AS STRUCT(p BIGINT, i BIGINT, s VARCHAR)[]) AS f, 0::BIGINT AS g FROM o
        UNION ALL SELECT doc, type, organization, intent, n, CASE WHEN hit = 0 THEN list_append(f, {{'p': page, 'i': idx::BIGINT, 's': s}}) ELSE f END, CASE WHEN hit = 0 THEN len(f) + 1 ELSE hit END
        FROM (SELECT o.*, r.f, coalesce(list_position(list_transform(r.f, lambda x: x.s = o.s OR (x.p = o.page AND abs(x.i - o.idx) <= 140)), true), 0) AS hit FROM r JOIN o USING (doc, type, organization, intent) WHERE o.n = r.n + 1)),
    m AS (SELECT o.*, r.g FROM r JOIN o USING (doc, type, organization, intent, n))
    SELECT doc, type, organization, intent, arg_min(page, n) AS page, CAST(arg_min(idx, n) AS INTEGER) AS index, count(DISTINCT page) AS pages, count(*) AS occurrences FROM m GROUP BY doc, type, organization, intent, g"""


_latin = "src AS (SELECT source AS doc, doc_id AS page, text FROM documents)"
SQL["approvals_extract_ru"] = f"WITH {G}, {found_approvals('pages_', RUSSIAN)} SELECT doc, page, idx AS index, matched, type, intent, priority, organization FROM app"
SQL["approvals_grouped_ru"] = f"WITH RECURSIVE {G}, {grouped_approvals('pages_', RUSSIAN)}"
SQL["approvals_extract"] = f"WITH {_latin}, {found_approvals('src', LATIN_APPROVALS)} SELECT doc, page, idx AS index, matched, type, intent, organization, md5(context) AS context, md5(signature) AS signature FROM app"
SQL["approvals_grouped"] = f"WITH RECURSIVE {_latin}, {grouped_approvals('src', LATIN_APPROVALS)}"


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
