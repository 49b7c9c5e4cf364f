"""SQL building blocks for the answers: the same derivations, written for an RE2 dialect."""

W = r"\t-\r\x{85}\p{Z}"
GLUE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{P}\p{S}"
ENDS = "。！？!?；;"
CLOSERS = r"”’」』》）】〕〉\])\"''"


def trim(x):
    return f"regexp_replace({x}, '^[{W}]+|[{W}]+$', '', 'g')"


def visible(x):
    return f"regexp_replace({x}, '[{W}]+', '', 'g')"


def core(x):
    return rf"regexp_replace({x}, '[{W}\p{{P}}\p{{S}}]+', '', 'g')"


def clean(x):
    one = rf"regexp_replace({trim(x)}, '([{GLUE}])[{W}]+', '\1', 'g')"
    two = rf"regexp_replace({one}, '[{W}]+([{GLUE}])', '\1', 'g')"
    return f"regexp_replace({two}, '[{W}]+', ' ', 'g')"


def segments(x):
    pieces = f"regexp_extract_all({clean(x)}, '[^{ENDS}]*[{ENDS}][{CLOSERS}]*|[^{ENDS}]+')"
    return f"list_filter(list_transform({pieces}, lambda s: {trim('s')}), lambda s: s <> '')"


def grams(x):
    return f"list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"


def tokens(x):
    """ceil(len/4) per ASCII run plus one per other visible character."""
    runs = rf"regexp_extract_all({x}, '[\x00-\x08\x0E-\x1F\x21-\x7F]+')"
    return (
        f"(coalesce(list_sum(list_transform({runs}, lambda r: (length(r) + 3) // 4)), 0)"
        rf" + length(regexp_replace({x}, '[\x00-\x7F{W}]+', '', 'g')))"
    )


def round4(x):
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


def mean(x, order):
    """Mean of a column with the additions in a fixed order."""
    return f"list_reduce(list({x} ORDER BY {order}), lambda u, v: u + v) / count({x})"


SENT_ARRAYS = f"""
docs AS (SELECT doc_id AS page_id, lang, source, translate(text, '.', '。') AS z FROM documents),
arr AS (SELECT page_id, lang, source, {segments('z')} AS sents FROM docs),
sent AS (SELECT page_id, lang, source, unnest(sents) AS seg,
                CAST(generate_subscripts(sents, 1) - 1 AS BIGINT) AS pos FROM arr)"""


def _cand(lossy):
    """What each engine saw of each sentence. Lossy readings keep the sentence's position as their slot; of
    plain ones the slots are those of the alignment, see below."""
    b = clean("replace(seg, 'ea', 'ca')" if lossy else "replace(seg, ',', '')")
    d = clean("replace(seg, 'th', 'tb')") if lossy else "seg"
    seen = f"""
  SELECT page_id, pos AS slot, 'a' AS agent, seg AS text FROM sent
  UNION ALL SELECT page_id, pos, 'b', {b} FROM sent WHERE {b} <> ''
  UNION ALL SELECT page_id, pos, 'c', seg FROM sent WHERE length({core('seg')}) <= 80
  UNION ALL SELECT page_id, pos, 'd', {d} FROM sent WHERE source <> 'src7'"""
    cand = f"cand AS ({seen})" if lossy else PLACED.format(seen=seen, core=core("text"))
    return f"""
{cand},
nval AS (SELECT page_id, count(DISTINCT agent) AS n FROM cand GROUP BY page_id)"""


# A sentence without a core form pairs with nothing, so each engine's copy is a slot of its own. It stands
# behind the last sentence with a core form that its engine saw, and an engine that joins later puts its own first.
PLACED = """
seen AS (SELECT *, {core} = '' AS bare FROM ({seen})),
keyed AS (SELECT *, CASE WHEN bare THEN
                      coalesce(max(CASE WHEN NOT bare THEN slot END)
                               OVER (PARTITION BY page_id, agent ORDER BY slot), -1) ELSE slot END AS after,
                 CASE WHEN bare THEN 102 - ascii(agent) ELSE 0 END AS turn, CASE WHEN bare THEN slot ELSE 0 END AS own
          FROM seen),
cand AS (SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY after, turn, own) - 1 AS slot, agent, text
         FROM keyed)"""


CAND_LOSSY = SENT_ARRAYS + "," + _cand(True)
CAND_PLAIN = SENT_ARRAYS + "," + _cand(False)

K_CONF = "(1 - pow(0.2, 1 + (k - 1) * 0.6))"

VOTES = f"""
vis AS (SELECT c.*, {visible('text')} AS form, n FROM cand c JOIN nval USING (page_id)),
grp AS (SELECT page_id, slot, form, any_value(n) AS n, count(*) AS k, arg_min(text, agent) AS text,
               string_agg(agent, '|' ORDER BY agent) AS froms FROM vis GROUP BY page_id, slot, form),
agreed AS (SELECT page_id, slot, k, n, text, froms,
                  {round4(f"CASE WHEN n > k THEN {K_CONF} * (1 - 0.5 * (n - k) / n) ELSE {K_CONF} END")} AS confidence
           FROM grp WHERE k >= 2 AND 2 * k > n),
allslots AS (SELECT DISTINCT page_id, slot FROM cand),
numbered AS (SELECT s.page_id, s.slot, a.text IS NOT NULL AS consensus,
                    sum(CASE WHEN a.text IS NOT NULL THEN 1 ELSE 0 END)
                        OVER (PARTITION BY s.page_id ORDER BY s.slot) AS ordinal
             FROM allslots s LEFT JOIN agreed a ON a.page_id = s.page_id AND a.slot = s.slot),
regions AS (SELECT page_id, ordinal, min(slot) AS segment, max(slot) AS last_slot
            FROM numbered WHERE NOT consensus GROUP BY page_id, ordinal),
merged AS (SELECT r.page_id, r.segment, c.agent, string_agg(c.text, '' ORDER BY c.slot) AS text
           FROM regions r JOIN cand c ON c.page_id = r.page_id AND c.slot BETWEEN r.segment AND r.last_slot
           GROUP BY r.page_id, r.segment, c.agent),
disputes AS (SELECT r.page_id, r.segment, r.last_slot, coalesce(b.text, '') AS before, coalesce(f.text, '') AS after,
                    m.candidates
             FROM regions r
             LEFT JOIN agreed b ON b.page_id = r.page_id AND b.slot = r.segment - 1
             LEFT JOIN agreed f ON f.page_id = r.page_id AND f.slot = r.last_slot + 1
             JOIN (SELECT page_id, segment, string_agg(agent || '=' || text, '|' ORDER BY agent) AS candidates
                   FROM merged GROUP BY page_id, segment) m ON m.page_id = r.page_id AND m.segment = r.segment)"""


def jaccard(a, b):
    """Of two relations with core and g columns."""
    inter = f"len(list_intersect({a}.g, {b}.g))"
    return (
        f"CASE WHEN {a}.core = '' OR {b}.core = '' THEN 0.0 WHEN {a}.core = {b}.core THEN 1.0 "
        f"WHEN len({a}.g) = 0 OR len({b}.g) = 0 THEN 0.0 "
        f"ELSE {inter} * 1.0 / (len({a}.g) + len({b}.g) - {inter}) END"
    )


# Local choice per region of `merged`.
MEDOID = f"""
prof AS (SELECT page_id, segment, agent, text, core, {grams('core')} AS g
         FROM (SELECT *, {core('text')} AS core FROM merged)),
pairs AS (SELECT x.page_id, x.segment, x.agent, y.agent AS other, CAST({jaccard('x', 'y')} AS DOUBLE) AS s
          FROM prof x JOIN prof y ON x.page_id = y.page_id AND x.segment = y.segment AND x.agent <> y.agent),
scored AS (SELECT p.page_id, p.segment, p.agent, p.text,
                  coalesce(list_reduce(list(q.s ORDER BY q.other) FILTER (WHERE q.s IS NOT NULL), lambda u, v: u + v), 0.0) AS score,
                  count(*) OVER (PARTITION BY p.page_id, p.segment) AS size
           FROM prof p LEFT JOIN pairs q ON q.page_id = p.page_id AND q.segment = p.segment AND q.agent = p.agent
           GROUP BY p.page_id, p.segment, p.agent, p.text),
local AS (SELECT page_id, segment, agent, text, score, size,
                 {round4("CASE WHEN size < 2 THEN 0.25 ELSE 0.30 + 0.35 * (score / (size - 1)) END")} AS confidence
          FROM (SELECT *, row_number() OVER (PARTITION BY page_id, segment ORDER BY score DESC, agent) AS rn FROM scored)
          WHERE rn = 1)"""

# Outcome per region for the stand-in arbiter of the inputs.
OUTCOMES = f"""
answers AS (SELECT m.page_id, m.segment,
                   CASE WHEN lang = 'en' THEN m.text WHEN lang = 'es' THEN m.text || '!' ELSE '' END AS text
            FROM (SELECT page_id, segment, arg_min(text, agent) AS text FROM merged GROUP BY page_id, segment) m
            JOIN documents d ON d.doc_id = m.page_id WHERE lang IN ('en', 'es', 'de')),
outcomes AS (
  SELECT d.page_id, d.segment, d.candidates,
         CASE WHEN a.text IS NULL THEN 'fallback' WHEN {trim('a.text')} = '' THEN 'dropped' ELSE 'escalated' END AS outcome,
         CASE WHEN a.text IS NULL THEN l.text WHEN {trim('a.text')} = '' THEN '' ELSE a.text END AS text,
         CASE WHEN a.text IS NULL THEN l.confidence WHEN {trim('a.text')} = '' THEN 0.0
              WHEN EXISTS (SELECT 1 FROM merged m WHERE m.page_id = d.page_id AND m.segment = d.segment
                           AND {visible('m.text')} = {visible('a.text')}) THEN 0.95 ELSE 0.80 END AS confidence,
         CASE WHEN a.text IS NULL THEN l.agent WHEN {trim('a.text')} = '' THEN '' ELSE 'arbiter' END AS froms
  FROM disputes d JOIN local l ON l.page_id = d.page_id AND l.segment = d.segment
  LEFT JOIN answers a ON a.page_id = d.page_id AND a.segment = d.segment),
segs AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY slot) - 1 AS idx FROM (
  SELECT page_id, slot, text, confidence, 'consensus' AS source, froms, FALSE AS disputed, '' AS candidates FROM agreed
  UNION ALL
  SELECT page_id, segment, text, confidence, outcome, froms, TRUE, candidates FROM outcomes WHERE outcome <> 'dropped'))"""

FUSED = VOTES + "," + MEDOID + "," + OUTCOMES

# Accented letters of the texts to single ASCII marks, since levenshtein here counts bytes.
ASCII = "translate({x}, 'éÉßÇçäÄóèñÑÊíêüÖÍÜÈöÓ', '!@#$%^&*()-=+[]{{}};:<')"


def ascii_marks(x):
    return ASCII.format(x=x)


REPEATS = f"""
forms AS (SELECT *, length(core) AS size, {ascii_marks('core')} AS marks
          FROM (SELECT page_id, idx, disputed, source, {visible('text')} AS vis, {core('text')} AS core FROM segs)),
later AS (SELECT *, unnest([1, 2, 3, 4]) AS gap FROM forms
          WHERE disputed AND source <> 'consensus' AND size >= 8),
near AS (SELECT l.page_id, l.idx AS later, e.idx AS earlier, l.marks AS one, e.marks AS two,
                l.vis = e.vis OR contains(e.core, l.core) AS same,
                least(l.size, e.size) AS short, greatest(l.size, e.size) AS long
         FROM later l JOIN forms e ON e.page_id = l.page_id AND e.idx = l.idx - l.gap WHERE e.core <> ''),
valid AS (SELECT page_id, later, earlier FROM near WHERE same
          UNION ALL
          SELECT page_id, later, earlier FROM (SELECT * FROM near WHERE NOT same AND short * 10 >= long * 9)
          WHERE levenshtein(one, two) <= greatest(1, long // 12)),
kept AS (SELECT s.*, row_number() OVER (PARTITION BY s.page_id ORDER BY s.idx) - 1 AS nidx FROM segs s
         WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.page_id = s.page_id AND v.later = s.idx))"""


def query(ctes, select):
    return f"WITH {ctes}\n{select}"
