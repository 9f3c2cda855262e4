"""Pieces of DuckDB SQL that the queries' twins share. RE2 has ASCII classes and no lookahead, so word ends are spelled out."""

from __future__ import annotations

from paperloom.sources.exam import CHAPTERS, CURRENT_YEAR

# Fixed values, spelled out here once more, so that a wrong entry on either side shows.
BANNERS = (
    "nitr", "national institute of technology rourkela", "best of luck", "all the best", "time allowed", "max marks", "watermark", "confidential",
)
NOISE_STARTS = r"page\s*[-:\s]*\d+(\s*(of|/)\s*\d+)?\s*$|pg\.?\s*\d+\s*$|registration\s*no|roll\s*no|sem(ester)?\s*exam"
INSTRUCTIONS = (
    r"answer\s+all\s+(the\s+)?questions", r"answer\s+any\s+(four|three|five|two|one|six)\s+questions", r"attempt\s+any", r"attempt\s+all", r"full\s+marks", r"time\s*:",
    r"best\s+of\s+luck", r"all\s+the\s+best", r"figures\s+in\s+the\s+margin", r"candidates\s+are\s+required", r"maximum\s+marks", r"questions\s+carry\s+equal\s+marks",
    r"write\s+answers\s+in\s+your\s+own",
)
GENERIC_INSTRUCTIONS = (
    r"\b(answer|attempt)\s+(all|any|the\s+following|questions)\b", r"^\s*(answer|attempt|choose|select)\s+(the\s+following|any|all|questions|one|two|three|four|five)\b",
    r"^\s*(answer|attempt)\s*$",
)
VERBS = (
    "explain", "describe", "discuss", "compare", "differentiate", "analyze", "evaluate", "design", "calculate", "derive", "illustrate", "justify", "what", "why", "how",
    "when", "consider", "assume", "find", "determine", "show", "prove", "solve", "define", "write", "state", "list", "sketch", "verify", "identify", "trace", "compute",
    "formulate", "construct", "give", "elaborate", "distinguish", "summarize", "obtain",
)
SHORT_VERBS = (
    "define", "explain", "list", "state", "sketch",
)
TWO_WORD_VERBS = (
    "define", "explain", "list", "state", "sketch", "write",
)
ABBREVIATIONS = (
    "cpu", "sram", "dram", "os", "fifo", "lru", "pcb", "mmu", "tlb", "i/o", "ram", "rom", "dma", "lan", "wan", "ip", "tcp", "udp", "sql", "xml", "dbms", "api", "acid",
    "oop", "uml", "dns", "http", "https", "ftp", "bjt", "fet", "op-amp", "alu", "asic", "fpga", "risc", "cisc", "cs",
)

EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def chain(text: str, *steps: tuple[str, str, bool]) -> str:
    """regexp_replace of pattern by text, everywhere if asked."""
    for pattern, to, everywhere in steps:
        text = f"regexp_replace({text}, {q(pattern)}, {q(to)}" + (", 'g')" if everywhere else ")")
    return text


def normal(text: str) -> str:
    steps = [(r"^\s*(?:q|question)\s*\d+[\s.:,\-]*", "", False), (r"^\s*\d+[.:\-]+\s*", "", False), (r"^\s*(?:\([a-z0-9]+\)|[a-z0-9]+[).:\-])\s*", "", False), (r"\s+", " ", True)]
    return f"trim({chain(f'trim({chain(f"lower({text})", *steps)})', (r'[^\p{L}\p{N}\p{M}_\s()]', '', True))})"


PAPERS = "papers AS (SELECT o_custkey AS session_id, o_orderkey AS paper_id, year(o_orderdate)::INT AS held, CASE WHEN o_orderkey % 17 <> 0 THEN year(o_orderdate)::INT END AS year, 'Exam ' || year(o_orderdate) || ' ' || o_orderkey || '.pdf' AS filename FROM orders)"
PQ = """pq AS (SELECT l_orderkey AS paper_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice))::INT AS ordinal,
  CASE l_returnflag WHEN 'A' THEN 'Explain' WHEN 'N' THEN 'Describe' ELSE 'Compare' END || ' the ' || p_name || CASE WHEN l_linestatus = 'F' THEN '.' ELSE '' END AS text,
  nullif(l_quantity, 13) AS marks FROM lineitem JOIN part ON l_partkey = p_partkey)"""
Q = f"q AS (SELECT session_id, paper_id, year, filename, ordinal, text, marks, sha256({normal('text')}) AS content_hash FROM papers JOIN pq USING (paper_id))"
G = """g AS (SELECT session_id, content_hash, first(text ORDER BY length(text) DESC, paper_id, ordinal) AS canonical_text, count(*) AS occurrences, avg(marks) AS avg_marks, max(marks) AS max_marks,
  min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS n_years, coalesce(max(year) - min(year), 0) AS year_span FROM q GROUP BY session_id, content_hash)"""
TOPIC = "CASE " + " ".join(f"WHEN contains(lower(canonical_text), {q(c)}) THEN {q(c)}" for c in CHAPTERS) + f" ELSE {q(CHAPTERS[-1])} END"
S = """s AS (SELECT session_id, count(DISTINCT year) AS years, count(*) AS s_papers FROM papers GROUP BY session_id),
so AS (SELECT session_id, max(occurrences) AS occ, max(max_marks) AS mm FROM g GROUP BY session_id),
sn AS (SELECT session_id, greatest(years, 1) AS s_years, s_papers, coalesce(occ, 1) AS s_occurrences, CASE WHEN session_id % 3 = 0 THEN 70.0::DOUBLE ELSE coalesce(nullif(mm, 0), 10.0)::DOUBLE END AS s_marks FROM s LEFT JOIN so USING (session_id))"""
#: ix: places of groups in their sessions; sc: token-set scores of pairs of wordings x < y of `want`. A common subsequence is as long as the last number of the
#: last row of the usual table, one row a character.
IX = "pl AS (SELECT session_id, content_hash, min((paper_id, ordinal)) AS place FROM q GROUP BY session_id, content_hash), ix AS (SELECT session_id, content_hash, canonical_text, (row_number() OVER (PARTITION BY session_id ORDER BY place, content_hash) - 1)::INT AS idx FROM g JOIN pl USING (session_id, content_hash))"
_SET = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda t: t <> ''))"
_JOINED = lambda c: f"array_to_string(list_sort({c}), ' ')"
SC = f"""tk AS (SELECT DISTINCT x, y, {_SET('x')} AS tx, {_SET('y')} AS ty FROM want),
sp AS (SELECT x, y, {_JOINED('list_intersect(tx, ty)')} AS s, {_JOINED('list_filter(tx, lambda t: NOT list_contains(ty, t))')} AS p, {_JOINED('list_filter(ty, lambda t: NOT list_contains(tx, t))')} AS q FROM tk),
lc AS (SELECT *, CASE WHEN p = '' OR q = '' THEN 0 ELSE list_last(list_reduce(list_transform(string_split(p, ''), lambda t: [unicode(t)::BIGINT]), lambda was, c:
  list_reduce(list_transform(range(1, length(q) + 1), lambda t: [t::BIGINT]), lambda now, j: list_append(now, CASE WHEN unicode(q[j[1]]) = c[1] THEN was[j[1]] + 1 ELSE greatest(was[j[1] + 1], now[j[1]]) END), [0::BIGINT]),
  list_transform(range(0, length(q) + 1), lambda t: 0::BIGINT))) END AS lcs, CASE WHEN s = '' THEN 0 ELSE 1 END AS k FROM sp),
sc AS (SELECT x, y, CASE WHEN s <> '' AND (p = '' OR q = '') THEN 1.0::DOUBLE ELSE greatest(1 - (length(p) + length(q) - 2 * lcs)::DOUBLE / (2 * (length(s) + k) + length(p) + length(q)),
  CASE WHEN s = '' THEN 0.0 ELSE 1 - (k + length(p))::DOUBLE / (2 * length(s) + k + length(p)) END, CASE WHEN s = '' THEN 0.0 ELSE 1 - (k + length(q))::DOUBLE / (2 * length(s) + k + length(q)) END) END AS score FROM lc)"""
#: ed: pairs of groups with a score of 0.84 or more. Groups in order: one without a seed among its lower neighbours is a seed; the others go to their lowest seed.
ED = f"""{IX}, want AS (SELECT DISTINCT least(a.canonical_text, b.canonical_text) AS x, greatest(a.canonical_text, b.canonical_text) AS y FROM ix a JOIN ix b ON a.session_id = b.session_id AND a.idx < b.idx), {SC},
ed AS (SELECT a.session_id, a.idx AS i, b.idx AS j, score FROM ix a JOIN ix b ON a.session_id = b.session_id AND a.idx < b.idx JOIN sc ON x = least(a.canonical_text, b.canonical_text) AND y = greatest(a.canonical_text, b.canonical_text) WHERE score >= 0.84)"""
CL = f"""{ED}, nb AS (SELECT session_id, j AS idx, list(i) AS lower, row_number() OVER (PARTITION BY session_id ORDER BY j) AS r FROM ed GROUP BY session_id, j),
sd AS (SELECT session_id, 0::BIGINT AS r, []::INT[] AS joined FROM (SELECT DISTINCT session_id FROM nb)
  UNION ALL SELECT sd.session_id, nb.r, CASE WHEN len(list_filter(nb.lower, lambda t: NOT list_contains(sd.joined, t))) > 0 THEN list_append(sd.joined, nb.idx) ELSE sd.joined END FROM sd JOIN nb ON nb.session_id = sd.session_id AND nb.r = sd.r + 1),
fin AS (SELECT session_id, arg_max(joined, r) AS joined FROM sd GROUP BY session_id),
cl AS (SELECT ix.session_id, ix.idx, content_hash, canonical_text, CASE WHEN list_contains(fin.joined, ix.idx) THEN list_min(list_filter(nb.lower, lambda t: NOT list_contains(fin.joined, t))) ELSE ix.idx END AS seed
  FROM ix LEFT JOIN fin USING (session_id) LEFT JOIN nb ON nb.session_id = ix.session_id AND nb.idx = ix.idx),
cc AS (SELECT cl.*, coalesce(ed.score, 1.0::DOUBLE) AS confidence, count(*) OVER (PARTITION BY cl.session_id, seed)::INT AS cluster_size, 'c_' || cl.session_id || '_' || seed AS cluster_id FROM cl LEFT JOIN ed ON ed.session_id = cl.session_id AND ed.i = seed AND ed.j = cl.idx)"""
F = f"""{CL}, f AS (SELECT g.*, cc.cluster_id, cc.cluster_size, {TOPIC.replace('canonical_text', 'g.canonical_text')} AS topic, 100.0::DOUBLE * occurrences / s_occurrences AS f_freq, CASE WHEN last_year IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100.0::DOUBLE - 20.0::DOUBLE * ({CURRENT_YEAR} - last_year)) END AS f_recency,
  CASE WHEN coalesce(avg_marks, 0) = 0 THEN 50.0::DOUBLE ELSE least(100.0::DOUBLE, 100.0::DOUBLE * avg_marks / s_marks) END AS f_marks, 100.0::DOUBLE * n_years / s_years AS f_spread, least(100.0::DOUBLE, 25.0::DOUBLE * (cluster_size - 1)) AS f_cluster, 50.0::DOUBLE AS f_chapter
  FROM g JOIN sn USING (session_id) JOIN cc USING (session_id, content_hash)),
b0 AS (SELECT *, floor((0.0::DOUBLE + f_freq * 0.30::DOUBLE + f_recency * 0.25::DOUBLE + f_marks * 0.20::DOUBLE + f_spread * 0.15::DOUBLE + f_cluster * 0.07::DOUBLE + f_chapter * 0.03::DOUBLE) * 10 + 0.5) / 10 AS priority_score FROM f),
b1 AS (SELECT *, CASE WHEN priority_score >= 85 THEN 'critical' WHEN priority_score >= 70 THEN 'very_high' WHEN priority_score >= 50 THEN 'high' WHEN priority_score >= 30 THEN 'medium' ELSE 'low' END AS priority_level,
  list_filter([CASE WHEN f_freq >= 80 THEN 'is extremely frequent across papers' WHEN f_freq >= 50 THEN 'has appeared multiple times' END,
    CASE WHEN f_recency >= 80 THEN 'was asked recently (last in ' || last_year || ')' WHEN f_recency >= 50 THEN 'was asked in recent years' END,
    CASE WHEN f_spread >= 60 THEN 'shows high consistency across multiple years' END,
    CASE WHEN avg_marks >= 8 THEN 'carries high weightage (' || floor(avg_marks)::INT || ' marks on average)' END,
    CASE WHEN cluster_size > 1 THEN 'appears in ' || cluster_size || ' similar variations' END], lambda x: x IS NOT NULL) AS reasons FROM b0),
bank AS (SELECT *, 'Ranked ' || CASE priority_level WHEN 'critical' THEN 'Critical' WHEN 'very_high' THEN 'Very High' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' ELSE 'Low' END ||
  CASE WHEN len(reasons) = 0 THEN ' based on standard frequency and spacing factors.' WHEN len(reasons) = 1 THEN ' because it ' || reasons[1] || '.'
  ELSE ' because it ' || array_to_string(reasons[1:len(reasons) - 1], ', ') || ', and ' || reasons[len(reasons)] || '.' END AS priority_reason FROM b1)"""
#: A page of each paper, as sources.exam.rendered makes it: a line a question, parts and sections by the paper's number.
_N = "(CASE WHEN paper_id % 3 = 0 THEN (ordinal + 1) // 2 ELSE ordinal END)::BIGINT"
RENDERED = f"""rl AS (SELECT paper_id, ordinal, text || CASE WHEN marks IS NULL THEN '' ELSE ' (' || marks::INT || ' marks)' END AS tail FROM pq),
rp AS (SELECT paper_id, ordinal, CASE WHEN paper_id % 2 = 0 AND ordinal = 1 THEN 'SECTION A' || chr(10) WHEN paper_id % 2 = 0 AND ordinal = 3 THEN 'Page 2 of 3' || chr(10) || 'SECTION B' || chr(10) || 'Long Answer Questions' || chr(10) ELSE '' END
  || CASE WHEN paper_id % 3 <> 0 THEN 'Q' || {_N} || '. ' || tail WHEN ordinal % 2 = 1 THEN 'Q' || {_N} || '. Answer the following:' || chr(10) || '(a) ' || tail ELSE '(b) ' || tail END AS line FROM rl),
rendered AS (SELECT paper_id, string_agg(line, chr(10) ORDER BY ordinal) AS text FROM rp GROUP BY paper_id)"""
QUESTIONS = f"WITH RECURSIVE {PAPERS}, {PQ}, {Q}"
GROUPS = f"{QUESTIONS}, {G}"
CLUSTERS = f"{GROUPS}, {CL}"
BANK = f"{GROUPS}, {S}, {F}"

LINES = "lines AS (SELECT doc_id, (unnest(generate_series(1, len(string_split(text, chr(10))))) - 1)::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
PAGES = """pg AS (SELECT page_id, page_id // 5 AS paper_id, (page_id % 5 + 1)::INT AS page_no, (page_id % 2)::INT AS image_count,
  CASE WHEN (page_id // 5) % 4 = 0 OR ((page_id // 5) % 4 = 2 AND page_id % 2 = 0) THEN '' WHEN (page_id // 5) % 4 = 3 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || regexp_extract(html, '<h1>([^<]*)</h1>', 1) || ' ' || url ELSE html END AS text,
  CASE WHEN (page_id // 5) % 4 = 3 AND page_id % 3 = 0 THEN '' ELSE regexp_replace(html, '<[^>]*>', ' ', 'g') END AS ocr_text FROM pages),
routed AS (SELECT *, (length(trim(text)) < 100 OR (image_count > 0 AND length(trim(text)) < 250)) AND trim(ocr_text) <> '' AS scanned FROM pg)"""

NOISE = rf"(?i)^\s*({NOISE_STARTS})|" + "|".join(r"\s+".join(b.split()) for b in BANNERS)
REPAIR = [
    (r"^\s*(\d{1,3})[,:](\s|$)", r"\1.\2"),
    (r"(?i)^\s*([ivx]+)[,:](\s|$)", r"\1.\2"),
    (r"(?i)^\s*(Q\d{1,3}):(\s|$)", r"\1.\2"),
    (r"\b(Question|Q)\s*[lL|]\b", r"\1 1"),
    (r"(?i)\b([1-9])o\s*(?:marks?|m)\b", r"\10 marks"),
    (r"([(\[]\s*\d*)[Oo](\d*\s*[)\]])", r"\10\2"),
    (r"^\s*l([.):,])", r"1\1"),
    (r"^\s*(\d+)(?:st|nd|rd|th|[sS])(\s|$)", r"\1.\2"),
    (r"^\s*([ivxIVX]+)[sS](\s|$)", r"\1.\2"),
]


def repaired(line: str) -> str:
    return chain(line, *[(p, to, True) for p, to in REPAIR])


def cleaned(text: str) -> str:
    steps = [(r"[\n\r]", " ", True), (r"\s+[\\|_~^]\s+", " ", True), (r"^[\\|_~^]\s+|\s+[\\|_~^]$", " ", True), (r"\.{3,}", ".", True), (r"\?{2,}", "?", True), (r"!{2,}", "!", True), (r"-{3,}", "-", True), (r"\s+", " ", True)]
    return f"trim({chain(text, *steps)})"


PRODUCT = r"(?i)([(\[]\s*(\d+)\s*(?:marks?|m|mark\s+each)?\s*[x*]\s*(\d+)\s*(?:marks?|m)?\s*[)\]])"
BRACKETED = r"(?i)([(\[]\s*(\d+)\s*(?:marks?|m)?\s*[)\]])"
BARE = r"(?i)\b(\d+)\s*(?:marks?|m)\b"

SPACE = r"[\s\x0B\x{85}\p{Z}]"
#: A text's tokens, and the checks over them, as columns of `v`: t, tok, share, broken, n.
CHECKS = rf"""{LINES}, t AS (SELECT doc_id, line_no, trim(line) AS t FROM lines), tk AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS tok FROM t),
c AS (SELECT *, list_transform(tok, lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_]+$', '', 'g')) AS cores FROM tk),
v AS (SELECT *, length(regexp_replace(t, '[\p{{L}}\p{{N}}\p{{M}}_\s\x0B\x{{85}}\p{{Z}}+\-=*/()<>,.;?''"]', '', 'g')) / length(t) AS share,
  len(list_filter(cores, lambda x: x <> '' AND ((regexp_full_match(x, '\p{{L}}+') AND length(x) >= 2 AND NOT (x = upper(x) AND x <> lower(x)) AND NOT regexp_matches(lower(x), '[aeiouy]') AND lower(x) NOT IN {listed(ABBREVIATIONS)})
    OR regexp_matches(x, '[}}{{\]\[|\\^~_]')
    OR (NOT regexp_full_match(x, '[\p{{L}}\p{{N}}]+') AND NOT regexp_full_match(x, '\d+(\.\d+)?|[a-zA-Z\d]+[''\-][a-zA-Z\d]+|[A-Z](\.[A-Z])+\.?|\(?[a-zA-Z\d\-]+\)?|\[[a-zA-Z\d\-]+\]|[a-zA-Z\d+\-=*/()<>,:!]+'))))) / len(tok) AS broken,
  len(tok) AS n, length(regexp_replace(t, '{SPACE}+', '', 'g')) AS chars,
  list_transform(tok[1:3], lambda x: lower(regexp_replace(x, '[^\p{{L}}\p{{N}}\p{{M}}_]', '', 'g'))) AS heads FROM c)"""
METADATA = rf"(?i){EDGE_L}(semester|branch|subject\s*code|school\s+of|kiit|university|examination|roll\s+no|reg\s+no|registration|sessional|mid-semester|end-semester|course|dept|department|programme|degree|tech|autumn|spring){EDGE_R}"
#: time: ends in a colon, after which a word has to follow directly.
INSTRUCTION = rf"(?i){EDGE_L}(" + "|".join(p for p in INSTRUCTIONS if not p.endswith(":")) + rf"){EDGE_R}|{EDGE_L}time\s*:[\p{{L}}\p{{N}}_]"
META = rf"{INSTRUCTION}|{EDGE_L}(answer|attempt)\s+(all|any|the\s+following|questions){EDGE_R}|" + "|".join(p.replace(r"\b", EDGE_R) for p in GENERIC_INSTRUCTIONS[1:])
PAGE = rf"(?i)^\s*page\s+\d+|^\s*page\s+no|{EDGE_L}pg\s*\.?\s*\d+{EDGE_R}"
SYSTEM = r"(?i)^\s*\[subquestions\s+only\]\s*$"
BLACK = f"CASE WHEN regexp_matches(t, {q(METADATA)}) THEN 5 WHEN regexp_matches(t, {q(INSTRUCTION)}) THEN 12 WHEN regexp_matches(t, {q(PAGE)}) THEN 8 WHEN regexp_matches(t, {q(SYSTEM)}) THEN 0 END"
BLACK_REASON = f"CASE WHEN regexp_matches(t, {q(METADATA)}) THEN 'University metadata' WHEN regexp_matches(t, {q(INSTRUCTION)}) THEN 'Exam instruction' WHEN regexp_matches(t, {q(PAGE)}) THEN 'Page metadata' WHEN regexp_matches(t, {q(SYSTEM)}) THEN 'System-generated content' END"
_VERB = f"len(list_filter(heads, lambda x: x IN {listed(VERBS)})) > 0"
_MARKED = f"(regexp_matches(t, {q(BRACKETED)}) OR regexp_matches(t, {q(BARE)}))"
POINTS = rf"""greatest(0, least(100, 55 + CASE WHEN {_VERB} THEN 25 ELSE 0 END + CASE WHEN contains(t, '?') THEN 25 ELSE 0 END + CASE WHEN {_MARKED} THEN 15 ELSE 0 END + CASE WHEN length(t) > 20 THEN 12 ELSE 0 END
  - CASE WHEN NOT {_VERB} AND NOT contains(t, '?') AND NOT {_MARKED} AND NOT regexp_matches(t, '(?i)^(consider|let|assume|for\b)') THEN 25 ELSE 0 END - CASE WHEN t = upper(t) AND upper(t) <> lower(t) AND length(t) > 5 THEN 20 ELSE 0 END))"""
GARBAGE_REASON = "CASE WHEN t = '' THEN 'OCR Garbage: Empty text' WHEN share > 0.18 AND length(t) > 8 THEN 'OCR Garbage: Too many special symbols' WHEN broken > 0.35 AND n >= 2 THEN 'OCR Garbage: Too many suspicious/broken words' END"
LENGTH_REASON = f"CASE WHEN chars < 10 AND NOT (n = 2 AND heads[1] IN {listed(SHORT_VERBS)}) THEN 'Too short (length ' || chars || ' < 10 characters)' END"
WORD_REASON = f"CASE WHEN n < 2 THEN 'Too few words (count ' || n || ' < 2)' WHEN n = 2 AND heads[1] NOT IN {listed(TWO_WORD_VERBS)} THEN '2-word block does not start with action verb' END"
WORD_CONFIDENCE = f"CASE WHEN n < 2 THEN 10 WHEN n = 2 AND heads[1] NOT IN {listed(TWO_WORD_VERBS)} THEN 20 END"
STATUS = "CASE WHEN points < 40 THEN 'rejected' WHEN points <= 60 THEN 'review' ELSE 'accepted' END"
VALID = f"""WITH {CHECKS}, p AS (SELECT *, {POINTS} AS points, {GARBAGE_REASON} AS r1, {LENGTH_REASON} AS r2, {WORD_REASON} AS r3, {WORD_CONFIDENCE} AS w3, {BLACK_REASON} AS r4, {BLACK} AS w4 FROM v),
valid AS (SELECT doc_id, line_no, t, CASE WHEN r1 IS NOT NULL THEN 0 WHEN r2 IS NOT NULL THEN 15 WHEN r3 IS NOT NULL THEN w3 WHEN r4 IS NOT NULL THEN w4 ELSE points END::INT AS confidence,
  CASE WHEN coalesce(r1, r2, r3, r4) IS NOT NULL THEN 'rejected' ELSE {STATUS} END AS status,
  coalesce(r1, r2, r3, r4, CASE WHEN points < 40 THEN 'Does not match question verbs/patterns' WHEN points <= 60 THEN 'Borderline question indicators' ELSE 'Genuine question indicators found' END) AS reason FROM p)"""
