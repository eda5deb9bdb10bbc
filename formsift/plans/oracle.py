"""The document rules as DuckDB SQL, written apart from the operators.

Each function gives one or more common table expressions, or an expression."""

from __future__ import annotations

from formsift import vocab
from formsift.operators import synth

STATES = "|".join(vocab.STATE_CODES)
TIGHT = r"regexp_replace({v}, '[\s-]', '', 'g')"
#: Patterns without looking around: what they take besides the value stands outside group 1.
MATCHERS = {
    "Aadhaar": (r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b", 0, TIGHT),
    "PAN": (r"(?i)\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0, "upper({v})"),
    "Phone": (r"(?:^|[^A-Za-z0-9+])((?:\+91[\s-]?)?[6-9]\d{9})(?:$|[^0-9])", 1, TIGHT),
    "Email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0, "{v}"),
    "Voter ID": (r"(?i)\b[A-Z]{3}[0-9]{7}\b", 0, "upper({v})"),
    "Driving Licence": (rf"(?i)(?:^|[^A-Za-z0-9])((?:{STATES})[-\s]?\d{{2}}[-\s]?\d{{4,13}})(?:$|[^A-Za-z0-9])", 1, f"upper({TIGHT})"),
    "DOB": (r"(?i)(?:\bdate\s+of\s+birth\b|\bdob\b|\bborn\s+on\b|\bbirth\s+date\b|\bbirthdate\b)\s*(?::|-|=|\bis\b|\bwas\b)?\s*((?:0?[1-9]|[12]\d|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)\d{2})", 1, "{v}"),
}


def matches(kind: str, src: str = "src", order: int = 0) -> str:
    """SELECT of (doc_id, k, type, value, start, end) of a pattern's matches."""
    pattern, group, value = MATCHERS[kind]
    lengths = lambda x, upto: f"coalesce(list_sum(list_transform({x}[1:{upto}], lambda y: length(y))), 0)"
    return f"""SELECT doc_id, {order} AS k, '{kind}' AS type, {value.format(v="m[i]")} AS value, pos AS start, (pos + length(m[i]))::INT AS "end" FROM (
      SELECT *, ({lengths("g", "i")} + {lengths("a", "i - 1")} + instr(a[i], m[i]) - 1)::INT AS pos FROM (
        SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS a, regexp_extract_all(text, '{pattern}', {group}) AS m, string_split_regex(text, '{pattern}') AS g FROM {src})))"""


def found() -> str:
    """found: candidates of all patterns, with ord by place and kind."""
    union = " UNION ALL ".join(f"({matches(kind, order=i)})" for i, kind in enumerate(MATCHERS))
    return f"""found AS (SELECT *, {vocab.REGEX_CONFIDENCE}::DOUBLE AS confidence, 'regex' AS source, true AS validated,
      (row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", k) - 1)::INT AS ord FROM ({union}))"""


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def roles(places: str) -> str:
    """role_of (doc_id, ord, role, label, score, model) of rows (doc_id, ord, type, text, start) of a table."""
    values = ", ".join(f"({_text(kind)}, {rank}, {i}, {_text(label)})" for rank, table in ((3, vocab.PRIMARY_LABELS), (2, vocab.NON_TARGET_LABELS), (1, vocab.SECONDARY_LABELS)) for kind, labels in table.items() for i, label in enumerate(labels))
    clean = lambda x: f"translate(lower({x}), '’`', '''''')"
    last = lambda x: f"CASE WHEN contains({x}, label) THEN length({x}) - instr(reverse({x}), reverse(label)) - length(label) + 1 END"
    return f"""labels AS (SELECT * FROM (VALUES {values}) AS v(kind, rank, i, label)),
    seen AS (SELECT doc_id, ord, upper(type) AS kind, start, {clean("string_split(left(text, start), chr(10))[-1]")} AS line, {clean("right(left(text, start), 120)")} AS near FROM {places}),
    placed AS (SELECT doc_id, ord, rank, i, label, {last("line")} AS a, {last("near")} AS b FROM seen JOIN labels USING (kind) WHERE start IS NOT NULL),
    each AS (SELECT doc_id, ord, rank, CASE WHEN max(a) IS NOT NULL THEN max(a) ELSE max(b) END AS pos,
      CASE WHEN max(a) IS NOT NULL THEN arg_max(label, a * 100 - i) FILTER (a IS NOT NULL) ELSE arg_max(label, b * 100 - i) FILTER (b IS NOT NULL) END AS label FROM placed GROUP BY ALL),
    best AS (SELECT doc_id, ord, arg_max(rank, pos * 10 + rank) AS rank, arg_max(label, pos * 10 + rank) AS label FROM each WHERE pos IS NOT NULL GROUP BY ALL),
    role_of AS (SELECT doc_id, ord, CASE rank WHEN 3 THEN 'primary' WHEN 2 THEN 'non_target' WHEN 1 THEN 'secondary_person' ELSE 'unknown' END AS role, coalesce(label, '') AS label,
      CASE WHEN rank = 3 THEN 1.0 WHEN rank IS NULL THEN 0.0 ELSE -1.0 END::DOUBLE AS score, CASE WHEN start IS NULL THEN 'none' ELSE 'nearest_field' END AS model FROM seen LEFT JOIN best USING (doc_id, ord))"""


CANONICAL = "CASE upper(trim(type)) WHEN 'VOTER ID' THEN 'VOTER_ID' WHEN 'DRIVING LICENCE' THEN 'DRIVING_LICENCE' WHEN 'DATE OF BIRTH' THEN 'DOB' ELSE replace(upper(trim(type)), ' ', '_') END"
KEPT_ROLE = "NOT (role = 'secondary_person' AND upper(type) = 'NAME') AND NOT (role = 'non_target' AND upper(type) IN ('EMAIL', 'PHONE', 'DOB', 'ADDRESS'))"
#: Of canonical types.
DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
PHONE = f"CASE WHEN regexp_full_match({DIGITS}, '91[0-9]{{10}}') THEN substr({DIGITS}, 3) ELSE {DIGITS} END"
DATE = "CASE WHEN regexp_full_match(value, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN coalesce(strftime(try_strptime(value, '%d/%m/%Y'), '%Y-%m-%d'), value) WHEN regexp_full_match(value, '\\d{1,2}-\\d{1,2}-\\d{4}') THEN coalesce(strftime(try_strptime(value, '%d-%m-%Y'), '%Y-%m-%d'), value) ELSE value END"
KEY = f"type || chr(10) || CASE type WHEN 'PHONE' THEN {PHONE} WHEN 'DOB' THEN {DATE} WHEN 'AADHAAR' THEN {TIGHT.format(v='value')} WHEN 'DRIVING_LICENCE' THEN {TIGHT.format(v='value')} WHEN 'VOTER_ID' THEN {TIGHT.format(v='value')} ELSE lower(value) END"
VALID = rf"""CASE type WHEN 'PAN' THEN regexp_full_match(upper(value), '[A-Z]{{5}}[0-9]{{4}}[A-Z]') WHEN 'AADHAAR' THEN regexp_full_match({TIGHT.format(v="value")}, '[2-9]\d{{11}}')
    WHEN 'PHONE' THEN regexp_full_match({PHONE}, '[6-9]\d{{9}}') WHEN 'EMAIL' THEN regexp_full_match(value, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')
    WHEN 'DRIVING_LICENCE' THEN regexp_full_match(upper({TIGHT.format(v="value")}), '({STATES})\d{{2}}\d{{4,13}}') WHEN 'VOTER_ID' THEN regexp_full_match(upper({TIGHT.format(v="value")}), '[A-Z]{{3}}[0-9]{{7}}') ELSE type IN ('NAME', 'ADDRESS', 'DOB') END"""


def quality(e: str) -> str:
    yes = lambda f: f"CASE WHEN {e}.{f} THEN 0.1::DOUBLE ELSE 0 END"
    return f"({e}.confidence + 0.3::DOUBLE * {e}.score + {yes('valid')} + {yes('agree')})"


def priority(e: str) -> str:
    ranks = lambda regex, model: f"CASE {e}.source WHEN 'regex' THEN {regex} WHEN 'deberta' THEN {model} WHEN 'llm/context' THEN 1 ELSE 0 END"
    return f"CASE WHEN {e}.type IN ('NAME', 'ADDRESS', 'DOB') THEN {ranks(2, 3)} WHEN {e}.type IN ('PAN', 'AADHAAR', 'DRIVING_LICENCE', 'VOTER_ID', 'PHONE', 'EMAIL') THEN {ranks(3, 2)} ELSE 0 END"


FIELDS = ("type", "value", "confidence", "source", "start", "end", "validated", "role", "label", "score", "model", "valid", "agree")


def _struct(e: str, **changes: str) -> str:
    return "{" + ", ".join(f"'{f}': " + changes.get(f, f'{e}."{f}"') for f in FIELDS) + "}"


def canonical(cand: str) -> str:
    """good (doc_id, ord, key and FIELDS): canonical types, squeezed values, right formats only."""
    return rf"""typed AS (SELECT * REPLACE ({CANONICAL} AS type, trim(regexp_replace(value, '\s+', ' ', 'g')) AS value) FROM {cand}),
    good AS (SELECT doc_id, ord, {KEY} AS key, type, value, confidence, source, start, "end", validated, role, label, score, model, true AS valid, false AS agree FROM typed WHERE {VALID})"""


def folded() -> str:
    """folded (doc_id, first, e): one entity a key of `good`, in order of first sight."""
    rank = lambda e: f"({quality(e)}, {priority(e)}, {e}.confidence)"
    won = _struct("w", agree="true", valid="f.e.valid OR k.e.valid")
    return f"""keyed AS (SELECT doc_id, key, {_struct("good")} AS e, row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) AS n, min(ord) OVER (PARTITION BY doc_id, key) AS first FROM good),
    fold AS (SELECT doc_id, key, first, n, e FROM keyed WHERE n = 1
      UNION ALL SELECT doc_id, key, first, n, {won} FROM (SELECT k.doc_id, k.key, k.first, k.n, f, k, CASE WHEN {rank("k.e")} > {rank("f.e")} THEN k.e ELSE f.e END AS w FROM fold AS f JOIN keyed AS k ON f.doc_id = k.doc_id AND f.key = k.key AND k.n = f.n + 1)),
    folded AS (SELECT doc_id, first, arg_max(e, n) AS e FROM fold GROUP BY doc_id, key, first)"""


def merged() -> str:
    """merged (doc_id, grp, idx, e): folded, with fragments of names and addresses joined."""
    parts = ["m0 AS (SELECT doc_id, 0 AS grp, first AS idx, e FROM folded)"]
    for i, (kind, gap) in enumerate((("NAME", 1), ("ADDRESS", 2)), 1):
        one = _struct("x", value="v", end='z."end"', confidence="CASE WHEN n > 1 THEN c ELSE x.confidence END", score="CASE WHEN n > 1 THEN s ELSE x.score END")
        parts.append(f"""b{i} AS (SELECT *, CASE WHEN e.start - lag(e."end") OVER w <= {gap} THEN 0 ELSE 1 END AS begins FROM m{i - 1} WHERE e.type = '{kind}' AND e.start IS NOT NULL AND e."end" IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY e.start, grp, idx)),
    i{i} AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY e.start, grp, idx) AS island, row_number() OVER (PARTITION BY doc_id ORDER BY e.start, grp, idx) AS r FROM b{i}),
    j{i} AS (SELECT doc_id, island, arg_min(e, r) AS x, arg_max(e, r) AS z, string_agg(e.value, ' ' ORDER BY r) AS v, min(e.confidence) AS c, max(e.score) AS s, count(*) AS n FROM i{i} GROUP BY doc_id, island),
    m{i} AS (SELECT * FROM m{i - 1} WHERE e.type <> '{kind}' UNION ALL SELECT doc_id, {i}, island, {one} FROM j{i})""")
    parts.append("merged AS (SELECT * FROM m2)")
    return ", ".join(parts)


def resolved() -> str:
    """final (doc_id, ord, e): merged, without what a kept and better one overlaps, in order."""
    key = KEY.replace("value", "e.value").replace("type", "e.type")
    return f"""ranked AS (SELECT doc_id, e, {key} AS key, {quality("e")} AS q, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(e.start, 1000000000), {quality("e")} DESC, grp, idx) AS k FROM merged),
    keep AS (SELECT doc_id, k, [{{'e': e, 'key': key, 'q': q}}] AS kept FROM ranked WHERE k = 1
      UNION ALL SELECT r.doc_id, r.k, CASE WHEN len(list_filter(p.kept, lambda y: coalesce(y.e.start < r.e."end" AND r.e.start < y.e."end", false) AND (y.key = r.key OR (y.e.type = r.e.type AND y.q >= r.q)))) > 0 THEN p.kept
        ELSE list_append(p.kept, {{'e': r.e, 'key': r.key, 'q': r.q}}) END FROM keep AS p JOIN ranked AS r ON p.doc_id = r.doc_id AND r.k = p.k + 1),
    last AS (SELECT doc_id, arg_max(kept, k) AS kept FROM keep GROUP BY doc_id),
    final AS (SELECT doc_id, (i - 1)::INT AS ord, kept[i].e AS e FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM last))"""


def add(value: str, agree: str) -> str:
    return f"CASE WHEN e.valid THEN {value} ELSE 0 END + CASE WHEN e.agree THEN {agree} ELSE 0 END"


SCORE = f"round(least(1, CASE e.source WHEN 'regex' THEN 0.90 + {add('0.05', '0.05')} WHEN 'deberta' THEN e.confidence + {add('0.05', '0.10')} ELSE CASE WHEN e.confidence = 0 THEN 0.70 ELSE e.confidence END + {add('0.05', '0.10')} END), 2)"


def enriched() -> str:
    """entities (doc_id, ord, type, ...): final with its confidence and level."""
    return f"""entities AS (SELECT doc_id, ord, e.type AS type, e.value AS value, {SCORE}::DOUBLE AS confidence, e.source AS source, e.start AS start, e."end" AS "end", e.valid AS validated, e.role AS context_role, e.label AS context_label,
      e.score AS context_score, e.model AS context_model, e.valid AS format_valid, e.agree AS methods_agree, CASE WHEN {SCORE} >= 0.9 THEN 'high' WHEN {SCORE} >= 0.7 THEN 'medium' ELSE 'low' END AS confidence_level FROM final)"""


def extracted() -> str:
    """entities of the texts in src."""
    placed = "at_text AS (SELECT found.*, text FROM found JOIN src USING (doc_id))"
    with_role = f"cand AS (SELECT * FROM found JOIN role_of USING (doc_id, ord) WHERE {KEPT_ROLE})"
    return ", ".join([found(), placed, roles("at_text"), with_role, canonical("cand"), folded(), merged(), resolved(), enriched()])


def synthetic(n: str, seed: int = synth.SEED) -> str:
    """forms (document_id, document_type, text, entities type, value, start, end) of n clean forms."""
    draw = lambda name, k: f"(('0x' || substr(md5('{seed}/{name}/' || id), 1, 15))::BIGINT % {k})"
    pick = lambda name, words: f"[{', '.join(map(_text, words))}][1 + {draw(name, len(words))}]"
    digits = lambda name, k: f"lpad({draw(name, 10**k)}::VARCHAR, {k}, '0')"
    letters = lambda name, k: " || ".join(f"chr((65 + {draw(f'{name}{i}', 26)})::INT)" for i in range(k))
    two = lambda x: f"lpad(({x})::VARCHAR, 2, '0')"
    date = lambda name, mark: f"{two('1 + ' + draw(name + 'd', 28))} || '{mark}' || {two('1 + ' + draw(name + 'm', 12))} || '{mark}' || (1970 + {draw(name + 'y', 35)})"
    first, last = pick("first", vocab.FIRST_NAMES), pick("last", vocab.LAST_NAMES)
    fields = {
        "name": f"{first} || ' ' || {last}",
        "other": f"{pick('first2', vocab.FIRST_NAMES)} || ' ' || {pick('last2', vocab.LAST_NAMES)}",
        "dob": date("dob", "/"),
        "issued": date("issued", "-"),
        "validity": date("validity", "-"),
        "phone": f"(6 + {draw('phone0', 4)})::VARCHAR || {digits('phone', 9)}",
        "pan": f"{letters('pan', 5)} || {digits('pan', 4)} || {letters('panz', 1)}",
        "aadhaar": f"(2 + {draw('aadhaar0', 8)})::VARCHAR || {digits('aadhaar', 11)}",
        "voter": f"{letters('voter', 3)} || {digits('voter', 7)}",
        "dl": f"{pick('state', vocab.STATE_CODES)} || {two('1 + ' + draw('rto', 99))} || (2014 + {draw('year', 11)})::VARCHAR || {digits('serial', 8)}",
        "address": f"(1 + {draw('house', 9999)})::VARCHAR || ' ' || {pick('street', vocab.STREETS)} || ', ' || {pick('city', vocab.CITIES)}",
        "email": f"lower({first}) || '.' || lower({last}) || '@' || {pick('domain', vocab.EMAIL_DOMAINS)}",
        "org": pick("org", vocab.ORGANIZATIONS),
    }
    texts, golds, kinds = [], [], []
    for i, (kind, heading, between, lines) in enumerate(vocab.LAYOUTS):
        said = [f"{_text(heading)} || chr(10)"]
        gold = []
        for line in lines.split("|"):
            label, _, field = line.partition("=")
            said.append(f"{_text(label)} || chr(10)" if not field else f"{_text(label)} || {'chr(10)' if between.isspace() else _text(between)} || f_{field} || chr(10)")
            gold += [f"{{'type': '{t}', 'value': f_{field}}}" for t, f in synth.GOLD.items() if f == field]
        texts.append(f"WHEN {i} THEN {' || '.join(said)}")
        golds.append(f"WHEN {i} THEN [{', '.join(gold)}]")
        kinds.append(f"WHEN {i} THEN '{kind}'")
    return f"""WITH v AS (SELECT id, {draw("type", len(vocab.LAYOUTS))} AS which, {", ".join(f"{sql} AS f_{k}" for k, sql in fields.items())} FROM (SELECT unnest(range({n})) AS id)),
    t AS (SELECT id, CASE which {" ".join(kinds)} END AS document_type, CASE which {" ".join(texts)} END AS text, CASE which {" ".join(golds)} END AS gold FROM v),
    forms AS (SELECT printf('train_%06d', id + 1) AS document_id, document_type, text, unnest(gold) AS g FROM t)
    SELECT document_id, document_type, text, g.type AS type, g.value AS value, (instr(text, g.value) - 1)::INT AS start, (instr(text, g.value) - 1 + length(g.value))::INT AS "end" FROM forms"""


def matched_gold() -> str:
    """Whether a labelled value (type, value, text) has its type's form and its label before it;
    names and addresses are left to models."""
    birth = "regexp_matches(left(text, start), '(?i)(?:\\bdate of birth|\\bdob|\\bbirth date)(?:: |\n)$')"
    known = "CASE type WHEN 'DOB' THEN " + birth + " ELSE type NOT IN ('NAME', 'ADDRESS') END"
    return known
