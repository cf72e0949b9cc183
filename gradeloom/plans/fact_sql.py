"""The SQL beside which the fact, comparison and evaluation queries are run.

It is written for itself: patterns, units and turns are spelled out here and nothing is taken from
the operators but word lists and weights. The word boundary of this dialect knows ASCII only, so
facts are found in a text of the same length in which letters of other scripts are an underscore
and other signs a tilde; what is shown is cut from the text itself.
"""

from __future__ import annotations

from gradeloom import config
from gradeloom.functions.text import in_list

_TENS = "ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred"
_ONES = "one|two|three|four|five|six|seven|eight|nine"
_N = rf"([0-9]+(?:[.][0-9]+)?|(?:zero|{_ONES}|{_TENS})(?:[- \t\n\f\r](?:{_ONES}))?)"
_M = "(january|february|march|april|may|june|july|august|september|october|november|december)"
_Y, _D, _TH = "((?:19|20)[0-9]{2})", "([0-3]?[0-9])", "(?:st|nd|rd|th)?"
_BETWEEN = r"(?:,\s*|\s+)"
#: The forms of facts by turn.
_FORMS = {
    "iso": rf"\b{_Y}[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12][0-9]|3[01])\b",
    "named": rf"(?i)\b{_M}\s+{_D}{_TH}{_BETWEEN}{_Y}\b",
    "dayed": rf"(?i)\b{_D}{_TH}\s+{_M}{_BETWEEN}{_Y}\b",
    "lasting": rf"(?i)\b{_N}\s*(second|minute|hour|day|week|month|year)s?\b",
    "percent": rf"(?i)\b{_N}\s*(?:%|percent(?:age points?)?\b)",
    "degrees": rf"(?i)\b{_N}\s*(?:(?:degrees?\s*)?(celsius|fahrenheit)|°\s*([cf]))\b",
    "part": r"(?i)\b(?:three[-\s]+quarters?|one[-\s]+(?:quarters?|halves?|half|fifths?)|halfway|half)\b",
    "bytes": rf"(?i)\b{_N}\s*(kilobyte|kb|megabyte|mb|gigabyte|gb)s?\b",
    "year": rf"\b{_Y}\b",
    "number": rf"(?i)\b{_N}\b",
    "entity": r"\b[A-Z][A-Za-z'-]*(?:\s+(?:(?:of|the|and|bin|al)\s+)?[A-Z][A-Za-z'-]*)*\b",
}
#: What the full-width digits are in these forms: no digits where a form names the first figures.
_LITERAL = ("iso", "named", "dayed", "year", "entity")
_WIDE = "".join(chr(0xFF10 + d) for d in range(10))
_GAP = r"[\p{Z}\x0b\x1c-\x1f\x{85}]"
_WORD = r"[\p{L}\p{N}_]"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ascii(c: str, signs: str = "°") -> str:
    """c with other letters as underscores and other signs, but for some, as tildes."""
    return rf"regexp_replace(regexp_replace({c}, '[^\x00-\x7F\p{{L}}\p{{N}}{signs}]', '~', 'g'), '[^\x00-\x7F{signs}]', '_', 'g')"


def _case(x: str, values: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v) if isinstance(v, str) else f'{v}::DOUBLE'}" for k, v in values.items()) + " END"


def _amount(x: str) -> str:
    word = _case("w", {k: v for k, v in config.NUMBER_WORDS.items() if k != "hundred"})
    said = rf"regexp_split_to_array(replace(lower({x}), '-', ' '), '\s+')"
    total = f"list_sum(list_transform({said}, lambda w: coalesce({word}, 0)))"
    return f"coalesce(TRY_CAST({x} AS DOUBLE), CASE WHEN contains(lower({x}), 'hundred') THEN greatest(1, {total}) * 100 ELSE {total} END)"


def _g(form: str, n: int) -> str:
    return f"regexp_extract(q.t, {_lit(_FORMS[form])}, {n})"


def _date(form: str, y: int, m: int, d: int) -> str:
    month = f"CAST({_g(form, m)} AS INT)" if form == "iso" else f"list_position(string_split({_lit(_M.strip('()'))}, '|'), lower({_g(form, m)}))"
    return f"{_g(form, y)} || '-' || {month} || '-' || CAST({_g(form, d)} AS INT)"


_LASTS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 1, "year": 12}
_SIZES = {"k": 1, "m": 1024, "g": 1048576}
_PARTS = {"half": 0.5, "halfway": 0.5, "one half": 0.5, "one halve": 0.5, "one quarter": 0.25, "three quarter": 0.75, "one fifth": 0.2}
_PART = r"regexp_replace(regexp_replace(lower(q.t), '[-\s]+', ' ', 'g'), 's$', '')"
#: Kind, name in the key and amount in it.
_KEYED = {
    "iso": ("dates", _date("iso", 1, 2, 3), "0"), "named": ("dates", _date("named", 3, 1, 2), "0"), "dayed": ("dates", _date("dayed", 3, 2, 1), "0"),
    "lasting": ("durations", f"CASE WHEN lower({_g('lasting', 2)}) IN ('month', 'year') THEN 'calendar' ELSE 'fixed' END", f"{_amount(_g('lasting', 1))} * {_case(f'lower({_g('lasting', 2)})', _LASTS)}"),
    "percent": ("percentages", "''", f"{_amount(_g('percent', 1))} / 100"),
    "degrees": ("temperatures", f"CASE WHEN lower({_g('degrees', 2)} || {_g('degrees', 3)})[1] = 'c' THEN 'celsius' ELSE 'fahrenheit' END", _amount(_g("degrees", 1))),
    "part": ("percentages", "''", _case(_PART, _PARTS)),
    "bytes": ("storage", "''", f"{_amount(_g('bytes', 1))} * {_case(f'lower({_g('bytes', 2)})[1]', _SIZES)}"),
    "year": ("dates", "'year ' || q.t", "0"),
    "number": ("numbers", "''", _amount("q.t")),
}
KINDS = ("durations", "percentages", "temperatures", "storage", "dates", "numbers")
_NOT_GAP = r"[\s\p{Z}\x1c-\x1f\x{85}]"
_NAME = rf"regexp_replace(regexp_replace(lower(e.s), '''s$', ''), '^(?:the|a|an){_NOT_GAP}+', '')"

def facts(texts: str) -> list[str]:
    """Steps from the rows (row_id, field_name, x) of texts to facts: for each kind a list of {f, v, s}, its name, amount and words, in order."""
    steps = [
        f"spaced AS (SELECT row_id, field_name, x, regexp_replace(coalesce(x, ''), '{_GAP}', ' ', 'g') AS y FROM {texts})",
        f"marked AS (SELECT *, {_ascii('y')} AS literal, {_ascii(f'translate(y, {_lit(_WIDE)}, {_lit('0123456789')})')} AS figures FROM spaced)",
        "matched AS (SELECT *, " + ", ".join(f"regexp_extract_all({t}, {_lit(p)}) AS m_{form}, string_split_regex({t}, {_lit(p)}) AS g_{form}" for form, p in _FORMS.items() for t in ["literal" if form in _LITERAL else "figures"]) + " FROM marked)",
        "placed AS (SELECT row_id, field_name, x, figures, literal, " + ", ".join(
            f"list_transform(range(1, len(m_{c}) + 1), lambda i: {{'b': list_sum(list_transform(g_{c}[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m_{c}[1:i - 1], lambda z: length(z))), 0), 'n': length(m_{c}[i]), 't': m_{c}[i]}}) AS p_{c}" for c in _FORMS) + " FROM matched)",
        # a percent sign within a word is none
        r"t0 AS (SELECT * REPLACE (list_filter(p_percent, lambda q: NOT (ends_with(q.t, '%') AND regexp_matches(figures[CAST(q.b + q.n + 1 AS BIGINT)], '\w'))) AS p_percent), [] :: STRUCT(b HUGEINT, n BIGINT, t VARCHAR)[] AS taken FROM placed)",
    ]
    turns = [c for c in _FORMS if c != "entity"]
    for i, c in enumerate(turns):
        own = f"p_{c}" if c == "lasting" else f"list_filter(p_{c}, lambda q: len(list_filter(taken, lambda o: q.b < o.b + o.n AND o.b < q.b + q.n)) = 0)"
        steps.append(f"f{i} AS (SELECT *, {own} AS o_{c} FROM t{i})")
        steps.append(f"t{i + 1} AS (SELECT * REPLACE (list_concat(taken, o_{c}) AS taken) FROM f{i})")
    lists = {k: " || ".join(f"list_transform(o_{c}, lambda q: {{'f': {name}, 'v': CAST({v} AS DOUBLE), 'b': q.b, 'n': q.n}})" for c, (kind, name, v) in _KEYED.items() if kind == k) for k in KINDS}
    shown = ", ".join(f"list_transform({lists[k]}, lambda q: {{'f': q.f, 'v': q.v, 's': x[CAST(q.b + 1 AS BIGINT):CAST(q.b + q.n AS BIGINT)]}}) AS {k}" for k in KINDS)
    entity = f"list_filter(list_transform(list_transform(p_entity, lambda q: {{'s': x[CAST(q.b + 1 AS BIGINT):CAST(q.b + q.n AS BIGINT)]}}), lambda e: {{'f': {_NAME}, 'v': 0::DOUBLE, 's': e.s}}), lambda e: length(e.f) <> 1)"
    renamed = f"list_transform({entity}, lambda e: {{'f': coalesce({_case('e.f', config.SAME_ENTITY)}, e.f), 'v': e.v, 's': e.s}})"
    named = f"list_filter({renamed}, lambda e: e.f NOT IN {in_list([*config.NO_ENTITIES, *config.NUMBER_WORDS])})"
    steps.append(f"facts AS (SELECT row_id, field_name, x, {shown}, {named} AS entities FROM t{len(turns)})")
    return steps


def _of(table: str, fields) -> str:
    return "(" + " UNION ALL ".join(f"SELECT row_id, '{f}' AS field_name, {f} AS x FROM {table}" for f in fields) + ")"


def listed(kind: str, texts: str) -> str:
    """The first statement of each fact of texts."""
    shown = {"dates": "f AS date_key", "entities": "f AS entity"}.get(kind, "f AS family, v AS amount" if kind in ("durations", "temperatures") else "v AS amount")
    return (
        f"WITH {', '.join(facts(texts))}, each AS (SELECT row_id, field_name, unnest(range(1, len({kind}) + 1)) AS i, unnest({kind}) AS q FROM facts), "
        f"first AS (SELECT row_id, field_name, q.f AS f, q.v AS v, q.s AS surface FROM each QUALIFY row_number() OVER (PARTITION BY row_id, field_name, q.f, q.v ORDER BY i) = 1) SELECT row_id, field_name, {shown}, surface FROM first"
    )


_STOP = in_list(config.STOPWORDS)


def folded(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def content(c: str) -> str:
    words = rf"list_filter(regexp_extract_all({_ascii(folded(c), '')}, '\b[a-z][a-z''-]*\b'), lambda w: w NOT IN {_STOP})"
    return f"list_distinct(list_transform({words}, lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, 's$', '') ELSE w END))"


def _initials(t: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({t}, '[A-Za-z]+'), lambda w: CASE WHEN lower(w) IN {_STOP} THEN '#' ELSE lower(w[1:1]) END), '')"


def acronym(a: str, b: str) -> str:
    def one(x: str, y: str) -> str:
        # the boundary knows ASCII letters only: whole words are looked at
        return rf"len(list_filter(list_filter(regexp_extract_all({x}, '{_WORD}+'), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9]{{1,5}}')), lambda w: contains({_initials(y)}, lower(w)))) > 0"

    return f"({one(a, b)} OR {one(b, a)})"


def alias(a: str, b: str) -> str:
    def said(c: str, word: str) -> str:
        return rf"regexp_matches({c}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{word})(?:$|[^\p{{L}}\p{{N}}_])')"

    pairs = ((r"h\s*2\s*o", "water"), (r"co\s*2", r"carbon\s+dioxide"))
    return "(" + " OR ".join(f"({said(a, x)} AND {said(b, y)}) OR ({said(a, y)} AND {said(b, x)})" for x, y in pairs) + ")"


# ---- comparison of an answer with its references ----

_CLEAN = r"regexp_replace(coalesce({c}, ''), '^[\s\p{{Z}}\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x1c-\x1f\x{{85}}]+$', '', 'g')"
_OPPOSED = (("yes", "no"), ("approved", "rejected"), ("approved", "denied"), ("accepted", "rejected"), ("accepted", "denied"), ("allowed", "prohibited"), ("enabled", "disabled"), ("true", "false"), ("successful", "failed"), ("increase", "decrease"), ("increased", "decreased"), ("before", "after"))
_NEGATION = rf"\b(?:not|never){_NOT_GAP}+[a-z]+\b"


def _told(kind: str, a: str, r: str) -> str:
    return f"{{'kind': '{kind}', 'answer_value': {a}, 'reference_value': {r}}}"


def _valued(kind: str, a: str, r: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({r}) > 0 AND NOT list_has_any(key_{a}, key_{r}) THEN {_told(kind, f'{a}[1].s', f'{r}[1].s')} END"


def _polarity() -> str:
    tries = []
    for pair in _OPPOSED:
        for x, y in (pair, pair[::-1]):
            tries.append(rf"CASE WHEN regexp_matches(a_not, '\b{x}\b') AND regexp_matches(r_not, '\b{y}\b') THEN {_told('polarity', _lit(x), _lit(y))} END")
    last = "regexp_extract({m}, '[a-z]+$')"
    for x, y in (("a_not", "r_not"), ("r_not", "a_not")):
        hit = rf"list_filter(regexp_extract_all({x}, '{_NEGATION}'), lambda m: {last.format(m='m')} <> 'only' AND regexp_matches({y}, '\b' || {last.format(m='m')} || '\b'))[1]"
        both = (hit, last.format(m=hit)) if x == "a_not" else (last.format(m=hit), hit)
        tries.append(f"CASE WHEN {hit} IS NOT NULL THEN {_told('polarity', *both)} END")
    return f"coalesce({', '.join(tries)})"


def _entity() -> str:
    def only(mine: str, others: str, text: str) -> str:
        return rf"list_filter({mine}, lambda e: NOT list_contains(list_transform({others}, lambda o: o.f), e.f) AND NOT regexp_matches({text}, '\b' || regexp_escape(e.f) || '\b'))[1].s"

    a, r = only("a_entities", "r_entities", "r_plain"), only("r_entities", "a_entities", "a_plain")
    near = "list_has_any(key_a_entities, key_r_entities) OR list_has_any(a_content, r_content) OR (len(a_content) <= 4 AND len(r_content) <= 4)"
    return f"CASE WHEN NOT acronym AND {a} IS NOT NULL AND {r} IS NOT NULL AND ({near}) THEN {_told('named entity', a, r)} END"


_SINGULAR = {"durations": "duration", "percentages": "percentage", "temperatures": "temperature", "storage": "storage", "dates": "date", "numbers": "number"}
_ALL = (*KINDS, "entities")


def compared(records: str = "sample_evaluations") -> list[str]:
    """Steps to compared: (row_id, source, conflicts, agrees, met) of each reference of the records that is there."""
    lists = [f"{s}_{k}" for s in "ar" for k in (*_ALL, "shares")]
    plain = rf"regexp_replace({folded('{c}')}, '(?:''s|’s)($|[^\p{{{{L}}}}\p{{{{N}}}}_])', '\1', 'g')"
    nots = rf"regexp_replace({folded('{c}')}, 'n[''’]t($|[^\p{{{{L}}}}\p{{{{N}}}}_])', ' not\1', 'g')"
    conflicts = [_valued(_SINGULAR[k], f"a_{k}", f"r_{k}") for k in KINDS] + [_valued("percentage", "a_percentages", "r_shares"), _valued("percentage", "a_shares", "r_percentages"), _polarity(), _entity()]
    same = [f"(len(a_{k}) > 0 AND len(r_{k}) > 0 AND list_has_all(key_a_{k}, key_r_{k}) AND list_has_all(key_r_{k}, key_a_{k}))" for k in KINDS]
    same += ["list_has_any(key_a_percentages, key_r_shares)", "list_has_any(key_a_shares, key_r_percentages)", "list_has_any(key_a_entities, key_r_entities)", "acronym", alias("a", "r")]
    stated = " OR ".join(f"len(r_{k}) > 0" for k in KINDS)
    held = " AND ".join(f"list_has_all(key_a_{k}, key_r_{k})" for k in KINDS)
    words = rf"len(regexp_extract_all({_ascii(folded('r'))}, '\b[\w%°''-]+\b'))"
    spaced = rf"[^\x00-\x7F\p{{L}}\p{{N}}\p{{Z}}]"
    return [
        "clean AS (SELECT row_id, " + ", ".join(f"{_CLEAN.format(c=c)} AS {c}" for c in ("question", "answer")) + ", " + ", ".join(f"nullif({_CLEAN.format(c=c)}, '') AS {c}" for c in ("expected_answer", "context")) + f" FROM {records})",
        *facts(_of("clean", ("answer", "expected_answer", "context"))),
        "paired AS (SELECT a.row_id, CASE r.field_name WHEN 'context' THEN 'context' ELSE 'expected answer' END AS source, a.x AS a, r.x AS r, " + ", ".join(f"{s}.{k} AS {s}_{k}" for s in "ar" for k in _ALL)
        + " FROM facts a JOIN facts r USING (row_id) WHERE a.field_name = 'answer' AND r.field_name <> 'answer' AND r.x IS NOT NULL)",
        "shared AS (SELECT *, " + ", ".join(f"list_filter({s}_numbers, lambda q: q.v BETWEEN 0 AND 1) AS {s}_shares" for s in "ar") + " FROM paired)",
        "keyed AS (SELECT *, " + ", ".join(f"list_transform({c}, lambda q: q.f || ' ' || q.v) AS key_{c}" for c in lists) + f", {content('a')} AS a_content, {content('r')} AS r_content, {acronym('a', 'r')} AS acronym, "
        + ", ".join(f"{_ascii(plain.format(c=c), '')} AS {c}_plain, regexp_replace(regexp_replace({nots.format(c=c)}, '{spaced}', '~', 'g'), '[^\\x00-\\x7F\\p{{Z}}~]', '_', 'g') AS {c}_not" for c in "ar") + " FROM shared)",
        f"judged AS (SELECT *, list_filter([{', '.join(conflicts)}], lambda c: c IS NOT NULL) AS conflicts, ({' OR '.join(same)}) AS agrees FROM keyed)",
        f"compared AS (SELECT row_id, source, conflicts, agrees, source = 'expected answer' AND {words} <= 8 AND len(r_content) <= 5 AND len(conflicts) = 0 AND ((({stated}) AND {held}) OR agrees OR (len(r_content) > 0 AND list_has_all(a_content, r_content))) AS met FROM judged)",
    ]


def both() -> str:
    steps = compared() + ["e AS (FROM compared WHERE source = 'expected answer')", "c AS (FROM compared WHERE source = 'context')"]
    return "WITH " + ", ".join(steps)


#: Statements put together from the parts table: what its own texts never say.
STATED = """(SELECT p_partkey AS row_id, q AS question, a AS answer, e AS expected_answer, CAST(NULL AS VARCHAR) AS context FROM (SELECT p_partkey, 'What does the label say?' AS q,
  CASE p_partkey % 8
    WHEN 0 THEN 'The discount is ' || p_size || '%.' WHEN 1 THEN 'About ' || p_size || ' percent, or one half.' WHEN 2 THEN 'It is three quarters of ' || p_size || ' GB.'
    WHEN 3 THEN 'It was approved on March ' || (p_size % 28 + 1) || ', 2024.' WHEN 4 THEN 'It is not sealed and holds ' || p_size || ' degrees Celsius.' WHEN 5 THEN 'It lasts ' || p_size || ' weeks from 2023-05-' || (p_size % 28 + 1) || '.'
    WHEN 6 THEN 'One fifth was allowed at ' || p_size || ' °F before noon.' ELSE 'Twenty-one of the ' || p_size || ' percentage points.' END AS a,
  CASE p_partkey % 8
    WHEN 0 THEN 'The discount is 0.' || p_size || '.' WHEN 1 THEN '50% or ' || (p_size + p_size % 2) || ' percent' WHEN 2 THEN '75 percent of ' || p_size * 1024 || ' MB'
    WHEN 3 THEN 'It was rejected on ' || (p_size % 28 + 1) || 'th March 2024.' WHEN 4 THEN 'It is sealed and holds ' || (p_size + p_size % 2) || ' °C.' WHEN 5 THEN p_size * 7 || ' days from May ' || (p_size % 28 + 1) || ', 2023'
    WHEN 6 THEN '20% was prohibited at ' || p_size || ' fahrenheit after noon.' ELSE 'The Label Office of Lisbon says twenty-one.' END AS e
  FROM part))"""
_SOURCE = _of("sample_evaluations", ("answer", "expected_answer", "context"))
_PARTS_TEXTS = _of(STATED, ("answer", "expected_answer"))
ORACLES = {f"facts_{k}": listed(k, _SOURCE) for k in (*KINDS, "entities")} | {f"stated_{k}": listed(k, _PARTS_TEXTS) for k in KINDS} | {
    "stated_conflicts": f"WITH {', '.join(compared(STATED))} SELECT row_id, c.kind, c.answer_value, c.reference_value, source FROM (SELECT row_id, source, unnest(conflicts) AS c FROM compared)",
    "stated_agreements": f"WITH {', '.join(compared(STATED))} SELECT row_id, agrees, met FROM compared",
    "content_words": f"SELECT row_id, field_name, coalesce(array_to_string(list_sort({content("coalesce(x, '')")}), ' '), '') AS words FROM {_of('sample_evaluations', ('answer', 'expected_answer', 'context'))}",
    "acronym_match": f"SELECT row_id, {acronym('answer', 'expected_answer')} AS matches FROM sample_evaluations WHERE answer IS NOT NULL AND expected_answer IS NOT NULL",
    "fact_alias": f"SELECT row_id, {alias('answer', 'context')} AS matches FROM sample_evaluations WHERE answer IS NOT NULL AND context IS NOT NULL",
    "conflicts": f"WITH {', '.join(compared())} SELECT row_id, c.kind, c.answer_value, c.reference_value, source FROM (SELECT row_id, source, unnest(conflicts) AS c FROM compared)",
    "equivalences": f"{both()} SELECT row_id, coalesce(e.agrees, false) AS agrees_with_expected, coalesce(c.agrees, false) AS agrees_with_context FROM clean LEFT JOIN e USING (row_id) LEFT JOIN c USING (row_id)",
    "short_value_match": f"{both()} SELECT row_id, coalesce(e.met, false) AS met FROM clean LEFT JOIN e USING (row_id)",
    "conflict_primary": f"{both()}, p AS (SELECT row_id, coalesce(e.conflicts[1], c.conflicts[1]) AS q, CASE WHEN len(e.conflicts) > 0 THEN 'expected answer' ELSE 'context' END AS source FROM clean LEFT JOIN e USING (row_id) LEFT JOIN c USING (row_id)) SELECT row_id, q.kind, q.answer_value, q.reference_value, source FROM p WHERE q IS NOT NULL",
}
