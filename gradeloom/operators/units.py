"""Quantities stated in text, converted to one common unit per quantity kind.

Everything is one SQL statement: the amount and its unit are taken from the text with
regular expressions, unit spellings are resolved by a join with the alias table, a missing
unit is taken from the unit the record asks for, then from the sheet unit it declares, and
the factor and offset of the unit give the amount in the common unit.

Defined results: null, empty and unit-free texts give no row; every quantity of a text counts, or
the first only where a value is known to state one; parts joined as in "1 kg 701 g" add up; a figure
whose unit stands elsewhere is taken where the text has no unit itself; repeated input rows give one
output row each and place; unknown spellings and quantity kinds missing from the targets give no row.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame

#: Fixed values. unit: (quantity, factor, offset to base, spellings); base units are gram,
#: millimetre, second, degree celsius, millilitre and kilobyte.
UNITS: dict[str, tuple[str, str, str, str]] = {
    "milligram": ("mass", "0.001", "0", "mg milligram milligrams milligramm milligramme milligrammes miligramo miligramos миллиграмм мг"),
    "gram": ("mass", "1", "0", "g gram grams gramme grammes gramm gramo gramos gr г грамм граммов грамма"),
    "kilogram": ("mass", "1000", "0", "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes kilogramm kilogramo kilogramos кг килограмм килограммов килограмма"),
    "tonne": ("mass", "1000000", "0", "t tonne tonnes metric_ton metric_tons tonnen tonelada toneladas тонн тонна тонны"),
    "pound": ("mass", "453.59237", "0", "lb lbs pound pounds pfund livre livres libra libras фунт фунтов"),
    "ounce": ("mass", "28.349523125", "0", "oz ounce ounces unze unzen once onces onza onzas"),
    "stone": ("mass", "6350.29318", "0", "st stone stones"),
    "micrometre": ("length", "0.001", "0", "µm micrometre micrometres micrometer micrometers"),
    "millimetre": ("length", "1", "0", "mm millimetre millimetres millimeter millimeters millimètre millimètres milímetro milímetros мм миллиметров"),
    "centimetre": ("length", "10", "0", "cm centimetre centimetres centimeter centimeters zentimeter centimètre centimètres centímetro centímetros см сантиметров"),
    "decimetre": ("length", "100", "0", "dm decimetre decimetres decimeter decimeters dezimeter décimètre décimètres decímetro decímetros"),
    "metre": ("length", "1000", "0", "m metre metres meter meters mètre mètres metro metros м метр метров метра"),
    "kilometre": ("length", "1000000", "0", "km kilometre kilometres kilometer kilometers kilomètre kilomètres kilómetro kilómetros км километров километра"),
    "inch": ("length", "25.4", "0", "in inch inches zoll pouce pouces pulgada pulgadas"),
    "foot": ("length", "304.8", "0", "ft foot feet fuß pied pieds pie pies"),
    "yard": ("length", "914.4", "0", "yd yds yard yards yarda yardas"),
    "mile": ("length", "1609344", "0", "mi mile miles meile meilen mille milles milla millas"),
    "nautical mile": ("length", "1852000", "0", "nmi nautical_mile nautical_miles"),
    "millisecond": ("duration", "0.001", "0", "ms msec millisecond milliseconds millisekunde millisekunden milliseconde millisecondes milisegundo milisegundos"),
    "second": ("duration", "1", "0", "s sec secs second seconds sekunde sekunden seconde secondes segundo segundos с сек секунд секунды"),
    "minute": ("duration", "60", "0", "min mins minute minutes minuten minuto minutos мин минут минуты"),
    "hour": ("duration", "3600", "0", "h hr hrs hour hours stunde stunden std heure heures hora horas ч час часов часа"),
    "day": ("duration", "86400", "0", "d day days tag tage tagen jour jours día días сут день дней дня"),
    "week": ("duration", "604800", "0", "wk wks week weeks woche wochen semaine semaines semana semanas неделя недель недели"),
    "degree celsius": ("temperature", "1", "0", "c °c degree_celsius degrees_celsius degree_c degrees_c deg_c celsius grad_celsius degrés_celsius degré_celsius grados_celsius"),
    "degree fahrenheit": ("temperature", "0.55555555555555555556", "-17.77777777777777777778", "f °f degree_fahrenheit degrees_fahrenheit degree_f degrees_f deg_f fahrenheit grad_fahrenheit degrés_fahrenheit grados_fahrenheit"),
    "kelvin": ("temperature", "1", "-273.15", "k °k kelvin kelvins degrees_kelvin"),
    "millilitre": ("volume", "1", "0", "ml cc millilitre millilitres milliliter milliliters mililitro mililitros мл"),
    "centilitre": ("volume", "10", "0", "cl centilitre centilitres centiliter centiliters zentiliter centilitro centilitros"),
    "decilitre": ("volume", "100", "0", "dl decilitre decilitres deciliter deciliters deziliter decilitro decilitros"),
    "litre": ("volume", "1000", "0", "l litre litres liter liters litern litro litros л литр литров литра"),
    "hectolitre": ("volume", "100000", "0", "hl hectolitre hectolitres hectoliter hectoliters hektoliter"),
    "gallon": ("volume", "3785.411784", "0", "gal gals gallon gallons gallone gallonen galón galones"),
    "quart": ("volume", "946.352946", "0", "qt quart quarts"),
    "pint": ("volume", "473.176473", "0", "pt pint pints"),
    "cup": ("volume", "236.5882365", "0", "cup cups"),
    "fluid ounce": ("volume", "29.5735295625", "0", "fl_oz fl._oz fl_ozs floz fluid_ounce fluid_ounces"),
    "byte": ("storage", "0.0009765625", "0", "b byte bytes octet octets байт"),
    "kilobyte": ("storage", "1", "0", "kb kib kilobyte kilobytes kibibyte kibibytes kilooctet kilooctets ko кб"),
    "megabyte": ("storage", "1024", "0", "mb mib megabyte megabytes mebibyte mebibytes mo мб"),
    "gigabyte": ("storage", "1048576", "0", "gb gib gigabyte gigabytes gibibyte gibibytes go гб"),
    "terabyte": ("storage", "1073741824", "0", "tb tib terabyte terabytes tebibyte tebibytes to тб"),
}
#: Number words.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
    "null": 0, "ein": 1, "eine": 1, "einen": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8,
    "neun": 9, "zehn": 10, "elf": 11, "zwölf": 12, "zwanzig": 20,
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9, "dix": 10,
    "onze": 11, "douze": 12, "vingt": 20,
    "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10,
    "once": 11, "doce": 12, "veinte": 20,
}
#: Words that multiply the figure before them.
MULTIPLIERS = {"thousand": 1000, "million": 1000000, "tausend": 1000, "mille": 1000, "mil": 1000, "hundred": 100, "dozen": 12}
FIELDS = ("answer", "expected_answer", "context")

#: Letters of other alphabets and widths, and the plain letters they look like.
LOOK_ALIKE = ("аеорсухіјѕкмтнвАЕОРСУХІЈЅКМТНВΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρ", "aeopcyxijskmthbAEOPCYXIJSKMTHBABEZHIKMNOPTYXovap")
WIDE = ("".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))


def _alternatives(words) -> str:
    """A pattern of any of words, the longest first, branched by their first letters so that most places fail at once."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        by_first.setdefault(w[0], []).append(re.escape(w[1:]).replace("_", r"\s?"))
    return "|".join(re.escape(c) + (rest[0] if len(rest) == 1 else f"(?:{'|'.join(rest)})") for c, rest in sorted(by_first.items()))


def _bare(word: str) -> str:
    """word without its accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _spellings() -> dict[str, str]:
    seen: dict[str, str] = {}
    for unit, (*_, words) in UNITS.items():
        for w in words.split():
            for form in (w, _bare(w)):
                seen.setdefault(form.replace("_", "").replace(".", ""), unit)
    return seen


def _patterns() -> dict[str, str]:
    words = {w for *_, ws in UNITS.values() for w in ws.split()}
    words |= {_bare(w) for w in words}
    # these are also everyday words: they are units only where nothing, a mark or a word of extent follows
    guarded = {"in", "to", "go", "mo", "ko", "once", "mil", "st"} & words
    unit = rf"(?:{_alternatives(words - guarded)}|(?:{_alternatives(guarded)})(?=\s*$|[^\p{{L}}\s]|\s+(?:long|wide|high|tall|deep|is)\b))(?![\p{{L}}\p{{N}}_])"
    digits = r"\d{1,3}(?:[.,' ]\d{3})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
    spoken = f"(?:half(?: an?)?|(?:{_alternatives(NUMBER_WORDS)})(?:[- ](?:{_alternatives(NUMBER_WORDS)}))?(?: and a half)?)(?=\\s)"
    times = f"(?:{_alternatives(MULTIPLIERS)})"
    number = rf"(?:(?<![\p{{L}}\p{{N}}_.,])(?:[-−]|minus )?(?:{digits}|{spoken}))"
    also = rf"(?:(?:,? ?(?:and|und|et|y|и)? ?)({digits})\s?({unit}))?"
    return {
        "whole": rf"({number})(?:\s?({times}))?\s?-?({unit}){also}{also}",
        "bare": rf"({number})(?:\s?({times}))?(?![\p{{L}}\p{{N}}])",
        "asked": rf"(?:(?:answer|measured|expressed|[,;:])[^\p{{L}}\p{{N}}]*in(?: units of)?|, en|\()[^\p{{L}}\p{{N}}]*({unit})[^\p{{L}}\p{{N}}]*$",
        "sheet": rf"(?:unit[^:.]*: ?|figures[^.]* (?:are|is) in |values[^.]* in |inventory \(|einheit[^:.]*: ?|unité[^:.]*: ?|unidad[^:.]*: ?)({unit})",
        "entry": r"(?:value|reads|wert|valeur|valor|=|lautet|indique)\s*:?\s*",
        "english": r"\b(?:the|is|it|what|how|which|of|does|at|to|takes|holds|weighs|needs|hours?|weeks?|days?|grams?|ounces?|feet|yards?|inch(?:es)?|pounds?|gallons?)\b",
        "comma": r"\b(?:der|die|das|wie|von|ist|wiegt|dauert|nennt|zeigt|tage|stunden|sekunden|wochen|gramm|le|la|les|du|de|pèse|mesure|dure|quelle|combien|jours|heures|secondes|semaines|el|los|cuánto|pesa|mide|dura|días|horas|segundos|semanas)\b",
        "spoken": rf"\b(?:half|{_alternatives(NUMBER_WORDS)})\b",
    }


def _sql(fields, every: bool) -> str:
    p = {k: f'r"{v}"' for k, v in _patterns().items()}
    entry_bare = f'r"{_patterns()["entry"]}{_patterns()["bare"]}"'
    table = ", ".join(f"('{s}', '{q}', {f}D, {o}D)" for s, u in _spellings().items() for q, f, o, _ in [UNITS[u]])
    spoken_map = "map(" + ", ".join(f"'{w}', {v}D" for w, v in NUMBER_WORDS.items()) + ")"
    times_map = "map(" + ", ".join(f"'{w}', {v}D" for w, v in MULTIPLIERS.items()) + ")"
    wide = [x.replace("\\", "\\\\").replace("'", "\\'") for x in WIDE]

    def clean(c):
        return rf"""CASE WHEN {c} RLIKE '[^\\x01-\\x7f]' THEN regexp_replace(translate({c}, '{wide[0]}', '{wide[1]}'), r"[\u0300-\u036f\u200b-\u200f\u2060\ufeff\u00ad]", '') ELSE {c} END"""

    def fold(c):
        latin = f"CASE WHEN NOT {c} RLIKE '[Α-ωЀ-ӿ]' OR {c} RLIKE '[бгджзилпфцчшщъыьэюяБГДЖЗИЛПФЦЧШЩЪЫЬЭЮЯ]' THEN {c} ELSE translate({c}, '{LOOK_ALIKE[0]}', '{LOOK_ALIKE[1]}') END"
        return rf"""trim(lower(regexp_replace({latin}, r"[\s\u00a0\u2000-\u200a\u202f\u3000]+", ' ')))"""

    def amount(n, comma):
        """The figure n as a double; comma tells whether a comma, not a point, is the decimal sign where both readings fit."""
        figure = f"regexp_replace({n}, '^(?:minus |[-−])', '')"
        point = f"""replace(regexp_replace({figure}, "[. ']", ''), ',', '.')"""
        english = f"""regexp_replace({figure}, "[, ']", '')"""
        return f"""(CASE WHEN {n} RLIKE '^(?:minus |[-−])' THEN -1D ELSE 1D END) * coalesce(
            try_cast(CASE WHEN {figure} RLIKE "^[0-9]+,([0-9]{{1,2}}|[0-9]{{4,}})$|^0,|[. '][0-9]{{3}},[0-9]+$" THEN {point}
                          WHEN {figure} RLIKE "^[0-9]+[.]([0-9]{{1,2}}|[0-9]{{4,}})$|^0[.]|,[0-9]{{3}}[.][0-9]+$" THEN {english}
                          WHEN {comma} THEN {point} ELSE {english} END AS DOUBLE),
            aggregate(split({figure}, '[- ]'), 0D, (a, w) -> CASE WHEN w = 'hundred' THEN greatest(a, 1D) * 100D WHEN w IN ('and', 'a', 'an') THEN a WHEN w = 'half' THEN a + 0.5D ELSE a + {spoken_map}[w] END))"""

    def alias(c):
        return rf"""regexp_replace({c}, r"[\s._-]", '')"""

    cleaned, folded = (", ".join(f"{g(f)} AS {f}" for f in ("question", *FIELDS)) for g in (clean, fold))
    stacked = ", ".join(f"'{f}', {f}" for f in fields)
    # a text without a unit of its own stays, with nothing stated
    stated = f"posexplode(coalesce(nullif(regexp_extract_all(text, {p['whole']}, 0), array()), array(''))) AS (place, stated)" if every else f"0 AS place, regexp_extract(text, {p['whole']}, 0) AS stated"
    body = f"""
    WITH unit_alias(spelling, quantity, factor, offset) AS (VALUES {table}),
    visible AS (SELECT row_id, {cleaned} FROM RECORDS),
    plain AS (SELECT row_id, {folded} FROM visible),
    long AS (
        SELECT row_id, question, context AS sheet_text, stack({len(fields)}, {stacked}) AS (field_name, text) FROM plain),
    met AS (
        SELECT row_id, field_name, text, question, sheet_text, {stated}
        FROM long WHERE text RLIKE '[0-9]' OR text RLIKE {p['spoken']}),
    units_elsewhere AS (
        SELECT row_id, field_name, place, text, question, stated,
               CASE WHEN stated = '' THEN nullif(regexp_extract(question, {p['asked']}, 1), '') END AS asked,
               CASE WHEN stated = '' THEN nullif(regexp_extract(text, {p['sheet']}, 1), '') END AS own_sheet,
               CASE WHEN stated = '' AND field_name <> 'context' THEN nullif(regexp_extract(sheet_text, {p['sheet']}, 1), '') END AS other_sheet
        FROM met),
    taken AS (
        SELECT row_id, field_name, place, text, question,
               CASE WHEN stated <> '' THEN regexp_extract(stated, {p['whole']}, 1)
                    ELSE coalesce(nullif(regexp_extract(text, {entry_bare}, 1), ''), regexp_extract(text, {p['bare']}, 1)) END AS n1,
               CASE WHEN stated <> '' THEN regexp_extract(stated, {p['whole']}, 2)
                    ELSE coalesce(nullif(regexp_extract(text, {entry_bare}, 2), ''), regexp_extract(text, {p['bare']}, 2)) END AS m1,
               coalesce(nullif(regexp_extract(stated, {p['whole']}, 3), ''), own_sheet, asked, other_sheet) AS u1,
               nullif(regexp_extract(stated, {p['whole']}, 4), '') AS n2, regexp_extract(stated, {p['whole']}, 5) AS u2,
               nullif(regexp_extract(stated, {p['whole']}, 6), '') AS n3, regexp_extract(stated, {p['whole']}, 7) AS u3
        FROM units_elsewhere
        WHERE stated <> '' OR own_sheet IS NOT NULL OR asked IS NOT NULL OR other_sheet IS NOT NULL),
    written AS (
        SELECT *, CASE WHEN text RLIKE {p['comma']} THEN NOT text RLIKE {p['english']}
                       WHEN text RLIKE {p['english']} THEN false
                       ELSE question RLIKE {p['comma']} AND NOT question RLIKE {p['english']} END AS decimal_comma
        FROM taken WHERE n1 <> ''),
    figures AS (
        SELECT row_id, field_name, place, {alias('u1')} AS u1, {alias('u2')} AS u2, {alias('u3')} AS u3,
               ({amount('n1', 'decimal_comma')}) * coalesce({times_map}[m1], 1D) AS v1,
               CASE WHEN n2 IS NOT NULL THEN {amount('n2', 'decimal_comma')} END AS v2,
               CASE WHEN n3 IS NOT NULL THEN {amount('n3', 'decimal_comma')} END AS v3
        FROM written)
    SELECT f.row_id, f.field_name, f.place, t.quantity, t.common_unit,
           f.v1 * a.factor + a.offset
             + coalesce(CASE WHEN b.quantity = a.quantity THEN f.v2 * b.factor END, 0D)
             + coalesce(CASE WHEN c.quantity = a.quantity THEN f.v3 * c.factor END, 0D) AS amount
    FROM figures f
    JOIN unit_alias a ON a.spelling = f.u1
    LEFT JOIN unit_alias b ON b.spelling = f.u2 AND f.v2 IS NOT NULL
    LEFT JOIN unit_alias c ON c.spelling = f.u3 AND f.v3 IS NOT NULL
    JOIN TARGETS t ON t.quantity = a.quantity
    WHERE f.v1 IS NOT NULL
    """
    return body.replace("{", "{{").replace("}", "}}").replace("RECORDS", "{records}").replace("TARGETS", "{targets}")


def to_common_units(records: DataFrame, targets: DataFrame, fields=FIELDS, every: bool = True) -> DataFrame:
    """(row_id, field_name, place, quantity, common_unit, amount DOUBLE) of each quantity that a text states.

    place counts a text's quantities from 0; every=False takes the first of each text.
    """
    records = records.select("row_id", "question", *FIELDS)
    return records.sparkSession.sql(_sql(fields, every), records=records, targets=targets.select("quantity", "common_unit").distinct())
