"""Visually identical text brought to one plain form.

Each Arrow batch is given to an embedded DuckDB, whose SQL maps compatibility forms and special
spaces with ``translate`` and a lookup, drops invisible characters with regular expressions,
composes accents with ``nfc_normalize`` and folds look-alike letters word by word. Rows without
a character outside printable ASCII, tab and line break are plain already and skip the SQL.

Compatibility forms are all that Unicode decomposes, whatever their script, but for KEPT, signs in
everyday use that are written as such, and for accents that stand alone. Look-alike letters are
folded in a word that mixes scripts, and in a word wholly of look-alikes where the text has no word
of that script itself: Cyrillic, Greek, Armenian, Cherokee, and the phonetic Latin letters. The
dotless i stays: it is a letter of Turkish words.

Defined results: null stays null, empty stays empty; text is processed whole whatever its length;
the plain form of a plain form is itself; repeated rows each give their own result; columns
other than the key and the named text columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Text that can only be plain.
NEEDS_SQL = "[^\\t\\n\\r\\x20-\\x7e]"

#: Letters of other alphabets and the Latin letters they look like. The strict
#: ones look the same in every upright type; the others only in some.
CYRILLIC_STRICT = ("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅԌ", "aeopcyxijshdqwABEKMHOPCTYXIJSG")
CYRILLIC_LOOSE = ("кмтнвгпиьЬЗбЪ", "kmthbrnubb36b")
GREEK_STRICT = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj")
GREEK_LOOSE = ("αικρτυχγεωηβ", "aikptuxyewnb")
ARMENIAN = ("օսհոցզՕՍԼ", "ouhngqOUL")
CHEROKEE = ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏎᏒᏚᏙᏢᏞᏟᏦᏴᏔᏂ", "DRTiAJEWMHGZ4RSVPLCKBWh")
#: Phonetic letters; they stay where a word has phonetic letters that look like no plain one.
PHONETIC = ("ɑɡɩ", "agi")
#: Signs, and letters of Armenian, Thai and Lao words, that have a compatibility form and are kept.
KEPT = "ª²³¹º¼½¾№™℠ʹևำຳໜໝ"

#: Characters without a shape of their own, as a class of regular expressions.
INVISIBLE = r"\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{0084}\x{0086}-\x{009F}\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E007F}"
#: Spaces other than the ordinary one.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _compatibility() -> dict[str, str]:
    """Every character with a compatibility form, and that form; marks of the typesetter and lone accents have none."""
    pairs = {}
    for c in map(chr, range(0x110000)):
        if unicodedata.decomposition(c).startswith("<") and c not in SPACES + KEPT and not "\u2010" <= c <= "\u205e":
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and plain.strip() and not plain.startswith(" "):
                pairs[c] = plain
    return pairs


_COMPATIBILITY = _compatibility()
_ONE = {c: p for c, p in _COMPATIBILITY.items() if len(p) == 1}
_MANY = {c: p for c, p in _COMPATIBILITY.items() if c not in _ONE}


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars) -> str:
    """chars as ranges of a class of regular expressions."""
    points = sorted(set(map(ord, chars)))
    begins = [b for a, b in zip([-9, *points], points) if b != a + 1]
    ends = [a for a, b in zip(points, [*points[1:], -9]) if b != a + 1]
    return "".join(f"\\x{{{a:04X}}}" + (f"-\\x{{{b:04X}}}" if b > a else "") for a, b in zip(begins, ends))


_STRICT = (CYRILLIC_STRICT, GREEK_STRICT, ARMENIAN, CHEROKEE)
_LOOSE = (CYRILLIC_LOOSE, GREEK_LOOSE)
#: The scripts whose letters are looked at, as a class of regular expressions.
_OTHER = r"\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}"


def _macros() -> list[str]:
    """SQL that defines the macros shapes(t), others_own(t, no_small) and words(t, other_text)."""
    foreign, latin = (_quote("".join(pair[k] for pair in (*_STRICT, *_LOOSE))) for k in (0, 1))
    latin_back = _quote("aeopcyxABEKMHOPCTYX")
    cyrillic_back = _quote("аеорсухАВЕКМНОРСТУХ")
    letters = _class("".join(a for a, _ in _STRICT))
    alike = _quote("[" + _class("".join(a for a, _ in (*_STRICT, *_LOOSE))) + "]")
    phonetic = _class(PHONETIC[0])
    return [
        f"CREATE MACRO widths(t) AS CASE WHEN regexp_matches(t, {_quote('[' + _class(_MANY) + ']')}) THEN array_to_string(list_transform(string_split(t, ''), lambda c: coalesce(getvariable('compatibility')[c], c)), '') ELSE t END",
        f"CREATE MACRO forms(t) AS CASE WHEN regexp_matches(t, {_quote('[' + _class([*_ONE, *SPACES]) + ']')}) THEN translate(t, {_quote(''.join(_ONE) + SPACES)}, {_quote(''.join(_ONE.values()) + ' ' * len(SPACES))}) ELSE t END",
        f"CREATE MACRO shapes(t) AS nfc_normalize(regexp_replace(forms(widths(t)), '[{INVISIBLE}]', '', 'g'))",
        # whether a text has a word of the other alphabet itself: one without Latin letters and with a letter
        # that looks like none of the strict look-alikes, or three and more capitals where no Latin letter is small
        f"CREATE MACRO own_word(w, no_small) AS regexp_matches(w, '^[{_OTHER}\\p{{M}}]+$') AND (regexp_replace(w, '[{letters}]', '', 'g') <> '' OR (no_small AND length(w) >= 3 AND w = upper(w)))",
        f"CREATE MACRO others_own(t, no_small) AS len(list_filter(regexp_extract_all(t, '[{_OTHER}\\p{{Latin}}\\p{{M}}]+'), lambda w: own_word(w, no_small))) > 0",
        # a word of both alphabets: its Latin letters stand in when it has letters only the other alphabet has and all its Latin ones look alike
        f"""CREATE MACRO mixed_word(w) AS CASE
              WHEN regexp_matches(w, '\\p{{Cyrillic}}') AND regexp_matches(regexp_replace(w, {alike}, '', 'g'), '\\p{{Cyrillic}}')
                   AND NOT regexp_matches(translate(w, {latin_back}, {cyrillic_back}), '\\p{{Latin}}') THEN translate(w, {latin_back}, {cyrillic_back})
              ELSE translate(w, {foreign}, {latin}) END""",
        # a short word wholly of look-alikes stands for a Latin one unless the text has words of that alphabet
        f"""CREATE MACRO plain_word(w, other_text) AS CASE
              WHEN regexp_matches(w, '[{_OTHER}]') AND regexp_matches(w, '\\p{{Latin}}') THEN mixed_word(w)
              WHEN NOT other_text AND regexp_matches(w, '^[{letters}]+$') THEN translate(w, {foreign}, {latin})
              WHEN regexp_matches(w, '[{phonetic}]') AND regexp_matches(w, '[A-Za-z]') AND NOT regexp_matches(regexp_replace(w, '[{phonetic}]', '', 'g'), '[\\x{{0250}}-\\x{{02FF}}]') THEN translate(w, '{PHONETIC[0]}', '{PHONETIC[1]}')
              ELSE w END""",
        f"""CREATE MACRO words(t, other_text) AS CASE WHEN regexp_matches(t, '[{_OTHER}{phonetic}]') THEN
              array_to_string(list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: plain_word(w, other_text)), '') ELSE t END""",
    ]


def _connection():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
    con.execute(f"SET VARIABLE compatibility = map([{','.join(map(_quote, _MANY))}], [{','.join(map(_quote, _MANY.values()))}])")
    for m in _macros():
        con.execute(m)
    return con


_CON = None


def _odd(columns: Sequence[str]) -> Column:
    """Whether a row has a text that may not be plain."""
    odd = F.lit(False)
    for c in columns:
        odd = odd | F.coalesce(F.col(c).rlike(NEEDS_SQL), F.lit(False))
    return odd


def _shaped(records: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The rows with a text that may not be plain, as plain_columns gives them."""
    kept = records.select(key, *(F.col(c).cast("string").alias(c) for c in columns))
    schema = T.StructType([kept.schema[key], *(T.StructField(c, T.StringType()) for c in columns), *(T.StructField(f"{c}_stored_plain", T.BooleanType()) for c in columns)])
    n = range(len(columns))
    # in steps, so that each text's flags are found once and not once for each of its words
    sql = (
        f'WITH shaped AS (SELECT "{key}", ' + ", ".join(f'"{columns[i]}" AS c{i}, shapes("{columns[i]}") AS s{i}' for i in n) + " FROM batch), "
        "cased AS (SELECT *, " + ", ".join(f"NOT regexp_matches(s{i}, '[a-z]') AS b{i}" for i in n) + " FROM shaped), "
        "owned AS (SELECT *, " + ", ".join(f"others_own(s{i}, b{i}) AS o{i}" for i in n) + " FROM cased), "
        "plain AS (SELECT *, " + ", ".join(f"nfc_normalize(words(s{i}, o{i})) AS p{i}" for i in n) + " FROM owned) "
        f'SELECT "{key}", ' + ", ".join([f"p{i}" for i in n] + [f"p{i} IS NOT DISTINCT FROM c{i}" for i in n]) + " FROM plain"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _CON
        if _CON is None:
            _CON = _connection()
        for b in batches:
            _CON.register("batch", pa.Table.from_batches([b]))
            found = _CON.execute(sql).to_arrow_table()
            _CON.unregister("batch")
            names = [f.name for f in schema]
            types = [b.schema.field(0).type, *[pa.string()] * len(columns), *[pa.bool_()] * len(columns)]
            for out in found.rename_columns(names).cast(pa.schema(list(zip(names, types)))).to_batches():
                yield out

    return kept.where(_odd(columns)).mapInArrow(run, schema)


def plain_columns(records: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, each column in its plain form, each column + "_stored_plain" BOOLEAN)."""
    as_is = records.select(key, *(F.col(c).cast("string").alias(c) for c in columns)).where(~_odd(columns))
    return _shaped(records, key, columns).unionByName(as_is.withColumns({f"{c}_stored_plain": F.lit(True) for c in columns}))


def not_plain(records: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field_name) of each value that is not stored in its plain form; one scan."""
    flags = ", ".join(f"'{c}', {c}_stored_plain" for c in columns)
    return _shaped(records, key, columns).select(key, F.expr(f"stack({len(columns)}, {flags}) AS (field_name, stored_plain)")).where("NOT stored_plain").drop("stored_plain")
