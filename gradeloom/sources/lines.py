"""Raw CSV lines parsed into declared columns, rows that fail kept apart with their reason.

Each Arrow batch is one CSV block: pyarrow's reader splits it, its invalid-row callback takes
the rows with a wrong number of fields, every field is read as a string, and vector casts then
label the cells that their column does not allow. No shuffle, one pass over the lines.

Defined results: a null or empty line has no fields and is a ``column_count`` reject; an
empty table gives an empty result; repeated lines are parsed each on its own; the input's other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame, functions as F

BAD_QUOTING, COLUMN_COUNT, BAD_VALUE = "bad_quoting", "column_count", "bad_value"
#: A record whose quoting follows RFC 4180.
QUOTED_OK = r'^(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*$'


def not_blank(cells: pa.Array) -> pa.Array:
    return pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(cells)), 0)


def anything(cells: pa.Array) -> pa.Array:
    return pc.is_valid(cells)


def whole_number(low: int, high: int) -> Callable[[pa.Array], pa.Array]:
    """Allows empty cells and whole numbers from low to high."""

    def check(cells: pa.Array) -> pa.Array:
        # longer digit strings than an int64 holds cannot be in range; the cast must not see them
        digits = pc.match_substring_regex(cells, r"^0*[0-9]{1,18}$")
        n = pc.cast(pc.if_else(digits, cells, "-1"), pa.int64())
        return pc.or_(pc.equal(cells, ""), pc.and_(digits, pc.and_(pc.greater_equal(n, low), pc.less_equal(n, high))))

    return check


def date_time(cells: pa.Array) -> pa.Array:
    """Allows real dates and times written YYYY-MM-DD HH:MM:SS."""
    form = pc.match_substring_regex(cells, r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]) (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$")
    text = pc.if_else(form, cells, "1970-01-01 00:00:00")
    # the days a month has: strptime takes or shifts days the calendar lacks, so they are counted
    year, month, day = (pc.cast(pc.utf8_slice_codeunits(text, a, b), pa.int32()) for a, b in ((0, 4), (5, 7), (8, 10)))

    def divides(n):
        return pc.equal(pc.multiply(pc.divide(year, n), n), year)

    leap = pc.or_(pc.and_not(divides(4), divides(100)), divides(400))
    february = pc.if_else(leap, 29, 28)
    most = pc.if_else(pc.equal(month, 2), february, pc.if_else(pc.is_in(month, pa.array([4, 6, 9, 11], pa.int32())), 30, 31))
    return pc.and_(pc.and_(form, pc.greater(year, 0)), pc.less_equal(day, most))


#: The declared columns of an uploaded line and what each allows.
UPLOAD_COLUMNS: dict[str, Callable[[pa.Array], pa.Array]] = {
    "id": anything, "question": not_blank, "answer": not_blank, "expected_answer": anything,
    "context": anything, "pass_threshold": whole_number(0, 100), "asked_at": date_time,
}


def _parse(ids: pa.Array, lines: pa.Array, columns: Mapping[str, Callable], out: pa.Schema, id_name: str) -> pa.RecordBatch:
    n = len(lines)
    reasons: list[str | None] = [None] * n
    fields: dict[str, list] = {c: [None] * n for c in columns}
    text = pc.fill_null(lines, "")
    well_quoted = pc.match_substring_regex(text, QUOTED_OK)
    failed: list[int] = []

    def rejected(row: pcsv.InvalidRow) -> str:
        failed.append(int(row.text.split(",", 1)[0].strip('"')))
        return "skip"

    keep = pc.indices_nonzero(well_quoted)
    for i in pc.indices_nonzero(pc.invert(well_quoted)).to_pylist():
        reasons[i] = BAD_QUOTING
    if len(keep):
        numbered = pc.binary_join_element_wise(pc.cast(keep, pa.string()), pc.take(text, keep), ",")
        block = "\n".join(numbered.to_pylist()).encode() + b"\n"
        names = ["\x00row", *columns]
        table = pcsv.read_csv(
            pa.BufferReader(block),
            read_options=pcsv.ReadOptions(column_names=names, use_threads=False, block_size=len(block) + 1),
            parse_options=pcsv.ParseOptions(newlines_in_values=True, invalid_row_handler=rejected, ignore_empty_lines=False),
            convert_options=pcsv.ConvertOptions(column_types={**{c: pa.string() for c in names}, "\x00row": pa.int64()}, strings_can_be_null=False),
        ).combine_chunks()
        for i in failed:
            reasons[i] = COLUMN_COUNT
        at = table.column(0).to_pylist()
        cells = {c: _one(table.column(1 + k)) for k, c in enumerate(columns)}
        fine = None
        for c, allows in columns.items():
            ok = pc.fill_null(allows(cells[c]), False)
            fine = ok if fine is None else pc.and_(fine, ok)
        for i, ok in zip(at, fine.to_pylist() if fine is not None else [True] * len(at)):
            if not ok:
                reasons[i] = BAD_VALUE
        for c in columns:
            values = fields[c]
            for i, v in zip(at, cells[c].to_pylist()):
                values[i] = v
    arrays = [pc.cast(ids, out.field(id_name).type), pa.array(reasons, pa.string()), *(pa.array(fields[c], pa.string()) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, schema=out)


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) and column.num_chunks != 1 else column.chunk(0)


def parse_lines(lines: DataFrame, id_column: str = "line_id", text_column: str = "raw_line", columns: Mapping[str, Callable] = UPLOAD_COLUMNS) -> DataFrame:
    """(line id, reason, *declared columns as strings); reason is null for the rows that load."""
    kept = lines.select(F.col(id_column).cast("bigint").alias(id_column), F.col(text_column).cast("string").alias(text_column))
    out = pa.schema([(id_column, pa.int64()), ("reason", pa.string()), *((c, pa.string()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _parse(b.column(0), b.column(1), columns, out, id_column)

    quoted = ", ".join([f"`{id_column}` bigint", "reason string", *(f"`{c}` string" for c in columns)])
    return kept.mapInArrow(run, quoted)


def split_lines(lines: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The rows that load, and (line id, reason) of the rows that do not."""
    parsed = parse_lines(lines, **options)
    id_column = options.get("id_column", "line_id")
    return parsed.where("reason IS NULL").drop("reason"), parsed.where("reason IS NOT NULL").select(id_column, "reason")
