"""Fill-in-middle: documents cut into lines and put in another order, by DuckDB over Arrow batches.

Each batch is registered as a view of an in-memory DuckDB connection; one
statement cuts all its texts, arranges the parts and digests them, so no row is
touched in Python. A batch is cut where its texts reach a few MB, so what a
task holds is bounded by its longest text. The connections have one thread and
no folder of their own: nothing is left on an executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Markers of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")

#: Lines of a text; the digest whose groups of eight digits are the draws; the cut; the parts; the output.
ARRANGE = r"""
with drawn as (
  select row, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as lines, text, sha256('{seed}:' || id) as digest from batch
), numbers as (
  select row, text, lines, len(lines)::bigint as n,
    [('0x' || digest[k:k + 7])::ubigint for k in [1, 9, 17, 25]] as h from drawn
), cut as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
    case when text = '' or contains(text, '{p}') or contains(text, '{s}') or contains(text, '{m}') or h[3] % 100 >= {rate} then 'plain'
         when h[4] % 100 < {spm} then 'spm' else 'psm' end as form
  from numbers
), parts as (
  select row, text, n, form,
    coalesce(array_to_string(list_slice(lines, 1, a), ''), '') as prefix,
    coalesce(array_to_string(list_slice(lines, a + 1, b), ''), '') as middle,
    coalesce(array_to_string(list_slice(lines, b + 1, n), ''), '') as suffix
  from cut
)
select n, form,
  case when form <> 'plain' then length(prefix)::bigint end as prefix_chars,
  case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  case form when 'psm' then '{p}' || prefix || '{s}' || suffix || '{m}' || middle
            when 'spm' then '{s}' || suffix || '{p}' || prefix || '{m}' || middle
            else text end as output
from parts order by row
"""

#: The text from output and form alone: markers occur once each, as texts that hold one are left plain.
RESTORE = r"""
with halves as (
  select row, form, output, string_split(output, '{m}') as half from batch
), parts as (
  select row, form, output, half[2] as middle,
    string_split(case form when 'psm' then substr(half[1], 4) when 'spm' then substr(half[1], 4) end, case form when 'psm' then '{s}' else '{p}' end) as ends
  from halves
)
select case form when 'psm' then ends[1] || middle || ends[2] when 'spm' then ends[2] || middle || ends[1] else output end as restored
from parts order by row
"""

#: Digests of two columns, and nothing of their texts.
DIGESTS = "select sha256(output) as output_sha256, sha256(restored) as restored_sha256 from batch order by row"


def _connection():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
    con.execute("set preserve_insertion_order = true")
    return con


def _run(con, statement: str, **columns: pa.Array) -> pa.Table:
    n = len(next(iter(columns.values())))
    con.register("batch", pa.table({"row": pa.array(np.arange(n)), **columns}))
    found = con.sql(statement).to_arrow_table()
    con.unregister("batch")
    return found


def _arranger(statement: str, restore: str | None, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for whole in batches:
            for batch in slices(whole, 1):
                found = _run(con, statement, id=batch.column(0), text=batch.column(1))
                if restore:
                    restored = _run(con, restore, form=found["form"], output=found["output"])["restored"]
                    found = found.append_column("restored", restored)
                if digests:
                    both = _run(con, DIGESTS, output=found["output"], restored=found["restored"])
                    found = found.select(["n", "form", "prefix_chars", "middle_chars"])
                    for name in both.column_names:
                        found = found.append_column(name, both[name])
                columns = [pa.chunked_array([batch.column(i)]) for i in range(2, batch.num_columns)] + found.columns
                names = batch.schema.names[2:] + found.column_names
                yield from pa.table(columns, names=names).combine_chunks().to_batches()
        con.close()

    return run


def _ids(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _statement(template: str, seed: int, rate: int, spm: int) -> str:
    return template.format(seed=seed, rate=rate, spm=spm, p=MARKS[0], s=MARKS[1], m=MARKS[2])


def _formed(docs: DataFrame, seed: int, rate: int, spm: int, restore: bool, digests: bool) -> DataFrame:
    if not 0 <= rate <= 100 or not 0 <= spm <= 100:
        raise ValueError("rate and spm are percentages")
    rows = docs.select(_ids(F.col("doc_id")).alias("__id"), F.coalesce("text", F.lit("")).alias("__text"), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = "output_sha256 string, restored_sha256 string" if digests else "output string, restored string" if restore else "output string"
    shape = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, {texts}"
    run = _arranger(_statement(ARRANGE, seed, rate, spm), _statement(RESTORE, seed, rate, spm) if restore else None, digests)
    return rows.mapInArrow(run, shape)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, restore: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) and, if asked for, restored: a row for each row of ``docs``.

    A text is cut into its n lines, ends included; digests of seed and doc_id
    draw two cuts and the form: ``rate`` percent of texts are arranged, ``spm``
    percent of these suffix first. Texts that are empty or hold a marker stay
    plain and have null prefix_chars and middle_chars (code points). restored
    is the text made again from output and form alone. Null texts are
    empty; a null doc_id draws as an empty one and stays null; equal rows give
    equal rows; no rows give none; other columns are ignored.
    """
    return _formed(docs, seed, rate, spm, restore, False)


def checked(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): :func:`fill_in_middle` with the digests of its texts only."""
    return _formed(docs, seed, rate, spm, True, True)
