"""Fill-in-middle: texts rearranged so that a model learns to fill a gap.

A text is cut into units, each with the white space before it. Prefix, middle and suffix are
runs of units, cut at two places drawn by the hash of the document's id. The work is a
pipeline of Arrow kernels over whole batches: units are split into list arrays, flattened
with the index of their text, numbered within it, filtered by role, rebuilt as lists, and
joined into pieces. No loop runs over texts or units.

Units match ``[ws]*[^ws]+|[ws]+`` with ws as space and U+0009 to U+000D, so a unit
begins exactly where white space follows another character. There a mark is put
and the text is split. The mark is a control character and a letter; the control character itself
is written as the mark's first character and another letter before, and turned back at the end, so
any text comes through.

Form: plain when the text is empty or contains a sentinel, or by the third draw; else suffix
first (spm) or prefix first (psm) by the fourth.

Defined cases: a null text is empty; a null id draws as an empty id; equal ids draw
equally, so equal rows give equal rows; columns named as the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.frames import column_of, map_batches

#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = r"\x20\x09-\x0D"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_HELD = "\x01"
_CUT, _SELF = _HELD + "b", _HELD + "a"
NONE = pa.scalar("", pa.large_string())
ADDED = "n_units bigint, form string, output string, prefix_chars bigint, middle_chars bigint"


@dataclass(frozen=True)
class Rates:
    """Shares, in hundredths, of documents that are rearranged, and of those with the suffix first."""

    rearranged: int = 50
    suffix_first: int = 80


def draws(id_column: str, seed: int = 42, count: int = 4) -> list:
    """The first 8-digit groups of the hash of ``seed:id``, as whole numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(count)]


def units_of(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(unit, number of its text, its ordinal in the text), flat over a batch of texts."""
    held = pc.replace_substring(texts, _HELD, _SELF)
    marked = pc.replace_substring_regex(held, f"([^{SPACE}])([{SPACE}])", rf"\1{_CUT}\2")
    lists = pc.split_pattern(marked, _CUT)
    units, owner = pc.list_flatten(lists), pc.cast(pc.list_parent_indices(lists), pa.int64())
    first = pc.take(pc.cast(lists.offsets, pa.int64()), owner)
    ordinal = pc.subtract(pa.array(np.arange(len(units)) + lists.offsets[0].as_py()), first)
    real = pc.greater(pc.binary_length(units), 0)  # an empty text splits into one empty string
    return pc.filter(units, real), pc.filter(owner, real), pc.filter(ordinal, real)


def joined(units: pa.Array, owner: pa.Array, role: pa.Array, texts: int) -> pa.Array:
    """The units where ``role`` holds, joined in order: one string for each text."""
    units, owner = pc.filter(units, role), pc.filter(owner, role)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner.to_numpy(), minlength=texts))])
    lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), units)
    return pc.replace_substring(pc.binary_join(lists, NONE), _SELF, _HELD)


def rearranged(texts: pa.Array, cuts: tuple[pa.Array, pa.Array], form_draws: tuple[pa.Array, pa.Array], rates: Rates):
    """The added columns for a batch of texts."""
    n = len(texts)
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    units, owner, ordinal = units_of(texts)
    size = pa.array(np.bincount(owner.to_numpy(), minlength=n), pa.int64())
    places = [pc.subtract(c, pc.multiply(pc.divide(c, pc.add(size, 1)), pc.add(size, 1))) for c in cuts]
    low = pc.take(pc.min_element_wise(*places), owner)
    high = pc.take(pc.max_element_wise(*places), owner)
    before, after = pc.less(ordinal, low), pc.greater_equal(ordinal, high)
    between = pc.invert(pc.or_(before, after))
    prefix, middle, suffix = (joined(units, owner, r, n) for r in (before, between, after))
    marked = pc.or_(pc.or_(*(pc.match_substring(texts, m) for m in (PREFIX, SUFFIX))), pc.match_substring(texts, MIDDLE))
    share = [pc.subtract(d, pc.multiply(pc.divide(d, 100), 100)) for d in form_draws]
    plain = pc.or_(pc.or_(pc.equal(size, 0), marked), pc.greater_equal(share[0], rates.rearranged))
    spm = pc.less(share[1], rates.suffix_first)
    p, s, m = (pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE))
    psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, NONE)
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, NONE)
    unset = pa.scalar(None, pa.int64())
    return {
        "n_units": size,
        "form": pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM)),
        "output": pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text)),
        "prefix_chars": pc.if_else(plain, unset, pc.cast(pc.utf8_length(prefix), pa.int64())),
        "middle_chars": pc.if_else(plain, unset, pc.cast(pc.utf8_length(middle), pa.int64())),
    }


def filled(
    docs: DataFrame, id_column: str = "doc_id", seed: int = 42, rates: Rates = Rates(), with_restored: bool = False
) -> DataFrame:
    """``docs`` with ``n_units``, ``form``, ``output``, ``prefix_chars`` and ``middle_chars``.

    One map over the texts, no shuffle. The numbers of characters are null where the form is plain.
    ``with_restored`` adds ``restored``, rebuilt from output and form in the same map.
    """
    added = T.StructType.fromDDL(ADDED + (", restored string" if with_restored else "")).fields
    own = [f for f in docs.schema if f.name not in {a.name for a in added}]
    drawn = F.struct(*[d.alias(f"d{k}") for k, d in enumerate(draws(id_column, seed))])
    # The draws travel beside the row, under a place that no column name can clash with.
    packed = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in own]).alias("row"), drawn.alias("drawn"))
    text = [f.name for f in own].index("text")

    def job(batch: pa.RecordBatch):
        row, d = column_of(batch, "row"), column_of(batch, "drawn").flatten()
        found = rearranged(row.field(text), (d[0], d[1]), (d[2], d[3]), rates)
        if with_restored:
            found["restored"] = text_of(found["output"], found["form"])
        return {"row": row, "filled": pa.StructArray.from_arrays(*_columns(found, added))}

    schema = T.StructType([
        T.StructField("row", T.StructType(own)), T.StructField("filled", T.StructType(added)),
    ])
    return map_batches(packed, schema, job).select("row.*", "filled.*")


def _columns(found: dict, added: list[T.StructField]) -> tuple[list[pa.Array], list[str]]:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    arrays = [found[f.name] for f in added]
    arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    return [a.cast(kinds[f.dataType.simpleString()]) for a, f in zip(arrays, added)], [f.name for f in added]


def restored(filled_docs: DataFrame, column: str = "restored") -> DataFrame:
    """``filled_docs`` with the text rebuilt from ``output`` and ``form`` alone.

    No piece holds a sentinel and none can arise where a piece meets one, so the first
    sentinel of each kind ends its piece.
    """
    own = [f for f in filled_docs.schema if f.name != column]
    at = {f.name: k for k, f in enumerate(own)}
    packed = filled_docs.select(F.struct(*[F.col(f"`{f.name}`") for f in own]).alias("row"))
    schema = T.StructType([T.StructField("row", T.StructType(own)), T.StructField("text", T.StringType())])

    def job(batch: pa.RecordBatch):
        row = column_of(batch, "row")
        return {"row": row, "text": text_of(row.field(at["output"]), row.field(at["form"]))}

    return map_batches(packed, schema, job).select("row.*", F.col("text").alias(column))


def text_of(output: pa.Array, form: pa.Array) -> pa.Array:
    """Texts from their outputs and forms."""
    spm = pc.equal(form, SPM)
    plain = pc.equal(form, PLAIN)
    # Plain rows get sentinels that end empty pieces, so that every row splits alike.
    framed = pc.if_else(plain, PREFIX + SUFFIX + MIDDLE, pc.cast(output, pa.large_string()))
    head, middle = _split(framed, pa.array([MIDDLE] * len(output)))
    opening, inner = pc.if_else(spm, SUFFIX, PREFIX), pc.if_else(spm, PREFIX, SUFFIX)
    first, second = _split(head, inner)
    first = pc.utf8_slice_codeunits(first, len(opening[0].as_py()) if len(opening) else 0)
    prefix, suffix = pc.if_else(spm, second, first), pc.if_else(spm, first, second)
    whole = pc.binary_join_element_wise(prefix, middle, suffix, NONE)
    return pc.cast(pc.if_else(plain, pc.cast(output, pa.large_string()), whole), pa.string())


def _split(texts: pa.Array, marks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first mark of each text (one of two marks a batch)."""
    before = after = pa.nulls(len(texts), pa.large_string())
    for mark in pc.unique(marks).to_pylist():
        own = pc.equal(marks, mark)
        parts = pc.split_pattern(pc.if_else(own, texts, mark), mark, max_splits=1)
        before = pc.if_else(own, pc.list_element(parts, 0), before)
        after = pc.if_else(own, pc.list_element(parts, 1), after)
    return before, after


ORACLE = f"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
    SELECT doc_id, text,
           ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
           ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4,
           regexp_extract_all(text, '[{SPACE}]*[^{SPACE}]+|[{SPACE}]+') AS units
    FROM drawn
), cut AS (
    SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low,
           greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high
    FROM numbers
), pieces AS (
    SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
           array_to_string(units[high + 1:], '') AS suffix,
           CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                     OR h3 % 100 >= 50 THEN '{PLAIN}'
                WHEN h4 % 100 < 80 THEN '{SPM}' ELSE '{PSM}' END AS form
    FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form <> '{PLAIN}' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> '{PLAIN}' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN '{PLAIN}' THEN text
              WHEN '{PSM}' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(CASE form WHEN '{PLAIN}' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM pieces
"""
