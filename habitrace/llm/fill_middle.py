"""Fill-in-middle: a document's lines are cut into prefix, middle and suffix.

The lines are the pieces of the tokenizers library's ``Split`` pre-tokenizer
with isolated matches (nothing is trained); their offsets are code points, so
the number of offsets is the number of lines and an offset of a given rank is a
cut. Which cuts and which order of the parts a document gets follows from a
hash of its id. Each row is on its own: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"


def line_ends(splitter, text: str) -> list[int]:
    """The code point after each unit that ``splitter`` finds."""
    return [end for _, (_, end) in splitter.pre_tokenize_str(text)] if text else []


def transform(text: str, key: str, ends: list[int], rate: int = 100, spm_share: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text; ``rate`` percent of the documents are rearranged."""
    n, seed = len(ends), hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(seed[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, last = ([0, *ends][k] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < spm_share:
        return n, "spm", first, last - first, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", first, last - first, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restored(output: str, form: str) -> str:
    """The exact text from an output and its form."""
    if form == "plain":
        return output
    rest, middle = output.split(MIDDLE)
    ahead, behind = rest[len(PREFIX) :].split(SUFFIX if form == "psm" else PREFIX)
    prefix, suffix = (ahead, behind) if form == "psm" else (behind, ahead)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_share: int = 50) -> DataFrame:
    """The id and ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``, one row for each row.

    A null text is an empty one and gives ``plain``, as every text does that
    holds a mark; the two lengths are null there. A null id hashes as an empty
    string; repeated rows repeat their output, texts of any length are cut as a
    whole, an empty table stays empty. Other columns, whatever they are called,
    are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        splitter = Split(Regex(LINES), behavior="isolated")
        for batch in batches:
            # one text at a time, so that a batch's outputs and not its offsets are held
            made = [transform(text, f"{seed}:{key}", line_ends(splitter, text), rate, spm_share) for key, text in zip(batch.column(1).to_pylist(), (t.as_py() or "" for t in batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([row[k] for row in made], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())))], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    schema = rows.select(id_col).schema
    for name, kind in (c.split() for c in COLUMNS.split(", ")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def with_digests(made: DataFrame) -> DataFrame:
    """``made`` with the digest of its output, and of the text that output and form give back, in place of the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [[], []]
            for form, output in zip(batch.column("form").to_pylist(), batch.column("output")):
                for found, text in zip(digests, (output.as_py(), restored(output.as_py(), form))):
                    found.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, digests)], names=[*kept, "output_sha256", "restored_sha256"])

    kept = [c for c in made.columns if c != "output"]
    return made.mapInArrow(run, made.select(*kept).schema.add("output_sha256", "string").add("restored_sha256", "string"))


def oracle_sql() -> str:
    """The registered query for DuckDB, by lists of lines instead of offsets."""
    return f"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
h as (select doc_id, t, [cast('0x' || substr(s, 1 + 8 * k, 8) as bigint) for k in [0, 1, 2, 3]] as h, string_split(t, chr(10)) as parts from d),
n as (select *, len(parts) - cast(parts[-1] = '' as int) as n from h),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b from n),
e as (select *, cast(case when a = n then length(t) else coalesce(list_sum([length(x) + 1 for x in parts[1:a]]), 0) end as bigint) as i, cast(case when b = n then length(t) else coalesce(list_sum([length(x) + 1 for x in parts[1:b]]), 0) end as bigint) as j from c),
f as (select *, case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h[3] % 100 >= 100 then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form,
  substr(t, 1, i) as p, substr(t, i + 1, j - i) as m, substr(t, j + 1) as q from e)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then i end as prefix_chars, case when form <> 'plain' then j - i end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || q || '{MIDDLE}' || m else '{SUFFIX}' || q || '{PREFIX}' || p || '{MIDDLE}' || m end) as output_sha256, sha256(t) as restored_sha256
from f"""
