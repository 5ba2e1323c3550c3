"""Fill-in-middle transformation by a two-pass streaming matcher.

A text is a sequence of units: a word with the white space before it, or white space at the end.
The first pass over the lazy match iterator only counts the units; the second advances a new iterator
to the two ranks that the document's dice choose and keeps the two offsets.  No unit, and no list
of units, is ever stored, so a text of any length costs two offsets besides the text itself.

The dice are the first four 32-bit groups of a SHA-256 of the seed and the id: two cut the text, one
chooses whether it is transformed, one the order (suffix-prefix-middle or prefix-suffix-middle).
Everything is a function of the row, so there is no shuffle and a repeated task gives the same rows.

Defined results: a null text is an empty one; empty texts and those that hold a sentinel stay plain, as
do those that the dice leave; a null id takes the dice of an empty id; rows that repeat an id get the
same dice, and cuts by their own number of units; texts are read whole, whatever their length; an
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, slices, table

#: A unit. Possessive, so that a long run of white space is not tried again from the back.
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of a hundred that are transformed, and of these the share in the order suffix, prefix, middle.
RATE, SPM, SEED = 50, 80, 42

COLUMNS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class Plan:
    rate: int = RATE
    spm: int = SPM

    def cut(self, text: str, dice: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
        """n, form, characters of the prefix and of the middle, output."""
        n = 0
        for _ in UNIT.finditer(text):  # first pass: a count
            n += 1
        if not n or dice[2] % 100 >= self.rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", None, None, text
        first, last = sorted((dice[0] % (n + 1), dice[1] % (n + 1)))
        a, b = offsets(text, first, last)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if dice[3] % 100 < self.spm:
            return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def offsets(text: str, first: int, last: int) -> tuple[int, int]:
    """Where the first ``first`` and the first ``last`` units end; the second pass, by one iterator."""
    units, ends = UNIT.finditer(text), []
    done = end = 0
    for rank in (first, last):
        if rank > done:
            end, done = next(islice(units, rank - done - 1, None)).end(), rank
        ends.append(end)
    return ends[0], ends[1]


def dice(seed: int = SEED) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


def transform(docs: DataFrame, seed: int = SEED, plan: Plan | None = None) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output per document."""
    plan = plan or Plan()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [plan.cut(t.as_py() or "", d.as_py()) for t, d in zip(b.column("text"), b.column("dice"), strict=True)]
            cols = list(zip(*got, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols, types)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", dice(seed).alias("dice")).transform(in_arrow, run, COLUMNS)


def restore(transformed: DataFrame) -> DataFrame:
    """Adds restored, the text that ``output`` and ``form`` were made of; by splits at the sentinels."""
    def between(a: str, b: str | None) -> Column:
        rest = F.substring_index("output", a, -1)
        return F.substring_index(rest, b, 1) if b else rest

    # each sentinel occurs once in an output, so the part behind the last one is the part behind it
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    return transformed.withColumn("restored", F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(F.col("output")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(transform(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
r AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
         ('0x' || h[17:24])::BIGINT % 100 AS rate, ('0x' || h[25:32])::BIGINT % 100 AS way
  FROM d),
f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR rate >= 50 THEN 'plain' WHEN way < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM f
"""
