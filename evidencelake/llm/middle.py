"""Fill-in-the-middle: texts cut in three, their parts put in another order between markers.

Cuts are numbers of code points, texts are UTF-8 bytes. A sparse index of a text's exceptions, the places and excess
bytes of its multibyte characters, turns one into the other by a binary search; where only ASCII stands, a place is
plain arithmetic. So no text is decoded, and an ASCII text has an empty index. The index of a whole batch is built at
once, its texts being one buffer.

Cuts and forms come from a digest of the seed and doc_id alone, so a run can be repeated on any cluster and each task
can be lost. Nothing is shuffled.

Defined results: a null text is an empty one, which stays plain; a text that holds a marker stays plain, so every
output can be taken apart; a null doc_id is written as no digits; equal rows give equal rows; texts of any length are
cut as a whole; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, MOVED_PERCENT, SUFFIX_FIRST_PERCENT = 1, 90, 20


class ExceptionIndex:
    """Code points and bytes of the texts of one UTF-8 buffer, by its multibyte characters alone."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: the bytes; offsets: where each text begins and, last, where the last one ends."""
        first = np.flatnonzero(data >= 0xC0)
        lead = data[first]
        self.at = first  # byte places of the exceptions
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)])
        self.point = first - self.excess[:-1]  # their places in code points
        self.offsets = offsets.astype(np.int64)
        self.starts = self.points(self.offsets)

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points of the buffer before byte places; a place inside of a character counts up to its beginning."""
        before = np.searchsorted(self.at, at)
        last = np.maximum(before - 1, 0)
        if len(self.at) == 0:
            return np.asarray(at, dtype=np.int64)
        inside = (before > 0) & (at < self.at[last] + 1 + self.excess[last + 1] - self.excess[last])
        return np.where(inside, self.point[last], at - self.excess[before])

    def bytes(self, points: np.ndarray) -> np.ndarray:
        """Byte places in the buffer of places in code points."""
        return points + self.excess[np.searchsorted(self.point, points)]

    def lengths(self) -> np.ndarray:
        """Code points of each text."""
        return np.diff(self.starts)

    def cut(self, text: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Byte places in the buffer after so many code points of the texts of the given numbers."""
        return self.bytes(self.starts[text] + points)


def draws(seed: int) -> list[Column]:
    """Four 32-bit numbers of each doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, seed: int = SEED, moved: int = MOVED_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, output.

    Of the texts `moved` percent are rearranged, of those `suffix_first` percent as suffix, prefix, middle (spm), the
    others as prefix, suffix, middle (psm).
    """
    common.prepare(docs.sparkSession)
    text = F.col("text")
    marked = sum((F.contains(text, F.lit(m)).cast("int") for m in (PREFIX, SUFFIX, MIDDLE)), F.lit(0)) > 0
    h1, h2, h3, h4 = draws(seed)
    plain = text.isNull() | (text == "") | marked | (h3 % 100 >= moved)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select("doc_id", "text", form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    marks = {k: m.encode() for k, m in (("p", PREFIX), ("s", SUFFIX), ("m", MIDDLE))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            data, offsets = common.utf8_buffer(batch["text"])
            index = ExceptionIndex(data, offsets)
            n, order = index.lengths(), np.arange(batch.num_rows)
            one, two = (batch[h].to_numpy() % (n + 1) for h in ("h1", "h2"))
            low, high = np.minimum(one, two), np.maximum(one, two)
            first, second = index.cut(order, low), index.cut(order, high)
            view, outputs = memoryview(data), []
            forms = batch["form"].to_pylist()
            for form, a, b, c, d in zip(forms, offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), strict=True):
                if form == "plain":
                    outputs.append(bytes(view[a:d]))
                    continue
                before = marks["p"], view[a:b]
                after = marks["s"], view[c:d]
                parts = (*before, *after) if form == "psm" else (*after, *before)
                outputs.append(b"".join((*parts, marks["m"], view[b:c])))
            still = np.array([f == "plain" for f in forms], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n), batch["form"], pa.array(low, mask=still), pa.array(high - low, mask=still), pa.array(outputs, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; no marker stands in a text that was rearranged, so the first one is it."""

    def after(text: Column, mark: str) -> Column:
        return F.substring(text, F.locate(mark, text) + F.lit(len(mark)), F.length(text))

    body = F.substring(output, F.lit(1 + len(PREFIX)), F.length(output))
    middle = after(body, MIDDLE)
    rest = F.substring_index(body, MIDDLE, 1)
    psm = F.concat(F.substring_index(rest, SUFFIX, 1), middle, after(rest, SUFFIX))
    spm = F.concat(after(rest, PREFIX), middle, F.substring_index(rest, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the outputs and of the texts rebuilt from them."""
    rows = transform(docs)
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as s from documents),
h as (select *, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {MOVED_PERCENT} then 'plain'
      when h4 % 100 < {SUFFIX_FIRST_PERCENT} then 'spm' else 'psm' end as form from h),
p as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end::bigint as prefix_chars, case when form <> 'plain' then b - a end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
    else '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
