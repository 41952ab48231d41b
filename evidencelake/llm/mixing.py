"""Mixing sources to target weights by a temperature, as column expressions only.

Source shares of tokens are raised to an exponent between 0 (all sources alike) and 1 (as they are). The exponent is
bisected, in rounds of fifteen inner points at once, until the repetition limit or the entropy is met: each round is one
aggregate over the table of sources. The weights become a token budget for each source. Its documents are dealt by
hash into blocks of bounded size; an epoch is a permutation of the blocks and of the documents in each, so a place in
it needs sums over blocks and over one block only. Whole epochs use every document once, the last one stops at the
budget. `slot` cuts the mixed stream into pieces in which every source has its weight.

Defined results: a document without words counts as one token; a null text is an empty one; a null source is a source
of its own; repeated rows are documents of their own; a null doc_id is kept; an empty table gives no row; further
columns are ignored (by `mixed_rows` kept).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm import common

WORDS = r"[^\x20\x09-\x0D]+"
#: Tokens that a block and a slot hold about; a block is what one task sorts.
BLOCK_TOKENS = 100_000
#: Rows of a source are met in so many parts when they learn their source's numbers.
SALTS = 32
INNER, DIGITS = 15, 6
#: How often the rarest source may be repeated while the largest is used once.
REPETITION = 2.0


def place_hash(*parts: Column | str) -> Column:
    """A 52-bit number from the digest of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def tokens_of(docs: DataFrame, *keep: str) -> DataFrame:
    count = F.greatest(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)), F.lit(1)).cast("long")
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    return docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), named.alias("source"), count.alias("n_tokens"))


def exponent(sources: DataFrame, *, repetition: float | None = None, entropy: float | None = None) -> float:
    """The exponent, to DIGITS places, that meets the limit or the target; sources: tokens."""
    if (repetition is None) == (entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    size = F.col("tokens").cast("double")
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0

    def met(points: list[float]) -> list[bool]:
        if repetition is not None:
            found = sources.agg(*((F.max(F.pow(size, F.lit(a - 1))) / F.min(F.pow(size, F.lit(a - 1)))).alias(f"r{i}") for i, a in enumerate(points))).first()
            return [found[i] <= repetition * (1 + 1e-12) for i in range(len(points))]
        share = size / F.lit(float(total))
        columns = []
        for i, a in enumerate(points):
            columns += [F.sum(F.pow(share, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{i}")]
        found = sources.agg(*columns).first()
        # entropy of p^a / z falls as a grows; the largest a that keeps it is wanted: met from the other side
        return [math.log(found[2 * i]) - a * found[2 * i + 1] / found[2 * i] <= entropy for i, a in enumerate(points)]

    step = 10**DIGITS
    low, high = 0, step  # the least point of the grid at which it is met; 1 if none is
    if met([0.0])[0]:
        return 0.0
    while high - low > 1:
        points = sorted({low + (high - low) * i // (INNER + 1) for i in range(1, INNER + 1)} - {low, high}) or [(low + high) // 2]
        found = met([p / step for p in points])
        low, high = max([low, *(p for p, f in zip(points, found, strict=True) if not f)]), min([high, *(p for p, f in zip(points, found, strict=True) if f)])
    return high / step


def plan(rows: DataFrame, *, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None) -> tuple[DataFrame, float]:
    """For each source its tokens, weight, budget and blocks; and the whole budget, by default the least that uses all documents."""
    sources = common.store(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    power = exponent(sources, repetition=repetition, entropy=entropy)
    raised = F.pow(F.col("tokens").cast("double"), F.lit(power))
    total, least = sources.agg(F.sum(raised), F.min(raised / F.col("tokens"))).first()
    if budget is None:
        budget = total / least if total else 0
    weight = raised / F.lit(total or 1.0)
    planned = sources.select(
        "source", "tokens", weight.alias("weight"), (weight * F.lit(float(budget))).alias("due"), F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS)).cast("long").alias("blocks")
    )
    return planned, budget


def mix(docs: DataFrame, *keep: str, seed: int = 0, **targets) -> DataFrame:
    """doc_id, source, copy, n_tokens, slot and place: the mixed stream is in the order of slot and place."""
    common.prepare(docs.sparkSession)
    rows = tokens_of(docs, *keep) if keep else common.store(tokens_of(docs), "tokens")
    sources, budget = plan(rows, **targets)
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mark = place_hash(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    known = rows.withColumn("mark", mark).withColumn("salt", F.pmod("mark", F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"])
    known = known.withColumn("block", F.pmod(F.floor(F.col("mark") / SALTS), F.col("blocks")))
    # an epoch beyond rounding: due / tokens copies, the last one partial
    epochs = F.ceil(F.round(F.col("due") / F.col("tokens"), 9)).cast("int")
    in_blocks = known.groupBy("source", "block").agg(F.sum("n_tokens").alias("held"), F.first("tokens").alias("tokens"), F.first("due").alias("due"))
    copies = in_blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), epochs - 1)))
    turn = place_hash(F.lit(str(seed)), "source", F.col("block").cast("string"), F.col("copy").cast("string"))
    epoch = Window.partitionBy("source", "copy").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.withColumn("turn", turn).withColumn("before", F.col("copy") * F.col("tokens") + F.coalesce(F.sum("held").over(epoch), F.lit(0)))
    copies = copies.filter(F.col("before") < F.round(F.col("due"), 3)).select("source", "block", "copy", "before")
    drawn = known.drop("mark", "salt", "weight", "blocks").join(copies, ["source", "block"])
    inner = place_hash(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string"))
    block = Window.partitionBy("source", "block", "copy").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("place", inner).withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(block), F.lit(0)))
    slots = max(1, math.ceil(budget / BLOCK_TOKENS))
    slot = F.floor(F.round(F.col("at") / F.col("due"), 12) * slots).cast("long")
    plain = F.when(F.col("source") != "null", F.substring("source", 2, 2**31 - 1)).alias("source")
    return drawn.filter(F.col("at") < F.round(F.col("due"), 3)).select(*keep, "doc_id", plain, "copy", "n_tokens", slot.alias("slot"), "place")


def mixed_rows(docs: DataFrame, *, seed: int = 0, **targets) -> DataFrame:
    """The rows with their columns, as often as they are drawn.

    Rows are told apart by doc_id and text; equal rows are drawn alike. Only counts and keys are sorted, the texts move once.
    """
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    key = [F.col("doc_id").cast("long").alias("doc"), version.alias("version"), F.col("source").cast("string").alias("from")]
    narrow = docs.select("doc_id", "source", "text", version.alias("version"))
    drawn = mix(narrow, "version", seed=seed, **targets)
    times = drawn.groupBy(F.col("doc_id").alias("doc"), "version", F.col("source").alias("from")).agg(F.count("*").alias("drawn"))
    equal = docs.groupBy(*key).agg(F.count("*").alias("rows"))
    same = lambda a, b: a["doc"].eqNullSafe(b["doc"]) & (a["version"] == b["version"]) & a["from"].eqNullSafe(b["from"])
    names = common.free_names(docs, "key_doc", "key_version", "key_from", "times", "turn_of")
    times = times.join(equal, same(times, equal)).select(times["doc"], times["version"], times["from"], F.ceil(F.col("drawn") / F.col("rows")).cast("int")).toDF(*names[:4])
    met = (F.col("doc_id").cast("long").eqNullSafe(F.col(names[0]))) & (version == F.col(names[1])) & F.col("source").cast("string").eqNullSafe(F.col(names[2]))
    return docs.join(times, met).withColumn(names[4], F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*docs.columns)


ORACLE = rf"""
with recursive d as (
  select doc_id, coalesce('s' || source, 'null') as source,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1)::bigint as n_tokens
  from documents),
s as (select source, sum(n_tokens)::bigint as tokens, ceil(sum(n_tokens) / {BLOCK_TOKENS}.0)::bigint as blocks from d group by 1),
x as (select list(tokens::double) as ts from s),
bisect as (
  select ts, case when list_max(list_transform(ts, lambda t: pow(t, -1.0))) / list_min(list_transform(ts, lambda t: pow(t, -1.0))) <= {REPETITION} * (1 + 1e-12) then -1 else 0 end as low,
    case when list_max(list_transform(ts, lambda t: pow(t, -1.0))) / list_min(list_transform(ts, lambda t: pow(t, -1.0))) <= {REPETITION} * (1 + 1e-12) then 0 else 1000000 end as high from x
  union all
  select ts, case when fits then low else mid end, case when fits then mid else high end from (
    select ts, low, high, (low + high) // 2 as mid,
      list_max(list_transform(ts, lambda t: pow(t, ((low + high) // 2) / 1000000.0 - 1))) / list_min(list_transform(ts, lambda t: pow(t, ((low + high) // 2) / 1000000.0 - 1))) <= {REPETITION} * (1 + 1e-12) as fits
    from bisect where high - low > 1)),
e as (select min(high) / 1000000.0 as power from bisect),
r as (select source, tokens, blocks, pow(tokens::double, power) as raised from s, e),
total as (select sum(raised) as z, sum(raised) / min(raised / tokens) as budget from r),
p as (select source, tokens, blocks, raised / z * budget as due, budget from r, total),
k as (
  select d.doc_id, d.source, n_tokens, tokens, due, budget,
    (('0x' || substr(md5('0:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint // {SALTS}) % blocks as block
  from d join p on d.source = p.source),
b as (
  select source, block, copy, copy * tokens + coalesce(sum(held) over (partition by source, copy order by turn, block rows between unbounded preceding and 1 preceding), 0) as before, due from (
    select source, block, held, tokens, due, copy, ('0x' || substr(md5('0:' || source || ':' || block || ':' || copy), 1, 13))::bigint as turn from (
      select source, block, sum(n_tokens) as held, any_value(tokens) as tokens, any_value(due) as due, unnest(range(0, ceil(round(any_value(due) / any_value(tokens), 9))::bigint)) as copy from k group by 1, 2))),
i as (
  select k.doc_id, k.source, b.copy, n_tokens, k.due, budget, place,
    before + coalesce(sum(n_tokens) over (partition by k.source, k.block, b.copy order by place, k.doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as pos
  from k join b on k.source = b.source and k.block = b.block and b.before < round(b.due, 3),
  lateral (select ('0x' || substr(md5('0:' || coalesce(k.doc_id::varchar, 'null') || ':' || b.copy), 1, 13))::bigint as place))
select doc_id, case when source <> 'null' then substr(source, 2) end as source, copy::int as copy, n_tokens,
  floor(round(pos / due, 12) * greatest(1, ceil(budget / {BLOCK_TOKENS}.0)))::bigint as slot, place
from i where pos < round(due, 3)
"""
