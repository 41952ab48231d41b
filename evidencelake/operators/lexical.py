"""BM25 over many queries at once.

A chunk is one row, so its complete score for a query is known as soon as the
chunk's own term counts are.  The plan therefore moves only the occurrences of
query vocabulary, dealt by chunk; terms are counted and scores summed per query
and chunk where the chunk is, and every task keeps its own best ``k`` per query
(window group limit) before the final, small exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import sizing, text
from evidencelake.session import ensure_checkpoint_dir

SCORE_DIGITS = 9
_LENGTH_ROW = "\x00length"
#: Terms in more chunks than these are searched once for all queries that share them.
COMMON_CHUNKS = 500
#: Pairs of a query and a chunk in a part, about.  Fewer queries than the second count as so many, and more than the
#: third as so many: very many queries are short and meet few chunks each.  Only the number of parts follows from it.
PART_PAIRS, MIN_QUERIES, MOST_QUERIES = 1_500_000, 150, 2_000


@dataclass(frozen=True)
class Bm25:
    """Weighting parameters; ``rare_ratio`` bounds what counts as a rare term."""

    k1: float = 1.5
    b: float = 0.75
    rare_ratio: float = 0.01

    def __post_init__(self) -> None:
        if self.k1 <= 0 or not 0 <= self.b <= 1:
            raise ValueError("BM25 takes k1 above 0 and b from 0 to 1")
        if not 0 < self.rare_ratio <= 1:
            raise ValueError("a rare term is in some share of the chunks: above 0, at most 1")


def tokenize(df: DataFrame, text_col: str = "text", out: str = "terms") -> DataFrame:
    """Add the retrieval tokens of a text column."""
    return df.withColumn(out, text.tokens(F.col(text_col)))


def term_statistics(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Occurrences and chunk frequency of every term in one shuffle.

    Each chunk emits its occurrences and, flagged, its distinct terms; both
    counts are combined map-side, so a term found in every chunk stays cheap.
    """
    terms = text.tokens(F.col(text_col))
    marked = F.concat(
        F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
        F.transform(
            F.array_distinct(terms),
            lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")),
        ),
    )
    return (
        chunks.select(F.inline(marked))
        .groupBy("term")
        .agg(
            F.sum("tf").cast("bigint").alias("occurrences"),
            F.sum("df").cast("bigint").alias("chunk_frequency"),
        )
    )


def query_terms(queries: DataFrame, text_col: str = "query_text", scope_col: str | None = None) -> DataFrame:
    """Distinct terms per query as rows (scope, query_id, term)."""
    return queries.select(
        _scope(scope_col),
        "query_id",
        F.explode(F.array_distinct(text.tokens(F.col(text_col)))).alias("term"),
    )


def _scope(scope_col: str | None) -> Column:
    """Corpus a row belongs to; one common corpus when none is named."""
    return (F.lit(0) if scope_col is None else F.col(scope_col)).alias("scope")


@dataclass(frozen=True)
class Scopes:
    """Corpora that share chunks: ``rows`` (scope, chunk_id), and a scope that holds every chunk where one is named.

    Terms are counted once a chunk, whatever number of scopes it is in; scopes are attached to the counts.
    """

    rows: DataFrame
    everywhere: str | None = None


def _deal_by_chunk(rows: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows of a chunk in one task, in as many parts as bound the (query, chunk) pairs that a task may hold."""
    pairs = chunks.count() * min(max(queries.count(), MIN_QUERIES), MOST_QUERIES)
    parts = max(-(-pairs // PART_PAIRS), chunks.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, "chunk_id")


def _terms(chunks: DataFrame, text_col: str) -> Column:
    return F.col("terms") if "terms" in chunks.columns else text.tokens(F.col(text_col))


def _corpus_sizes(chunks: DataFrame, scope_col: str | None, text_col: str) -> DataFrame:
    """scope, n, average length, added up where the chunks are read.

    With very many queries counts are dealt by term, and the length rows of all chunks would be one term of one task.
    """
    lengths = chunks.select(_scope(scope_col), "chunk_id", F.size(_terms(chunks, text_col)).cast("double").alias("length"))
    return lengths.where(F.col("scope").isNotNull()).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))


def _chunk_terms(
    chunks: DataFrame, queries: DataFrame, vocabulary: DataFrame, small: bool, scope_col: str | None, scopes: Scopes | None, text_col: str, lengths: bool
) -> DataFrame:
    """Counts of vocabulary terms per chunk plus, with ``lengths``, one length row for each chunk.

    The length row keeps chunks without any query term in the corpus size and
    in the average length, and lets both be read from the same exchange.  With
    few queries that exchange deals by chunk, so neither the counts nor the
    scores of a chunk need another, and no task counts terms before it.
    """
    found = _terms(chunks, text_col)
    keys = ["term"] if scopes is not None else ["scope", "term"]
    wanted = vocabulary.select(*keys).distinct() if scopes is not None else vocabulary
    occurrences = (
        chunks.select(_scope(scope_col), "chunk_id", found.alias("terms"))
        .withColumn("length", F.size("terms"))
        .select("scope", "chunk_id", "length", F.explode(F.array_append("terms", F.lit(_LENGTH_ROW)) if lengths else F.col("terms")).alias("term"))
        .where(F.col("term").isNotNull() & F.col("scope").isNotNull())
        .join(sizing.hint(wanted, small), keys, "left_semi")
        .select("scope", "chunk_id", "length", "term")
    )
    if small:
        occurrences = _deal_by_chunk(occurrences, chunks, queries)
    counts = occurrences.groupBy("scope", "chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    if scopes is None:
        return counts
    bare, rows = counts.drop("scope"), scopes.rows.select("scope", "chunk_id")
    if scopes.everywhere is not None:
        rows = rows.unionByName(chunks.select(F.lit(scopes.everywhere).alias("scope"), "chunk_id").distinct())
    placed = bare.join(rows, "chunk_id").select("scope", *bare.columns)
    return placed.join(sizing.hint(vocabulary, small), ["scope", "term"], "left_semi")


@dataclass(frozen=True)
class LexicalScores:
    """Scored pairs together with the per-query facts confidence needs."""

    pairs: DataFrame
    query_facts: DataFrame


@dataclass(frozen=True)
class _Weighed:
    """Counts of query terms per chunk, frequencies of these terms and the terms of the queries."""

    counts: DataFrame
    frequency: DataFrame
    terms: DataFrame
    small: bool


def _weigh(
    chunks: DataFrame, queries: DataFrame, params: Bm25, scope_col: str | None, scopes: Scopes | None, text_col: str, max_query_terms: int,
    *, stored: bool = False,
) -> _Weighed:
    terms = query_terms(queries, scope_col=scope_col)
    small = sizing.fits(terms, max_query_terms)
    lengths = small or scopes is not None
    vocabulary = terms.select("scope", "term")
    if lengths:
        vocabulary = vocabulary.unionByName(terms.select("scope", F.lit(_LENGTH_ROW).alias("term")))
    vocabulary = vocabulary.distinct()
    counts = _chunk_terms(chunks, queries, vocabulary, small, None if scopes else scope_col, scopes, text_col, lengths)
    if stored and not small:  # they are read by several joins
        ensure_checkpoint_dir(chunks.sparkSession)
        counts = counts.checkpoint()

    # The length rows hold the corpus size and average length of their scope: one row
    # per scope, of which the queries name no more than they have terms.  They are told
    # apart after the count, so that all readers of the counts share one exchange.
    totals = counts.groupBy("scope", "term").agg(
        F.count(F.lit(1)).alias("df"), F.avg(F.col("length").cast("double")).alias("average"),
        F.bool_or(F.col("term") == F.lit(_LENGTH_ROW)).alias("is_length"),
    )
    sizes = totals.where("is_length").select("scope", F.col("df").alias("n"), "average") if lengths else _corpus_sizes(chunks, scope_col, text_col)
    # the average is read on both sides, so that both are one plan up to here
    held = totals.where(~F.col("is_length") & F.col("average").isNotNull()).select("scope", "term", "df")
    frequency = held.join(sizing.hint(sizes, small), "scope").select(
        "scope",
        "term",
        "df",
        "average",
        F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
        (F.col("df") <= F.greatest(F.lit(1), F.ceil(F.col("n") * params.rare_ratio))).alias("rare"),
    )
    return _Weighed(counts, frequency, terms, small)


def _weight(params: Bm25) -> Column:
    """Share of one term in the score of a chunk, from idf, tf, length and average."""
    ratio = F.when(F.col("average") > 0, F.col("length") / F.col("average")).otherwise(F.lit(0.0))
    return F.col("idf") * (
        F.col("tf") * (params.k1 + 1) / (F.col("tf") + params.k1 * (1 - params.b + params.b * ratio))
    )


def _summed(matches: DataFrame, *by: str) -> DataFrame:
    """Scores and match counts of rows with ``weight`` and ``rare``."""
    return matches.groupBy("scope", *by, "chunk_id").agg(
        F.round(F.sum("weight"), SCORE_DIGITS).alias("score"),
        F.count(F.lit(1)).cast("bigint").alias("matched_terms"),
        F.count_if("rare").cast("bigint").alias("matched_rare_terms"),
    ).where(F.col("score") > 0)


def _term_weights(weighed: _Weighed) -> DataFrame:
    return weighed.frequency.join(sizing.hint(weighed.terms, weighed.small), ["scope", "term"]).drop("df")


def _all_pairs(weighed: _Weighed, params: Bm25) -> DataFrame:
    matches = weighed.counts.join(sizing.hint(_term_weights(weighed), weighed.small), ["scope", "term"])
    return _summed(matches.withColumn("weight", _weight(params)), "query_id").drop("scope")


def score(
    chunks: DataFrame,
    queries: DataFrame,
    *,
    params: Bm25 = Bm25(),
    scope_col: str | None = None,
    scopes: Scopes | None = None,
    text_col: str = "text",
    max_query_terms: int = sizing.DEFAULT_ROWS,
) -> LexicalScores:
    """Score every (query, chunk) pair of one scope that shares a term.

    ``chunks``: chunk_id and text (or a ready ``terms`` array); ``queries``:
    query_id and query_text.  With ``scope_col`` both carry the corpus they
    belong to, and corpus size, lengths and frequencies are per scope, so many
    snapshots are searched in one job.  Where scopes share chunks, ``scopes``
    names them and only ``queries`` carry the column.

    ``pairs``: query_id, chunk_id, score, matched_terms, matched_rare_terms.
    ``query_facts``: query_id, term_count, rare_term_count.
    """
    weighed = _weigh(chunks, queries, params, scope_col, scopes, text_col, max_query_terms)
    weights = _term_weights(weighed)
    rare = weights.groupBy("query_id").agg(F.count_if("rare").cast("bigint").alias("rare_term_count"))
    facts = (
        queries.select(
            F.col("query_id"),
            F.size(F.array_distinct(text.tokens(F.col("query_text")))).cast("bigint").alias("term_count"),
        )
        .join(rare, "query_id", "left")
        .withColumn("rare_term_count", F.coalesce("rare_term_count", F.lit(0).cast("bigint")))
    )
    return LexicalScores(_all_pairs(weighed, params), facts)


def _contenders(weighed: _Weighed, params: Bm25, k: int, common_df: int) -> DataFrame:
    """Pairs that hold the best ``k`` chunks of every query, with whole scores where they can win.

    Terms in more than ``common_df`` chunks are common.  The common terms of a query are a set that many queries may
    share: each set is searched once and keeps its best ``k``.  A chunk with another term of the query is met by that
    term and gets its common terms by chunk and term.  A chunk with common terms alone that is not among the best of
    their set has ``k`` chunks before it whatever else those hold, so nothing is lost.
    """
    counts, terms = weighed.counts, weighed.terms
    is_common = F.col("df") > common_df
    known = terms.join(weighed.frequency, ["scope", "term"])
    common = known.where(is_common)
    sets = common.groupBy("scope", "query_id").agg(F.sort_array(F.collect_list("term")).alias("shared"))
    sets = sets.withColumn("set_id", F.sha2(F.array_join("shared", " "), 256))
    members = sets.groupBy("scope", "set_id").agg(F.first("shared").alias("shared")).select("scope", "set_id", F.explode("shared").alias("term"))
    weight = _weight(params).alias("weight")
    set_matches = counts.join(members.join(weighed.frequency, ["scope", "term"]), ["scope", "term"])
    set_pairs = _summed(set_matches.select("scope", "set_id", "chunk_id", "rare", weight), "set_id")
    order = Window.partitionBy("scope", "set_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    best = set_pairs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
    of_sets = sets.select("scope", "query_id", "set_id").join(best, ["scope", "set_id"]).drop("set_id")

    own = counts.join(known.where(~is_common), ["scope", "term"]).select("scope", "query_id", "chunk_id", "rare", weight)
    met = own.select("scope", "query_id", "chunk_id").distinct().join(
        common.select("scope", "query_id", "term", "average", "idf", "rare"), ["scope", "query_id"]
    )
    added = met.join(counts, ["scope", "chunk_id", "term"]).select("scope", "query_id", "chunk_id", "rare", weight)
    whole = _summed(own.unionByName(added), "query_id")
    found = whole.unionByName(of_sets).groupBy("scope", "query_id", "chunk_id")
    # the pair of a set lacks the other terms of the query, so the greater one is whole
    return found.agg(*[F.max(c).alias(c) for c in ("score", "matched_terms", "matched_rare_terms")]).drop("scope")


def top_k(scored: DataFrame, k: int, *, min_score: float | None = None, by: str = "query_id") -> DataFrame:
    """Best ``k`` rows per query, highest score first, ties by chunk id."""
    if k <= 0:
        raise ValueError("k counts rows: 1 or more")
    kept = scored if min_score is None else scored.where(F.col("score") >= min_score)
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("chunk_id"))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    chunks: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    min_score: float = 0.0,
    params: Bm25 = Bm25(),
    scope_col: str | None = None,
    scopes: Scopes | None = None,
    text_col: str = "text",
    max_query_terms: int = sizing.DEFAULT_ROWS,
    common_df: int = COMMON_CHUNKS,
) -> DataFrame:
    """Ranked chunks per query: query_id, chunk_id, score, rank and match counts.

    Where the queries are not proven few, what they share of common terms is searched once a set of terms.
    """
    if min_score < 0:
        raise ValueError("min_score is 0 or more")
    if k <= 0:
        raise ValueError("k counts rows: 1 or more")
    weighed = _weigh(chunks, queries, params, scope_col, scopes, text_col, max_query_terms, stored=True)
    pairs = _all_pairs(weighed, params) if weighed.small else _contenders(weighed, params, k, common_df)
    return top_k(pairs, k, min_score=min_score)
