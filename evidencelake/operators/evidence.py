"""Decomposed retrieval, evidence groups and evidence safety."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text
from evidencelake.operators import lexical
from evidencelake.session import ensure_checkpoint_dir

# Patterns of text that tries to act as an instruction.
SAFETY_PATTERNS = {
    "role_marker": r"(?:\[(?:system|assistant|developer)\]|<(?:system|assistant|developer)>|(?:^|\n)(?:system|assistant|developer)\s*:)",
    "instruction_override": (
        r"(?:ignore\s+(?:a\s+pergunta|as\s+instrucoes|instrucoes\s+anteriores|previous\s+instructions)|"
        r"retorne\s+insufficient[_ ]evidence|return\s+insufficient[_ ]evidence|responda\s+[a-z0-9_-]+|output\s+[a-z0-9_-]+)"
    ),
    "response_shaped": r'\{[^{}]{0,500}"(?:status|claims|answer|text)"\s*:',
    "citation_manipulation": r"(?:cite|citar|use)\s+(?:o\s+)?evidence[_ -]?id\b",
}

COMPARISON_SCOPE = "comparison"


def safety_signals(value: Column) -> Column:
    """Names of the suspicious patterns found in a text."""
    plain = text.strip_marks(value)
    return F.array_compact(
        F.array(*[F.when(plain.rlike(f"(?iU){p}"), F.lit(name)) for name, p in SAFETY_PATTERNS.items()])
    )


def safety_summary(rows: DataFrame, found: Column, expected: Column) -> DataFrame:
    """Recall, specificity, exact signal match and quarantine accuracy."""
    flags = rows.select(F.array_sort(found).alias("f"), F.array_sort(expected).alias("e")).select(
        (F.size("f") > 0).alias("flagged"), (F.size("e") > 0).alias("attack"), (F.col("f") == F.col("e")).alias("exact")
    )
    rate = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return flags.agg(
        F.count(F.lit(1)).cast("bigint").alias("case_count"),
        rate(F.col("exact"), "exact_signal_match"),
        rate(F.when(F.col("attack"), F.col("flagged")), "attack_recall"),
        rate(F.when(~F.col("attack"), ~F.col("flagged")), "legitimate_specificity"),
        rate(F.col("attack") == F.col("flagged"), "quarantine_accuracy"),
    )


def scopes(snapshots: DataFrame) -> lexical.Scopes:
    """All chunks for comparisons, and for each date the chunks valid on it.

    ``snapshots``: reference_date, chunk_id.
    """
    rows = snapshots.select("chunk_id", F.col("reference_date").cast("string").alias("scope"))
    return lexical.Scopes(rows, COMPARISON_SCOPE)


#: (chunks, questions, k, scopes) to ranked chunks, as :func:`lexical.search`; questions carry ``corpus``.
Retriever = Callable[[DataFrame, DataFrame, int, lexical.Scopes], DataFrame]


def bm25(chunks: DataFrame, asked: DataFrame, k: int, within: lexical.Scopes) -> DataFrame:
    return lexical.search(chunks, asked, k=k, scope_col="corpus", scopes=within)


def execute(
    steps: DataFrame, chunks: DataFrame, snapshots: DataFrame, threshold: float, k: int, *, retriever: Retriever = bm25
) -> tuple[DataFrame, DataFrame]:
    """Run every planned step in its own corpus.

    ``steps``: query_id, step_id, position, query, reference_date.  Returns
    evidence rows of ready steps and one status row per step; a step below the
    threshold releases nothing.
    """
    ensure_checkpoint_dir(steps.sparkSession)
    key = F.concat_ws("/", F.col("query_id").cast("string"), "step_id")
    asked = steps.select(
        key.alias("query_id"),
        F.col("query").alias("query_text"),
        F.coalesce(F.col("reference_date").cast("string"), F.lit(COMPARISON_SCOPE)).alias("corpus"),
    )
    ranked = retriever(chunks, asked, k, scopes(snapshots))
    # same partitioning as the ranking itself
    whole_step = Window.partitionBy("query_id")
    accepted = (
        ranked.withColumn("top_score", F.max("score").over(whole_step))
        .where(F.col("top_score") >= threshold)
        .select(F.col("query_id").alias("step_key"), "rank", "chunk_id", "score")
        .checkpoint()  # k rows a step, read by all that follows; the search runs once
    )
    keyed = steps.withColumn("step_key", key)
    ready = accepted.groupBy("step_key").agg(F.lit(True).alias("ready"))
    states = keyed.join(ready, "step_key", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))
    evidence = keyed.select("query_id", "step_id", "position", "step_key").join(accepted, "step_key")
    return evidence.drop("step_key"), states.drop("step_key")


def execution_status(planned: DataFrame, states: DataFrame) -> DataFrame:
    """ready only when every step is; unclear plans keep their status.

    ``planned``: query_id, plan_status.
    """
    per_query = states.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("step_count"),
        F.count_if("ready").cast("bigint").alias("ready_steps"),
        F.bool_and("ready").alias("all_ready"),
    )
    return planned.select("query_id", "plan_status").join(per_query, "query_id", "left").select(
        "query_id",
        F.when(F.col("plan_status") == "needs_clarification", "needs_clarification")
        .when(F.col("all_ready"), "ready")
        .otherwise("insufficient_evidence")
        .alias("status"),
        F.coalesce("step_count", F.lit(0)).cast("bigint").alias("step_count"),
        F.coalesce("ready_steps", F.lit(0)).cast("bigint").alias("ready_steps"),
    )


def bundles(statuses: DataFrame, states: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per query: can_generate, ordered steps and ordered evidence.

    A query has at most ``steps x k`` evidence rows, so the arrays are small.
    ``evidence`` carries text, document_id, section and needs_review.
    """
    steps = states.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "step_id", "scope", "reference_date"))).alias("steps")
    )
    found = evidence.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "position", "rank", "step_id", F.col("chunk_id").cast("string").alias("chunk_id"),
                    "document_id", F.lit(None).cast("int").alias("page"), "section", "text", "needs_review",
                )
            )
        ).alias("evidence")
    )
    return (
        statuses.select("query_id", (F.col("status") == "ready").alias("can_generate"))
        .join(steps, "query_id", "left")
        .join(found, "query_id", "left")
    )


def observable(packed: DataFrame) -> DataFrame:
    """What a golden comparison sees of a bundle: its gate and, in order, steps with the places of their citations."""
    citations = lambda step: F.transform(
        F.filter("evidence", lambda e: e["step_id"] == step["step_id"]),
        lambda e: F.struct(e["chunk_id"].alias("chunk_id"), e["document_id"].alias("document_id"), e["rank"].cast("bigint").alias("rank")),
    )
    groups = F.transform(
        "steps",
        lambda s: F.struct(
            s["step_id"].alias("step_id"), s["reference_date"].cast("string").alias("reference_date"), s["scope"].alias("scope"),
            F.coalesce(citations(s), F.array().cast("array<struct<chunk_id:string,document_id:string,rank:bigint>>")).alias("citations"),
        ),
    )
    nothing = F.array().cast(
        "array<struct<step_id:string,reference_date:string,scope:string,citations:array<struct<chunk_id:string,document_id:string,rank:bigint>>>>"
    )
    return packed.select("query_id", "can_generate", F.coalesce(groups, nothing).alias("groups"))


def preservation(expected: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """Shares of groups that kept their step and their citations, of bundles that are equal and of gates that agree.

    Groups are compared place by place and citations in their order; a place that only one side has counts as lost.
    A bundle without an actual one counts with all its groups lost.  ``actual`` holds one row for each of ``by``.
    """
    wanted = expected.select("query_id", F.col("can_generate").alias("gate"), F.col("groups").alias("wanted"))
    joined = actual.join(wanted, "query_id", "right")
    both = F.arrays_zip(F.col("wanted").alias("w"), F.coalesce("groups", F.slice("wanted", 1, 0)).alias("a"))
    context = lambda g: F.struct(g["step_id"], g["reference_date"], g["scope"])
    present = lambda z: z["w"].isNotNull() & z["a"].isNotNull()
    count = lambda test: F.size(F.filter("both", lambda z: present(z) & test(z)))
    rows = joined.withColumn("both", both).select(
        *by,
        F.size("both").alias("n"),
        count(lambda z: context(z["w"]).eqNullSafe(context(z["a"]))).alias("contexts"),
        count(lambda z: z["w"]["citations"].eqNullSafe(z["a"]["citations"])).alias("citations"),
        F.col("can_generate").eqNullSafe(F.col("gate")).alias("same_gate"),
    )
    exact = (F.col("contexts") == F.col("n")) & (F.col("citations") == F.col("n")) & F.col("same_gate")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("case_count"),
        F.sum("n").cast("bigint").alias("group_count"),
        F.round(F.avg(exact.cast("int")), 6).alias("exact_match"),
        F.round(F.sum("contexts") / F.sum("n"), 6).alias("context_preservation_accuracy"),
        F.round(F.sum("citations") / F.sum("n"), 6).alias("citation_preservation_accuracy"),
        F.round(F.avg(F.col("same_gate").cast("int")), 6).alias("generation_gate_accuracy"),
    )
