"""Strict readers of JSON payloads, one a row.

A payload is read against its fields.  What does not fit exactly, an unknown field, a missing one, another type, a
value outside of a closed list or an id that occurs twice, is a row with its problem; nothing is coerced or dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DATE = r"^\d{4}-\d{2}-\d{2}$"
KINDS = ("string", "integer", "boolean", "date", "strings", "pairs")


@dataclass(frozen=True)
class Field:
    """Type of a field; an optional one may be absent or null."""

    kind: str
    required: bool = True
    values: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of field: {self.kind}")


# Fields, states and intents of the payload formats.
ANALYSIS = {
    "intent": Field("string", values=("audit_case", "comparison", "document_lookup", "external_lookup", "general")),
    "requires_external_data": Field("boolean"),
    "requires_decomposition": Field("boolean"),
}
RULE = {
    "rule_id": Field("string"), "version": Field("integer"), "subject": Field("string"), "action": Field("string"),
    "decision": Field("string", values=("allow", "deny")), "effective_from": Field("date"), "effective_until": Field("date", required=False),
    "priority": Field("integer"), "conditions": Field("pairs", required=False), "source_document_id": Field("string"),
}
ENTITY = {"entity_id": Field("string"), "entity_type": Field("string"), "aliases": Field("strings", required=False)}
EDGE = {name: Field("string") for name in ("source_id", "relation", "target_id", "document_id", "chunk_id")}
RELATION_POLICY = {"name": Field("string"), "version": Field("integer"), "allowed_relations": Field("strings")}
CHUNK = {
    "chunk_id": Field("string"), "document_id": Field("string"), "text": Field("string"),
    "page": Field("integer", required=False), "section": Field("string", required=False),
}
CASE = {"id": Field("string"), "query": Field("string"), "status": Field("string"), "document_ids": Field("strings")}


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _part(name: str, kind: str = "variant") -> Column:
    return F.try_variant_get("_json", f"$.{name}", kind)


def _fits(name: str, field: Field) -> Column:
    value = _part(name)
    held = {
        "string": _type(value) == "STRING",
        "integer": _type(value) == "BIGINT",
        "boolean": _type(value) == "BOOLEAN",
        "date": _type(value) == "STRING",
        "strings": F.forall(_part(name, "array<variant>"), lambda x: F.coalesce(_type(x), F.lit("VOID")) == "STRING"),
        "pairs": F.forall(F.map_values(_part(name, "map<string,variant>")), lambda x: F.coalesce(_type(x), F.lit("VOID")) == "STRING"),
    }[field.kind]
    return F.coalesce(held, F.lit(False))


def _value(name: str, field: Field) -> Column:
    kind = {"string": "string", "integer": "bigint", "boolean": "boolean", "date": "string", "strings": "array<string>", "pairs": "map<string,string>"}
    value = _part(name, kind[field.kind])
    return F.try_to_date(value, "yyyy-MM-dd") if field.kind == "date" else value


def read(rows: DataFrame, column: str, fields: dict[str, Field]) -> DataFrame:
    """Adds the fields as columns and ``problem``, NULL where the payload fits; of one that does not no field is given.

    The first of these counts: ``malformed``, ``not_an_object``, ``unexpected:<fields>``, ``missing:<fields>``,
    ``wrong_type:<field>``, ``invalid_value:<field>``.
    """
    keys = F.json_object_keys(column)
    known = F.array(*map(F.lit, fields))
    needed = F.array(*(F.lit(name) for name, field in fields.items() if field.required)).cast("array<string>")
    listed = lambda values: F.array_join(F.array_sort(values), ",")
    unexpected, missing = F.array_except(keys, known), F.array_except(needed, keys)
    absent = lambda name: ~F.array_contains(keys, name) | (F.coalesce(_type(_part(name)), F.lit("VOID")) == "VOID")
    wrong, invalid = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, field in reversed(fields.items()):
        bad = ~_fits(name, field)
        wrong = F.when(bad if field.required else ~absent(name) & bad, f"wrong_type:{name}").otherwise(wrong)
        if field.kind == "date":
            text = _part(name, "string")
            outside = text.isNotNull() & ~(text.rlike(_DATE) & F.try_to_date(text, "yyyy-MM-dd").isNotNull())
        elif field.values:
            outside = ~_part(name, "string").isin(*field.values)
        else:
            continue
        invalid = F.when(outside, f"invalid_value:{name}").otherwise(invalid)
    problem = (
        F.when(F.col("_json").isNull(), "malformed")
        .when(keys.isNull(), "not_an_object")
        .when(F.size(unexpected) > 0, F.concat(F.lit("unexpected:"), listed(unexpected)))
        .when(F.size(missing) > 0, F.concat(F.lit("missing:"), listed(missing)))
        .otherwise(F.coalesce(wrong, invalid))
    )
    judged = rows.withColumn("_json", F.try_parse_json(column)).withColumn("problem", problem)
    clean = F.col("problem").isNull()
    return judged.select(*rows.columns, *(F.when(clean, _value(n, f)).alias(n) for n, f in fields.items()), "problem")


def reject_repeats(rows: DataFrame, keys: list[str], problem: str) -> DataFrame:
    """Marks every accepted row whose key occurs in more than one of them; keys are counted, their rows never listed."""
    accepted = F.col("problem").isNull()
    counts = rows.where(accepted).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    joined = rows.join(counts, keys, "left")
    return joined.withColumn("problem", F.when(accepted & F.col("_n").isNotNull(), problem).otherwise(F.col("problem"))).drop("_n").select(*rows.columns)


def rules(rows: DataFrame, column: str) -> DataFrame:
    """Rule payloads as rule rows; a version given twice is rejected in both places."""
    found = reject_repeats(read(rows, column, RULE), ["rule_id", "version"], "repeated_rule_version")
    empty = F.create_map().cast("map<string,string>")
    return found.withColumn("conditions", F.when(F.col("problem").isNull(), F.coalesce("conditions", empty)))


def execution_dataset(chunks: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two corpora and the cases that ask them: (chunk rows, case rows), each with its problem.

    ``chunks``: corpus (``comparison`` or a reference date as text) and payload; ``cases``: payload.  Chunk ids are
    unique over all corpora, case ids over all cases, and a case may only expect documents that some accepted chunk has.
    """
    held = read(chunks, "payload", CHUNK)
    dated = F.col("corpus").rlike(_DATE) & F.try_to_date("corpus", "yyyy-MM-dd").isNotNull()
    held = held.withColumn("problem", F.when(F.col("problem").isNull() & ~F.coalesce((F.col("corpus") == "comparison") | dated, F.lit(False)), "unknown_corpus").otherwise(F.col("problem")))
    held = reject_repeats(held, ["chunk_id"], "repeated_chunk_id")
    asked = reject_repeats(read(cases, "payload", CASE), ["id"], "repeated_case_id")
    wanted = asked.where(F.col("problem").isNull()).select("id", F.explode("document_ids").alias("document_id"))
    documents = held.where(F.col("problem").isNull()).select("document_id").distinct()
    unknown = wanted.join(documents, "document_id", "left_anti").select("id").distinct().withColumn("_unknown", F.lit(True))
    joined = asked.join(unknown, "id", "left")
    problem = F.when(F.col("problem").isNull() & F.col("_unknown").isNotNull(), "unknown_document").otherwise(F.col("problem"))
    return held, joined.withColumn("problem", problem).drop("_unknown").select(*asked.columns)
