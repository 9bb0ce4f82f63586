"""Checks of events and tables against their contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tickforge.contracts import EVENT_CONTRACTS, LINEAGE_COLUMNS, TABLE_CONTRACTS, Field


def _seen(field: Field) -> Column:
    """What one document holds under a name: its JSON type, its text or its number."""
    at = f"'$.{field.name}'"
    parts = [F.expr(f"schema_of_variant(try_variant_get(document, {at}, 'variant'))").alias("kind")]
    if field.one_of or field.kind == "time":
        parts.append(F.expr(f"try_variant_get(document, {at}, 'string')").alias("text"))
    if field.kind in ("integer", "number"):
        parts.append(F.expr(f"try_variant_get(document, {at}, 'double')").alias("number"))
    return F.struct(*parts).alias(field.name)


def _type_ok(field: Field, seen: Column) -> Column:
    kind = seen["kind"]
    if field.kind in ("integer", "number"):
        ok = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        if field.kind == "integer":
            ok = ok & ((kind == "BIGINT") | (seen["number"] == F.floor(seen["number"])))
    elif field.kind == "object":
        ok = kind.startswith("OBJECT")
    elif field.kind == "strings":
        ok = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
    else:
        ok = kind == "STRING"
    return (ok | (kind == "VOID")) if field.nullable else ok


def _rules(field: Field, seen: Column) -> list[Column]:
    """One column per rule: the rule's name when broken, else NULL."""
    present = seen["kind"].isNotNull()
    rules = []

    def broken(when: Column, rule: str) -> None:
        rules.append(F.when(when, F.lit(f"{rule}:{field.name}")))

    if field.required:
        broken(~present, "required")
    broken(present & ~_type_ok(field, seen), "type")
    if field.kind == "time":
        broken(seen["text"].isNotNull() & F.try_to_timestamp(seen["text"]).isNull(), "format")
    if field.one_of:
        allowed = F.coalesce(seen["text"].isin(*field.one_of), F.lit(False))
        broken(present & ~allowed, "const" if len(field.one_of) == 1 else "enum")
    if field.at_least is not None:
        broken(seen["number"] < field.at_least, "minimum")
    if field.above is not None:
        broken(seen["number"] <= field.above, "exclusiveMinimum")
    return rules


# What schema_of_variant says of a value that surely has its type; other values are looked at one by one.
SURE = {"integer": "BIGINT", "number": r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))", "object": "OBJECT<[^<>`]*>", "strings": "ARRAY<(?:STRING|VOID)>"}


def _shape(fields: tuple[Field, ...]) -> str:
    """Matches the schema of documents that hold every required field and no unknown one, all of their types.

    The schema names the fields in order and quotes names that are no plain words.
    """
    parts = []
    for field in sorted(fields, key=lambda f: f.name):
        kind = SURE.get(field.kind, "STRING")
        kind = f"(?:{kind}|VOID)" if field.nullable else kind
        parts.append(f"(?:{field.name}: {kind}(?:, |>\\z))" + ("" if field.required else "?"))
    return r"\AOBJECT<" + "".join(parts) + r"\z"


def _sound(fields: tuple[Field, ...]) -> Column:
    """Whether a document surely breaks no rule; not TRUE where that takes a closer look."""
    tests = [F.expr("schema_of_variant(document)").rlike(_shape(fields))]
    for field in fields:
        read = lambda kind: F.expr(f"try_variant_get(document, '$.{field.name}', '{kind}')")  # noqa: B023, E731
        if field.one_of:
            tests.append(read("string").isin(*field.one_of))
        if field.kind == "time":
            tests.append(F.try_to_timestamp(read("string")).isNotNull())
        if field.at_least is not None:
            tests.append(read("double") >= field.at_least)
        if field.above is not None:
            tests.append(read("double") > field.above)
    return reduce(lambda a, b: a & b, tests)


def _broken(fields: tuple[Field, ...], text: str) -> Column:
    """The broken rules of a document in name order, each field looked up once.

    All of it is inside a lambda: that is interpreted, only for the documents that need it,
    and keeps the generated code small enough to be compiled.
    """
    known = F.array(*[F.lit(field.name) for field in fields])
    looked_up = F.struct(
        *[_seen(field) for field in fields],
        F.array_except(F.json_object_keys(text), known).alias("unknown"),
    )

    def found(seen: Column) -> Column:
        rules = [rule for field in fields for rule in _rules(field, seen[field.name])]
        unknown = F.transform(seen["unknown"], lambda name: F.concat(F.lit("unknown:"), name))
        readable = F.col("document").isNotNull() & seen["unknown"].isNotNull()
        return F.when(readable, F.array_sort(F.concat(F.array_compact(F.array(*rules)), unknown))).otherwise(F.array(F.lit("malformed")))

    return F.transform(F.array(looked_up), found)[0]


def contract_violations(events: DataFrame, contract: str, text: str = "value") -> DataFrame:
    """Add ``violations``: the broken rules of each JSON event, in name order.

    The document is parsed once; the generator keeps the optimizer from repeating that.
    Sound documents are told by one look at their schema and the fields with bounds; rules are
    looked up one by one for the others.
    """
    fields = EVENT_CONTRACTS[contract]
    parsed = events.withColumn("document", F.explode(F.array(F.try_parse_json(text))))
    none = F.array().cast("array<string>")
    return parsed.withColumn("violations", F.when(_sound(fields), none).otherwise(_broken(fields, text))).drop("document")


def table_conformance(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and required column: whether it is there, and its NULL count."""
    return reduce(DataFrame.unionByName, [_conformance(name, df) for name, df in tables.items()])


def _conformance(name: str, df: DataFrame) -> DataFrame:
    contract = TABLE_CONTRACTS.get(name)
    if contract is None:
        return df.limit(0).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"),
            F.lit(None).cast("string").alias("column_name"),
            F.lit(False).alias("present"),
            F.lit(None).cast("long").alias("null_count"),
            F.lit(None).cast("long").alias("row_count"),
            F.lit(False).alias("is_partition"),
            F.lit(False).alias("is_lineage"),
            F.lit("unknown_table").alias("error"),
        )
    there = set(df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in contract.required_columns if c in there],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c in there).alias("present"),
            (F.col(f"nulls_{c}") if c in there else F.lit(None).cast("long")).alias("null_count"),
            F.lit(c in contract.partition_columns).alias("is_partition"),
            F.lit(c in LINEAGE_COLUMNS).alias("is_lineage"),
        )
        for c in contract.required_columns
    ]
    return counts.select("row_count", F.explode(F.array(*entries)).alias("entry")).select(
        F.lit(name).alias("table_name"),
        "entry.column_name",
        "entry.present",
        "entry.null_count",
        "row_count",
        "entry.is_partition",
        "entry.is_lineage",
        F.lit(None).cast("string").alias("error"),
    )
