"""Agent responses: free text with fenced JSON blocks -> findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from findmill import vocab
from findmill.functions import coerce
from findmill.functions.once import computed_once
from findmill.functions.text import SPACE
from findmill.operators.ordering import order_text

# Fixed value: a fenced JSON block, any case, over several lines, shortest match
JSON_FENCE = rf"(?is)```json{SPACE}*(.*?){SPACE}*```"

# The keys read from each item
FIELDS = [
    "id", "category", "severity", "confidence", "file", "line_start", "line_end", "title",
    "description", "impact", "recommendation", "code_snippet", "suggested_fix",
]


def json_blocks(text: Column) -> Column:
    """Contents of all fenced JSON blocks, in order."""
    return F.regexp_extract_all(text, F.lit(JSON_FENCE), 1)


def explode_blocks(responses: DataFrame) -> DataFrame:
    """One row per fenced block: adds block_no and block."""
    return responses.select(
        "*", F.posexplode(json_blocks(F.col("text"))).alias("block_no", "block")
    ).drop("text")


def parse_responses(responses: DataFrame, source: str = vocab.AI) -> DataFrame:
    """Findings of agent responses (report_id, response_no, agent, default_category, text).

    Broken JSON and non-object items yield nothing.  The agent is the caller's,
    whatever the record says.  ``ord`` follows response, block and item order without
    a sort, so this also runs on a streaming DataFrame.
    """
    exploded = (
        explode_blocks(responses)
        .withColumn("parsed", F.try_parse_json("block"))
        .select(
            "report_id", "response_no", "agent", "default_category", "block_no",
            F.posexplode(coerce.elements(F.col("parsed"))).alias("item_no", "item"),
        )
        .filter(coerce.is_object(F.col("item")))
    )
    items = computed_once(
        exploded, ["report_id", "response_no", "agent", "default_category", "block_no", "item_no"],
        {f"v_{name}": coerce.field(F.col("item"), name) for name in FIELDS},
    )

    def value(name: str) -> Column:
        return F.col(f"v_{name}")

    numbers = [value(n) for n in ("confidence", "line_start", "line_end")]
    broken = coerce.overflows(numbers[0]) | coerce.overflows(numbers[1]) | coerce.overflows(numbers[2])
    made_id = F.sha2(
        F.concat_ws("|", "report_id", "agent", "response_no", "block_no", "item_no"), 256
    )
    return items.filter(~broken).select(
        "report_id",
        order_text(F.col("response_no"), F.col("block_no"), F.col("item_no")).alias("ord"),
        F.coalesce(coerce.as_optional_text(value("id")), made_id).alias("id"),
        "agent",
        coerce.as_text(value("category"), F.col("default_category")).alias("category"),
        coerce.as_severity(value("severity")).alias("severity"),
        coerce.as_confidence(value("confidence")).alias("confidence"),
        F.lit(source).alias("source"),
        coerce.as_optional_text(value("file")).alias("file"),
        coerce.as_line(value("line_start")).alias("line_start"),
        coerce.as_line(value("line_end")).alias("line_end"),
        coerce.as_text(value("title"), vocab.TITLE_DEFAULT).alias("title"),
        coerce.as_text(value("description"), vocab.DESCRIPTION_DEFAULT).alias("description"),
        coerce.as_text(value("impact"), vocab.IMPACT_DEFAULT).alias("impact"),
        coerce.as_text(value("recommendation"), vocab.RECOMMENDATION_DEFAULT).alias("recommendation"),
        coerce.as_optional_text(value("code_snippet")).alias("code_snippet"),
        coerce.as_optional_text(value("suggested_fix")).alias("suggested_fix"),
        F.array().cast("array<string>").alias("merged_from"),
    )
