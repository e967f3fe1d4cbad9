"""SQL table functions: rows of a nested value, to be called with LATERAL. Spark inlines them, so plans stay native."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schemas import PART

ITEMS = "try_variant_get(try_parse_json(concat('[', content, ']')), '$', 'array<variant>')"
IS_LIST = f"coalesce(size({ITEMS}) = 1 AND startswith(schema_of_variant({ITEMS}[0]), 'ARRAY<OBJECT'), false)"
PLAIN = f"from_json(to_json(array(named_struct('type', 'text', 'text', content))), 'array<{PART}>')"

# Name, arguments, result columns and body.
TABLE_FUNCTIONS = (
    (
        "content_parts", "content STRING", "part INT, type STRING, text STRING, image_ref STRING",
        f"SELECT part, p.type, p.text, p.image_ref FROM (SELECT posexplode(CASE WHEN {IS_LIST} THEN from_json(content, 'array<{PART}>') ELSE {PLAIN} END) AS (part, p))",
    ),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session, e.g. ``SELECT m.id, p.* FROM messages m, LATERAL content_parts(m.content) p``."""
    for name, arguments, columns, body in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")
    return [name for name, *_ in TABLE_FUNCTIONS]
