"""The text and score functions for SQL: temporary functions of a session, made of SQL alone."""

from __future__ import annotations

from pyspark.sql import SparkSession

from larkspur.functions.text import DOMAINS
from larkspur.operators.ranking import RRF_K

FUNCTIONS = {
    "vault_tokens(text STRING)": (
        "ARRAY<STRING>",
        "flatten(transform(regexp_extract_all(coalesce(text, ''), '([\\\\u4e00-\\\\u9fff]+|[a-zA-Z0-9]+)', 1), r -> CASE WHEN r RLIKE '^[\\\\u4e00-\\\\u9fff]' THEN concat(transform(sequence(1, char_length(r)), i -> substring(r, i, 1)), "
        "CASE WHEN char_length(r) > 1 THEN transform(sequence(1, char_length(r) - 1), i -> substring(r, i, 2)) ELSE array() END) ELSE array(lower(r)) END))",
    ),
    "vault_rrf(place INT, weight DOUBLE)": ("DOUBLE", f"weight / ({RRF_K} + place)"),
    "vault_strength(accessed_at TIMESTAMP_NTZ, as_of TIMESTAMP_NTZ)": ("DOUBLE", "power(greatest(timestampdiff(MICROSECOND, accessed_at, as_of) / 3.6e9, 0.01D), -0.5D)"),
    "vault_domain(path STRING)": ("STRING", "CASE " + " ".join(f"WHEN startswith(path, '{k}') THEN '{v}'" for k, v in DOMAINS.items()) + " ELSE 'Unknown' END"),
    "vault_time_bonus(day DATE, first DATE, last DATE, anchor DATE, sure DOUBLE)": (
        "DOUBLE",
        "coalesce(CASE WHEN day BETWEEN first AND last THEN 0.3D * (1 - 0.3D * abs(datediff(day, anchor)) / greatest(datediff(last, first), 1)) * sure ELSE 0.3D * exp(-abs(datediff(day, anchor)) / 365.0D) * 0.5D * sure END, 0.0D)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; an activation is ``ln(sum(vault_strength(accessed_at, now)))``, a fused
    score ``sum(vault_rrf(place, 1.0))``."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
