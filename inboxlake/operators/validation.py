"""Row validation (P13): a rule list becomes an ``array<string>`` of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SUGGESTED_ACTIONS, TRIAGE_STATUSES, URGENCY_WEIGHTS


def violations(rules: list[tuple[str, Column]]) -> Column:
    """``rules`` = [(name, failing predicate)] -> array of failing rule names (nulls never fail)."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]),
                    lambda x: x.isNotNull())


def triage_violations(triage: DataFrame, categories: DataFrame) -> DataFrame:
    """Enum, range and existence rules of a triage result; only rows with violations."""
    ids = categories.select(F.col("id").alias("_known"))
    k1 = ids.withColumnRenamed("_known", "_k1")
    k2 = ids.withColumnRenamed("_known", "_k2")
    t = (triage.join(k1, triage["category_id"] == k1["_k1"], "left")
         .join(k2, triage["llm_category_id"] == k2["_k2"], "left"))
    urg = list(URGENCY_WEIGHTS)
    rules = [
        ("urgency_invalid", ~F.col("urgency").isin(*urg)),
        ("llm_urgency_invalid", ~F.col("llm_urgency").isin(*urg)),
        ("action_invalid", ~F.col("suggested_action").isin(*SUGGESTED_ACTIONS)),
        ("confidence_out_of_range", (F.col("confidence") < 0) | (F.col("confidence") > 100)),
        ("status_invalid", ~F.col("status").isin(*TRIAGE_STATUSES)),
        ("category_unknown", F.col("category_id").isNotNull() & F.col("_k1").isNull()),
        ("llm_category_unknown", F.col("llm_category_id").isNotNull() & F.col("_k2").isNull()),
    ]
    return (t.select(*triage.columns, violations(rules).alias("violations"))
            .where(F.size("violations") > 0))
