"""Personal-data queries over whole documents."""

from __future__ import annotations

import secrets

from pyspark.sql import functions as F

from ..operators import logs
from ..operators import privacy as pv
from ..operators.partitioning import spread
from .catalog import query


@query("pii_anonymize")
def pii_anonymize(fx):
    """T1 + T2: the unique placeholder mappings of every document (exploded)."""
    d = spread(fx.t.documents.select("doc_id", "text")).select("doc_id", "text", pv.detect(F.col("text")).alias("spans"))
    txt, maps = pv.anonymize_text(F.col("text"), F.col("spans"))
    return (d.select("doc_id", F.explode_outer(maps).alias("m")).where(F.col("m").isNotNull())  # detected once: see mapping_rows
            .select("doc_id", "m.placeholder", "m.entity_type", F.length("m.original_value").alias("value_chars"),
                    "m.score"))


@query("pii_roundtrip", oracle="""SELECT doc_id,
  md5(CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11)) = '' THEN '' ELSE text END) AS text_md5,
  length(text) AS n_chars
FROM documents""")
def pii_roundtrip(fx):
    """T1 -> T2 -> T3 on every document: restoring the placeholders gives the source text back."""
    d = spread(fx.t.documents.select("doc_id", "text")).select("doc_id", "text", pv.detect(F.col("text")).alias("spans"))
    anon, maps = pv.anonymize_text(F.col("text"), F.col("spans"))
    back = pv.deanonymize(anon, maps)
    return d.select("doc_id", F.md5(back).alias("text_md5"), F.length("text").alias("n_chars"))


@query("pii_stage")
def pii_stage(fx):
    """T4 + A17: anonymize stage over all messages (subject and body), with size metrics."""
    msgs, _ = pv.anonymize_stage(fx.emails.select("id", "subject", "body"))
    return logs.text_size_metrics(msgs, "body", "anonymized_body").select("id", "chars_in", "chars_out", "mapping_count")


@query("pii_mapping_counts")
def pii_mapping_counts(fx):
    """Placeholder mappings per entity type over all messages."""
    _, maps = pv.anonymize_stage(fx.emails.select("id", "subject", "body"))
    return maps.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"),
                                           F.countDistinct("email_id").alias("n_emails"))


@query("encrypt_roundtrip", oracle="""SELECT doc_id, md5(text) AS text_md5, strlen(text) + 28 AS n_bytes FROM documents""")
def encrypt_roundtrip(fx):
    """AES-GCM encrypt every document, decrypt, and compare (IV 12 + tag 16 bytes)."""
    if not fx.spark.conf.get("inboxlake.crypto.key", None):  # nothing is kept: a key for this run will do
        fx.spark.conf.set("inboxlake.crypto.key", secrets.token_hex(16))
    key = pv.session_key(fx.spark)
    enc = fx.t.documents.select("doc_id", pv.encrypt(F.col("text"), key).alias("enc"))
    return enc.select("doc_id", F.md5(pv.decrypt(F.col("enc"), key)).alias("text_md5"),
                      F.octet_length("enc").alias("n_bytes"))
