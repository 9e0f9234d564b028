"""From distribution documents to a checked ledger and its totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recohort.operators import gates, rewards as rw
from recohort.session import pin, prepare
from recohort.sources import rewards as sr


def reward_report(texts: DataFrame, token: str, type_id: int, batches: DataFrame | None = None,
                  published: str | None = None) -> dict[str, DataFrame]:
    """Ledger, epochs and totals of documents (file, epoch_start, text); any fault refuses them all.

    ``batches`` (file, total_raw) declares what each document must sum up to; ``published`` is a rounded
    figure to compare the exact total with. Every gate sees the documents before a number is computed.
    """
    prepare(texts.sparkSession)
    documents = pin(sr.distribution_documents(texts), "documents")
    gates.enforce(rw.reward_faults(documents, token, type_id))
    allocations, overrides = (pin(rows, "entries") for rows in (sr.ingest_reward_files(documents), sr.ingest_override_maps(documents)))
    gates.enforce(rw.reward_row_faults(allocations, overrides))
    if batches is not None:
        gates.enforce(rw.batch_total_faults(allocations, batches))
    ledger = pin(rw.reward_ledger(allocations, overrides, token), "ledger")
    totals = rw.reward_totals(ledger)
    out = {"ledger": ledger, "epochs": rw.reward_epoch_summary(ledger, overrides), "totals": totals}
    if published is not None:
        out["report"] = rw.reward_report_reconcile(totals.withColumn("published", F.lit(published)), "total_amount_raw", "published")
    return out
