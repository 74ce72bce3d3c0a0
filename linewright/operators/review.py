"""Review packets, reviewer policy and the hash-chained review log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright import fixed_values as fixed
from linewright.functions.canonical import canonical_text, digest, document_text
from linewright.functions.ordered import attach, latest_per_key, ordered_scan
from linewright.operators import contracts
from linewright.schemas import HUMAN_REVIEW
from linewright.session import written

PREVIOUS, RECORD = "previous_record_sha256", "record_sha256"
_NO_PREVIOUS = f'"{PREVIOUS}":null'


# ---- reviewer policy and uniqueness ---------------------------------------------------------------


def policy_fault() -> Column:
    """First broken rule of a human decision, NULL if none."""
    return F.expr("""CASE
      WHEN approved_stake > proposed_stake THEN 'stake.above_proposed'
      WHEN system_decision = 'BLOCKED' AND human_decision = 'approved' THEN 'approval.of_blocked'
      WHEN human_decision = 'approved' AND system_decision <> 'BET' THEN 'approval.needs_bet'
      WHEN human_decision = 'approved' AND approved_stake <= 0 THEN 'approval.needs_stake'
      WHEN human_decision <> 'approved' AND approved_stake <> 0 THEN 'stake.without_approval' END""")


def duplicates(reviews: DataFrame, log: DataFrame | None, *, arrival: str) -> DataFrame:
    """Add ``duplicate``: the id is in the log already, or an earlier arrival has it."""
    first = reviews.groupBy("review_id").agg(F.min(arrival).alias("_first"))
    marked = attach(reviews, first, ["review_id"]).withColumn("duplicate", F.col(arrival) > F.col("_first")).drop("_first")
    if log is None:
        return marked
    known = log.select("review_id").distinct().withColumn("_known", F.lit(True))
    return attach(marked, known, ["review_id"]).withColumn(
        "duplicate", F.col("duplicate") | F.coalesce("_known", F.lit(False))
    ).drop("_known")


# ---- hash chain -----------------------------------------------------------------------------------


def build_chain(records: DataFrame, log: str, seq: str, columns: Sequence[str], tails: DataFrame | None = None) -> DataFrame:
    """Add previous and own hash to every record, per log in sequence.

    The canonical text is made in the JVM; only the fold over hashes is
    sequential, as a chain is by definition. Logs run in parallel; within one,
    sorted texts stream through with one hash of state, so no log is ever held in
    memory, and the records themselves stay outside: hashes are joined to them by
    (log, seq), which must be unique. ``tails`` (log, tail) continues existing logs.
    """
    whole = records.withColumn(PREVIOUS, F.lit(None).cast("string"))
    ready = whole.select(log, seq, canonical_text(whole, [*columns, PREVIOUS]).alias("_text"))
    ready = attach(ready, tails.select(log, F.col("tail").alias("_tail")), [log]) if tails is not None else ready.withColumn("_tail", F.lit(None).cast("string"))
    placed = ready.repartition(log).sortWithinPartitions(log, seq)
    hashes = T.StructType([records.schema[log], records.schema[seq], T.StructField(PREVIOUS, T.StringType()), T.StructField(RECORD, T.StringType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for batch in batches:
            before, own = [], []
            for key, body, tail in zip(batch[log], batch["_text"], batch["_tail"]):
                if key != current:
                    current, last = key, tail
                before.append(last)
                full = body if last is None else body.replace(_NO_PREVIOUS, f'"{PREVIOUS}":"{last}"', 1)
                last = hashlib.sha256(full.encode()).hexdigest()
                own.append(last)
            yield batch[[log, seq]].assign(**{PREVIOUS: before, RECORD: own})

    return attach(records, placed.mapInPandas(fold, hashes), [log, seq])


def verify_chain(log_rows: DataFrame, log: str, seq: str, columns: Sequence[str], *, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``hash_ok`` and ``link_ok`` to every record, all records in parallel.

    ``keep``: the columns wanted of the records, all if None; only they and the hashes go through the scan's shuffle.
    """
    keep = log_rows.columns if keep is None else list(keep)
    own = digest(canonical_text(log_rows, [*columns, PREVIOUS]))
    hashed = log_rows.withColumn("hash_ok", own.eqNullSafe(F.col(RECORD))).select(*dict.fromkeys([*keep, log, seq, PREVIOUS, RECORD, "hash_ok"]))
    linked = ordered_scan(hashed, [log], [seq], previous={"_claimed": F.col(RECORD)})
    return linked.withColumn("link_ok", F.col(PREVIOUS).eqNullSafe(F.col("_claimed"))).select(*keep, "hash_ok", "link_ok")


def intake(reviews: DataFrame, log: DataFrame | None, *, arrival: str, log_id: str = "log_id") -> tuple[DataFrame, DataFrame]:
    """Contract, policy, chain check of the log, uniqueness, then chaining.

    ``reviews``: log_id, arrival, the review fields. ``log``: the existing records
    with ``seq`` and hashes. Returns the records to append and the rejects with
    their ``rejection``. A log whose chain is broken takes nothing.
    """
    fields = [f for f in HUMAN_REVIEW.names if f in reviews.columns]
    as_struct = reviews.withColumn("_doc", F.struct(*fields))
    checked = contracts.contract_errors(as_struct, "_doc", contracts.human_review, "_errors")
    faulted = checked.withColumn(
        "rejection",
        F.when(F.size("_errors") > 0, F.concat(F.lit("contract: "), F.array_join(F.transform("_errors", lambda e: e["code"]), ", "))).otherwise(policy_fault()),
    ).drop("_doc", "_errors")
    if log is not None:
        sound = verify_chain(log, log_id, "seq", fields, keep=[log_id])
        broken = sound.where(~(F.col("hash_ok") & F.col("link_ok"))).select(log_id).distinct().withColumn("_broken", F.lit(True))
        faulted = attach(faulted, broken, [log_id]).withColumn(
            "rejection", F.when(F.col("rejection").isNull() & F.col("_broken"), "log.chain_broken").otherwise(F.col("rejection"))
        ).drop("_broken")
    # Judged once; accepted and rejected rows both read it.
    faulted = written(faulted, "judged")
    passed = duplicates(faulted.where(F.col("rejection").isNull()), log, arrival=arrival).withColumn(
        "rejection", F.when(F.col("duplicate"), F.concat(F.lit("review_id.repeated: "), F.col("review_id")))
    ).drop("duplicate")
    rejected = faulted.where(F.col("rejection").isNotNull()).unionByName(passed.where(F.col("rejection").isNotNull()))
    accepted = passed.where(F.col("rejection").isNull()).drop("rejection")
    if log is None:
        numbered = ordered_scan(accepted, [log_id], [arrival], position="seq")
        return build_chain(numbered, log_id, "seq", fields), rejected
    tails = latest_per_key(log.select(log_id, "seq", F.col(RECORD).alias("tail")), [log_id], [F.col("seq")])
    numbered = ordered_scan(accepted, [log_id], [arrival], position="_place")
    numbered = attach(numbered, tails.select(log_id, F.col("seq").alias("_last")), [log_id]).withColumn(
        "seq", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_place")
    ).drop("_last", "_place")
    return build_chain(numbered, log_id, "seq", fields, tails), rejected


# ---- review packets -------------------------------------------------------------------------------


def review_packets(
    markets: DataFrame, models: DataFrame, notes: DataFrame | None, key: str, *, created_at: str, namespace: str = fixed.NAMESPACE
) -> DataFrame:
    """Market and model documents (VARIANT ``market_snapshot`` / ``model_output``) paired on ``key``.

    Gate HUMAN_REVIEW_REQUIRED iff the market checks are clean and the model
    verdict is usable; else BLOCKED. ``packet_sha256`` covers the packet without itself.
    """
    checked = contracts.contract_errors(markets, "market_snapshot", contracts.packet_market, "market_errors")
    verdict = contracts.model_verdict(models, "model_output", namespace)
    # Documents are written as text once, before rows meet; parsed ones and hashes stay out of the shuffle.
    sides, hashed = [], {}
    for side, column in ((checked, "market_snapshot"), (verdict, "model_output")):
        text, others = F.to_json(column).alias(column), [c for c in side.columns if c != column]
        parsed = isinstance(side.schema[column].dataType, T.VariantType)
        hashed[column] = F.col(column if parsed else f"_{column}")
        sides.append(side.select(*others, text, *([] if parsed else [document_text(side, column).alias(f"_{column}")])))
    paired = sides[0].join(sides[1], key)
    # No key is NULL here, so an equality will do and the pairs stay where they are.
    paired = paired.join(notes.select(key, "notes"), key, "left") if notes is not None else paired.withColumn("notes", F.lit(None).cast("string"))
    usable = (F.size("market_errors") == 0) & F.col("valid")
    packet = paired.select(
        key, F.lit(f"{namespace}.personal-review.v1").alias("packet_version"), F.lit(created_at).alias("created_at"),
        F.when(usable, "HUMAN_REVIEW_REQUIRED").otherwise("BLOCKED").alias("gate"),
        *[digest(text).alias(f"{column}_sha256") for column, text in hashed.items()],
        "market_snapshot", "model_output",
        F.struct(
            (F.size("market_errors") == 0).alias("market_valid"), F.col("market_errors"),
            F.struct("valid", "decision", "domain_match", "errors").alias("model"),
        ).alias("validation"),
        F.struct(
            F.col("notes"), F.lit(None).cast("string").alias("system_decision"),
            F.lit(None).cast("double").alias("proposed_stake"), F.lit(None).cast("double").alias("price_threshold"),
            F.lit(None).cast("string").alias("risk_binding_cap"),
        ).alias("analysis"),
        F.struct(
            F.lit("pending").alias("status"), F.array(*map(F.lit, fixed.HUMAN_DECISIONS)).alias("allowed_decisions"),
            F.lit(False).alias("model_probability_may_be_changed"), F.lit(False).alias("automatic_execution"),
        ).alias("human_review"),
    )
    content = [c for c in packet.columns if c != key]
    return packet.withColumn("packet_sha256", digest(canonical_text(packet, content)))
