"""Reviewer policy, review uniqueness and hash chains."""

from pyspark.sql import functions as F

from linewright.operators import review
from linewright.plans import views as v
from linewright.plans.registry import over, query
from linewright.session import written


def reviews(d):
    """Human decisions on candidates; some ids come twice."""
    return """
    SELECT o_orderkey AS arrival, concat('L', o_custkey % 100) AS log_id,
      concat('R', CASE WHEN o_orderkey % 40 = 1 THEN o_orderkey - 1 ELSE o_orderkey END) AS review_id,
      concat('P', o_orderkey) AS prediction_id, 'v1' AS model_version,
      CASE WHEN o_orderkey % 27 = 0 THEN '2024-01-01T00:00:00' ELSE '2024-01-01T00:00:00Z' END AS reviewed_at,
      CASE o_orderkey % 4 WHEN 0 THEN 'BET' WHEN 1 THEN 'BET' WHEN 2 THEN 'BLOCKED' ELSE 'WATCH' END AS system_decision,
      CASE o_orderkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'watch' WHEN 3 THEN 'approved' ELSE 'refresh_required' END AS human_decision,
      o_orderkey % 33 = 0 AS model_probability_changed,
      CAST(o_orderkey % 50 AS DOUBLE) AS proposed_stake,
      CASE WHEN o_orderkey % 5 IN (0, 3) THEN CAST(o_orderkey % 52 AS DOUBLE) ELSE CASE WHEN o_orderkey % 19 = 0 THEN 1e0 ELSE 0e0 END END AS approved_stake,
      o_orderpriority AS reason
    FROM {orders}"""


_FAULT = """CASE WHEN approved_stake > proposed_stake THEN 'stake.above_proposed'
  WHEN system_decision = 'BLOCKED' AND human_decision = 'approved' THEN 'approval.of_blocked'
  WHEN human_decision = 'approved' AND system_decision <> 'BET' THEN 'approval.needs_bet'
  WHEN human_decision = 'approved' AND approved_stake <= 0 THEN 'approval.needs_stake'
  WHEN human_decision <> 'approved' AND approved_stake <> 0 THEN 'stake.without_approval' END"""
_SCHEMA = """'contract: ' || nullif(concat_ws(', ', CASE WHEN model_probability_changed THEN 'schema.model_probability_changed.const' END,
  CASE WHEN arrival % 27 = 0 THEN 'schema.reviewed_at.format' END), '')"""


def review_rows(spark, sf_dir):
    return v.view(spark, sf_dir, reviews(v.SPARK), spread="orders").withColumn("packet_sha256", F.sha2(F.col("prediction_id"), 256))


@query("review_policy", over({"q": reviews}, f"SELECT arrival, {_FAULT} AS fault FROM q"))
def review_policy(spark, sf_dir):
    return review_rows(spark, sf_dir).select("arrival", review.policy_fault().alias("fault"))


@query("duplicate_reviews", over({"q": reviews}, """
    SELECT arrival, review_id, arrival > min(arrival) OVER (PARTITION BY review_id) AS duplicate FROM q"""))
def duplicate_reviews(spark, sf_dir):
    return review.duplicates(review_rows(spark, sf_dir), None, arrival="arrival").select("arrival", "review_id", "duplicate")


_INTAKE = f"""
    , f AS (SELECT *, coalesce({_SCHEMA}, {_FAULT}) AS fault FROM q)
    , d AS (SELECT *, CASE WHEN arrival > min(arrival) OVER (PARTITION BY review_id) THEN concat('review_id.repeated: ', review_id) END AS again FROM f WHERE fault IS NULL)"""


@query("review_rejects", over({"q": reviews}, f"""{_INTAKE}
    SELECT arrival, fault AS rejection FROM f WHERE fault IS NOT NULL UNION ALL SELECT arrival, again FROM d WHERE again IS NOT NULL"""))
def review_rejects(spark, sf_dir):
    _, rejected = review.intake(review_rows(spark, sf_dir), None, arrival="arrival")
    return rejected.select("arrival", "rejection")


@query("review_accepts", over({"q": reviews}, f"""{_INTAKE}
    SELECT arrival, log_id, row_number() OVER (PARTITION BY log_id ORDER BY arrival) - 1 AS seq FROM d WHERE again IS NULL"""))
def review_accepts(spark, sf_dir):
    accepted, _ = review.intake(review_rows(spark, sf_dir), None, arrival="arrival")
    return accepted.select("arrival", "log_id", "seq")


@query("review_log_intake", over({"q": reviews}, f"""
    , f AS (SELECT *, coalesce({_SCHEMA}, {_FAULT}) AS fault FROM q)
    , kept AS (SELECT log_id, review_id, row_number() OVER (PARTITION BY log_id ORDER BY arrival) - 1 AS seq FROM (
        SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY arrival) AS nth FROM f WHERE arrival % 2 = 0 AND fault IS NULL) e WHERE nth = 1)
    , tails AS (SELECT log_id, max(seq) AS last FROM kept GROUP BY log_id)
    , n AS (SELECT f.*, last, coalesce(fault, CASE WHEN last IS NOT NULL AND right(f.log_id, 1) = '3' THEN 'log.chain_broken' END) AS early
        FROM f LEFT JOIN tails USING (log_id) WHERE arrival % 2 = 1)
    , d AS (SELECT *, CASE WHEN arrival > min(arrival) OVER (PARTITION BY review_id) OR review_id IN (SELECT review_id FROM kept) THEN concat('review_id.repeated: ', review_id) END AS again
        FROM n WHERE early IS NULL)
    SELECT arrival, log_id, early AS rejection, CAST(NULL AS BIGINT) AS seq FROM n WHERE early IS NOT NULL
    UNION ALL SELECT arrival, log_id, again, NULL FROM d WHERE again IS NOT NULL
    UNION ALL SELECT arrival, log_id, NULL, coalesce(last + 1, 0) + row_number() OVER (PARTITION BY log_id ORDER BY arrival) - 1 FROM d WHERE again IS NULL"""))
def review_log_intake(spark, sf_dir):
    """Every other review goes to a log whose tails the rest continue; logs ending in 3 have a replaced hash and take nothing."""
    rows = review_rows(spark, sf_dir)
    sealed, _ = review.intake(rows.where("arrival % 2 = 0"), None, arrival="arrival")
    replaced = (F.substring("log_id", -1, 1) == "3") & (F.col("seq") == 0)
    log = written(sealed.withColumn(review.RECORD, F.when(replaced, F.sha2("reason", 256)).otherwise(F.col(review.RECORD))), "log")
    accepted, rejected = review.intake(rows.where("arrival % 2 = 1"), log, arrival="arrival")
    return accepted.select("arrival", "log_id", F.lit(None).cast("string").alias("rejection"), "seq").unionByName(
        rejected.select("arrival", "log_id", "rejection", F.lit(None).cast("long").alias("seq"))
    )


_FIELDS = ["log_id", "payload", "role", "seq"]
_TEXT = """concat('{"log_id":', c.log_id, ',"payload":', CAST(to_json(c.payload) AS VARCHAR), ',"previous_record_sha256":', %s, ',"role":', CAST(to_json(c.role) AS VARCHAR), ',"seq":', c.seq, '}')"""
_CHAIN = f"""
    , c AS (SELECT * FROM l)
    , chain AS (SELECT c.log_id, c.seq, CAST(NULL AS VARCHAR) AS previous_record_sha256, sha256({_TEXT % "'null'"}) AS record_sha256 FROM c WHERE seq = 0
      UNION ALL SELECT c.log_id, c.seq, chain.record_sha256, sha256({_TEXT % "concat(chr(34), chain.record_sha256, chr(34))"}) FROM chain JOIN c ON c.log_id = chain.log_id AND c.seq = chain.seq + 1)"""


def chained(spark, sf_dir):
    return review.build_chain(v.view(spark, sf_dir, v.log_rows(v.SPARK)), "log_id", "seq", _FIELDS)


@query("chain_build", over({"l": v.log_rows}, f"{_CHAIN} SELECT log_id, seq, previous_record_sha256, record_sha256 FROM chain").replace("WITH ", "WITH RECURSIVE ", 1))
def chain_build(spark, sf_dir):
    return chained(spark, sf_dir).select("log_id", "seq", "previous_record_sha256", "record_sha256")


@query("chain_verify", over({"l": v.log_rows}, """
    , t AS (SELECT *, log_id % 4 = 1 AND seq = 1 AS altered, log_id % 6 = 2 AND seq = 0 AS resealed FROM l)
    SELECT log_id, seq, NOT (altered OR resealed) AS hash_ok, NOT coalesce(lag(resealed) OVER (PARTITION BY log_id ORDER BY seq), false) AS link_ok FROM t"""))
def chain_verify(spark, sf_dir):
    """A chain with some payloads altered and some record hashes replaced after sealing."""
    rows = chained(spark, sf_dir).withColumns({
        "payload": F.when((F.col("log_id") % 4 == 1) & (F.col("seq") == 1), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")),
        "record_sha256": F.when((F.col("log_id") % 6 == 2) & (F.col("seq") == 0), F.sha2(F.col("payload"), 256)).otherwise(F.col("record_sha256")),
    })
    return review.verify_chain(rows, "log_id", "seq", _FIELDS).select("log_id", "seq", "hash_ok", "link_ok")
