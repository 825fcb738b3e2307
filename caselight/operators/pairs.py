"""Message / reply pairs: join, enrichment, dedupe, boilerplate filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight import config
from caselight.functions import text as T
from caselight.operators.ordering import head_per_group, id_order, sample_n


def brand_replies(messages: DataFrame, brand: str) -> DataFrame:
    return messages.where((F.col("inbound") == "False") & (F.col("author_id") == brand))


def customer_messages(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("inbound") == "True")


def reply_pairs(messages: DataFrame, brand: str, first_only: bool = False) -> DataFrame:
    """Each brand reply next to the customer message it answers.

    Message ids are unique, so only the reply side can be hot (one message with
    very many answers); adaptive skew-join splitting cuts that side and repeats
    the single matching message.  Both sides are narrowed before the shuffle and
    replies without a parent never enter it.
    """
    replies = brand_replies(messages, brand).select(
        F.col("in_response_to_tweet_id").alias("_parent"),
        F.col("tweet_id").alias("brand_tweet_id"),
        F.col("text").alias("brand_text"),
        F.col("created_at").alias("brand_created_at"))
    if first_only:
        # before the join: a customer message needs only its earliest reply
        replies = head_per_group(replies.where(F.col("_parent").isNotNull()), ["_parent"],
                                 id_order("brand_tweet_id"), 1)
    asked = customer_messages(messages).select(
        F.col("tweet_id").alias("cust_tweet_id"),
        F.col("text").alias("cust_text"),
        F.col("created_at").alias("cust_created_at"))
    return replies.join(asked, F.col("_parent") == F.col("cust_tweet_id")).select(
        "cust_tweet_id", "cust_text", "cust_created_at", "brand_tweet_id", "brand_text", "brand_created_at")


def enrich(pairs: DataFrame, brands: Sequence[str] = config.BRAND_HANDLES, scrub_pii: bool = True) -> DataFrame:
    """Clean texts, and flags read from the raw texts."""
    return pairs.select(
        "*",
        T.clean_text(F.col("cust_text"), scrub_pii, brands).alias("cust_text_clean"),
        T.clean_text(F.col("brand_text"), scrub_pii, brands).alias("brand_text_clean"),
        T.has_negative_emoji(F.col("cust_text")).alias("has_negative_emoji"),
        T.has_positive_emoji(F.col("cust_text")).alias("has_positive_emoji"),
        T.mentions_handoff(F.col("brand_text")).alias("has_dm_handoff"))


def dedupe_pairs(pairs: DataFrame) -> DataFrame:
    """One row per (clean message, clean reply): the one with the smallest ids."""
    return head_per_group(pairs, ["cust_text_clean", "brand_text_clean"],
                          id_order("cust_tweet_id", "brand_tweet_id"), 1)


def drop_boilerplate(pairs: DataFrame) -> DataFrame:
    return pairs.where(T.not_boilerplate(F.col("brand_text_clean")))


def drop_report(pairs: DataFrame) -> DataFrame:
    """Rows before, after and dropped by dedupe plus boilerplate filter; one grouping, no second scan."""
    groups = pairs.groupBy("cust_text_clean", "brand_text_clean").agg(F.count(F.lit(1)).alias("n"))
    kept = T.not_boilerplate(F.col("brand_text_clean"))
    return (groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
                       F.count_if(kept).alias("rows_after"))
            .withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after")))


def build_pairs(messages: DataFrame, brand: str, limit: int | None = None, seed: int = 42,
                first_only: bool = False, brands: Sequence[str] = config.BRAND_HANDLES) -> DataFrame:
    """Join, sample only if a ``limit`` is given, enrich, filter, dedupe.  The filter reads a dedupe key, so it may run first."""
    pairs = sample_n(reply_pairs(messages, brand, first_only), limit, ["cust_tweet_id", "brand_tweet_id"], seed)
    return dedupe_pairs(drop_boilerplate(enrich(pairs, brands)))
