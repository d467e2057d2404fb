"""Segment state: latest record wins, reuse of finished work, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def latest_state(log: DataFrame, *keys: str, stamp: list[str]) -> DataFrame:
    """The newest record per key of an append-only log; a partial aggregate, no sort and no window."""
    values = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*stamp)).alias("_r"))
    return newest.select(*keys, "_r.*")


def exhausted(max_retry: int = fixed.MAX_RETRY, policy: Column | None = None) -> Column:
    same_policy = F.col("qc_hash") == policy if policy is not None else F.lit(True)
    return (F.col("status") == "failed") & same_policy & (F.coalesce("attempts", F.lit(0)) >= max_retry + 1)


def classify_segments(plan: DataFrame, state: DataFrame, files: DataFrame, policy: str | Column, key: str = "segment_id",
                      max_retry: int = fixed.MAX_RETRY, retry_failed: bool = False) -> DataFrame:
    """Decide per identity: ``cached``, ``recheck``, ``exhausted`` or ``pending``, weighted by ``occurrences``.

    ``plan`` may repeat an identity; it is counted first, so all three join sides are unique on the key.
    ``files``: ``key, sha256`` of outputs that exist now.
    """
    wanted = plan.groupBy(key).agg(F.count("*").alias("occurrences"))
    policy = F.lit(policy) if isinstance(policy, str) else policy
    joined = wanted.join(state, key, "left").join(files.select(key, F.col("sha256").alias("_now")), key, "left")
    intact = (F.col("status") == "completed") & (F.col("_now") == F.col("content_sha256"))
    spent = exhausted(max_retry, policy) & F.lit(not retry_failed)
    verdict = (F.when(intact & (F.col("qc_hash") == policy), "cached").when(intact, "recheck")
               .when(spent, "exhausted").otherwise("pending"))
    return joined.withColumn("verdict", verdict).drop("_now")


def reuse_cache(wanted: DataFrame, local: DataFrame, previous: DataFrame, match: list[str], key: str = "segment_id") -> DataFrame:
    """Records importable from earlier finished runs.

    ``wanted`` and ``previous`` agree on ``match`` (speech signature, case-folded file stem, source hash, fingerprint) and
    on the identity; ``previous`` carries ``run_status, run_order, status, content_sha256, file_sha256``. The newest run
    wins; identities already complete in ``local`` are left alone.
    """
    sound = previous.filter(F.col("run_status").isin(fixed.TERMINAL_STATUSES) & (F.col("status") == "completed")
                            & (F.col("content_sha256") == F.col("file_sha256")))
    rest = [c for c in sound.columns if c not in (*match, key)]
    newest = (sound.groupBy(*match, key).agg(F.max_by(F.struct(*rest), "run_order").alias("_r"))
              .select(*match, key, "_r.*"))
    done = local.filter(F.col("status") == "completed").select(key).distinct()
    needed = wanted.select(*match, key).distinct().join(done, key, "left_anti")
    return needed.join(newest, [*match, key])
