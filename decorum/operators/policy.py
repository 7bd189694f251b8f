"""Company policy of a text-model label."""

from pyspark.sql import functions as F

from decorum import lexicon
from decorum.functions.scores import explanation
from decorum.session import small_table


def policy_table(spark, policies=None):
    """(llm_label, policy), one row per label."""
    return small_table(spark, (policies or lexicon.POLICIES).items(), ("llm_label", "policy"))


def map_policy(df, policies):
    """Look up the policy and word the explanation; both have a default."""
    joined = df.join(policies, "llm_label", "left")
    return joined.withColumns({
        "policy_violation": F.coalesce("policy", F.lit(lexicon.DEFAULT_POLICY)),
        "llm_explanation": explanation(F.col("llm_confidence"), F.col("policy")),
    }).drop("policy")
