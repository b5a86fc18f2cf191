"""Fixed contracts of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D, _F, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.FloatType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


SOURCE = _struct(("window_id", _S), ("big_recording_index", _L), ("session_index", _L), ("offset", _L), ("recon_loss", _D), ("embedding", T.ArrayType(_D)))
METADATA = _struct(("big_recording_index", _L), ("dataset", _S), ("modality", _S), ("sampling_rate", _D), ("n_channels", _L))
SELECTIONS = _struct(("run_id", _S), ("row_id", _S), ("rank", _I), ("marginal_logdet_gain", _D), ("utility", _D), ("recon_loss", _F))
RUNS = _struct(
    ("run_id", _S), ("config_id", _S), ("method", _S), ("direction", _S), ("scope", _S), ("candidate_run_id", _S), ("big_recording_index", _L), ("grouping", _S), ("group_id", _L), ("allocation", _S), ("candidate_k", _I),
    ("selection_eta", _D), ("actual_size", _I), ("operational_rank", _I), ("n_degenerate_steps", _I), ("rank_limited", _B), ("kernel_method", _S), ("w_interaction", _D), ("vendi_score", _D), ("vendi_score_normalized", _D),
    ("mean_pairwise_cosine", _D), ("log_det", _D), ("mean_recon_loss", _D), ("median_recon_loss", _D), ("min_recon_loss", _D), ("max_recon_loss", _D), ("mean_utility", _D),
    *((f"recon_loss_q{q}", _D) for q in (1, 5, 25, 50, 75, 95, 99)), ("baseline_jaccard", _D), ("adjacent_jaccard", _D), ("seed", _L), ("epsilon", _D), ("solver_backend", _S), ("device", _S), ("source_fingerprint", _S),
    ("configuration_fingerprint", _S), ("greedy_order", T.ArrayType(_I)), ("marginal_logdet_gains", T.ArrayType(_D)),
)
CURVES = _struct(
    ("config_id", _S), ("method", _S), ("direction", _S), ("scope", _S), ("selection_eta", _D), ("kernel_method", _S), ("w_interaction", _D), ("recording_count", _I),
    *((f"{m}_{s}", _D) for m in ("vendi_score", "vendi_score_normalized", "mean_pairwise_cosine", "mean_recon_loss") for s in ("mean", "median", "q25", "q75")), ("actual_size_mean", _D),
)
GROUPS = _struct(("row_id", _S), ("group_id", _I), ("group_path", _S), ("group_depth", T.ShortType()), ("group_split", _S), ("group_size", _I), ("attached", _B))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns and types: missing ones null, others dropped."""
    have = set(df.columns)
    return df.select([(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
