"""Operators for training-data preparation at corpus scale.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds ``queries()`` and
``oracle_sql()`` when the subpackage is present.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import op01_surrogates, op02_pieces, op03_shards, op04_repeats, op05_mixing, op06_jaccard, op07_quality, op08_secrets, op09_langid, op10_topk

    return {
        f.__name__: f
        for f in (
            op01_surrogates.op1_surrogates,
            op02_pieces.op2_sentencepiece,
            op03_shards.op3_shards,
            op04_repeats.op4_repeats,
            op05_mixing.op5_mixing,
            op06_jaccard.op6_jaccard,
            op07_quality.op7_quality,
            op08_secrets.op8_secrets,
            op09_langid.op9_langid,
            op10_topk.op10_topk,
        )
    }


def oracle_sql() -> dict[str, str]:
    from . import op04_repeats, op10_topk

    return {"op4_repeats": op04_repeats.SQL, "op10_topk": op10_topk.SQL}
