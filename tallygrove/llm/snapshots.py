r"""Chat formatting with collapse of cumulative snapshots.

A logged conversation that is a prefix of a longer one (or equal to one with a
smaller id) is dropped; the rest are rendered. Each conversation's turns are
read in order and a running BLAKE2b state is copied after every turn, so the
digest of every prefix costs one pass over the text. Digests of whole
conversations are anti-joined with the distinct digests of proper prefixes.

Turns go by (turn, role, text), nulls first. A null role or text hashes apart
from the empty string and renders as it. A null conversation id is a
conversation of its own. Repeated rows are repeated turns; further columns are
not read. In roles and texts ``<|`` renders as ``<\|``, so that no text can
open or close a turn. Conversations of
any length stream through a task; a hot first turn or a hot conversation is
aggregated to one row for its digest before the join.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.session import materialize, release, text_batches

#: A turn as text; <|role|> opens it, <|end|> closes it.
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _field(value: str | None) -> bytes:
    raw = b"" if value is None else value.encode("utf-8", "surrogatepass")
    return struct.pack("<q", -1 if value is None else len(raw)) + raw


def _prefix_digests(batches):
    """(conv_id, n_turns, digest, whole) for every prefix of every conversation; input sorted by conversation."""
    state, conv, n = None, None, 0
    held = None

    for batch in batches:
        ids, turns, digests, whole = [], [], [], []
        for c, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
            if state is None or c != conv:
                if held is not None:
                    ids.append(conv), turns.append(n), digests.append(held), whole.append(True)
                state, conv, n, held = hashlib.blake2b(digest_size=16), c, 0, None
            if held is not None:
                ids.append(conv), turns.append(n), digests.append(held), whole.append(False)
            state.update(_field(role) + _field(text))
            n, held = n + 1, state.digest()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(turns, pa.int64()), pa.array(digests, pa.binary()), pa.array(whole, pa.bool_())],
            ["conv_id", "n_turns", "digest", "whole"],
        )
    if held is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([held], pa.binary()), pa.array([True], pa.bool_())],
            ["conv_id", "n_turns", "digest", "whole"],
        )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): the conversations that stay. n_copies counts equal conversations."""
    text_batches(turns.sparkSession)
    ordered = (
        turns.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    # Written, as it is read for whole and for proper prefixes.
    prefixes = materialize(ordered.mapInArrow(_prefix_digests, "conv_id long, n_turns long, digest binary, whole boolean"), "chat-prefixes")
    wholes = (
        prefixes.where("whole")
        .groupBy("digest", "n_turns")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    proper = prefixes.where("not whole").select("digest", "n_turns").distinct()
    kept = materialize(wholes.join(proper, ["digest", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies"), "chat-kept")
    release(prefixes)
    return kept


def _plain(value: Column) -> Column:
    return F.replace(F.coalesce(value, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, text): each conversation in the chat template. A conversation's own turns are gathered in one row."""
    row = F.struct("turn", "role", "text")
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row), _turn_order).alias("_t"))
    one = lambda t: F.concat(
        F.lit("<|"), _plain(t["role"]), F.lit("|>\n"), _plain(t["text"]), F.lit(CLOSE)
    )
    return packed.select("conv_id", F.array_join(F.transform("_t", one), "").alias("text"))


def _turn_order(a, b):
    def by(x, y):
        return (
            F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1)
            .when(x < y, -1).when(x > y, 1).otherwise(0)
        )

    first, second = by(a["turn"], b["turn"]), by(a["role"], b["role"])
    return F.when(first != 0, first).when(second != 0, second).otherwise(by(a["text"], b["text"]))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of the maximal conversations."""
    kept = maximal_conversations(turns)
    chosen = turns.select("conv_id", "turn", "role", "text").join(
        kept.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi"
    )
    texts = render(chosen).withColumnRenamed("conv_id", "_r")
    return kept.join(texts, F.col("conv_id").eqNullSafe(F.col("_r"))).select("conv_id", "n_turns", "n_copies", "text")


def op10_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER w AS n,
         string_agg(coalesce(length(role)::VARCHAR, 'x') || ':' || coalesce(role, '') || coalesce(length(text)::VARCHAR, 'x') || ':' || coalesce(text, ''), '')
           OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS prefix
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
),
l AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS last FROM t),
whole AS (SELECT prefix, min(conv_id) AS conv_id, max(n) AS n_turns, count(*) AS n_copies FROM l WHERE n = last GROUP BY prefix),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM l WHERE n < last))
SELECT k.conv_id, k.n_turns, k.n_copies,
       string_agg('<|' || replace(coalesce(t.role, ''), '<|', '<\|') || '|>' || chr(10) || replace(coalesce(t.text, ''), '<|', '<\|') || '<|end|>' || chr(10), '' ORDER BY t.n) AS text
FROM kept k JOIN t ON t.conv_id = k.conv_id
GROUP BY k.conv_id, k.n_turns, k.n_copies
"""

QUERIES = {"op10_chat_snapshots": op10_chat_snapshots}
ORACLES = {"op10_chat_snapshots": ORACLE}
