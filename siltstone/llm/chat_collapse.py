"""Cumulative-snapshot collapse of logged conversations, then rendering.

A log often holds a conversation once for each turn it had so far. Each prefix of a conversation's turns gets a
rolling hash: the running xor of 128 bits of each turn's place and SHA-256, with the number of turns. A conversation
whose whole hash is a proper prefix hash of another is a snapshot of it; an anti-join leaves the maximal ones, of equal
ones the smallest conv_id. Up to there only ids and hashes are shuffled; the texts of the conversations that are left
join them at the end and are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of

START, END = "<|im_start|>", "<|im_end|>"
_HASH = ["n_turns", "a", "b"]


def _coded(c):
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def _plain(c):
    """Text in which no marker begins or ends a turn: one space goes into each."""
    c = F.coalesce(c, F.lit(""))
    for m in (END, START):
        c = F.replace(c, F.lit(m), F.lit("< " + m[1:]))
    return c


def _shown(role, text):
    return F.concat(F.lit(START), _plain(role), F.lit("\n"), _plain(text), F.lit(END + "\n"))


def _term(place, own):
    """The two halves that a turn adds to a prefix's hash."""
    return F.xxhash64(F.lit(1), place, own).alias("a"), F.xxhash64(F.lit(2), place, own).alias("b")


def collapse(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> conv_id, n_turns, rendered, for maximal conversations.

    Turns are in order of turn, role (nulls first) and a SHA-256 of role and text; repeated rows are repeated turns. A
    null role or text is a value of its own in comparisons and empty when rendered. Markers of turns inside a role or a
    text get a space, so that none can begin or end a turn. A row without conv_id is a conversation of its own, of one
    turn; of equal ones one is kept, if no conversation with an id equals or continues it. Extra columns are ignored; an
    empty table gives an empty result. A conversation's hashes are made in one task, as a stream; only its rendering,
    one string, has all its turns in memory.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.withColumn("own", F.sha2(F.concat(_coded(F.col("role")), _coded(F.col("text"))), 256))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "own")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "own")
    rows = rows.withColumn("n_turns", F.row_number().over(order).cast("long")).withColumn("more", F.lead("own").over(order).isNotNull())
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv_id", "turn", "role", "own", "n_turns", "more", *_term(F.col("n_turns"), F.col("own")))
    rows = rows.select("conv_id", "n_turns", "more", F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"))
    prefixes = rows.where("more").select(_HASH).distinct()
    one = F.lit(1).cast("long")
    alone = turns.where("conv_id is null").select(one.alias("n_turns"), *_term(one, F.col("own")), "role", "text")
    whole = rows.where(~F.col("more")).select("conv_id", *_HASH).union(alone.select(F.lit(None).cast("long"), *_HASH))
    left = whole.groupBy(_HASH).agg(F.min("conv_id").alias("conv_id")).join(prefixes, _HASH, "left_anti")
    # the texts of what is left
    long = turns.join(left.where("conv_id is not null").select("conv_id", "n_turns"), "conv_id")
    long = long.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "own", "text"))).alias("t"))
    long = long.select("conv_id", "n_turns", F.array_join(F.transform("t", lambda x: _shown(x["role"], x["text"])), "").alias("rendered"))
    alone = alone.groupBy(_HASH).agg(F.min(_shown(F.col("role"), F.col("text"))).alias("rendered")).join(left.where("conv_id is null").select(_HASH), _HASH, "left_semi")
    return long.union(alone.select(F.lit(None).cast("long"), "n_turns", "rendered"))


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(docs_of(spark, sf_dir, "conversations"))


_SHOW = "replace(replace(coalesce({}, ''), '<|im_end|>', '< |im_end|>'), '<|im_start|>', '< |im_start|>')"
ORACLE = f"""
WITH t AS (
  SELECT *, sha256(coalesce(strlen(role) || ':' || role, '-') || coalesce(strlen(text) || ':' || text, '-')) AS own, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
), c AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, own) AS l FROM t GROUP BY conv_id, alone
), p AS (
  SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, len(l))) AS i FROM c)
), f AS (
  SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l
)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns,
  array_to_string(list_transform(l, lambda x: '<|im_start|>' || {_SHOW.format('x.r')} || chr(10) || {_SHOW.format('x.t')} || '<|im_end|>' || chr(10)), '') AS rendered
FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = f.l)
"""
