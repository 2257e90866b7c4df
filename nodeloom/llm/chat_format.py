"""Chat formatting: conversations that were logged again and again while they grew collapse to the longest, and are rendered.

A turn's hash is of its role and text. The hash of a prefix is a polynomial of the hashes of its turns modulo a prime, so it is
a running sum, which blocks of BLOCK turns make in two steps: a conversation of any length is never in one task. A
conversation is dropped if another one, longer than it, has a prefix of its length and hash, or if an equal one has a smaller
id; what stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeloom.llm.scratch import save

#: Turns of a block.
BLOCK = 128
#: Moduli under 2**30, so that products of two numbers fit 64 bits. All hashes have to agree, some 120 bits.
PRIMES, BASES = (1073741789, 1073741783, 1073741741, 1073741723), (357913931, 715827883, 536870923, 268435459)
_ALL = range(len(PRIMES))
_HASHES = [f"h{i}" for i in _ALL]


def _turn_hash(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00"))), F.lit(PRIMES[seed]))


def _power(base: int, prime: int, exponent: Column) -> Column:
    """base ** exponent modulo prime: the product of the powers of the exponent's binary digits."""
    out, square = F.lit(1).cast("long"), base
    for bit in range(40):
        factor = F.when(F.shiftright(exponent, bit).bitwiseAND(F.lit(1)) == 1, square).otherwise(1)
        out = F.pmod(out * factor.cast("long"), F.lit(prime))
        square = square * square % prime
    return out


def _ranked(turns: DataFrame) -> DataFrame:
    """Turns with block, and place from 0 in the conversation, by turn and then text: blocks by the turn's number first."""
    turns = turns.withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK))
    order = ["turn", "role", "text"]
    within = F.row_number().over(W.partitionBy("conv_id", "block").orderBy(*order)) - 1
    turns = turns.withColumn("within", within.cast("long"))
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return turns.join(sizes.withColumn("before", before).drop("n"), ["conv_id", "block"]).withColumn("place", F.col("within") + F.col("before"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, block, place) of the conversations that are no prefix of another one."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null")
    turns = save(_ranked(own), "turns")
    terms = turns.select("conv_id", "block", "place", *[F.pmod(_turn_hash(i) * _power(BASES[i], PRIMES[i], F.col("place")), F.lit(PRIMES[i])).alias(f"t{i}") for i in _ALL])
    sums = terms.groupBy("conv_id", "block").agg(*[F.sum(f"t{i}").alias(f"s{i}") for i in _ALL])
    ahead = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"s{i}").over(ahead), F.lit(0)).alias(f"b{i}") for i in _ALL])
    so_far = W.partitionBy("conv_id", "block").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    prefixes = terms.withColumns({f"w{i}": F.sum(f"t{i}").over(so_far) for i in _ALL}).join(sums, ["conv_id", "block"])
    prefixes = save(prefixes.select("conv_id", (F.col("place") + 1).alias("n"), *[F.pmod(F.col(f"w{i}") + F.col(f"b{i}"), F.lit(PRIMES[i])).alias(f"h{i}") for i in _ALL]), "prefixes")
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("n", *_HASHES)).alias("last")).select("conv_id", "last.*")
    kept = whole.groupBy("n", *_HASHES).agg(F.min("conv_id").alias("conv_id"))
    # Prefixes shorter than their own conversation, each once however many have it.
    inner = prefixes.join(whole.select("conv_id", F.col("n").alias("all")), "conv_id").where("n < all").select("n", *_HASHES).distinct()
    kept = kept.join(inner, ["n", *_HASHES], "left_anti").select("conv_id")
    return turns.join(kept, "conv_id", "left_semi")


def render(conversations: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, n_chars, text): each maximal conversation in chat markup.

    A turn is ``begin`` + role + newline + text + ``end`` + newline. Turns are in the order of their numbers; equal numbers by
    role and text, a null number first. Null roles and texts render as empty but are unlike empty ones when conversations are
    compared. Rows with a null conv_id go. Other columns are ignored.
    """
    line = F.concat(F.lit(begin), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end + "\n"))
    turns = maximal(conversations).select("conv_id", "block", "place", line.alias("line"))
    joined = lambda a, b: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(a, b))), lambda x: x[b]), "")
    blocks = turns.groupBy("conv_id", "block").agg(joined("place", "line").alias("line"), F.count("*").alias("n"))
    out = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), joined("block", "line").alias("text"))
    return out.select("conv_id", "n_turns", F.length("text").cast("long").alias("n_chars"), "text")


#: The same in SQL: a conversation's turns as one list, looked up among the proper prefixes of all lists.
SQL = """
WITH whole AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, chr(1)), t := coalesce(text, chr(1))) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
inner_prefixes AS (SELECT DISTINCT md5(CAST(turns[1:n] AS VARCHAR)) AS h, n FROM whole, LATERAL (SELECT unnest(range(1, len(turns))) AS n)),
first AS (SELECT md5(CAST(turns AS VARCHAR)) AS h, len(turns) AS n, min(conv_id) AS conv_id FROM whole GROUP BY 1, 2)
SELECT w.conv_id, CAST(len(turns) AS BIGINT) AS n_turns, CAST(length(text) AS BIGINT) AS n_chars, text
FROM whole w JOIN first f USING (conv_id)
WHERE NOT EXISTS (SELECT 1 FROM inner_prefixes p WHERE p.h = f.h AND p.n = f.n)
"""
