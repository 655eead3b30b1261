"""Which texts hold which needles, set against set, by an index join on the needles' rarest grams.

A text that holds a needle holds all its grams (stretches of `size` characters), so it is enough to look
where the rarest of them is. Texts give out the grams that some needle asks for, which a semi-join
decides; how many texts a gram is in ranks the grams of a needle; the postings of its rarest one are the
candidates, and the needle is looked for in those alone. Of a needle only grams whose hash is a multiple
of `step` are asked for, where it has one, so texts send one gram in so many to the join.

A needle shorter than a gram is its own gram. Empty and null needles and texts match nothing. Ids name rows:
rows that repeat an id with equal content are one, and a null id is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .durable import written_once

SIZE = 12
STEP = 8


def _grams(text: str, size: int) -> Column:
    """All stretches of so many characters, overlapping, each once; one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _is_step(gram: Column, step: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(step)) == 0


def _asked(needles: DataFrame, size: int, step: int) -> DataFrame:
    """(needle_id, gram, is_step): the grams by which each needle may be looked for."""
    whole = F.when(F.length("needle") < size, F.array("needle")).otherwise(_grams("needle", size))
    some = F.filter("all", lambda g: _is_step(g, step))
    chosen = needles.select("needle_id", whole.alias("all")).withColumn("is_step", F.size(some) > 0)
    return chosen.select("needle_id", F.explode(F.when(F.col("is_step"), some).otherwise(F.col("all"))).alias("gram"), "is_step")


def contained(needles: DataFrame, texts: DataFrame, *, size: int = SIZE, step: int = STEP) -> DataFrame:
    """(needle_id, text_id) of every needle (needle_id, needle) that is a part of a text (text_id, text)."""
    needles = needles.where("needle_id IS NOT NULL AND needle <> ''").select("needle_id", "needle").distinct()
    texts = texts.where("text_id IS NOT NULL AND text <> ''").select("text_id", "text")
    asked = written_once(_asked(needles, size, step), "needle-grams")
    # At most as many kinds as a gram has characters, each with and without the step.
    kinds = asked.select(F.least(F.length("gram"), F.lit(size)).alias("size"), "is_step").distinct().collect()
    sizes = {k["size"]: all(other["is_step"] for other in kinds if other["size"] == k["size"]) for k in kinds}
    wanted = asked.select("gram").distinct()
    given = []
    for length, stepped in sorted(sizes.items()):
        grams = _grams("text", length)
        grams = F.filter(grams, lambda g: _is_step(g, step)) if stepped else grams
        given.append(texts.select("text_id", F.explode(grams).alias("gram")))
    if not given:
        return needles.join(texts, F.lit(False)).select("needle_id", "text_id")
    postings = written_once(reduce(DataFrame.unionByName, given).join(wanted, "gram", "left_semi").distinct(), "gram-postings")
    found = asked.join(postings.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    # A needle with a gram that no text has is in none.
    rarest = found.groupBy("needle_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    candidates = rarest.join(postings, "gram").select("needle_id", "text_id")
    met = candidates.join(needles, "needle_id").join(texts, "text_id")
    return met.where(F.contains("text", F.col("needle"))).select("needle_id", "text_id").distinct()
