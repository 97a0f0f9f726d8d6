"""Intent, slots and names in a table of messages; evidence and answer checks."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.fixed_values import DEFAULT_INTENT, INTENT_KEYWORDS
from .ranking import top_k_per_group

# which slots an intent carries
INTENT_SLOTS = {"forecast": ("district", "sub_head"), "hotspots": ("district", "sub_head"), "risk_rank": ("district",)}


def intent(df: DataFrame, text: str, options: Mapping[str, Sequence[str]] | None = None,
           defaults: Mapping[str, str] | None = None,
           keywords: Mapping[str, Sequence[str]] = INTENT_KEYWORDS, fallback: str = DEFAULT_INTENT,
           person: str | None = None) -> DataFrame:
    """Adds ``intent`` and one column per slot. Defaults fill the forecast slots only.

    ``person`` names a column with a resolved person; network questions without one fall back.
    """
    label = F.coalesce(tx.cue_label(text, keywords), F.lit(fallback))
    if person is not None:
        label = F.when((label == "network") & F.col(person).isNull(), F.lit(fallback)).otherwise(label)
    out = df.withColumn("intent", label)
    for slot, values in (options or {}).items():
        users = [i for i, slots in INTENT_SLOTS.items() if slot in slots]
        found = tx.longest_contained(text, values)
        filled = F.coalesce(found, F.lit((defaults or {}).get(slot)))
        out = out.withColumn(slot, F.when(F.col("intent") == "forecast", filled)
                             .when(F.col("intent").isin(users), found))
    return out


def _grams(text: str, n: int) -> Column:
    """The distinct runs of n characters of a text; empty for a shorter one."""
    @F.arrow_udf("array<string>")
    def runs(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), 64):  # as Python strings only the runs of a few texts at a time
            rows = [text.as_py() for text in texts[at:at + 64]]
            parts.append(pa.array([list({row[i:i + n] for i in range(len(row) - n + 1)}) for row in rows], pa.list_(pa.string())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return runs(text)


def _candidates(low: DataFrame, known: DataFrame, message_id: str, person: str) -> DataFrame:
    """(message, person, _name) that may match: the message has the rarest run of the name."""
    size = F.length("_name")

    def by_rarest_run(some: DataFrame, n: int) -> DataFrame:
        runs = low.select(message_id, F.explode(_grams("_text", n)).alias("_gram")).withColumn("_gram", F.xxhash64("_gram"))  # eight bytes a run
        own = some.select(person, "_name", F.explode(_grams("_name", n)).alias("_gram")).withColumn("_gram", F.xxhash64("_gram"))
        often = runs.join(own.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
        key = own.join(often, "_gram").groupBy(person, "_name").agg(F.min(F.struct("_n", "_gram")).alias("_key"))
        return runs.join(key.select(person, "_name", F.col("_key._gram").alias("_gram")), "_gram").select(message_id, person, "_name")

    found = by_rarest_run(known.where(size.between(3, 7)), 3).unionByName(by_rarest_run(known.where(size >= 8), 8))
    for n in (1, 2):
        short = known.where(size == n)
        found = found.unionByName(low.select(message_id, F.explode(_grams("_text", n)).alias("_name")).join(short, "_name")
                                  .select(message_id, person, "_name"))
    return found.distinct()


def names_in_text(messages: DataFrame, message_id: str, text: str, names: DataFrame, person: str, name: str) -> DataFrame:
    """(message, person) for every name that occurs in a message as a substring.

    A name of eight or more characters is looked up by the one of its eight-character runs that
    the fewest messages have, one of three to seven by its three-character runs, a shorter one
    by itself; the messages found are then searched for the whole name. So a text gives at most
    about four keys per character, whatever lengths names have, and long names that differ in a
    few characters (numbered ones) do not share a key. Repeated messages count each, repeated
    names once.
    """
    low = messages.select(message_id, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text")).repartition(message_id)  # a small file of messages has many runs
    known = names.where(F.length(name) > 0).select(person, F.lower(name).alias("_name")).distinct()
    found = _candidates(low, known, message_id, person)
    return low.join(found, message_id).where(F.contains("_text", "_name")).select(message_id, person)


def resolve_name(messages: DataFrame, message_id: str, text: str, names: DataFrame, person: str, name: str,
                 degree: DataFrame) -> DataFrame:
    """One person per message: among the persons named, the most connected (id breaks ties).

    ``degree`` is (person, n).
    """
    found = names_in_text(messages, message_id, text, names, person, name).join(degree, person, "left")
    return top_k_per_group(found.withColumn("n", F.coalesce("n", F.lit(0))), [message_id],
                           [F.desc("n"), person], 1).select(message_id, person)


def evidence_ids(df: DataFrame, case: str = "case_id", cap: int | None = None) -> DataFrame:
    """The case ids of a result, with ``cap`` the smallest so many; empty if it has no such column."""
    if case not in df.columns:
        return df.sparkSession.createDataFrame([], f"{case} long")
    ids = df.select(case).where(F.col(case).isNotNull())
    return ids if cap is None else ids.orderBy(case).limit(cap)


def confidence(df: DataFrame, row_count: str = "row_count", repaired: str = "repaired") -> DataFrame:
    return df.withColumn("confidence", F.when((F.col(row_count) > 0) & ~F.col(repaired), "high")
                         .when(F.col(row_count) == 0, "low").otherwise("medium"))
