"""Replicated changes: which of them collide, what a collision mode does about it, and how a stream of them is applied.

A change row has the key columns, `type` (I, U or D), `priority`, `changed_at`, `source` (the number of its database),
`transaction` and `sequence`, and the new values. A target's rows may have the same columns, of the change that they
come from. The same functions serve batch frames and the micro-batches of a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["source", "transaction", "sequence"]
ORIGIN = ["priority", "changed_at", *ORDER]

#: Modes that only detect collisions (benign: and drop repeats), and modes that resolve them.
DETECTING, RESOLVING = ("passive", "active", "benign"), ("priority", "last_write")

#: What an error does: leaves out its transaction, or its row, or stops the data set, the database or the server.
ERROR_MODES = ("skip_transaction", "skip_row", "quiet_cdds", "quiet_database", "quiet_server")


def resolve(target: DataFrame | None, changes: DataFrame, keys: list[str], mode: str = "last_write") -> DataFrame:
    """The changes with their `outcome`: applied, dropped (it loses, or changes nothing), benign (a repeat) or error.

    Detecting modes take the changes of a key as they come, by time, source, transaction and sequence. Each is compared
    with what the target's row and the changes before it left; a change in error leaves all as it was.

    * passive: inserts of rows that are there and deletes of rows that are not are errors; an update of a missing row is
      not noticed, and changes nothing.
    * active: these, and updates of missing rows, are errors.
    * benign: as active, but a change that the row has from the same transaction already is benign. (An update is the
      same if its sequence is, too.)

    Resolving modes compare the last change of each source, and the target's row where its source sent no change:

    * priority: the highest wins, none counts as 0; of equal ones the lower database number.
    * last_write: the latest wins; of equal ones the lower database number. A delete needs no later time than the
      target's row.

    One shuffle by key; a key's changes are sorted by one task, which may spill them, and pass through its windows.
    """
    if mode not in DETECTING + RESOLVING:
        raise ValueError(f"no collision mode: {mode}")
    kinds = dict(changes.dtypes)
    rows = changes.withColumn("_old", F.lit(False))
    if target is not None:
        there = target.join(changes.select(*keys).distinct(), keys, "left_semi")
        origin = [(F.col(c) if c in target.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in ORIGIN]
        rows = rows.unionByName(there.select(*keys, *origin, F.lit("I").alias("type"), F.lit(True).alias("_old")), allowMissingColumns=True)
    rows = rows.repartition(*keys)
    rows = _detected(rows, keys, mode) if mode in DETECTING else _resolved(rows, keys, mode)
    return rows.where("not _old").select(*changes.columns, "outcome")


def _detected(rows: DataFrame, keys: list[str], mode: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(F.desc("_old"), F.col("changed_at").asc_nulls_last(), *ORDER).rowsBetween(Window.unboundedPreceding, -1)
    # updates and changes in error leave a row there or missing as it was, so the last insert or delete tells
    rows = rows.withColumn("_there", F.coalesce(F.last(F.when(F.col("type") != "U", F.col("type") == "I"), ignorenulls=True).over(before), F.lit(False)))
    kind, there = F.col("type"), F.col("_there")
    wrong = F.when(kind == "I", there).otherwise(~there)
    outcome = F.when(~wrong, "applied").otherwise("error")
    if mode == "passive":
        outcome = F.when((kind == "U") & ~there, "dropped").otherwise(outcome)
    rows = rows.withColumn("outcome", outcome)
    if mode == "benign":
        last = F.last(F.when((F.col("outcome") == "applied") & (kind != "D"), F.struct(*ORDER)), ignorenulls=True).over(before)
        rows = rows.withColumn("_last", last)
        same = (F.col("source") == F.col("_last.source")) & (F.col("transaction") == F.col("_last.transaction"))
        repeated = there & same & ((kind == "I") | ((kind == "U") & (F.col("sequence") == F.col("_last.sequence"))))
        rows = rows.withColumn("outcome", F.when(~F.col("_old") & F.coalesce(repeated, F.lit(False)), "benign").otherwise(F.col("outcome")))
    return rows


def _resolved(rows: DataFrame, keys: list[str], mode: str) -> DataFrame:
    own = Window.partitionBy(*keys, "source").orderBy("_old", F.desc("transaction"), F.desc("sequence"))
    rows = rows.withColumn("_latest", F.row_number().over(own) == 1)
    rank = F.coalesce("priority", F.lit(0)) if mode == "priority" else F.col("changed_at")
    best = Window.partitionBy(*keys).orderBy(F.desc(F.col("_latest") & ~F.col("_old")), rank.desc_nulls_last(), "source")
    old = F.max(F.when(F.col("_old") & F.col("_latest"), F.struct(rank.alias("rank"), F.col("source").alias("source")))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_n", F.row_number().over(best)).withColumn("_row", old)
    later = F.col("_row.rank").isNull() | (rank > F.col("_row.rank")) | ((rank == F.col("_row.rank")) & (F.col("_row.source").isNull() | (F.col("source") < F.col("_row.source"))))
    if mode == "last_write":
        later = later | (F.col("type") == "D")
    wins = (F.col("_n") == 1) & (F.col("_row").isNull() | F.coalesce(later, F.lit(False)))
    return rows.withColumn("outcome", F.when(wins, "applied").otherwise("dropped"))


def winners(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key: the latest, of equal ones that of the lower database number, then the last of its transaction.

    The window keeps its first row only, so most rows are left out before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("changed_at").desc_nulls_last(), F.asc("source"), F.desc("transaction"), F.desc("sequence"))
    return changes.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def apply_resolved(target: DataFrame, resolved: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The target after resolved changes: the last applied one of each key."""
    return apply(target, winners(resolved.where("outcome = 'applied'"), keys), keys, values)


def collisions(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several sources changed, with the number of changes and sources."""
    return changes.groupBy(*keys).agg(F.count("*").alias("n_changes"), F.count_distinct("source").alias("n_sources")).where("n_sources > 1")


def apply(target: DataFrame, changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The target after changes of which there is one for each key: deleted, updated and inserted rows in one full join."""
    new = changes.select(*(F.col(k).alias(f"_{k}") for k in keys), "type", *(F.col(v).alias(f"_{v}") for v in values))
    on = [target[k] == F.col(f"_{k}") for k in keys]
    joined = target.join(new, on, "full")
    changed = F.col("type").isNotNull()
    columns = [F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys] + [F.when(changed, F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    return joined.where(~changed | (F.col("type") != "D")).select(*columns)


def duplicate_inserts(target: DataFrame, changes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inserts of keys that are not there, inserts that collide)."""
    inserts = changes.where("type = 'I'")
    there = target.select(*keys)
    return inserts.join(there, keys, "left_anti"), inserts.join(there, keys, "left_semi")


def shadow(changes: DataFrame, keys: list[str]) -> DataFrame:
    """History of all changes: each row is in the archive unless it is its key's last one."""
    later = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("changed_at"), *(F.desc(c) for c in ORDER)))
    return changes.withColumn("in_archive", (later > 1).cast("int"))


def subset(changes: DataFrame, rows: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The part of a data set that a target takes: rows by value, columns by name."""
    out = changes if rows is None else changes.where(rows)
    return out if columns is None else out.select(*columns)


#: What a target takes part in: sending changes, receiving them, and having collisions looked for.
TARGETS = {"full_peer": (True, True, True), "protected_read_only": (False, True, True), "unprotected_read_only": (False, True, False)}


def deliver(target: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], target_type: str = "full_peer", mode: str = "last_write") -> DataFrame:
    """A target after incoming changes: unprotected targets take each key's last change, the others look for collisions by mode."""
    _, receives, checks = TARGETS[target_type]
    if not receives:
        return target
    if checks:
        return apply_resolved(target, resolve(target, incoming, keys, mode), keys, values)
    return apply(target, winners(incoming, keys), keys, values)


def outgoing(local: DataFrame, target_type: str) -> DataFrame:
    """Changes that a target of this type sends on: none from read-only ones."""
    return local if TARGETS[target_type][0] else local.where("false")


def split_errors(changes: DataFrame, keys: list[str], mode: str, on_error: str = "skip_transaction", target: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes to apply, changes in error with their `reason`).

    In error are rows with a null key or an unknown type (malformed), and collisions of a detecting mode (collision).
    skip_row leaves out these rows; all other modes leave out their whole transactions (`reason` transaction for the
    rest of one), and what remains is looked at once more, as rows that it built on may be gone.
    """
    if on_error not in ERROR_MODES:
        raise ValueError(f"no error mode: {on_error}")
    bad = F.coalesce(~F.col("type").isin("I", "U", "D"), F.lit(True))
    for k in keys:
        bad = bad | F.col(k).isNull()
    broken, good = changes.where(bad).withColumn("reason", F.lit("malformed")), changes.where(~bad)
    resolved = resolve(target, good, keys, mode)
    wrong = resolved.where("outcome = 'error'").drop("outcome").withColumn("reason", F.lit("collision"))
    errors = broken.unionByName(wrong)
    if on_error != "skip_row":
        lost = errors.select("source", "transaction").distinct()
        rest = resolved.where("outcome <> 'error'").join(lost, ["source", "transaction"], "left_semi").select(*changes.columns, F.lit("transaction").alias("reason"))
        resolved = resolve(target, good.join(lost, ["source", "transaction"], "left_anti").select(*changes.columns), keys, mode)
        errors = errors.unionByName(rest).unionByName(resolved.where("outcome = 'error'").drop("outcome").withColumn("reason", F.lit("collision")))
    return resolved.where("outcome = 'applied'").drop("outcome"), errors


class Quieted(RuntimeError):
    """A data set, database or server stopped by an error."""


def batch_writer(path: str, keys: list[str], values: list[str], mode: str = "last_write", on_error: str = "skip_transaction", target: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that appends the last applied change of each key under `path`, one folder for a batch id.

    A repeated batch overwrites its own folder, so recovery applies it once. Changes in error go to `path`_errors, to be
    tried again; the quiet modes then end the stream of what they quiet (Quieted), with nothing of the batch applied.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, errors = split_errors(batch, keys, mode, on_error, target)
            folder = f"{path}_errors/batch={batch_id}"
            errors.write.mode("overwrite").parquet(folder)
            if on_error.startswith("quiet") and not batch.sparkSession.read.schema(errors.schema).parquet(folder).isEmpty():
                raise Quieted(f"{on_error.removeprefix('quiet_')} quieted: batch {batch_id} has changes in error")
            winners(good, keys).select(*keys, "type", "priority", "changed_at", *ORDER, *values).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write
