"""Edits of memories with a log of what they did, their reversal, and what follows from them in the graph and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import empty_strings
from larkspur.operators.chunks import paragraph_chunks
from larkspur.operators.graph import weave
from larkspur.operators.lexical import LexicalIndex

ENTRY = "struct<step:int,op:string,place:int,old:string,new:string,outcome:string>"
#: Lists of a memory that corrections may change.
FIELDS = ("tags", "themes", "personal_facts", "locations", "people", "events", "emotions")


def _steps(edits: DataFrame, *columns: str) -> DataFrame:
    return edits.groupBy("memory_path").agg(F.array_sort(F.collect_list(F.struct("step", *columns))).alias("_edits"))


def apply_fact_edits(memories: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds, updates and removes facts (``memory_path, step, op, old, new``), those of one memory one after the other. A fact is
    named by a part of it that must occur in exactly one, and is added only where it isn't there; else nothing changes. Adds
    ``before``, ``after`` and ``log``, what each step did to which place, the whole old fact included."""
    facts = F.coalesce(F.col("personal_facts"), empty_strings())

    def step(state: Column, e: Column) -> Column:
        now = state["facts"]
        named = F.filter(now, lambda f: f.contains(e["old"]))
        one, whole = F.size(named) == 1, F.get(named, F.lit(0))
        adds = (e["op"] == "add") & ~F.array_contains(now, e["new"])
        changes, removes = (e["op"] == "update") & one & (whole != e["new"]), (e["op"] == "remove") & one
        place = F.when(adds, F.size(now)).when(changes | removes, F.array_position(now, whole).cast("int") - 1)
        after = F.when(adds, F.concat(now, F.array(e["new"]))).when(changes, F.transform(now, lambda f: F.when(f == whole, e["new"]).otherwise(f))).when(removes, F.filter(now, lambda f: f != whole)).otherwise(now)
        done = F.struct(e["step"].cast("int"), e["op"], place, F.when(changes | removes, whole), F.when(adds | changes, e["new"]), F.when(place.isNotNull(), "applied").otherwise("unchanged")).cast(ENTRY)
        return F.struct(after.alias("facts"), F.concat(state["log"], F.array(done)).alias("log")).cast(f"struct<facts:array<string>,log:array<{ENTRY}>>")

    start = F.struct(facts.alias("facts"), F.array().cast(f"array<{ENTRY}>").alias("log")).cast(f"struct<facts:array<string>,log:array<{ENTRY}>>")
    done = memories.join(_steps(edits, "op", "old", "new"), "memory_path").withColumn("_done", F.aggregate("_edits", start, step))
    return done.withColumns({"before": facts, "after": F.col("_done.facts"), "log": F.col("_done.log")}).drop("_edits", "_done")


def edit_log(applied: DataFrame, at: Column) -> DataFrame:
    """``log_id, memory_path, step, op, place, old, new, outcome, at``: one row an edit."""
    rows = applied.select("memory_path", F.inline("log"))
    return rows.select(F.substring(F.md5(F.concat_ws("|", "memory_path", "step", at.cast("string"))), 1, 12).alias("log_id"), "*", at.alias("at"))


def log_entry(log: DataFrame, log_id: str) -> DataFrame:
    return log.filter(F.col("log_id") == log_id)


def log_lines(log: DataFrame) -> DataFrame:
    """``log_id, line``: what each edit did, in words."""
    head = F.format_string("%s %s (%s)", F.upper("op"), F.col("memory_path"), F.col("log_id"))
    told = F.when(F.col("outcome") != "applied", "nothing changed").when(F.col("op") == "add", F.concat(F.lit("added: "), "new")).when(F.col("op") == "remove", F.concat(F.lit("removed: "), "old")).otherwise(F.concat(F.lit("before: "), "old", F.lit("; after: "), "new"))
    return log.select("log_id", F.concat(head, F.lit(": "), told).alias("line"))


def revert_edits(memories: DataFrame, log: DataFrame) -> DataFrame:
    """``memory_path, reverted`` of the memories with edits in ``log`` (all or some of their entries), these taken back from the last
    on: what was added goes, what was changed gets its old words, what was removed comes back to its place. Facts that
    are no longer there stay as they are."""
    facts = F.coalesce(F.col("personal_facts"), empty_strings())

    def back(now: Column, e: Column) -> Column:
        at = F.greatest(F.lit(0), F.least(e["place"], F.size(now)))
        return (
            F.when(e["op"] == "add", F.filter(now, lambda f: f != e["new"]))
            .when(e["op"] == "update", F.transform(now, lambda f: F.when(f == e["new"], e["old"]).otherwise(f)))
            .otherwise(F.concat(F.slice(now, F.lit(1), at), F.array(e["old"]), F.slice(now, at + 1, F.greatest(F.lit(0), F.size(now) - at))))
            .cast("array<string>")
        )

    done = _steps(log.filter("outcome = 'applied'"), "op", "place", "old", "new")
    rows = memories.join(done, "memory_path")
    return rows.select("memory_path", F.aggregate(F.reverse("_edits"), facts.cast("array<string>"), back).alias("reverted"))


def synced_edges(edges: DataFrame, log: DataFrame, memories: DataFrame, at: Column) -> DataFrame:
    """The graph after edits of facts: open edges whose evidence is the start of a fact that went end then; a new fact that names
    a person and a place of its memory (``memory_path, people, locations``) gives an edge, if there is none that is open."""
    applied = log.filter("outcome = 'applied'")
    gone = applied.filter("old is not null").select(F.substring("old", 1, 80).alias("evidence")).distinct().withColumn("_gone", F.lit(True))
    open_ = F.col("t_valid_end").isNull() & F.col("rel").isin("person_loc", "person_event") & F.col("_gone").isNotNull()
    kept = edges.join(gone, "evidence", "left").withColumns({"invalidated_by": F.when(open_, "edit").otherwise(F.col("invalidated_by")), "t_valid_end": F.when(open_, at).otherwise(F.col("t_valid_end"))}).select(*edges.columns)
    told = applied.filter("new is not null").select("memory_path", F.col("new").alias("fact")).join(memories.select("memory_path", "people", "locations"), "memory_path")
    named = told.select("fact", F.explode("people").alias("src"), "locations").select("fact", "src", F.explode("locations").alias("dst"))
    named = named.filter(F.col("fact").contains(F.col("src")) & F.col("fact").contains(F.col("dst"))).groupBy("src", "dst").agg(F.min(F.substring("fact", 1, 80)).alias("evidence"))
    fresh = named.join(kept.filter("rel = 'person_loc' and t_valid_end is null").select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    rows = fresh.select(F.lit("person_loc").alias("rel"), F.lit("Person").alias("src_label"), "src", F.lit("Location").alias("dst_label"), "dst", "evidence", at.alias("t_valid_start"), F.lit(None).cast("timestamp_ntz").alias("t_valid_end"), at.alias("t_ingested"), F.lit(None).cast("string").alias("invalidated_by"))
    return kept.unionByName(rows.select(*edges.columns))


def corrections(issues: DataFrame) -> DataFrame:
    """Reported issues (``memory_path, nth, field, issue_type, current_value, suggested_value``) as changes ``memory_path, step,
    field, action, value``: what is made up, misplaced or inaccurate goes, what is suggested or missing comes."""
    wrong = F.col("issue_type").isin("hallucination", "wrong_association", "inaccurate") & (F.coalesce("current_value", F.lit("")) != "")
    comes = (F.coalesce("suggested_value", F.lit("")) != "") & ((F.col("issue_type").isin("missing", "inaccurate")) | wrong)
    out = F.when(wrong, F.struct((2 * F.col("nth")).alias("step"), F.lit("remove").alias("action"), F.col("current_value").alias("value")))
    into = F.when(comes, F.struct((2 * F.col("nth") + 1).alias("step"), F.lit("add").alias("action"), F.col("suggested_value").alias("value")))
    return issues.select("memory_path", "field", F.inline(F.array_compact(F.array(out, into)))).select("memory_path", "step", "field", "action", "value")


def correct_fields(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Memories with the lists named in FIELDS changed by ``changes`` (see `corrections`; ``set`` replaces a list, and a value
    ``#3`` means the fourth entry), those of one memory one after the other."""

    def step(items: Column, e: Column) -> Column:
        value = e["value"]
        nth = F.when(value.rlike("^#[0-9]+$"), F.substring(value, 2, 9).cast("int"))
        without = F.when(nth.isNotNull(), F.filter(items, lambda x, i: i != nth)).otherwise(F.filter(items, lambda x: ~x.contains(value)))
        return F.when(e["action"] == "set", F.array(value)).when((e["action"] == "add") & ~F.array_contains(items, value), F.concat(items, F.array(value))).when(e["action"] == "remove", without).otherwise(items).cast("array<string>")

    joined = memories.join(_steps(changes, "field", "action", "value"), "memory_path", "left")
    own = lambda field: F.filter(F.coalesce(F.col("_edits"), F.array().cast(joined.schema["_edits"].dataType)), lambda e: e["field"] == field)
    changed = {f: F.aggregate(own(f), F.coalesce(F.col(f), empty_strings()).cast("array<string>"), step) for f in FIELDS if f in memories.columns}
    return joined.withColumns(changed).drop("_edits")


def pending_embeddings(log: DataFrame) -> DataFrame:
    """``memory_path, n, last_at``: memories whose text changed since they were embedded, and how often."""
    return log.filter("outcome = 'applied'").groupBy("memory_path").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))


def snapshot(memories: DataFrame, paths: DataFrame, at: Column) -> DataFrame:
    """The rows of some paths as they are, with the time: what an edit may be compared with or undone by."""
    return memories.join(paths.select("memory_path").distinct(), "memory_path", "left_semi").withColumn("snapshot_at", at)


def cascade(edges: DataFrame, chunks: DataFrame, index: LexicalIndex, memories: DataFrame, documents: DataFrame, paths: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """What follows from a correction of some memories (``path``): their edges are woven anew, their chunks cut anew and those of the
    lexical index replaced. Gives the graph and the chunk table (``chunk_id, path, chunk_index, para``) as they are then."""
    asked = paths.select("path").distinct()
    mine = memories.join(asked.withColumnRenamed("path", "memory_path"), "memory_path", "left_semi")
    kept = edges.join(asked.select(F.col("path").alias("src"), F.lit("Memory").alias("src_label")), ["src", "src_label"], "left_anti").select(*edges.columns)
    woven = weave(mine, at).select(*edges.columns)
    fresh = woven.join(kept.select("rel", "src", "dst").distinct(), ["rel", "src", "dst"], "left_anti").select(*edges.columns)
    cut = paragraph_chunks(documents.join(asked, "path", "left_semi"), "path", "text")
    index.refresh(cut.select("chunk_id", "para"), "para", chunks.join(asked, "path", "left_semi").select("chunk_id"))
    return kept.unionByName(fresh), chunks.join(asked, "path", "left_anti").select(*cut.columns).unionByName(cut)
