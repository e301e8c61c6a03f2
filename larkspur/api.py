"""What a client calls: searches, look-ups, timelines, upkeep and reversible edits over one set of tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import INTENTS, intents, paragraphs, sections
from larkspur.operators import edits, graph, lifecycle, memories, ranking
from larkspur.operators.chunks import paragraph_chunks, parent_sections
from larkspur.operators.lexical import LexicalIndex
from larkspur.plans import search as plans
from larkspur.session import cut_lineage, spread
from larkspur.sources.inbox import append_accesses


def at(when: datetime) -> Column:
    return F.lit(when).cast("timestamp_ntz")


@dataclass
class Vault:
    """The tables of a vault; every method gives a DataFrame and changes nothing."""

    documents: DataFrame
    memories: DataFrame
    edges: DataFrame
    accesses: DataFrame
    vectors: DataFrame | None = None
    index: LexicalIndex | None = None

    def build_index(self, folder: str) -> Vault:
        """The same vault with a lexical index over its paragraphs, kept at ``folder``."""
        chunks = paragraph_chunks(spread(self.documents.select("path", "text")), "path", "text").select("chunk_id", "para")
        return replace(self, index=LexicalIndex.build(chunks, "chunk_id", "para", folder))

    def corpus(self) -> plans.Corpus:
        docs = self.documents.select("path", "text", F.col("date_created").alias("date"), "type")
        return plans.Corpus(docs, self.index, self.vectors, self.edges, self.accesses)

    def _query(self, query: str) -> DataFrame:
        return self.documents.sparkSession.createDataFrame([("q", query)], "query_id string, query string")

    def search_memory(self, query: str, as_of: datetime, k: int = 5, domains: list[str] | None = None, doc_type: str | None = None, log_to: str | None = None, **options: object) -> DataFrame:
        """The best k; where ``log_to`` names a log, what was found is appended to it as read at ``as_of``."""
        found = plans.search(self.corpus(), self._query(query), at(as_of), plans.Options(k=k, domains=tuple(domains or ()), doc_type=doc_type, **options))
        if log_to:
            found = cut_lineage(found)
            append_accesses(found, log_to, at(as_of))
        return found

    def search_with_sections(self, query: str, as_of: datetime, k: int = 5) -> DataFrame:
        """The best k with the whole section that each one's first chunk stands in."""
        parts = self.documents.select("path", F.posexplode(sections(F.coalesce("text", F.lit("")))).alias("section_no", "section"))
        rows = parts.select("path", "section_no", F.col("section.title").alias("title"), F.posexplode(paragraphs(F.col("section.body"))).alias("sibling_order", "para"))
        return parent_sections(self.search_memory(query, as_of, k), rows)

    def query_memory_at_time(self, query: str, when: datetime, k: int = 5) -> DataFrame:
        """The best k among memories with an edge valid at that time."""
        found = plans.search(self.corpus(), self._query(query), at(when), plans.Options(k=3 * k))
        return plans.search_at(found.select("query_id", "path", "score"), self.edges, at(when), k)

    def get_entity_timeline(self, name: str) -> DataFrame:
        names = self.edges.sparkSession.createDataFrame([(name,)], "name string")
        return graph.timeline(self.edges, names).orderBy(F.asc_nulls_first("t_valid_start"))

    def get_profile(self, size: int = 250) -> DataFrame:
        return self.documents.filter(F.col("path").startswith("10_Profile/")).select("path", F.substring("text", 1, size).alias("start"))

    def list_journals(self, year: int, limit: int = 20) -> DataFrame:
        m = memories.current_memories(self.memories).filter(F.col("memory_path").startswith(f"30_Journal/{year}/"))
        return m.orderBy(F.desc("memory_path")).limit(limit).select("memory_path", F.substring("summary", 1, 80).alias("line"))

    def read_file(self, path: str, as_of: datetime | None = None, log_to: str | None = None) -> DataFrame:
        """One document; where ``log_to`` names a log, that it was read."""
        found = self.documents.filter(F.col("path") == path).select("path", "text")
        if log_to and as_of:
            append_accesses(found, log_to, at(as_of), "read_file")
        return found

    def find_memories(self, keyword: str) -> DataFrame:
        word = keyword.lower()
        return self.documents.filter(F.lower("path").contains(word) | F.lower(F.coalesce("text", F.lit(""))).contains(word)).select("path")

    def inspect(self, path: str) -> DataFrame:
        """What the vault, the graph and the index have about one memory."""
        asked = self.documents.sparkSession.createDataFrame([(path,)], "path string")
        return lifecycle.trace(asked, memories.current_memories(self.memories), self.edges, paragraph_chunks(self.documents, "path", "text"))

    def get_memory_health(self) -> DataFrame:
        m = memories.current_memories(self.memories)
        return m.agg(F.count("*").alias("n"), F.sum(F.col("dormant").cast("int")).alias("n_dormant"), F.count("enriched_at").alias("n_enriched"))

    def optimize_memory(self, as_of: datetime) -> dict[str, DataFrame]:
        """What upkeep would do: pairs recalled together, memories to let rest, names to merge."""
        used = ranking.activation(memories.accesses(self.accesses), "memory_path", "accessed_at", at(as_of))
        people = self.edges.filter("dst_label = 'Person'").select(F.col("dst").alias("name")).distinct()
        return {
            "co_recalled": memories.co_recalled(memories.accesses(self.accesses), F.col("accessed_at"), "memory_path"),
            "forgettable": memories.forgettable(memories.current_memories(self.memories), used),
            "names": memories.name_groups(people, "name", graph.degrees(self.edges, "Person")),
        }

    def _edit(self, path: str, op: str, old: str, new: str) -> DataFrame:
        edit = self.memories.sparkSession.createDataFrame([(path, 1, op, old, new)], "memory_path string, step int, op string, old string, new string")
        return edits.apply_fact_edits(memories.current_memories(self.memories), edit)

    def add_fact(self, path: str, fact: str) -> DataFrame:
        return self._edit(path, "add", "", fact)

    def update_fact(self, path: str, old: str, new: str) -> DataFrame:
        return self._edit(path, "update", old, new)

    def invalidate_fact(self, path: str, old: str) -> DataFrame:
        return self._edit(path, "remove", old, "")

    def correct_text(self, path: str, old: str, new: str) -> DataFrame:
        edits = self.documents.sparkSession.createDataFrame([(path, old, new)], "path string, old string, new string")
        return memories.correct_texts(self.documents.select("path", "text"), edits)

    def revert(self, edited: DataFrame, log: DataFrame, log_id: str | None = None) -> DataFrame:
        """The fact lists of edited memories (``memory_path, personal_facts``) with all edits of a log, or one, taken back."""
        return edits.revert_edits(edited, edits.log_entry(log, log_id) if log_id else log)

    def guide(self, requests: DataFrame, text: str) -> DataFrame:
        """Which kinds of call a request asks for."""
        return requests.withColumn("classes", intents(F.col(text)))


CLASSES = tuple(INTENTS)
