"""The engine as its users call it: save, search, delete, prune and count."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallkit import config
from recallkit.config import SearchStrategy
from recallkit.functions.lineage import cut
from recallkit.operators import graph, stats
from recallkit.plans import ingest, lifecycle, search
from recallkit.plans.actions import ActionLog
from recallkit.sources import adapters
from recallkit.sources import text as texts
from recallkit.sources.embedders import Provider, embed, hash_vectors
from recallkit.sources.index import Index
from recallkit.sources.manifest import Manifest, new_batch
from recallkit.sources.store import ReadOnly, Store

_TEXT = T.StringType()
EDGE = T.StructType(
    [T.StructField(n, _TEXT) for n in ("from_id", "to_id", "edge_type")] + [T.StructField("props", T.MapType(_TEXT, _TEXT)), T.StructField("stub", T.BooleanType())]
)
RAW = T.StructType(
    [T.StructField(n, _TEXT) for n in ("id", "text", "source_type", "project")]
    + [T.StructField("metadata", T.MapType(_TEXT, _TEXT))]
)

FAILURE = "id string, error string, at timestamp"
MAX_LOG_CHARS = 200_000


def _given(tags: Sequence[str] = (), importance: float | None = None) -> dict[str, str]:
    """What a caller sets, as metadata."""
    return ({"tags": ",".join(tags)} if tags else {}) | ({} if importance is None else {"importance": str(importance)})


def _pairs(values: dict[str, str]) -> list[Column]:
    return [F.lit(x) for pair in values.items() for x in pair]


class Engine:
    """Memories and edges under one folder; batches of any size go through the same plans."""

    def __init__(self, spark: SparkSession, path: str, provider: Provider = hash_vectors, read_only: bool = False,
                 log_actions: bool = False):
        self.spark, self.provider, self.read_only = spark, provider, read_only
        self.manifest = Manifest(spark, f"{path}/manifest")
        self.store = Store(spark, f"{path}/memories", read_only, manifest=self.manifest)
        self.path = path.rstrip("/")
        self.actions = ActionLog(spark, f"{path}/log") if log_actions else None
        self.index = Index(spark, f"{path}/index", self.manifest)

    def memories(self) -> DataFrame:
        return self.store.current()

    def edges(self) -> DataFrame:
        """Edges between rows that exist, and references (``stub``) of such rows; one of a key."""
        rows = self.manifest.read(self.path, "edges", EDGE)
        once = rows.groupBy("from_id", "to_id", "edge_type").agg(
            F.max_by("props", F.size("props")).alias("props"), F.bool_or(F.coalesce("stub", F.lit(False))).alias("stub")
        )
        m = self.memories()
        held = m.select(F.col("id").alias("from_id"))
        return graph.induced(once.where("NOT stub"), m).unionByName(once.where("stub").join(held, "from_id", "left_semi"))

    def links(self) -> DataFrame:
        """The edges that searches follow."""
        return self.edges().where("NOT stub").drop("stub")

    def _write_edges(self, batch: str, edges: DataFrame) -> list[str]:
        edges = edges if "stub" in edges.columns else edges.withColumn("stub", F.lit(False))
        rows = edges.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EDGE])
        rows.write.parquet(f"{self.path}/edges/batch={batch}")
        return ["edges"]

    def _add_edges(self, edges: DataFrame) -> None:
        batch = new_batch()
        self.manifest.commit(batch, self._write_edges(batch, edges))

    def failures(self) -> DataFrame:
        """``id, error, at`` of all texts that could not be ingested."""
        return self.manifest.read(self.path, "failures", FAILURE).drop("version")

    def save_all(self, raw: DataFrame, now: str, refused: DataFrame | None = None) -> DataFrame:
        """Ingest raw texts (``id, text, source_type, project, metadata``); gives the decisions.

        ``tags`` (with commas) and ``importance`` in the metadata set those columns.  Texts that
        could not be ingested are in :meth:`failures`, ``refused`` (``id, error``) among them.  Rows, edges, postings and failures are one
        batch: it is seen whole once the manifest lists it, and not at all if a step fails.
        """
        if self.read_only:
            raise ReadOnly(self.store.path)
        active = cut(self.memories().where("archived_at IS NULL"))
        check = lambda rows: self.store.checked(rows)
        batch = ingest.ingest(raw, active, now, self.provider, promote_metadata=True, check=check)
        replaced = batch.decisions.where("action = 'REPLACE'").select(F.col("existing_id").alias("id"))
        name = new_batch()
        parts = [*self.index.write(name, batch.memories), *self._write_edges(name, batch.edges), "failures"]
        failed = batch.failed.select(F.col("id").cast("string").alias("id"), "error")
        failed = failed if refused is None else failed.unionByName(refused)
        failed.select("id", "error", F.lit(now).cast("timestamp").alias("at")).write.parquet(
            f"{self.path}/failures/batch={name}"
        )
        self.store.commit(batch.memories, replaced, now, name, parts)
        return batch.decisions

    def ingest(self, kind: str, now: str, **tables) -> DataFrame:
        """Save what the adapter of a kind makes of its tables; see :mod:`recallkit.sources.adapters`."""
        raw, refused = adapters.adapt(kind, **tables)
        return self.save_all(raw, now, refused)

    def save(
        self,
        content: str,
        now: str,
        source: str = "conversation",
        project: str | None = None,
        metadata: dict[str, str] | None = None,
        tags: Sequence[str] = (),
        importance: float | None = None,
    ) -> DataFrame:
        """Save one text; an unknown source counts as a conversation."""
        kind = source if source in config.SOURCE_TYPES else "conversation"
        row = (f"{now}|{content}", content, kind, project, {**(metadata or {}), **_given(tags, importance)})
        return self.save_all(self.spark.createDataFrame([row], RAW), now)

    def flush(self, log: str, now: str, session_id: str | None = None, project: str | None = None,
              tags: Sequence[str] = ()) -> DataFrame:
        """Save a transcript by windows of turns; one of over ``MAX_LOG_CHARS`` characters is refused."""
        if len(log) > MAX_LOG_CHARS:
            raise ValueError(f"INVALID_PARAMETER: a transcript has at most {MAX_LOG_CHARS} characters")
        turns = texts.turns_of(self.spark.createDataFrame([(session_id or now, log)], "id string, text string"))
        meta = F.create_map(
            F.lit("session_id"), F.col("id"), F.lit("turn_start"), F.col("turn_start").cast("string"),
            F.lit("turn_end"), F.col("turn_end").cast("string"), *_pairs(_given(tags)),
        )
        raw = texts.windows_of(turns).select(
            F.concat_ws("|", "id", "turn_start").alias("id"), F.col("content").alias("text"),
            F.lit("conversation").alias("source_type"), F.lit(project).cast("string").alias("project"), meta.alias("metadata"),
        )
        return self.save_all(raw, now)

    def save_pages(
        self, pages: DataFrame, now: str, project: str | None = None, tags: Sequence[str] = ()
    ) -> DataFrame:
        """Save fetched pages (``page_id, url, html``, and ``content_type`` if known).

        Pages that may not be ingested are in :meth:`failures` with the reason.
        """
        refused = texts.refused_pages(pages).select(F.concat_ws("|", F.col("id").cast("string"), "url").alias("id"), "error")
        raw = texts.documents_from_pages(pages).select(
            F.concat_ws("|", F.col("id").cast("string"), "url").alias("id"), "text", F.lit("url").alias("source_type"),
            F.lit(project).cast("string").alias("project"), F.create_map(F.lit("url"), F.col("url"), *_pairs(_given(tags))).alias("metadata"),
        )
        return self.save_all(raw, now, refused)

    def search(self, query: str, now: str, feedback: bool = True, **options) -> DataFrame:
        """Rows as ``memory_id, content, score, source_type, metadata``; hits count as accesses."""
        m, vector, began = self.memories(), self.provider([query])[0], time.monotonic()
        flags, observed = [], {} if self.actions else None
        found = cut(search.search(m, self.links(), query, vector, now, index=self.index, degrade=True, flags=flags,
                                  observed=observed, **options))
        if self.actions:
            strategy = asdict(options.get("strategy") or SearchStrategy())
            counts = {name: x.get["n"] for name, x in observed.items()} | {"returned": found.count()}
            about = {"query": query, "strategy": strategy, "project": options.get("project")}
            self.actions.record("search", now, about, counts, time.monotonic() - began, flags)
        if feedback and not self.read_only:
            self.store.touch(found.select("id"), now)
        return search.response(found, m)

    def answer(self, query: str, now: str, strategy: SearchStrategy | None = None, **options) -> DataFrame:
        """A search as one row: query, strategy, number of rows before the cut, and the results."""
        strategy = strategy or SearchStrategy()
        m, vector, flags = self.memories(), self.provider([query])[0], []
        found = cut(search.search(m, self.links(), query, vector, now, strategy=strategy, with_total=True,
                                  index=self.index, degrade=True, flags=flags, **options))
        return search.answer(query, strategy, found, m, flags)

    def search_graph(
        self, query: str, now: str, edge_types: Sequence[str] | None = None, depth: int = 2,
        project: str | None = None, strict: bool = False,
    ) -> DataFrame:
        m, vector = self.memories(), self.provider([query])[0]
        found = search.search_graph(m, self.links(), query, vector, now, edge_types, depth, project, strict,
                                    index=self.index, degrade=True)
        return search.response(found, m)

    def delete(self, ids: Sequence[str]) -> None:
        """Remove rows; edges that touch them vanish with them."""
        self.store.delete(self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def prune(self, now: str, older_than_days: int = config.RETENTION_DAYS, dry_run: bool = True) -> DataFrame:
        """Archive, consolidate and purge; ``checked, archived, consolidated, purged``.

        Rows into which others were merged get new vectors.
        """
        m = self.memories()
        naive = m.withColumn("archived_at", F.col("archived_at").cast("timestamp_ntz"))
        result = lifecycle.clean_up(naive, self.links(), now, retention_days=older_than_days)
        counts, kept_on = cut(result.counts), cut(result.survivors)
        if not dry_run:
            kept = cut(result.memories.select("id", F.col("archived_at").cast("timestamp").alias("archived_at")))
            gone = cut(m.select("id").join(kept.select("id"), "id", "left_anti"))
            changed = m.select("id", F.col("archived_at").alias("was")).join(kept, "id")
            self.store.update(cut(changed.where("was IS NULL AND archived_at IS NOT NULL").select("id", "archived_at")))
            self._add_edges(result.new_edges)
            self.store.delete(gone)
            stayed = self.memories().join(kept_on, "id", "left_semi").select("id", "content")
            self.store.update(cut(embed(stayed, self.provider).select("id", "embedding")))
        return counts

    def consolidate_all(self, now: str, page_rows: int = 100_000, most: int | None = None) -> int:
        """Consolidate what was saved since the last time, page after page; gives the pages done.

        Each page is one batch: rows archived, edges, and the cursor that the next one starts from,
        so a run that dies is taken up where it stood.  ``most`` stops after as many pages.
        """
        if self.read_only:
            raise ReadOnly(self.store.path)
        held = self.manifest.latest("cursor")
        active = cut(self.memories())
        done = 0
        for page in lifecycle.consolidation_pages(active, page_rows, tuple(held) if held else None):
            name = new_batch()
            stamp = F.create_map(F.lit("consolidated_at"), F.lit(now))
            edges = page.merged.select(F.col("survivor").alias("from_id"), F.col("id").alias("to_id"),
                                       F.lit(config.FREE_EDGE).alias("edge_type"), stamp.alias("props"))
            parts = self._write_edges(name, edges)
            self.store.commit(None, page.merged.select("id"), now, name, parts, cursor=list(page.cursor))
            done += 1
            if done == most:
                break
        return done

    def reindex(self) -> None:
        """Index all rows anew, as after a change of texts in the store; older postings are read no more."""
        at = self.manifest.last()
        self.index.rebuild(self.store.current(at).select("id", "content"), at)

    def compact(self) -> None:
        """Rows and accesses as one batch, edges as another, postings anew."""
        self.store.compact()
        at, batch = self.manifest.last(), new_batch()
        parts = self._write_edges(batch, cut(self.edges()))
        self.manifest.commit(batch, parts, base=parts, upto=at)
        self.reindex()

    def reembed(self, provider: Provider) -> None:
        """New vectors for all rows, archived ones included, in one distributed pass."""
        self.store.update(cut(embed(self.memories().select("id", "content"), provider).select("id", "embedding")))
        self.provider = provider

    def vacuum(self, hours: float = 24.0) -> int:
        """Delete files that no reader sees any more (of batches that failed or were replaced), older than ``hours``."""
        if self.read_only:
            raise ReadOnly(self.store.path)
        places = [(self.store.path, "rows"), (self.store.path, "touches"), (self.path, "edges"), (self.path, "failures"),
                  (self.index.path, "postings"), (self.index.path, "lengths")]
        return sum(self.manifest.vacuum(root, part, hours) for root, part in places)

    def stats(self, project: str | None = None) -> DataFrame:
        return stats.overall(self.memories(), project)

    def projects(self) -> DataFrame:
        return stats.projects(self.memories())
