"""A stored full-text index: postings by term and the length of each text, for searches that read no texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallkit import config
from recallkit.functions.lineage import cut
from recallkit.functions.tokens import query_phrases
from recallkit.operators import keyword
from recallkit.sources.manifest import Manifest, new_batch


#: Parts that the postings of one term are dealt in by id.
SHARDS = 16
POSTING = "term string, id string, positions array<int>"
LENGTH = "id string, dl int"


class Index:
    """Postings and lengths under a path, in the batches of a manifest.

    Of an id that was added again the last batch counts, and ids that the searched rows lack do not.
    The postings of a file lie in order of (term, id), so a search reads the row groups of its terms alone,
    and a frequent term is spread over files by id.  Those of the null term are lengths.  A rebuild replaces all batches before it.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = manifest or Manifest(spark, f"{self.path}/manifest")

    def write(self, batch: str, memories: DataFrame) -> list[str]:
        """Files of rows (``id, content``) for a batch that is not listed yet; gives the parts it has then."""
        rows = memories.select(F.col("id").cast("string").alias("id"), "content")
        # lengths come with the postings, so that texts are split once; a term is dealt in SHARDS parts by id
        places = keyword.term_places(rows).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(SHARDS)))
        lists = places.repartition("term", "shard").groupBy("term", "shard", "id").agg(F.collect_list("positions").alias("lists"))
        lists = lists.select("term", "id", F.array_sort(F.flatten("lists")).alias("positions"))
        lists.sortWithinPartitions("term", "id").write.parquet(f"{self.path}/postings/batch={batch}")
        written = self.spark.read.schema(POSTING).parquet(f"{self.path}/postings/batch={batch}")
        sizes = written.where("term IS NULL").select("id", F.explode("positions").alias("dl"))
        sizes.write.parquet(f"{self.path}/lengths/batch={batch}")
        return ["postings", "lengths"]

    def add(self, memories: DataFrame) -> None:
        """Index rows as a batch of its own."""
        batch = new_batch()
        self.manifest.commit(batch, self.write(batch, memories))

    def rebuild(self, memories: DataFrame, upto: int) -> None:
        """Index all rows as of a number of the manifest; what was listed up to it is read no more."""
        batch = new_batch()
        parts = self.write(batch, memories)
        self.manifest.commit(batch, parts, base=parts, upto=upto)

    def bm25(self, memories: DataFrame, query: str, k: int | None = config.TOP_K, project: str | None = None) -> DataFrame:
        """As :func:`recallkit.operators.keyword.bm25`; of ``memories`` no text is read."""
        phrases = query_phrases(query)
        if not phrases or not self.manifest.visible("lengths"):
            return keyword.bm25(memories, query, k, project)
        kind = memories.schema["id"].dataType
        held = self.manifest.read(self.path, "lengths", LENGTH).withColumn("id", F.col("id").cast(kind))
        last = held.groupBy("id").agg(F.max_by(F.struct("version", "dl"), "version").alias("last"))
        rows = memories.select("id", "project", "archived_at").join(last, "id").select("id", "project", "archived_at", "last.*")
        terms = sorted({t for p in phrases for t in p})
        lists = self.manifest.read(self.path, "postings", POSTING).where(F.col("term").isin(*terms))
        lists = lists.withColumn("id", F.col("id").cast(kind))
        places = {t: f"p{i}" for i, t in enumerate(terms)}
        met = lists.groupBy("id", "version").agg(
            *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(name) for t, name in places.items()]
        )
        counts = [_occurrences([F.col(places[t]) for t in p]).alias(f"tf{i}") for i, p in enumerate(phrases)]
        counted = cut(rows.join(met, ["id", "version"]).select("id", "project", "archived_at", "dl", *counts))
        corpus = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        corpus = corpus.crossJoin(counted.agg(*keyword.frequencies(len(phrases))))  # one row each
        return keyword.scored(counted, corpus, len(phrases), k, project)


def _occurrences(places: list[Column]) -> Column:
    """How often terms stand at adjacent positions, from the positions of each."""
    starts = reduce(F.array_intersect, [_earlier(p, j) for j, p in enumerate(places)])
    return F.when(starts.isNull(), 0).otherwise(F.size(starts))


def _earlier(places: Column, steps: int) -> Column:
    # a lambda of two parameters would get the index in the array as its second
    return F.transform(places, lambda x: x - steps) if steps else places
