"""The library as one object: tables by name, searches, status, maintenance plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import tokens
from .operators import evaluate, library, metadata, postings, queue, similarity
from .plans import intent, search
from .session import intermediate

TAG_CONFIDENCE = 0.5  # of tags whose list carries none
TOP_TAGS = 6


@dataclass
class Selection:
    """Models in use; the side images are scaled to for recognition is kept between 960 and 4096."""

    ocr: str = "balanced"
    text: str = "txt-base/v3"
    visual: str | None = None
    ocr_side: int = 1280
    allowed: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"ocr": ("fast", "balanced", "accurate")})

    def __post_init__(self):
        self.ocr_side = max(960, min(4096, self.ocr_side))
        for role, names in self.allowed.items():
            if getattr(self, role) not in names:
                raise ValueError(f"unknown {role} model {getattr(self, role)!r}")


class Engine:
    def __init__(self, spark: SparkSession, root: str, selection: Selection | None = None):
        self.spark, self.root, self.selection = spark, root, selection or Selection()
        self._derived: dict[str, DataFrame] | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def assets(self) -> DataFrame:
        return library.latest_assets(self.table("assets"))

    def chunks(self) -> DataFrame:
        return self.table("chunks").dropDuplicates(["id"])

    # -- status
    def folders(self) -> DataFrame:
        return library.folder_rollup(self.table("folders"), self.assets()).orderBy("created_at")

    def status(self) -> DataFrame:
        return library.status(self.assets(), self.table("stage_jobs").dropDuplicates(["id"]), self.chunks())

    def pipeline(self, asset: str) -> DataFrame:
        return queue.pipeline_status(self.table("stage_jobs").dropDuplicates(["id"]), asset)

    def recent(self, n: int = 20) -> DataFrame:
        return library.recent(self.assets(), n)

    # -- search
    def queries(self, texts: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")

    def near_chunks(self, chunks: DataFrame, assets: DataFrame, vectors: DataFrame) -> DataFrame:
        """(query_id, asset_id, chunk_id, exact, semantic): for each query and allowed asset the most similar chunk (the smallest id among equals), none cut."""
        usable = chunks.where((F.col("embedding_profile_id") == self.selection.text) & (F.size("embedding") == F.col("embedding_dimensions")))
        allowed = usable.join(assets.select(F.col("id").alias("asset_id")), "asset_id", "left_semi").select(F.struct("asset_id", F.col("id").alias("chunk_id")).alias("at"), "embedding")
        scores = similarity.cosine_scores(allowed, "at", "embedding", vectors).select("query_id", "at.*", "score")
        best = F.min_by(F.struct("chunk_id", "score"), F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("i")))
        return scores.groupBy("query_id", "asset_id").agg(best.alias("b")).select("query_id", "asset_id", "b.chunk_id", F.lit(0.0).alias("exact"), F.col("b.score").alias("semantic"))

    @staticmethod
    def document_types(chunks: DataFrame, assets: DataFrame) -> DataFrame:
        """(asset_id, document_type, confidence): the strongest type of which a cue or code occurs in a file's name or in one of its texts.

        Texts are not put together, as one asset may hold a large share of all: a code parted by two chunks is not seen."""
        named = assets.select(F.col("id").alias("asset_id"), "filename")
        read = named.join(chunks.select("asset_id", "text"), "asset_id", "left")
        found = metadata.classify(read).where("document_type <> 'other'")
        return found.groupBy("asset_id").agg(F.max(F.struct("confidence", "document_type")).alias("t")).select("asset_id", "t.document_type", "t.confidence")

    def derived(self) -> dict[str, DataFrame]:
        """What searches read, made once for this engine and written to the shared folder: chunks (each once, with tokens), metadata,
        entities, document types and tags of the whole library. Filters of a search apply to these tables."""
        if self._derived is None:
            at = intermediate(self.spark, "derived")

            def stored(name: str, df: DataFrame) -> DataFrame:
                df.write.parquet(f"{at}/{name}")
                return self.spark.read.schema(df.schema).parquet(f"{at}/{name}")

            chunks = stored("chunks", self.chunks().withColumn("tokens", tokens(F.col("text"))).withColumn("length", F.size("tokens")))
            assets = self.assets()
            names = assets.select(F.col("id").alias("asset_id"), "filename")
            found = metadata.extract(chunks.select("id", "asset_id", "text").join(names, "asset_id"))
            meta = stored("metadata", found.select("id", "asset_id", "text", "dates", "amounts", "identifiers", "urls", "emails", "phone_numbers"))
            entities = metadata.entities(meta.select("id", "asset_id", "text", "dates", "amounts"), "id").join(meta.select("id", "asset_id"), "id").select("asset_id", "normalized_value", "confidence")
            tags = chunks.where("source = 'visual_tags'").select("asset_id", F.explode(F.split("text", ", ")).alias("normalized_label")).withColumn("confidence", F.lit(TAG_CONFIDENCE))
            self._derived = {
                "chunks": chunks, "metadata": meta.drop("text"), "entities": stored("entities", entities.groupBy("asset_id", "normalized_value").agg(F.max("confidence").alias("confidence"))),
                "types": stored("types", self.document_types(chunks, assets)), "tags": stored("tags", tags.distinct()),
            }
        return self._derived

    def channels(
        self, queries: DataFrame, extensions: list[str] | None = None, folder: str | None = None, vectors: DataFrame | None = None, regions: DataFrame | None = None, prompts: DataFrame | None = None
    ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame | None]:
        """Plans, channels, best chunks, the assets that may be shown, and visual scores.

        ``vectors``: (query_id, q), the queries' vectors in the active text profile; ``regions``: (asset_id, region_id, embedding) of
        pictures and ``prompts``: (query_id, q), vectors of the queries' prompts in the same space. A channel without its vectors is empty."""
        plans = intent.plan(queries).persist()  # read by every channel; as small as the batch of queries
        assets = library.matches(self.assets(), extensions, folder)
        made = self.derived()
        chunks, ids = made["chunks"], assets.select(F.col("id").alias("asset_id"))
        allowed = lambda name: made[name].join(ids, "asset_id", "left_semi")
        toks = chunks.where("tokens is not null").select(F.col("id").alias("chunk_id"), "tokens", "length")
        exact = postings.bm25(toks, "chunk_id", plans).withColumnRenamed("score", "exact")
        owner = chunks.select(F.col("id").alias("chunk_id"), "asset_id").join(ids, "asset_id")
        scored = exact.select("query_id", "chunk_id", "exact", F.lit(0.0).alias("semantic")).join(owner, "chunk_id")
        if vectors is not None:
            scored = scored.unionByName(self.near_chunks(chunks, assets, vectors))
        best = search.best_chunks(scored).persist(StorageLevel.DISK_ONLY)  # hits only
        visual = None
        if regions is not None and prompts is not None:
            visual = similarity.visual_scores(regions.join(ids, "asset_id", "left_semi"), prompts)
        named = {
            "exact": best.select("query_id", "asset_id", F.col("exact").alias("score")),
            "semantic": best.select("query_id", "asset_id", F.col("semantic").alias("score")),
            "visual_tag": search.tag_channel(plans, allowed("tags")),
            "document_type": search.document_type_channel(plans, allowed("types")),
            "entity": search.entity_channel(plans, allowed("entities")),
            "metadata": search.metadata_channel(plans, allowed("metadata")),
            "filename": search.filename_channel(plans, assets),
        } | ({"visual": visual.select("query_id", "asset_id", "score")} if visual is not None else {})
        rows = None
        for name, part in named.items():
            part = part.join(ids, "asset_id", "left_semi").select("query_id", F.lit(name).alias("channel"), "asset_id", F.round("score", 6).alias("score"))
            rows = part if rows is None else rows.unionByName(part)
        return plans, rows, best, assets, visual

    def search(self, queries: DataFrame, extensions: list[str] | None = None, folder: str | None = None, n: int = 20, **how) -> DataFrame:
        """Results of many queries (query_id, query_text) at once; ``how`` as for ``channels``."""
        plans, rows, best, assets, visual = self.channels(queries, extensions, folder, **how)
        fused = search.fuse(search.rank_channels(rows), plans).join(plans.select("query_id", "visual_query", "document_query", F.size("terms").alias("n_terms")), "query_id")
        gated = search.strengths(fused).where("confidence is not null")
        # channels' scores have the names of channels, so a file's own name needs another
        shown = assets.select("id", F.col("filename").alias("file"), F.col("extension").alias("type"), F.coalesce("content_id", "id").alias("content_id"))
        shown = shown.join(search.other_places(shown), "content_id")
        typed = search.implied_filter(gated.join(shown.select(F.col("id").alias("asset_id"), F.col("type").alias("extension")), "asset_id"), plans, extensions is not None).drop("extension")
        out = search.results(typed, shown, n).join(best.select("query_id", "asset_id", "chunk_id"), ["query_id", "asset_id"], "left")
        tags = self.derived()["tags"].join(out.select("asset_id").distinct(), "asset_id", "left_semi")
        first = Window.partitionBy("asset_id").orderBy(F.desc("confidence"), "normalized_label")
        top = tags.withColumn("r", F.row_number().over(first)).where(F.col("r") <= TOP_TAGS).groupBy("asset_id").agg(F.array_sort(F.collect_list("normalized_label")).alias("top_visual_tags"))
        out = out.join(top, "asset_id", "left").withColumn("top_visual_tags", F.coalesce("top_visual_tags", F.array().cast("array<string>")))
        if visual is None:
            out = out.withColumn("best_region", F.lit(None).cast("int")).withColumn("z", F.lit(None).cast("double"))
        else:
            out = out.join(visual.select("query_id", "asset_id", "best_region", "z"), ["query_id", "asset_id"], "left")
        cols = ["query_id", "position", "asset_id", F.col("file").alias("filename"), F.col("type").alias("extension"), "confidence", "reasons", "fused", "combined_score",
                F.col("exact").alias("keyword_score"), F.col("semantic").alias("semantic_score"), F.col("visual").alias("visual_score"), F.col("z").alias("visual_z_score"), "best_region", "top_visual_tags", "other_places", "snippet", "page_number"]
        return search.with_snippets(out, self.derived()["chunks"], queries).select(*cols)

    def search_debug(self, queries: DataFrame, **filters) -> dict[str, DataFrame]:
        plans, rows, best, _, _ = self.channels(queries, **filters)
        ranked = search.rank_channels(rows)
        return {"plans": plans, "channels": search.diagnostics(ranked), "fused": search.fuse(ranked, plans), "best_chunks": best}

    def evaluate(self, ranked: DataFrame) -> DataFrame:
        return evaluate.evaluate(ranked, self.table("relevance_labels"))

    # -- maintenance
    def reconcile(self, scan: DataFrame) -> DataFrame:
        return library.reconcile(self.assets(), scan)

    def remove_folder(self, folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
        return library.remove_folder(self.assets(), {"chunks": self.chunks(), "stage_jobs": self.table("stage_jobs").dropDuplicates(["id"])}, folder)

    def reindex(self, new: Selection) -> DataFrame:
        pick = lambda s: {"ocr": s.ocr, "text": s.text, "visual": s.visual}
        return queue.reindex_plan(self.assets(), pick(self.selection), pick(new))

    def stale_text(self) -> DataFrame:
        return library.stale_text(self.chunks(), self.selection.text)
