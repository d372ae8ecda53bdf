"""A searchable library of texts (from the design specification): segments of postings, tombstones, generations.

Every change writes folders of its own, a segment of documents and postings or a set of tombstones, and then
publishes a generation: a small file that lists the folders that count.  A change that ends before that is never
seen, and of two changes made at once one gets an error and nothing is mixed.  What a document is follows
from its content's digest: equal content is not indexed again, other content replaces the older.

Postings are dealt by term and document together, so a term in every document is no task of its own, and sorted by
term within each file.  They move once, when they are counted; of the texts of a change, those move once that are
compared with documents known before.  A search reads the postings of its queries' terms, scores them (BM25) and says that
it was lexical.

Rows: document ids are unique in one change (others are an error) and not null; null texts are not indexed and
counted as failed, empty ones are documents without terms; an empty table makes a generation that adds nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import search_terms
from ..storage import create_text, delete, names, read_text
from .scoring import GuardError

#: Saturation of repeated terms and weight of a text's length.
K1, B = 1.2, 0.75
#: Results of a search: usual and most. Fixed values.
TOP, MOST = 8, 20
DOCS = "doc_id long, digest string, size int, text string, seq long"
POSTINGS = "term string, doc_id long, tf int, size int, seq long"
GONE = "doc_id long, before long"


class Library:
    """The library in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _state(self) -> dict:
        found = names(self.spark, f"{self.path}/generations")
        return json.loads(read_text(self.spark, f"{self.path}/generations/{found[-1]}")) if found else {"generation": 0, "segments": [], "gone": [], "failed": 0}

    def _publish(self, state: dict, **changed) -> None:
        state = state | changed | {"generation": state["generation"] + 1}
        create_text(self.spark, f"{self.path}/generations/{state['generation']:010d}", json.dumps(state))

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{x}" for x in folders)) if folders else self.spark.createDataFrame([], schema)

    def _live(self, state: dict, table: str, schema: str) -> DataFrame:
        """Rows of a table that no later tombstone names."""
        rows = self._read([f"{x}/{table}" for x in state["segments"]], schema).alias("r")
        gone = self._read(state["gone"], GONE).groupBy("doc_id").agg(F.max("before").alias("before")).alias("g")
        return rows.join(gone, (F.col("r.doc_id") == F.col("g.doc_id")) & (F.col("r.seq") < F.col("g.before")), "left_anti") if state["gone"] else rows

    def documents(self) -> DataFrame:
        """doc_id, digest, size (terms) and text of all documents."""
        return self._live(self._state(), "docs", DOCS).drop("seq")

    def _write_postings(self, postings: DataFrame, name: str) -> None:
        postings.select("term", "doc_id", "tf", "size", "seq").sortWithinPartitions("term", "doc_id").write.parquet(f"{self.path}/{name}/postings")

    def add(self, docs: DataFrame) -> dict:
        """Indexes documents (doc_id, text) that are new or whose content changed; returns how many were which."""
        state = self._state()
        seq = state["generation"] + 1
        seen = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("text").alias("full")).agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("full").alias("full")).collect()[0]
        if (seen.most or 0) > 1:
            raise GuardError("doc_id repeat")
        rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("digest"))
        if state["segments"]:
            known = self._live(state, "docs", DOCS).select(F.col("doc_id").alias("k"), F.col("digest").alias("was"))
            rows = rows.join(known, F.col("doc_id") == F.col("k"), "left").filter("k is null or was <> digest").withColumn("changed", F.col("k").isNotNull())
        else:
            rows = rows.withColumn("changed", F.lit(False))
        name = f"segment-{seq:010d}-{uuid.uuid4().hex}"
        rows.select("doc_id", "digest", F.size(search_terms(F.col("text"))).alias("size"), "text", F.lit(seq).cast("long").alias("seq"), "changed").write.parquet(f"{self.path}/{name}/docs")
        written = self.spark.read.schema(f"{DOCS}, changed boolean").parquet(f"{self.path}/{name}/docs")
        postings = written.select("doc_id", "size", "seq", F.explode(search_terms(F.col("text"))).alias("term")).groupBy("term", "doc_id", "size", "seq").agg(F.count("*").cast("int").alias("tf"))
        self._write_postings(postings, name)
        new = {r.changed: r.n for r in written.groupBy("changed").agg(F.count("*").alias("n")).collect()}
        counts = {"added": new.get(False, 0), "changed": new.get(True, 0), "unchanged": (seen.full or 0) - sum(new.values()), "failed": (seen.n or 0) - (seen.full or 0)}
        gone = state["gone"]
        if counts["changed"]:
            gone = [*gone, f"gone-{seq:010d}-{uuid.uuid4().hex}"]
            # documents of the same id in earlier segments
            written.filter("changed").select("doc_id", F.lit(seq).cast("long").alias("before")).write.parquet(f"{self.path}/{gone[-1]}")
        self._publish(state, segments=[*state["segments"], name], gone=gone, failed=state["failed"] + counts["failed"])
        return counts

    def remove(self, ids: DataFrame) -> None:
        """Drops the index of documents (doc_id); their source is not touched."""
        state = self._state()
        seq = state["generation"] + 1
        name = f"gone-{seq:010d}-{uuid.uuid4().hex}"
        ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(seq).cast("long").alias("before")).distinct().write.parquet(f"{self.path}/{name}")
        self._publish(state, gone=[*state["gone"], name])

    def remove_missing(self, scanned: DataFrame, complete: bool) -> None:
        """Drops documents that a scan of the source (doc_id) no longer has; a scan that failed half-way drops nothing."""
        if not complete:
            raise ValueError("an incomplete scan does not say what is missing")
        self.remove(self.documents().select("doc_id").join(scanned.select("doc_id"), "doc_id", "left_anti"))

    def merge(self) -> None:
        """Writes all that counts as one segment without tombstones; older generations stay until ``clean``."""
        state = self._state()
        name = f"segment-{state['generation'] + 1:010d}-{uuid.uuid4().hex}"
        self._live(state, "docs", DOCS).write.parquet(f"{self.path}/{name}/docs")
        self._write_postings(self._live(state, "postings", POSTINGS), name)
        self._publish(state, segments=[name], gone=[])

    def clean(self) -> None:
        """Deletes folders and generations that the current one does not list, such as those of changes that were broken off."""
        state = self._state()
        for x in names(self.spark, self.path):
            if x.startswith(("segment-", "gone-")) and x not in (*state["segments"], *state["gone"]):
                delete(self.spark, f"{self.path}/{x}")
        for x in names(self.spark, f"{self.path}/generations"):
            if int(x) < state["generation"]:
                delete(self.spark, f"{self.path}/generations/{x}")

    def search(self, queries: DataFrame, top: int = TOP) -> DataFrame:
        """The ``top`` best documents (MOST at most) for each of (query_id, query): query_id, rank, doc_id, score, mode; ties to smaller ids."""
        state = self._state()
        live = self._live(state, "docs", DOCS).agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean"))
        asked = queries.select("query_id", F.explode(F.array_distinct(search_terms(F.col("query")))).alias("term"))
        wanted = self._live(state, "postings", POSTINGS).join(asked.select("term").distinct(), "term", "left_semi")
        held = wanted.groupBy("term").agg(F.count("*").cast("double").alias("df"))
        n, mean, df, tf = (F.col(c) for c in ("n", "mean", "df", "tf"))
        weight = F.log(1 + (n - df + 0.5) / (df + 0.5))
        terms = asked.join(held, "term").join(F.broadcast(live)).withColumn("weight", weight)  # the broadcast is one row
        gain = F.col("weight") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / mean))
        scored = terms.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(gain), 9).alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        best = scored.withColumn("rank", place).filter(F.col("rank") <= min(top, MOST))
        return best.select("query_id", "rank", "doc_id", "score", F.lit("lexical").alias("mode"))

    def read(self, ids: DataFrame, most: int = 12_000) -> DataFrame:
        """doc_id, digest, the first ``most`` characters and whether there are more, for ids (doc_id, and digest if its version is to be checked)."""
        own = self.documents().select("doc_id", "digest", F.left("text", F.lit(most)).alias("text"), (F.length("text") > most).alias("more"))
        if "digest" in ids.columns:
            ids = ids.select("doc_id", F.col("digest").alias("wanted"))
            own = own.join(ids, "doc_id", "right").withColumn("status", F.when(F.col("digest").isNull(), "source_unavailable").when(F.col("digest") != F.col("wanted"), "stale").otherwise("ok"))
        else:
            own = own.join(ids.select("doc_id"), "doc_id", "right").withColumn("status", F.when(F.col("digest").isNull(), "source_unavailable").otherwise("ok"))
        return own.select("doc_id", "digest", "status", F.when(F.col("status") == "ok", F.col("text")).alias("text"), "more")

    def status(self) -> DataFrame:
        """One row: generation, segments, sets of tombstones, documents, terms, texts that failed, mode."""
        state = self._state()
        live = self._live(state, "docs", DOCS).agg(F.count("*").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("terms"))
        known = {"generation": state["generation"], "segments": len(state["segments"]), "tombstones": len(state["gone"]), "failed": state["failed"]}
        return live.select(*(F.lit(v).cast("long").alias(k) for k, v in known.items()), "documents", "terms", F.lit("lexical").alias("mode"))
