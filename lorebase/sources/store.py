"""The knowledge store: content-addressed rows in versioned Parquet folders, changed by appended deltas.

A row belongs to a collection and, by the hash of its id, to one of the collection's
buckets: the rows whose hash ends in the bucket's last ``depth`` bits. A bucket is a base
folder and the deltas written since. A change only appends: upserted rows, or tombstones
of deleted ids, each with its commit number, in a folder for every bucket it touches. Reads
merge: the latest delta row of an id counts, tombstones hide, base rows without a delta
stay. :meth:`KnowledgeStore.compact` folds the deltas of buckets that have gathered many or
large ones into new base folders, and splits a bucket that has outgrown ``bucket_bytes`` by
more bits of the hash; buckets of one collection may so differ in depth. Other buckets are
not rewritten.

A commit writes its folders, then publishes a manifest (folders, their bits and bytes, and
the ledger of stream batches) by a rename; readers keep the version they opened. A batch that
the ledger has is refused, so a micro-batch replayed after its commit changes nothing, and
one that died before the rename left nothing that a manifest names.

Rows of a file are in the order of documents, with Bloom filters on ids and document ids, so
a lookup skips the row groups that cannot hold what it asks for. The manifest has an entry
for each folder, so its size follows the bytes stored, at most one for each bucket and delta.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.hashing import storage_id
from lorebase.operators.balls import BallIndex
from lorebase.operators.dedup import keep_last
from lorebase.operators.knn import nearest
from lorebase.operators.retrieval import with_documents
from lorebase.session import broadcast_limit

METADATA = T.StructType([
    T.StructField("documentId", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("embeddingType", T.StringType()),
    T.StructField("chunkIndex", T.IntegerType()),
    T.StructField("uri", T.StringType()),
])
ROW = T.StructType([
    T.StructField("collection", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("document", T.StringType()),
    T.StructField("metadata", METADATA),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
DELTA = T.StructType([*ROW, T.StructField("_deleted", T.BooleanType()), T.StructField("_commit", T.LongType())])
#: Equality filters on this many values are pushed to the files.
PUSHED_VALUES = 10
NO_EMBEDDING = "precomputed embeddings are required"


def metadata_struct() -> Column:
    """Stored metadata of a chunk row; an empty ``uri`` is left out."""
    return F.struct(
        F.col("document_id").alias("documentId"),
        F.col("source"),
        F.col("type"),
        F.col("title"),
        F.col("embedding_type").alias("embeddingType"),
        F.col("chunk_index").cast("int").alias("chunkIndex"),
        F.nullif(F.col("uri"), F.lit("")).alias("uri"),
    )


def store_rows(chunks: DataFrame) -> DataFrame:
    """Embedded chunk rows -> store rows, the last one per storage id."""
    rows = chunks.filter(F.col("embedding").isNotNull()).select(
        "collection",
        storage_id(F.col("embedding_type"), F.col("content_hash"), F.col("document_id"), F.col("chunk_index")).alias("id"),
        F.col("content").alias("document"),
        metadata_struct().alias("metadata"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.col("chunk_index").alias("_position"),
    )
    return keep_last(rows, ["collection", "id"], "_position").drop("_position")


def upserted(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """State after an upsert by id."""
    return current.join(incoming.select("collection", "id"), ["collection", "id"], "left_anti").unionByName(incoming)


def without_ids(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("collection", "id"), ["collection", "id"], "left_anti")


def without_documents(current: DataFrame, documents: DataFrame) -> DataFrame:
    """State after removing documents together with their summaries."""
    names = documents.select("collection", F.explode(F.array(
        F.col("document_id"), F.concat("document_id", F.lit("-summary"))
    )).alias("_document"))
    keyed = current.withColumn("_document", F.col("metadata.documentId"))
    return keyed.join(names, ["collection", "_document"], "left_anti").select(*current.columns)


class KnowledgeStore:
    """Upsert, delete, read and k-NN over one root folder on a shared file system.

    ``buckets`` is the number a new collection starts with, a power of two. Buckets grow to
    ``bucket_bytes``; a bucket is compacted when its deltas number over ``most_deltas`` or
    exceed ``delta_share`` of its base.
    """

    def __init__(
        self, spark: SparkSession, root: str, buckets: int = 16, metric: str = "cosine",
        bucket_bytes: int = 256 << 20, most_deltas: int = 16, delta_share: float = 0.5, row_group_bytes: int = 16 << 20,
    ) -> None:
        if metric not in ("cosine", "l2", "ip"):
            raise ValueError(f"unknown metric: {metric}")
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.spark, self.root, self.metric = spark, root.rstrip("/"), metric
        self.depth = buckets.bit_length() - 1
        self.bucket_bytes, self.most_deltas, self.delta_share, self.row_group_bytes = bucket_bytes, most_deltas, delta_share, row_group_bytes

    # -- manifest ---------------------------------------------------------------

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def version(self) -> int:
        names = [n for n in self._children(f"{self.root}/manifest") if n.endswith(".json") and not n.startswith("_")]
        return int(names[-1][:-5]) if names else 0

    def _manifest(self, version: int | None = None) -> dict:
        """entries: dicts of collection, depth, bits, delta, path, bytes; batches: the last batch number of each stream."""
        version = self.version() if version is None else version
        if version == 0:
            return {"entries": [], "batches": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{version:010d}.json", wholetext=True).first()[0])

    def _folders(self, version: int | None = None) -> dict[tuple[str, int, int], list[str]]:
        """Folders, base first and then in the order of commits, of every bucket (collection, depth, bits)."""
        return {key: [e["path"] for e in held] for key, held in _buckets(self._manifest(version)["entries"]).items()}

    def _publish(self, version: int, manifest: dict) -> None:
        fs = self._fs()
        hidden = self._path(f"{self.root}/manifest/_{uuid.uuid4().hex}")
        stream = fs.create(hidden, False)
        stream.write(bytearray(json.dumps(manifest).encode("utf-8")))
        stream.close()
        if not fs.rename(hidden, self._path(f"{self.root}/manifest/{version:010d}.json")):
            raise RuntimeError(f"another writer has published version {version}")

    # -- reading ----------------------------------------------------------------

    def _scan(self, entries: list[dict], schema: T.StructType) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{e['path']}" for e in entries])

    def _merged(self, entries: list[dict], where: Column | None = None) -> DataFrame:
        """Current rows of whole buckets that meet ``where``, a condition that an id's base rows are filtered by early."""
        deltas = [e for e in entries if e["delta"]]
        base = self._scan([e for e in entries if not e["delta"]], ROW)
        base = base if where is None else base.filter(where)
        if not deltas:
            return base
        changed = self._scan(deltas, DELTA)
        ids = changed.select("collection", "id").distinct()
        if sum(e["bytes"] for e in deltas) <= broadcast_limit(self.spark):
            ids = F.broadcast(ids)
        latest = keep_last(changed, ["collection", "id"], "_commit").filter(~F.col("_deleted"))
        latest = latest if where is None else latest.filter(where)
        return base.join(ids, ["collection", "id"], "left_anti").select(*ROW.names).unionByName(latest.select(*ROW.names))

    def read(self, collections: list[str] | None = None, version: int | None = None) -> DataFrame:
        return self._merged([e for e in self._manifest(version)["entries"] if collections is None or e["collection"] in collections])

    def get(
        self,
        collection: str | None,
        ids: list[str] | None = None,
        where: dict[str, str] | None = None,
        include: list[str] = ("metadata", "document"),
    ) -> DataFrame:
        """Rows by id list and/or metadata equality, with the wanted columns only; of every collection if None is given.

        Both conditions reach the files, and ids open their buckets only.
        """
        entries = [e for e in self._manifest()["entries"] if collection is None or e["collection"] == collection]
        condition = F.lit(True)
        if ids is not None:
            if ids:
                hashes = self.spark.range(1).select(F.array(*[F.xxhash64(F.lit(i)) for i in ids])).first()[0]
                entries = [e for e in entries if any(h & ((1 << e["depth"]) - 1) == e["bits"] for h in hashes)]
            condition = F.col("id").isin(ids)
        for name, value in (where or {}).items():
            condition = condition & (F.col(f"metadata.{name}") == value)
        return self._merged(entries, condition).select(*(["collection"] if collection is None else []), "id", *include)

    def get_rows(self, ids: DataFrame, include: list[str] = ("metadata", "document")) -> DataFrame:
        """Rows by a table of (collection, id) of any size."""
        return self.read().join(ids.select("collection", "id").distinct(), ["collection", "id"], "left_semi").select("collection", "id", *include)

    def build_index(self) -> int:
        """Write the ball index of this version beside the rows; returns the version."""
        version = self.version()
        BallIndex.build(self.read(version=version), self.metric, f"{self.root}/index/{version:010d}")
        return version

    def query(self, questions: DataFrame, n: int = 10) -> DataFrame:
        """Nearest rows of every (collection, query_id, embedding) question, with text and metadata.

        A version with an index is searched through it. Otherwise only the folders of the
        collections asked for are opened: at most as many names as the manifest has.
        """
        version = self.version()
        if self._children(f"{self.root}/index/{version:010d}/centres"):
            index = BallIndex(self.spark, f"{self.root}/index/{version:010d}", self.metric)
            return with_documents(index.nearest(questions, n), self.read(version=version))
        held = {e["collection"] for e in self._manifest()["entries"]}
        rows = self.read([r[0] for r in questions.select("collection").distinct().collect() if r[0] in held])
        return with_documents(nearest(rows, questions, n, self.metric), rows)

    def exists(self, collection: str, document_id: str) -> bool:
        return not self.get(collection, where={"documentId": document_id}, include=[]).isEmpty()

    # -- writing ----------------------------------------------------------------

    def _written(self, rows: DataFrame, version: int, blooms: bool) -> list[dict]:
        """Entries of the folders written for rows with p_depth, p_bits and p_delta; ``blooms`` adds filters on ids, too large for deltas."""
        target = f"data/{version:010d}-{uuid.uuid4().hex[:8]}"
        parts = ["p_collection", "p_depth", "p_bits", "p_delta"]
        (
            rows.withColumn("p_collection", F.col("collection"))
            .hint("rebalance", *parts)
            .sortWithinPartitions(*parts, "metadata.documentId", "metadata.chunkIndex", "id")
            .write.partitionBy(*parts)
            .option("parquet.bloom.filter.enabled#id", str(blooms).lower()).option("parquet.bloom.filter.enabled#metadata.documentId", str(blooms).lower())
            .option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.block.size", str(self.row_group_bytes))
            .parquet(f"{self.root}/{target}")
        )
        fs, folders = self._fs(), [target]
        for _ in parts:
            folders = [f"{f}/{name}" for f in folders for name in self._children(f"{self.root}/{f}") if name.startswith("p_")]
        found = []
        for path in folders:
            collection, depth, bits, delta = (unquote(name.split("=", 1)[1]) for name in path.split("/")[2:])
            size = fs.getContentSummary(self._path(f"{self.root}/{path}")).getLength()
            found.append({"collection": collection, "depth": int(depth), "bits": int(bits), "delta": delta == "true", "path": path, "bytes": int(size)})
        return found

    def _commit(self, changes: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Append rows (ROW and _deleted) as deltas; the first rows of a collection are its base."""
        version, manifest = self.version() + 1, self._manifest()
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return version - 1
        depths: dict[str, int] = {}
        for e in manifest["entries"]:
            depths[e["collection"]] = max(e["depth"], depths.get(e["collection"], 0))
        known = self.spark.createDataFrame(list(depths.items()), "collection string, _known int")
        rows = changes.join(F.broadcast(known), "collection", "left").filter(F.col("_known").isNotNull() | ~F.col("_deleted"))
        rows = _placed(rows, F.coalesce("_known", F.lit(self.depth))).withColumn("p_delta", F.col("_known").isNotNull())
        added = self._written(rows.withColumn("_commit", F.lit(version).cast("bigint")).drop("_known"), version, not depths)
        if not added and not batch:
            return version - 1
        batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._publish(version, {"entries": manifest["entries"] + added, "batches": batches})
        return version

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Insert or replace by id, one row an id. A row without a vector fails the whole change.

        ``batch`` is a stream's name and batch number; a number not above the stream's last one is refused.
        """
        required = F.coalesce("embedding", F.raise_error(F.lit(NO_EMBEDDING)).cast("array<float>")).alias("embedding")
        try:
            return self._commit(rows.select(*[c for c in ROW.names if c != "embedding"], required, F.lit(False).alias("_deleted")), batch)
        except PySparkException as error:
            if NO_EMBEDDING in str(error):
                raise ValueError(NO_EMBEDDING) from error
            raise

    def _tombstones(self, doomed: DataFrame) -> int:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in ROW if f.name not in ("collection", "id")]
        return self._commit(doomed.select("collection", "id", *empty, F.lit(True).alias("_deleted")))

    def delete_ids(self, ids: DataFrame) -> int:
        """Hide rows by (collection, id) without reading the store; unknown ids are ignored."""
        return self._tombstones(ids.select("collection", "id").distinct())

    def delete_where(self, collection: str | None, **equal: str) -> int:
        rows = self.get(collection, where=equal, include=[])
        return self._tombstones(rows if collection is None else rows.withColumn("collection", F.lit(collection)))

    def delete_documents(self, documents: DataFrame) -> int:
        """Hide all rows of (collection, document_id), summaries included; only ids and document ids of those collections are read."""
        names = documents.select("collection", F.explode(F.array("document_id", F.concat("document_id", F.lit("-summary")))).alias("_document")).distinct()
        few = names.limit(PUSHED_VALUES + 1).collect()
        held = [e for e in self._manifest()["entries"]]
        if len(few) <= PUSHED_VALUES:  # as literals, so that row groups are skipped
            asked = {r["collection"] for r in few}
            rows = self._merged([e for e in held if e["collection"] in asked], F.col("metadata.documentId").isin([r["_document"] for r in few]))
        else:
            asked = {r[0] for r in names.select("collection").distinct().collect()}  # at most as many as the store is asked about
            rows = self._merged([e for e in held if e["collection"] in asked])
        keyed = rows.select("collection", "id", F.col("metadata.documentId").alias("_document"))
        return self._tombstones(keyed.join(names, ["collection", "_document"], "left_semi"))

    def delete_collection(self, collection: str) -> int:
        """Drop a collection; an unknown one is ignored."""
        manifest = self._manifest()
        kept = [e for e in manifest["entries"] if e["collection"] != collection]
        if len(kept) == len(manifest["entries"]):
            return self.version()
        version = self.version() + 1
        self._publish(version, {"entries": kept, "batches": manifest["batches"]})
        return version

    # -- upkeep -----------------------------------------------------------------

    def _due(self, key: tuple[str, int, int], held: list[dict]) -> bool:
        base, deltas = (sum(e["bytes"] for e in held if e["delta"] == kind) for kind in (False, True))
        many = sum(e["delta"] for e in held) > self.most_deltas
        return many or deltas > self.delta_share * base or (base > 2 * self.bucket_bytes and key[1] < 40)

    def compact(self, every: bool = False) -> int:
        """Fold the deltas of due buckets (or of every one that has any) into new base folders; split those that have outgrown their size."""
        version, manifest = self.version() + 1, self._manifest()
        held = _buckets(manifest["entries"])
        due = {k: v for k, v in held.items() if self._due(k, v) or (every and any(e["delta"] for e in v))}
        if not due:
            return version - 1
        deeper = []
        for (collection, depth, bits), entries in due.items():
            more, size = 0, sum(e["bytes"] for e in entries)
            while size > self.bucket_bytes << more and depth + more < 40:
                more += 1
            deeper.append((collection, bits, depth, depth + more))
        plan = self.spark.createDataFrame(deeper, "collection string, _bits long, _depth int, _to int")
        replaced = {e["path"] for entries in due.values() for e in entries}
        rows = self._merged([e for e in manifest["entries"] if e["path"] in replaced])
        inside = (rows["collection"] == plan["collection"]) & (F.xxhash64(rows["id"]).bitwiseAND(_mask(plan["_depth"])) == plan["_bits"])
        rows = _placed(rows.join(F.broadcast(plan), inside).select(*[rows[c] for c in ROW.names], "_to"), F.col("_to")).drop("_to")
        added = self._written(rows.withColumn("p_delta", F.lit(False)), version, True)
        self._publish(version, {"entries": [e for e in manifest["entries"] if e["path"] not in replaced] + added, "batches": manifest["batches"]})
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` versions names; returns how many. No writer may be at work."""
        last = self.version()
        if last == 0:
            return 0
        fs = self._fs()
        live = {e["path"] for v in range(max(1, last - keep + 1), last + 1) for e in self._manifest(v)["entries"]}
        live |= {"/".join(p.split("/")[:n]) for p in live for n in range(1, 7)}
        gone = 0
        for commit in self._children(f"{self.root}/data"):
            for c in [f"data/{commit}"] if f"data/{commit}" not in live else self._unnamed(f"data/{commit}", live):
                fs.delete(self._path(f"{self.root}/{c}"), True)
                gone += 1
        for version in range(1, last - keep + 1):
            fs.delete(self._path(f"{self.root}/manifest/{version:010d}.json"), False)
        return gone

    def _unnamed(self, folder: str, live: set[str]) -> list[str]:
        """Highest folders below a named one that no manifest names."""
        found = []
        for name in self._children(f"{self.root}/{folder}"):
            path = f"{folder}/{name}"
            if "=" in name and path not in live:
                found.append(path)
            elif "=" in name and path.count("/") < 5:
                found += self._unnamed(path, live)
        return found


def _mask(depth: Column) -> Column:
    return F.pow(F.lit(2.0), depth).cast("bigint") - 1


def _placed(rows: DataFrame, depth: Column) -> DataFrame:
    """Rows with the bucket that their hash has at a depth."""
    return rows.withColumn("p_depth", depth).withColumn("p_bits", F.xxhash64("id").bitwiseAND(_mask(F.col("p_depth"))))


def _buckets(entries: list[dict]) -> dict[tuple[str, int, int], list[dict]]:
    """Entries by bucket, the base first and then the deltas in the order of commits.

    A delta has the depth of its collection's deepest entry at the time, so it never covers
    more than a base. An entry belongs to the widest entry that covers it: the base, or the
    oldest deltas where a bucket has no rows of its own yet.
    """
    keys = {(e["collection"], e["depth"], e["bits"]) for e in entries}
    depths: dict[str, set[int]] = {}
    for collection, depth, _ in keys:
        depths.setdefault(collection, set()).add(depth)
    found: dict[tuple[str, int, int], list[dict]] = {}
    for e in sorted(entries, key=lambda e: e["delta"]):
        covers = ((e["collection"], d, e["bits"] & ((1 << d) - 1)) for d in sorted(depths[e["collection"]]))
        found.setdefault(next(key for key in covers if key in keys), []).append(e)
    return found
