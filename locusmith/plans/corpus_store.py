"""The store an ingest writes: rows are added under the id of their document version, and a version of the whole is published by one small file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "source_id string, language string, content_hash string, unit_count int, ingested_at timestamp, is_current boolean"
DOCUMENTS = "document_id string, " + HISTORY
#: Parts that hang on a document; none of their rows is ever removed.
PARTS = ("units", "chunks", "links")


class Store:
    """A folder with the parts by document_id, one list of documents per version, and a numbered file per version that names the list.

    The file is created only if it does not exist, so of two runs that publish at once one fails and leaves nothing visible. What a run wrote
    before it failed is not listed by any version; the next run of the same content writes the same rows in the same place.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def version(self) -> int:
        """The number of the published version; 0 for a store without any. Anything but a missing folder is an error of its own."""
        if not self._exists("versions"):
            return 0
        names = [status.getPath().getName() for status in self._fs.listStatus(self._path("versions"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def documents(self) -> DataFrame:
        """All document versions of the published version; without one, no rows."""
        number = self.version()
        if not number:
            return self.spark.createDataFrame([], DOCUMENTS)
        stream = self._fs.open(self._path(f"versions/{number:08}"))
        try:
            listed = stream.readUTF()
        finally:
            stream.close()
        return self.spark.read.schema(DOCUMENTS).parquet(f"{self.folder}/documents/{listed}")

    def part(self, name: str, current: bool = True) -> DataFrame | None:
        """The rows of a part whose document is listed (and current); null for a store that has none yet."""
        if name not in PARTS:
            raise ValueError(f"unknown part {name}")
        if not self.version() or not self._exists(name):
            return None
        documents = self.documents()
        documents = documents.where("is_current") if current else documents
        return self.spark.read.parquet(f"{self.folder}/{name}").join(documents.select("document_id"), "document_id", "left_semi")

    def publish(self, documents: DataFrame, parts: dict[str, DataFrame]) -> int:
        """Writes the parts of new document versions, then the list of documents, and makes it the published version. Returns its number."""
        number = self.version() + 1
        for name, rows in parts.items():
            if name not in PARTS:
                raise ValueError(f"unknown part {name}")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(f"{self.folder}/{name}")
        listed = uuid.uuid4().hex
        documents.select(*[c.split()[0] for c in DOCUMENTS.split(", ")]).coalesce(1).write.parquet(f"{self.folder}/documents/{listed}")
        stream = self._fs.create(self._path(f"versions/{number:08}"), False)
        try:
            stream.writeUTF(listed)
        finally:
            stream.close()
        return number


def new_rows(rows: DataFrame, documents: DataFrame, document: list[str]) -> DataFrame:
    """rows with the document_id of the document version they belong to."""
    return rows.join(documents.select("document_id", *document), document).withColumn("document_id", F.col("document_id"))
