"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of concepts, categories, clusters and their edges.
ONTOLOGY = {
    "nodes_concept": "id string, name string, is_ontology_concept boolean, is_ontology_category boolean, is_ontology_neighbour boolean, is_unused boolean",
    "nodes_category": "id string, name string, depth int, reference_page_id string, reference_page_key string, reference_page_url string",
    "edges_concept_concept": "from_id string, to_id string, score double, normalised_score double",
    "edges_category_category": "from_id string, to_id string",
    "edges_category_cluster": "from_id string, to_id string",
    "edges_cluster_concept": "from_id string, to_id string",
    "edges_category_anchor": "from_id string, to_id string",
    "edges_concept_concept_embeddings": "from_id string, to_id string, score double",
    "object_embeddings": "object_type string, object_id string, embedding string",
    "edges_category_topic": "category_id string, category_name string, topic_id string, topic_name string, embedding_score double, wikipedia_score double, score double",
}

#: Caches: what is stored for a token, and the closest token of each.
CACHES = {
    "video": "id_token string, origin_token string, fingerprint string, date_modified timestamp, date_added timestamp",
    "slide": "id_token string, origin_token string, fingerprint string, timestamp int, slide_number int, ocr_tesseract string, ocr_google string, language string, date_added timestamp",
    "audio": "id_token string, origin_token string, fingerprint string, duration double, transcript string, subtitles string, language string, date_added timestamp",
    "text": "id_token string, fingerprint string, source string, target string, source_lang string, target_lang string, date_added timestamp",
    "scraping": "id_token string, origin_token string, fingerprint string, link string, content string, page_type string, headers_removed int, long_patterns_removed int, date_added timestamp",
    "embedding": "id_token string, fingerprint string, source string, model_type string, embedding string, date_added timestamp",
    "most_similar": "id_token string, most_similar_token string",
}

#: Users and what they may do.
AUTH = {
    "users": "username string, full_name string, email string, hashed_password string, disabled boolean, scopes string",
    "rate_limits": "username string, path string, max_requests int, window_seconds int",
    "index_rights": "username string, index_name string",
    "index_aliases": "alias string, index_name string",
}

TABLES = {**ONTOLOGY, **{f"cache_{k}": v for k, v in CACHES.items()}, **{f"auth_{k}": v for k, v in AUTH.items()}}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A table without rows under its schema."""
    return spark.createDataFrame([], TABLES[table])


def create_missing(spark: SparkSession, folder: str, tables: list[str] | None = None) -> list[str]:
    """Make the tables that the folder lacks, empty; returns their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    made = []
    for name in tables or list(TABLES):
        at = path(f"{folder}/{name}")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            empty(spark, name).write.parquet(f"{folder}/{name}")
            made.append(name)
    return made
