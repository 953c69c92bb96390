"""A scan: tree -> changed files -> units, edges and vectors (entry A of the model)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..extract import registry
from ..functions.columns import embeddable
from ..operators import rows as R
from ..schemas import CALL_EDGES
from ..schemas import UNIT as UNIT_COLUMNS
from ..sources.files import scan_tree
from .embedding import Embedder, unit_vectors
from .lineage import cut
from .store import FILE, Store

UNIT = [*FILE, "qualified_name", "signature"]


@dataclass
class Scan:
    """Lazily planned results; nothing has run until one is read."""

    files: DataFrame
    changed: DataFrame
    gone: DataFrame
    units: DataFrame
    edges: DataFrame
    rejects: DataFrame
    lost: DataFrame
    vectors: DataFrame | None


def scan(spark: SparkSession, root: str, repo_id: int, hashes: DataFrame, embedder: Embedder | None = None, settings: Settings = DEFAULT) -> Scan:
    """Units, edges and vectors of the files below ``root`` whose hash isn't in ``hashes``; ``gone``: stored files that aren't there.

    Units with equal names and signatures in a file keep the first; ``lost`` counts the others (Q36).
    """
    files = scan_tree(spark, root, repo_id, settings)
    changed = R.changed_files(files, hashes, FILE)
    extracted = registry.extract(changed, settings)
    made = registry.units(extracted)
    units = R.first_by(made, UNIT, "ordinal")
    lost = made.groupBy(*UNIT).agg((F.count("*") - 1).alias("lost")).where("lost > 0")
    worth = units.where(embeddable(F.col("unit_type"), F.col("name"), F.col("body_text"), F.size("calls"), settings))
    return Scan(files.drop("content"), changed.drop("content"), R.tombstones(files, hashes, FILE), units, registry.edges(extracted), registry.rejects(extracted), lost, None if embedder is None else unit_vectors(worth, embedder))


def apply_scan(stored: DataFrame, fresh: DataFrame, result: Scan) -> DataFrame:
    """A stored table of the repository after the scan: rows of changed and gone files replaced (K1-K5, Q7)."""
    touched = result.changed.select(*FILE).union(result.gone.select(*FILE)).distinct()
    return R.replace_by_file(stored, fresh, touched, FILE)


#: Tables that a scan keeps in a store, as it makes them.
TABLES = {
    "units": f"repo_id bigint, file_path string, ordinal int, {UNIT_COLUMNS}",
    "edges": CALL_EDGES,
    "hashes": "repo_id bigint, file_path string, hash string",
    "vectors": "id string, repo_id bigint, language string, file_path string, qualified_name string, collection string, vector array<float>",
}


def save_scan(store: Store, result: Scan) -> list[int]:
    """Bring the stored tables up to date (K1-K5): rows of changed and gone files are replaced, in their buckets only. Returns these."""
    touched = cut(result.changed.select(*FILE).union(result.gone.select(*FILE)).distinct())
    fresh = {"units": result.units, "edges": result.edges, "hashes": result.changed.select(*FILE, "hash"), "vectors": result.vectors}
    return store.replace(touched, {name: new for name, new in fresh.items() if new is not None})
