"""Sinks: tables, export manifests, content-addressed names and incremental builds."""

from __future__ import annotations

from collections.abc import Iterator

from prismar.functions.strings import basename, extension, stem
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def write_embeddings(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("dataset", "modality").parquet(path)


def write_features(df: DataFrame, feature: str, path: str) -> None:
    """Only rows whose extraction worked."""
    df.where(F.col(feature).isNotNull()).write.mode("overwrite").parquet(path)


def write_latent(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_manifest(selected: DataFrame, groups: DataFrame, name_mode: str = "hash") -> DataFrame:
    """key, path, target, collides: each selected key (group::gid, or a path) resolved to one file. `groups`: gid, cursor, paths.

    `hash` names are md5(path)[:8]_basename; `basename` keeps names, leaves groups out, and marks names that more than one path has.
    """
    gid = F.regexp_extract("key", "^group::(.+)$", 1)
    both = selected.withColumn("gid", gid).join(groups, "gid", "left")
    pick = F.element_at("paths", F.least(F.greatest(F.coalesce("cursor", F.lit(0)), F.lit(0)), F.size("paths") - 1) + 1)
    out = both.withColumn("path", F.when(F.col("gid") == "", F.col("key")).otherwise(pick)).where("path is not null")
    if name_mode == "basename":
        out = out.where("gid = ''").withColumn("target", basename(F.col("path")))
    else:
        out = out.withColumn("target", F.concat(F.substring(F.md5("path"), 1, 8), F.lit("_"), basename(F.col("path"))))
    shared = out.groupBy("target").agg((F.count_distinct("path") > 1).alias("collides"))
    return out.join(shared, "target").select("key", "path", "target", "collides")


def story_manifest(story: DataFrame) -> DataFrame:
    """scene, original, poetry, line of (scene, text)."""
    return story.select("scene", F.format_string("%02d_original.jpg", F.col("scene").cast("int")).alias("original"), F.format_string("%02d_poetry.jpg", F.col("scene").cast("int")).alias("poetry"), F.concat((F.col("scene") + 1).cast("string"), F.lit(". "), F.col("text")).alias("line"))


def write_story(story: DataFrame, path: str) -> None:
    """One ordered text file; a story is as long as its scenes, so one task writes it."""
    story_manifest(story).coalesce(1).sortWithinPartitions("scene").select("line").write.mode("overwrite").text(path)


def _source(path: str):
    """The pyarrow file system of a listed path, and the path there. Listed local paths aren't percent-encoded."""
    from pyarrow import fs

    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, rest = path.split("://", 1)
    host, _, inside = rest.partition("/")
    files, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return files, f"{root.rstrip('/')}/{inside}"


def copy_files(manifest: DataFrame, folder: str) -> int:
    """Stream the file at each manifest row's path to its target below `folder` (any pyarrow file system); the number of targets.

    Tasks read and write on their own, so a selection of any size is copied; a repeated task writes the same files again. Of the paths of a colliding target the largest counts.
    """
    rows = manifest.groupBy("target").agg(F.max("path").alias("path"))

    def put(part: Iterator[Row]) -> None:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for r in part:
            own, path = _source(r.path)
            with own.open_input_stream(path, compression=None) as found, files.open_output_stream(f"{root}/{r.target}", compression=None) as out:
                while piece := found.read(4 << 20):
                    out.write(piece)

    rows.foreachPartition(put)
    return rows.count()


def content_name(content: Column, name: Column) -> Column:
    """ext_<md5 of the bytes>[:12] with the name's extension, .jpg where it has none."""
    ext = extension(name)
    return F.concat(F.lit("ext_"), F.substring(F.md5(content), 1, 12), F.when(ext == "", ".jpg").otherwise(ext))


def not_yet_built(new: DataFrame, built: DataFrame, *keys: str) -> DataFrame:
    """New rows whose (content hash, model) isn't built yet, each once."""
    return new.dropDuplicates(list(keys)).join(built.select(*keys), list(keys), "left_anti")


def derived_name(target: Column, reference: Column, method: Column, clock: Column) -> Column:
    return F.concat(stem(target), F.lit("_from_"), stem(reference), F.lit("_"), method, F.lit("_"), F.date_format(clock, "yyyyMMdd_HHmmss"), F.lit(".png"))
