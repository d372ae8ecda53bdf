"""Package, component and manifest operators: predicates, classifications and size models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import package_name

#: Extensions stored without compression. Fixed values.
STORED = ("zip", "whl", "7z", "gz", "bz2", "xz", "zst", "png", "jpg", "jpeg", "webp", "mp3", "flac", "ogg", "mp4", "safetensors", "onnx", "bin")
#: MB a second of copying, rebuilding, zipping and downloading. Fixed values.
COPY, REBUILD, ZIP, DOWNLOAD = 180, 30, 200, 2
FORMATS = ("json", "verbose_json", "text")


def safe_path(path: Column) -> Column:
    """Relative, without drive letters, without parent steps."""
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & (path != "")


def installed(files: DataFrame) -> DataFrame:
    """Per dir: whether it has a config.json and a finished weight file (columns dir, name)."""
    weight = F.col("name").rlike(r"\.(safetensors|bin)$") & ~F.col("name").endswith(".incomplete")
    return files.groupBy("dir").agg((F.bool_or(F.col("name") == "config.json") & F.bool_or(weight)).alias("installed"))


def problems(*rules: tuple[Column, str]) -> Column:
    """Names of all broken rules; a rule that can't be judged counts as broken."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules)), lambda x: x.isNotNull())


def route(method: Column, path: Column) -> Column:
    """Route of a request after cutting query, fragment and a trailing slash; 404 or 405 otherwise."""
    p = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"(?<=.)/$", "")
    known = {"/health": "GET", "/v1/models": "GET", "/v1/audio/transcriptions": "POST", "/v1/unload": "POST", "/v1/stream/sessions": "POST"}
    out = None
    for where, verb in known.items():
        hit = F.when(method == verb, F.lit(where)).otherwise("405")
        out = F.when(p == where, hit) if out is None else out.when(p == where, hit)
    inner = F.regexp_extract(p, r"^/v1/stream/sessions/[A-Za-z0-9]+(?:/(audio|finish))?$", 1)
    session = p.rlike(r"^/v1/stream/sessions/[A-Za-z0-9]+(/(audio|finish))?$")
    verb = F.when(inner == "", "DELETE").otherwise("POST")
    return out.when(session, F.when(method == verb, F.when(inner == "", "session").otherwise(inner)).otherwise("405")).otherwise("404")


def classify_error(text: Column) -> Column:
    """Class of an error message by the first pattern that is in it; empty if none is."""
    rules = [(r"no space|disk full|enospc", "disk"), (r"timed? ?out", "timeout"), (r"denied|permission", "permission"), (r"connection|network|resolve host|ssl", "network"), (r"hash|checksum|sha256", "hash")]
    out = F.when(text.rlike(f"(?i){rules[0][0]}"), rules[0][1])
    for p, name in rules[1:]:
        out = out.when(text.rlike(f"(?i){p}"), name)
    return out.otherwise("")


def archive_entry(path: Column, modified_year: Column) -> Column:
    """How a file goes into an archive: stored or deflated, year clamped, long names cut to their last 59 characters."""
    stored = F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*STORED)
    name = F.when(F.length(path) > 60, F.concat(F.lit("…"), F.right(path, F.lit(59)))).otherwise(path)
    return F.struct(F.when(stored, "store").otherwise("deflate").alias("method"), F.greatest(modified_year, F.lit(1980)).alias("year"), name.alias("label"))


def stage_seconds(model_bytes: Column, wheel_bytes: Column) -> Column:
    """Estimated seconds of copying models, rebuilding wheels (0.55 of their size is zipped) and zipping all."""
    mb = 1e6
    return model_bytes / (COPY * mb) + wheel_bytes / (REBUILD * mb) + (model_bytes + 0.55 * wheel_bytes) / (ZIP * mb)


def download_estimate(missing: Column, has_env: Column, torch_bytes: Column) -> Column:
    """10 MB for each missing package, 150 MB without an environment, and what torch needs."""
    return missing * 10_000_000 + F.when(has_env, 0).otherwise(150_000_000) + F.coalesce(torch_bytes, F.lit(0))


def disk_needed(plans: DataFrame) -> DataFrame:
    """Bytes needed on each volume: 1.05 of a stage plus 50 MB where it is staged, 0.95 of it where the archive goes."""
    stage = plans.select(F.col("stage_volume").alias("volume"), (F.col("bytes") * 1.05 + 50_000_000).alias("need"))
    archive = plans.select(F.col("zip_volume").alias("volume"), (F.col("bytes") * 0.95).alias("need"))
    return stage.unionByName(archive).groupBy("volume").agg(F.round(F.sum("need")).cast("bigint").alias("need"))


def record_line(path: Column, content: Column) -> Column:
    """A RECORD line: path, url-safe base64 of the SHA-256 without padding, size."""
    digest = F.regexp_replace(F.translate(F.base64(F.unhex(F.sha2(content, 256))), "+/", "-_"), "=+$", "")
    return F.concat(path, F.lit(",sha256="), digest, F.lit(","), F.octet_length(content).cast("string"))


def discover(files: DataFrame) -> DataFrame:
    """Component folders of paths (path): those, below mcp one level deeper, that hold both an installer and a README."""
    at = F.regexp_extract("path", "^(mcp/[^/]+|[^/]+)/([^/]+)$", 1).alias("component"), F.regexp_extract("path", "([^/]+)$", 1).alias("name")
    both = F.bool_or(F.col("name") == "install.ps1") & F.bool_or(F.col("name") == "README.md")
    return files.select(*at).filter(~F.col("component").isin("", "tools", "docs", "mcp")).groupBy("component").agg(both.alias("ok")).filter("ok").select("component")


def progress(line: Column) -> Column:
    """done and total of a progress line: counts, or a share of 100; null for other lines."""
    count = r"^(?:PROG|Progress) (\d+) (?:of )?(\d+)$"
    share = F.regexp_extract(line, r"(\d+(?:\.\d+)?)%$", 1)
    none = F.lit(None).cast("string")
    part = lambda i, other: F.when(line.rlike(count), F.regexp_extract(line, count, i)).when(share != "", other).otherwise(none)
    return F.struct(part(1, share).alias("done"), part(2, F.lit("100")).alias("total"))


def dependencies(project: Column) -> Column:
    """Entries of the list of dependencies in a project file."""
    return F.regexp_extract_all(F.regexp_extract(project, r"(?ms)^dependencies\s*=\s*\[(.*?)^\]", 1), F.lit(r'"([^"]+)"'), F.lit(1))


def distributions(found: DataFrame) -> DataFrame:
    """Packages (scan, name, has_metadata, editable), the first of each normalised name: norm, scan, and why it is left out."""
    skip = F.when(~F.col("has_metadata"), "no metadata").when(F.col("editable"), "editable").otherwise("")
    rows = found.select(package_name(F.col("name")).alias("norm"), "scan", skip.alias("skip"))
    return rows.groupBy("norm").agg(F.min("scan").alias("scan"), F.min_by("skip", "scan").alias("skip"))


def pick_files(files: DataFrame) -> DataFrame:
    """One file (model, file) of each role: int8 ones are wanted, but for decoders, which have a full one if there is any; then by name."""
    f = files.withColumn("role", F.regexp_extract("file", "^(encoder|decoder|joiner)", 1)).filter("role <> ''")
    small = F.col("file").contains("int8")
    wanted = F.when(F.col("role") == "decoder", ~small).otherwise(small)
    return f.groupBy("model", "role").agg(F.min_by("file", F.struct(~wanted, "file")).alias("file"))
