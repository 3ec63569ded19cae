"""Capture files: catalogue scan, upload checks and content identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.contract import CAPTURE_EXTENSIONS
from flowlens.functions.ordering import human_id, human_number, number_rows

# ---- fixed values: file magics ------------------------------------------------------------
PCAP_MAGICS = ("D4C3B2A1", "A1B2C3D4", "4D3CB2A1", "A1B23C4D")
PCAPNG_MAGIC = "0A0D0D0A"
# ---- fixed values: texts of stored rows ------------------------------------------------------
NO_PACKETS = "No parseable packets found in the capture."


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` as (filename, path, length, uri); none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        "path",
        "length",
        F.col("_metadata.file_path").alias("uri"),
    )


def catalogue(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Format, size, SHA-256 and the first failing check of every file, without its content.

    ``files`` have ``content``, or ``magic`` and ``sha256`` of a scan. Checks in order: name, path
    separators, extension, empty, size (where ``max_bytes`` is given), magic.
    """
    if "content" in files.columns:
        files = files.selectExpr(
            "* except (content)", "hex(substring(content, 1, 4)) as magic", "sha2(content, 256) as sha256"
        )
    limit = "null" if max_bytes is None else max_bytes
    extensions = ", ".join(f"'.{name}'" for name in CAPTURE_EXTENSIONS)
    magics = ", ".join(f"'{magic}'" for magic in (*PCAP_MAGICS, PCAPNG_MAGIC))
    checked = files.selectExpr(
        "*",
        r"lower(regexp_extract(filename, '^[.]*[^.].*?([.][^.]*)$', 1)) as extension",
    ).selectExpr(
        "*",
        rf"""case when filename is null or filename in ('', '.', '..') then 'no_file_selected'
            when filename like '%/%' or filename like '%\\\\%' then 'path_separator_in_name'
            when extension not in ({extensions}) then 'unsupported_extension'
            when length = 0 then 'empty_file'
            when length > {limit} then 'file_too_large'
            when magic is null or magic not in ({magics}) then 'unrecognised_content'
            end as reject_reason""",
    )
    return checked.selectExpr(
        "filename",
        "length as file_size",
        f"""case when reject_reason is null
            then if(magic = '{PCAPNG_MAGIC}', 'pcapng', 'pcap') end as capture_format""",
        "case when reject_reason is null then sha256 end as sha256",
        "reject_reason",
        *[c for c in files.columns if c not in ("filename", "length", "magic", "sha256")],
    )


def accepted_captures(checked: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Accepted files with a human id.

    A file already ``stored`` (same content under the same name) keeps its id; others are numbered
    by content hash after the highest stored number.
    """
    good = checked.where("reject_reason is null")
    if stored is None:
        highest = F.lit(0)
        known = good.where("false").select("sha256", "filename", F.lit("").alias("capture_id"))
    else:
        number = F.max(human_number("CAP", F.col("capture_id")))
        highest = stored.agg(F.coalesce(number, F.lit(0)).alias("n")).scalar()
        known = stored.groupBy("sha256", "filename").agg(F.min("capture_id").alias("capture_id"))
    names = ["sha256", "filename"]
    order = [F.col("sha256"), F.col("filename")]
    numbered = number_rows(
        good.join(known, names, "left_anti"), order, F.substring("sha256", 1, 3), "number"
    )
    fresh = numbered.withColumn("capture_id", human_id("CAP", F.col("number") + highest))
    return good.join(known, names).unionByName(fresh.drop("number"))


def cap_frames(frames: DataFrame, limit: int) -> DataFrame:
    """Frames up to ``limit`` per capture; the limit is the feature (it bounds one analysis)."""
    return frames.where(F.col("frame_number") <= limit)


def truncated_captures(frames: DataFrame, limit: int | None = None) -> DataFrame:
    """Frame counts per capture and whether the frame limit cut it; without one, none is cut."""
    kept = F.lit(True) if limit is None else F.col("frame_number") <= limit
    return frames.groupBy("capture_id").agg(
        F.count("*").alias("frames"),
        F.count_if(kept).alias("kept_frames"),
        F.coalesce(F.max(~kept), F.lit(False)).alias("truncated"),
    )


def capture_status(captures: DataFrame, packets: DataFrame) -> DataFrame:
    """Completed, or failed where nothing in the capture could be decoded."""
    counts = packets.groupBy("capture_id").agg(F.count("*").alias("packet_count"))
    joined = captures.select("capture_id").join(counts, "capture_id", "left")
    empty = F.coalesce("packet_count", F.lit(0)) == 0
    return joined.select(
        "capture_id",
        F.coalesce("packet_count", F.lit(0)).alias("packet_count"),
        F.when(empty, "failed").otherwise("completed").alias("status"),
        F.when(empty, "PARSER_ERROR").alias("error_code"),
        F.when(empty, NO_PACKETS).alias("error_message"),
    )
