"""Registry of expected recordings, duplicate links and independence groups of a folder of EDF files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import strata, text
from sigloom.operators import fingerprint as fp
from sigloom.operators import recordings
from sigloom.sources import edf

CASE_GROUP, OTHER_GROUP, CONTROL_GROUP = edf.GROUPS[1], edf.GROUPS[2], edf.GROUPS[0]


def matched_files(files: DataFrame) -> DataFrame:
    """Files at ``group/subject/stem.edf`` whose canonical stem is expected; the first name wins per stem."""
    parts = F.split("path", "/")
    n = F.size(parts)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?i)\.edf$", "")
    canonical = F.create_map(*[c for s in (edf.REST_STEM, *edf.TASK_STEMS) for c in (text.normalize_stem(F.lit(s)), F.lit(s))])
    named = files.select(
        "*", F.get(parts, n - 3).alias("group"), F.get(parts, n - 2).alias("subject_id"), F.element_at(parts, -1).alias("file_name"),
        F.try_element_at(canonical, text.normalize_stem(stem)).alias("stem"),
    ).filter("stem IS NOT NULL")
    cols = [c for c in named.columns if c not in ("group", "subject_id", "stem")]
    best = named.groupBy("group", "subject_id", "stem").agg(F.min_by(F.struct(*cols), "file_name").alias("f"), F.count(F.lit(1)).alias("n_files"))
    return best.select("group", "subject_id", "stem", "n_files", *[F.col(f"f.{c}").alias(c) for c in cols])


def strictly_matched(files: DataFrame) -> DataFrame:
    """``matched_files``, but two files of one subject and stem are an error."""
    found = matched_files(files)
    message = F.concat(F.lit("several files for "), F.concat_ws("/", "group", "subject_id", "stem"))
    return found.withColumn("n_files", F.when(F.col("n_files") > 1, F.raise_error(message).cast("long")).otherwise(F.col("n_files")))


def build_registry(files: DataFrame) -> DataFrame:
    """One row per expected (subject, stem), missing ones included, with header metadata and fingerprints."""
    found = matched_files(files)
    subjects = found.select("group", "subject_id").distinct()
    slots = F.explode(F.array(*[F.struct(F.lit(s).alias("stem"), F.lit(i).alias("trial")) for i, s in enumerate((edf.REST_STEM, *edf.TASK_STEMS))]))
    expected = subjects.select("group", "subject_id", slots.alias("s")).select("group", "subject_id", "s.stem", "s.trial")
    known = recordings.outline(found)
    stretches, readable = known.edges, found.join(known.meta.select("path"), "path", "left_semi")
    broken = known.quarantine.groupBy("path").agg(F.min_by("error", "piece").alias("_broken"))
    meta = edf.headers(found).drop("file_bytes").join(broken, "path", "left")
    meta = meta.withColumns({"status": F.when(F.col("_broken").isNotNull(), "error").otherwise(F.col("status")), "error": F.coalesce("_broken", "error")}).drop("_broken")
    digests = edf.channel_digests(readable)
    described = found.drop("content").join(meta, "path").join(edf.content_hashes(digests), "path", "left").join(stretches, "path", "left")
    rows = expected.join(described, ["group", "subject_id", "stem"], "left")
    age = text.age_from_name(F.col("subject_id"), F.col("group") == CONTROL_GROUP)
    rate = F.col("sfreq")
    return rows.select(
        "group", "subject_id", F.concat_ws("/", "group", "subject_id").alias("subject_key"), (F.col("group") == CASE_GROUP).cast("int").alias("label"),
        age.alias("age"), "stem", F.when(F.col("trial") == 0, "rest").otherwise("task").alias("condition"), "trial",
        F.concat_ws("/", "group", "subject_id", F.coalesce("file_name", F.concat("stem", F.lit(".edf")))).alias("relpath"), "path",
        F.coalesce("status", F.lit("missing")).alias("status"), "error", "file_bytes", "file_name", "sfreq", "n_times", "duration_s",
        ((F.col("head") + F.col("tail")) / rate).alias("edge_constant_s"), ((F.col("constant") - F.col("head") - F.col("tail")) / rate).alias("interior_constant_s"),
        ((F.col("n_times") - F.col("head") - F.col("tail")) / rate).alias("active_duration_s"), "head", "tail",
        "n_records_header", "n_records", "trailing_bytes", "physical_dim", "physical_min", "physical_max", "digital_min", "digital_max",
        "uniform_scaling", "quant_step_uv", "prefilter", "notch_50", "content_hash",
        text.at_least(age, edf.HOLDOUT_MIN_AGE).alias("holdout"), text.export_family(F.col("quant_step_uv"), F.col("physical_max")).alias("export_family"),
    )


def duplicate_links(registry: DataFrame, records: DataFrame) -> DataFrame:
    """Star links between files with equal content, and links between files sharing at least two record blocks."""
    ok = registry.filter("status = 'ok'")
    same = fp.identical_links(ok.select("relpath", "content_hash"), "content_hash", "relpath").withColumn("kind", F.lit("identical"))
    first = fp.keep_first(ok.select("content_hash", "relpath", "path"), "content_hash", "relpath")
    blocks = records.join(first.select("path", "relpath"), "path").select("relpath", "block").distinct()
    near = fp.overlap_links(blocks, "relpath", "block").withColumn("kind", F.lit("overlap"))
    return same.unionByName(near).select(F.col("a").alias("relpath_a"), F.col("b").alias("relpath_b"), "kind")


def subject_table(registry: DataFrame, links: DataFrame) -> DataFrame:
    """Subjects with strata inputs and the independence group used for every split."""
    owner = registry.select("relpath", "subject_key")
    edges = (
        links.join(owner.toDF("relpath_a", "a"), "relpath_a").join(owner.toDF("relpath_b", "b"), "relpath_b").select("a", "b").filter("a <> b")
    )
    subjects = registry.groupBy("subject_key").agg(
        F.min("group").alias("group"), F.min("subject_id").alias("subject_id"), F.min("label").alias("label"), F.min("age").alias("age"),
        F.bool_or("holdout").alias("holdout"), F.bool_or((F.col("condition") == "task") & (F.col("status") != "missing")).alias("has_task_files"),
        F.min_by("export_family", F.when(F.col("status") == "ok", F.col("trial"))).alias("export_family"),
        F.avg(F.when(F.col("status") == "ok", F.col("notch_50").cast("double"))).alias("notch_share"),
        F.avg(F.when(F.col("status") == "ok", (F.col("sfreq") == edf.TARGET_SFREQ).cast("double"))).alias("share_125"),
    )
    roots = fp.connected_components(subjects, edges, "subject_key")
    # subject keys are strings: number the roots through their order
    from sigloom.operators import folds

    codes = folds.dense_index(roots.select("root").distinct(), "root", name="split_group").select("root", "split_group")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"))
    grouped = roots.join(codes, "root").join(sizes, "root").select("subject_key", "split_group", "group_size")
    out = subjects.join(grouped, "subject_key")
    s = strata.stratum(F.col("group") == CASE_GROUP, F.col("holdout"), F.col("group") == OTHER_GROUP, F.col("has_task_files"), F.col("export_family"))
    return out.withColumn("stratum", s)


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registry, links and subject table of a data folder; raises if a group mixes held-out and training subjects."""
    from sigloom.session import checkpointed

    files = edf.list_files(spark, root)
    registry = checkpointed(build_registry(files))
    readable = files.join(registry.filter("status = 'ok'").select("path"), "path", "left_semi")
    links = checkpointed(duplicate_links(registry, edf.record_digests(readable)))
    subjects = checkpointed(subject_table(registry, links))
    if not fp.mixed_groups(subjects, "split_group", F.col("holdout")).isEmpty():
        raise ValueError("split groups mix held-out and training subjects")
    return registry, links, subjects
