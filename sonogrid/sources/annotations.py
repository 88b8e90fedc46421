"""Annotation documents and raw annotation formats as rows of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonogrid import schemas
from sonogrid.functions import names

REQUIRED = ("mels", "sr", "hop_size", "fft", "mean", "std")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Documents, one JSON object in each file. A broken file is an error."""
    return spark.read.schema(schemas.ANNOTATIONS).option("mode", "FAILFAST").json(path, multiLine=True)


def recordings(docs: DataFrame) -> DataFrame:
    """A row for each recording, with its place in the document; documents without one give none."""
    return docs.select(F.posexplode("recordings").alias("rec_no", "r")).select("rec_no", "r.recording.*", F.col("r.detected_events").alias("events"), names.stem(F.col("r.recording.filename")).alias("stem"))


def events(docs: DataFrame) -> DataFrame:
    """A row for each event; recordings without one give none."""
    return recordings(docs).select("rec_no", "stem", "bird_id", F.posexplode("events").alias("event_no", "e")).select("rec_no", "stem", "bird_id", "event_no", "e.onset_ms", "e.offset_ms", "e.units")


def units(docs: DataFrame, mode: str = "classify") -> DataFrame:
    """What a task looks at: 'detect' takes events (id 1), 'classify' and 'unit_detect' units with an id and both times."""
    if mode == "detect":
        out = events(docs).select("rec_no", "stem", "bird_id", "event_no", F.lit(0).alias("unit_no"), "onset_ms", "offset_ms", F.lit(1).alias("id"))
    elif mode in ("classify", "unit_detect"):
        u = events(docs).select("rec_no", "stem", "bird_id", "event_no", F.posexplode("units").alias("unit_no", "u"))
        out = u.select("rec_no", "stem", "bird_id", "event_no", "unit_no", "u.onset_ms", "u.offset_ms", "u.id")
        out = out.withColumn("id", F.lit(1)) if mode == "unit_detect" else out
    else:
        raise ValueError(f"mode: {mode}")
    return out.dropna(subset=["onset_ms", "offset_ms", "id"])


def one_recording(rows: DataFrame, on_duplicate: str = "concat") -> DataFrame:
    """Rows of recordings that a document lists more than once under a stem: of the first, of the last, or of all."""
    if on_duplicate == "concat":
        return rows
    pick = {"first": F.min, "last": F.max}[on_duplicate]
    return rows.join(rows.groupBy("stem").agg(pick("rec_no").alias("rec_no")), ["stem", "rec_no"], "left_semi")


def attach(files: DataFrame, rows: DataFrame, on_missing: str = "error") -> DataFrame:
    """Files with the annotations of their base_stem; a file without any is an error or is skipped."""
    if on_missing == "error":
        lost = files.join(rows.select(F.col("stem").alias("base_stem")), "base_stem", "left_anti").select("base_stem").limit(5).collect()
        if lost:
            raise ValueError(f"no annotations for {[r[0] for r in lost]}")
    elif on_missing != "skip":
        raise ValueError(f"on_missing: {on_missing}")
    return files.join(rows.withColumnRenamed("stem", "base_stem"), "base_stem")


def documents(rows: DataFrame) -> DataFrame:
    """Recordings as nested documents: units gathered into sorted events, events sorted by onset."""
    unit = F.struct("onset_ms", "offset_ms", F.col("id").cast("int").alias("id"))
    e = rows.groupBy("stem", "bird_id", "event_no").agg(F.min("onset_ms").alias("onset_ms"), F.max("offset_ms").alias("offset_ms"), F.array_sort(F.collect_list(unit)).alias("units"))
    r = e.groupBy("stem", "bird_id").agg(F.array_sort(F.collect_list(F.struct("onset_ms", "offset_ms", "units"))).alias("detected_events"), F.sum(F.size("units")).cast("int").alias("n"))
    return r.select(F.struct(F.col("stem").alias("filename"), "bird_id", F.col("n").alias("detected_vocalizations")).alias("recording"), "detected_events")


def read_audio_params(spark: SparkSession, path: str, defaults: dict[str, float] | None = None) -> DataFrame:
    """One row of parameters. Keys that are missing are an error, or take the defaults."""
    row = spark.read.schema(schemas.AUDIO_PARAMS).json(path, multiLine=True)
    if defaults is None:
        checks = [F.assert_true(F.col(k).isNotNull(), f"audio parameter {k} is missing").isNull() for k in REQUIRED]
        return row.where(F.expr("true") if not checks else checks[0]).where(_all(checks[1:]))
    return row.select(*(F.coalesce(F.col(k), F.lit(defaults.get(k))).cast(row.schema[k].dataType).alias(k) for k in row.columns))


def _all(checks: list[Column]) -> Column:
    out = F.lit(True)
    for c in checks:
        out = out & c
    return out


def ordered(a: Column, b: Column) -> tuple[Column, Column]:
    """P10: two times, the smaller first; both null if one is."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


def read_units_csv(spark: SparkSession, path: str) -> DataFrame:
    """Label, audio_file and times in ms or s under several names; tab or comma by the header; the bird is the file's stem; a byte order mark is dropped.

    Lines are split by the separator that their own file's header holds, so that many files of both kinds are read at once. Fields can be quoted, with separators
    and doubled quotes within; a line break within a field is not supported.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    header = lines.where(F.lower("line").contains("label") & F.lower("line").contains("audio_file"))
    header = header.groupBy("file").agg(F.min("line").alias("header")).withColumn("sep", F.when(F.col("header").contains("\t"), "\t").otherwise(","))
    # A separator with an even number of quotes after it stands outside of them.
    fields = lambda c: F.transform(F.split(c, F.concat("sep", F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)')), F.lit(-1)), lambda x: F.replace(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    rows = lines.join(header, "file").where((F.col("line") != F.col("header")) & (F.trim("line") != "")).withColumn("_names", F.transform(fields("header"), F.lower)).withColumn("_cells", fields("line"))
    whole = F.size("_cells") >= F.size("_names")
    rows = rows.where(whole).withColumn("c", F.when(whole, F.map_from_arrays("_names", F.slice("_cells", F.lit(1), F.size("_names")))))
    get = lambda k: F.try_element_at("c", F.lit(k)).try_cast("double")
    on = F.coalesce(get("onset_ms"), get("onset_s") * 1000, get("start_s") * 1000)
    off = F.coalesce(get("offset_ms"), get("offset_s") * 1000, get("end_s") * 1000)
    lo, hi = ordered(on, off)
    return rows.select(names.stem(F.col("file")).alias("bird_id"), F.try_element_at("c", F.lit("audio_file")).alias("audio_file"), F.try_element_at("c", F.lit("label")).alias("label"), lo.alias("onset_ms"), hi.alias("offset_ms"), F.try_element_at("c", F.lit("sequence")).alias("sequence")).dropna(subset=["onset_ms", "offset_ms"])


def read_sequences_xml(spark: SparkSession, path: str, rate: int = 32_000) -> DataFrame:
    """Sequences of notes in samples, as units in ms. Positions of notes count from their sequence."""
    schema = "WaveFileName string, Position bigint, Length bigint, NumNote int, Note array<struct<Position:bigint,Length:bigint,Label:string>>"
    s = spark.read.format("xml").option("rowTag", "Sequence").schema(schema).load(path)
    ms = lambda n: n * 1000.0 / rate
    n = s.select(names.stem(F.regexp_replace("WaveFileName", "(?i)\\.wav$", ".wav")).alias("stem"), F.col("Position").alias("base"), F.posexplode("Note").alias("unit_no", "n"))
    return n.select("stem", "unit_no", ms(F.col("base") + F.col("n.Position")).alias("onset_ms"), ms(F.col("base") + F.col("n.Position") + F.col("n.Length")).alias("offset_ms"), F.col("n.Label").alias("label"))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections, each (recording, onset, offset) once; a file that says song and lists none, or the reverse, is an error. An event's own span is its only unit."""
    d = spark.read.schema(schemas.DETECTIONS).json(path, multiLine=True)
    n = F.coalesce(F.size("segments"), F.lit(0))
    d = d.where(F.assert_true(F.coalesce(F.col("song_present") == (n > 0), F.lit(True)), F.concat(F.lit("song_present contradicts segments: "), "filename")).isNull())
    s = d.select("filename", F.explode("segments").alias("s")).select("filename", *[c.alias(k) for k, c in zip(("onset_ms", "offset_ms"), ordered(F.col("s.onset_ms"), F.col("s.offset_ms")), strict=True)])
    return s.dropDuplicates().withColumn("units", F.array(F.struct("onset_ms", "offset_ms", F.lit(0).alias("id"))))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Snippets, one JSON object a line, with duration and extension."""
    return spark.read.schema(schemas.MANIFEST).json(path).withColumns({"duration": F.col("end") - F.col("start"), "ext": names.extension(F.col("dst"))})


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Run metrics; blanks and unreadable numbers are null."""
    raw = spark.read.csv(path, header=True, schema=schemas.METRICS, enforceSchema=False)
    numbers = {c: names.lenient_double(F.col(c)) for c in ("f1", "fer", "lr")} | {c: names.lenient_int(F.col(c)) for c in ("num_classes", "num_classes_train", "num_classes_val", "patch_width", "steps", "batch_size", "class_weighting")}
    return raw.withColumns(numbers)


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """Loss logs with or without a header, sparse fields null; lines without a step are dropped."""
    cells = F.split("value", ",", -1)
    columns = [c.split() for c in schemas.LOSSES.split(", ")]
    kind = {"bigint": "bigint", "double": "double"}
    out = spark.read.text(path).select(*(names.blank_to_null(F.get(cells, F.lit(i))).try_cast(kind[t]).alias(n) for i, (n, t) in enumerate(columns)))
    return out.where("step IS NOT NULL")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One path a line, blank ones dropped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def label_map(labels: DataFrame, label: str) -> DataFrame:
    """Numbers for labels: those that are numbers keep their value, the others follow the largest in order. Labels are few by nature."""
    from pyspark.sql import Window

    d = labels.select(F.col(label).alias("label")).distinct().withColumn("value", F.col("label").try_cast("int"))
    top = F.coalesce(F.max("value").over(Window.partitionBy()), F.lit(-1))
    k = F.row_number().over(Window.orderBy(F.col("value").isNotNull(), "label"))
    return d.select("label", F.coalesce("value", (top + k).cast("int")).alias("id"))


def read_wav_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Stem and path from a JSON object of stems, a JSON list of objects or pairs, or lines of stem, tab and path; '#' starts a comment, a line without a tab is a path. Two paths for a stem are an error."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    as_map = F.map_entries(F.from_json(F.when(F.col("t").startswith("{"), F.col("t")), "map<string,string>"))
    listed = F.when(F.col("t").startswith("["), F.col("t"))
    as_rows = F.transform(F.from_json(listed, "array<struct<stem:string,path:string>>"), lambda x: F.struct(x["stem"].alias("key"), x["path"].alias("value")))
    as_pairs = F.transform(F.from_json(F.when(F.regexp_like("t", F.lit(r"^\[\s*\[")), F.col("t")), "array<array<string>>"), lambda x: F.struct(F.get(x, F.lit(0)).alias("key"), F.get(x, F.lit(1)).alias("value")))
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: x != "")
    as_lines = F.transform(lines, lambda x: F.struct(F.when(x.contains("\t"), F.trim(F.get(F.split(x, "\t"), F.lit(0)))).otherwise(names.stem(x)).alias("key"), F.trim(F.element_at(F.split(x, "\t"), -1)).alias("value")))
    entries = F.when(F.col("t").startswith("{"), as_map).when(F.regexp_like("t", F.lit(r"^\[\s*\[")), as_pairs).when(F.col("t").startswith("["), as_rows).otherwise(as_lines)
    out = text.select(F.explode(entries).alias("e")).select(F.col("e.key").alias("stem"), F.col("e.value").alias("path"))
    n = out.groupBy("stem").agg(F.min("path").alias("path"), F.count_distinct("path").alias("n"))
    return n.where(F.assert_true(F.col("n") == 1, F.concat(F.lit("two paths for "), "stem")).isNull()).select("stem", "path")


def of_bird(docs: DataFrame, bird: str | None) -> DataFrame:
    """Documents with the recordings of a bird only, everything else as it was; without a bird all stay. None left is an error."""
    if bird is None:
        return docs
    kept = docs.withColumn("recordings", F.filter("recordings", lambda r: r["recording"]["bird_id"] == bird))
    if kept.where(F.size("recordings") > 0).isEmpty():
        raise ValueError(f"no recordings of {bird}")
    return kept
