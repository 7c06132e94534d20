"""State machines, folds, incremental refresh, rendering and binary sources."""

import pickle
import tempfile
import uuid
import zlib

from pyspark.sql import functions as F

from ..operators import keys, progress
from ..sources import archives, readers, scripts, sinks
from ..streaming import incremental, switch
from . import views as V
from .registry import query


def _folder(spark) -> str:
    """A new folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{at.rstrip('/')}/textloom/{uuid.uuid4().hex}" if at else tempfile.mkdtemp(prefix="textloom-")


def _switch_events(events):
    current = F.when(F.col("event_id") % 5 == 0, "zh").otherwise(F.lit("en"))
    requested = F.when(F.col("event_id") % 5 < 4, "zh").otherwise(F.lit("en"))
    return events.select("user_id", "event_id", current.alias("current"), requested.alias("requested"))


_SWITCH = """WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'zh' ELSE 'en' END AS c, CASE WHEN event_id % 5 < 4 THEN 'zh' ELSE 'en' END AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, c, CASE WHEN r = 'zh' AND c <> 'zh' THEN 1 ELSE 0 END AS ticks, 'READY' AS status, true AS emitted FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_id, e.k, e.c,
  CASE WHEN s.status = 'PASS' THEN s.ticks WHEN e.c = 'zh' AND e.r = 'zh' AND s.c <> 'zh' THEN s.ticks WHEN e.r = 'zh' AND e.c <> 'zh' THEN s.ticks + 1 ELSE 0 END,
  CASE WHEN s.status = 'PASS' OR (e.c = 'zh' AND e.r = 'zh' AND s.c <> 'zh') THEN 'PASS' WHEN e.r = 'zh' AND e.c <> 'zh' AND s.ticks + 1 >= 4 THEN 'FAIL' ELSE 'READY' END,
  s.status <> CASE WHEN s.status = 'PASS' OR (e.c = 'zh' AND e.r = 'zh' AND s.c <> 'zh') THEN 'PASS' WHEN e.r = 'zh' AND e.c <> 'zh' AND s.ticks + 1 >= 4 THEN 'FAIL' ELSE 'READY' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, event_id, status FROM s WHERE emitted"""


@query(_SWITCH)
def switch_fsm_batch(spark, d):
    return switch.monitored(_switch_events(V.table(spark, d, "events")), "zh")


@query(_SWITCH)
def switch_fsm_stream(spark, d):
    at = _folder(spark)
    events = V.table(spark, d, "events")
    events.repartitionByRange(2, "event_id").write.parquet(f"{at}/in")
    return switch.run_stream(spark, f"{at}/in", events.schema, _switch_events, "zh", f"{at}/out", f"{at}/state", files_per_batch=1000)


@query("SELECT text, min(doc_id) >= 0 AS ok FROM documents GROUP BY text")
def incremental_two_batches(spark, d):
    at = _folder(spark)
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    for k in (0, 1):
        docs.where(F.col("doc_id") % 2 == k).write.mode("append").parquet(f"{at}/in")
    done = incremental.refresh(spark, f"{at}/in", docs.schema, f"{at}/out", f"{at}/state", "text", lambda new: new.withColumn("ok", F.col("doc_id") >= 0))
    return done.select("text", "ok")


@query("""WITH RECURSIVE n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 f AS (SELECT user_id, event_id, k, value AS ema FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.event_id, n.k, 0.7 * f.ema + 0.3 * n.value FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)
 SELECT user_id, count(*) AS n, round(arg_max(ema, k), 4) AS ema FROM f GROUP BY user_id""")
def eta_smoothing(spark, d):
    rows = progress.smoothed(V.table(spark, d, "events"), "user_id", "event_id", "value")
    return rows.withColumn("ema", F.round("ema", 4))


_LEAD = "CASE WHEN who <> '' THEN who || ' ' ELSE '' END"
_BLOCK = f"'# ' || string_split(filename, '/')[-1] || ':' || line || chr(10) || 'translate schinese ' || identifier || ':' || chr(10) || chr(10) || '    # ' || {_LEAD} || {V.encoded('what')} || chr(10) || '    ' || {_LEAD} || {V.encoded('translation')}"


def _block_units(spark, d):
    return V.keyed_units(spark, d).withColumn("translation", F.when(F.col("turn") % 4 != 3, F.concat(F.lit("译 "), "what"))).withColumn("seq", F.col("turn"))


@query(V.sql(f"""WITH u AS (SELECT *, CASE WHEN turn % 4 <> 3 THEN '译 ' || what END AS translation FROM keyed_units),
 o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, identifier ORDER BY turn) AS k FROM u WHERE translation IS NOT NULL) WHERE k = 1)
 SELECT filename, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY turn) AS text FROM o GROUP BY filename""", "keyed_units"))
def block_render(spark, d):
    none = spark.createDataFrame([], "filename string, line long, seq long, text string, translation string")
    return sinks.rendered(_block_units(spark, d), none, "schinese")


@query(V.sql("SELECT identifier, max('译 ' || what) AS translation FROM keyed_units WHERE turn % 4 <> 3 GROUP BY identifier", "keyed_units"))
def block_roundtrip(spark, d):
    """Files rendered and parsed again: the same map."""
    none = spark.createDataFrame([], "filename string, line long, seq long, text string, translation string")
    files = sinks.rendered(_block_units(spark, d), none, "schinese").withColumnRenamed("filename", "path")
    return readers.last_by(readers.dialogue_rows(files), "identifier")


@query(V.sql("SELECT text, count(*) AS n FROM string_units WHERE text <> '' AND text = trim(text) GROUP BY text", "string_units"))
def report_roundtrip(spark, d):
    rows = V.string_units(spark, d).where("text <> '' and text = trim(text)").select((F.col("id") * 100000 + F.col("line")).alias("seq"), F.lit("src").alias("filename"), "line", "text", F.floor(F.col("id") / 64).alias("part"))
    lines = sinks.report_lines(rows).join(rows.select("seq", "part").distinct(), "seq")
    files = lines.groupBy(F.col("part").cast("string").alias("path")).agg(F.array_join(F.collect_list("report"), "\n").alias("text"))
    return readers.untranslated_report(files).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT 'src' || page_id % 3 || '.txt' AS filename, page_id AS line, url AS what FROM pages")
def missing_report_reader(spark, d):
    p = V.table(spark, d, "pages")
    row = F.concat(F.lit("src"), (F.col("page_id") % 3).cast("string"), F.lit(".txt:"), F.col("page_id").cast("string"), F.lit("\t[e]\t"), "url", F.lit("\tid\tSay"))
    files = p.groupBy(F.floor(F.col("page_id") / 256).cast("string").alias("path")).agg(F.concat(F.lit("a\nb\nc\n"), F.array_join(F.collect_list(row), "\n")).alias("text"))
    return readers.missing_report(files).select("filename", F.col("line").cast("long").alias("line"), "what")


@query("SELECT text, 't:' || left(text, 4) AS translation FROM (SELECT DISTINCT text FROM documents)")
def progress_reader(spark, d):
    docs = V.table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    pairs = F.map_from_entries(F.collect_list(F.struct("text", F.concat(F.lit("t:"), F.left("text", F.lit(4))))))
    files = docs.groupBy(F.floor(F.col("doc_id") / 256).cast("string").alias("path")).agg(F.to_json(F.struct(F.lit("x").alias("__fp__"), pairs.alias("dialogues"))).alias("text"))
    return readers.progress(files).select("text", "translation")


_SCRIPT_LABEL = "label c.{0}:"


@query(V.sql("SELECT conv_id, count(*) AS n, string_agg(identifier, ',' ORDER BY turn) AS ids FROM keyed_units WHERE regexp_full_match(what, '[^{}\\[\\]\\\\\"#]*') GROUP BY conv_id", "keyed_units"))
def script_extract(spark, d):
    """Conversations written as scripts, parsed, and keyed: the identifiers of the units."""
    u = V.say_units(spark, d).where(r"""what rlike '^[^{}\\[\\]\\\\"#]*$'""")
    line = F.concat(F.lit("    "), "who", F.lit(" "), keys.say_code(None, F.col("what")))
    files = u.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    files = files.select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit("label c."), F.col("conv_id").cast("string"), F.lit(":\n"), "body", F.lit("\n")).alias("text"))
    found = scripts.extracted(files).where("kind = 'say'").withColumn("id", keys.identifier(F.col("label"), keys.say_code(F.col("who"), F.col("text"))))
    return found.groupBy(F.col("filename").cast("long").alias("conv_id")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]), ",").alias("ids"))


def archive(files: dict[str, bytes], key: int = 0x42424242) -> bytes:
    """An archive of version 3 with the files."""
    body, places = b"", {}
    for name, content in files.items():
        places[name] = [((34 + len(body)) ^ key, len(content) ^ key, b"")]
        body += content
    head = b"RPA-3.0 %016x %08x\n" % (34 + len(body), key)
    return head + body + zlib.compress(pickle.dumps(places))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def archive_entries(spark, d):
    """All documents packed in archives of 64 each, listed and read back."""
    import pandas as pd

    docs = V.table(spark, d, "documents").select("doc_id", "text")

    def build(key, frame):
        # the archives are made once for their index and once for their bytes, from rows that come in any order
        frame = frame.sort_values(["id", "text"])
        made = archive({f"scripts/{k}/{i}.rpy": t.encode() for k, (i, t) in enumerate(zip(frame["id"], frame["text"]))})
        return pd.DataFrame({"path": [f"a{key[0]}"], "content": [made]})

    packed = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("id"), "text", F.floor(F.col("doc_id") / 64).alias("a"))
    files = packed.groupBy("a").applyInPandas(build, "path string, content binary")
    read = archives.contents(files, archives.scripts_only(archives.entries(files)))
    found = read.select(F.expr(r"try_cast(regexp_extract(name, '(-?\\d+)\\.rpy$', 1) as bigint)").alias("doc_id"), F.sha2("content", 256).alias("sha"))
    return found.unionByName(docs.where("text is null").select("doc_id", F.lit(None).cast("string").alias("sha")))
