"""Writers: translation blocks, reports, progress, repaired lines. A rendered file is one row (filename, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import encode_say, escape_report
from ..operators.keys import keep_first
from ..operators.relate import append_queue


def base_name(path: Column, root: str | None = None) -> Column:
    """Below root as it is, with a game folder its tail, else the last part."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    tail = F.when(F.contains(p, F.lit("/game/")), F.regexp_extract(p, r"/game/(.*)$", 1)).otherwise(F.element_at(F.split(p, "/"), -1))
    return F.when(F.startswith(p, F.lit(root.rstrip("/") + "/")), F.substr(p, F.lit(len(root.rstrip("/")) + 2))).otherwise(tail) if root else tail


def dialogue_block(ref: Column, line: Column, language: Column, identifier: Column, who: Column, what: Column, translation: Column) -> Column:
    lead = F.when(who != "", F.concat(who, F.lit(" "))).otherwise(F.lit(""))
    return F.concat(F.lit("# "), ref, F.lit(":"), line.cast("string"), F.lit("\ntranslate "), language, F.lit(" "), identifier, F.lit(":\n\n    # "), lead, encode_say(what), F.lit("\n    "), lead, encode_say(translation))


def pieces(units: DataFrame, strings: DataFrame, language: str) -> DataFrame:
    """(filename, part, seq, head, text): translation files in pieces, to be ordered by part and seq, blank lines between them.

    units: filename, line, seq, identifier, who, what, translation; strings: filename, line, seq, text,
    translation. Rows without a translation are left out; an identifier stands once in a file, a string
    once in all, in the file that has it first; the strings of a file form one block at its end. `head` is the
    first line of the block that a piece goes on with, so a file of any size can be read piece by piece.
    """
    lang = F.lit(language)
    some = keep_first(units.where("translation is not null"), ["filename", "identifier"], ["seq"])
    own = some.select("filename", F.lit(0).alias("part"), "seq", F.lit(None).cast("string").alias("head"), dialogue_block(base_name(F.col("filename")), F.col("line"), lang, F.col("identifier"), F.coalesce("who", F.lit("")), F.col("what"), F.col("translation")).alias("text"))
    once = keep_first(strings.where("translation is not null"), ["text"], ["filename", "seq"])
    pair = F.concat(F.lit("    # "), base_name(F.col("filename")), F.lit(":"), F.col("line").cast("string"), F.lit("\n    old "), encode_say(F.col("text")), F.lit("\n    new "), encode_say(F.col("translation")))
    return own.unionByName(once.select("filename", F.lit(1).alias("part"), "seq", F.lit(f"translate {language} strings:").alias("head"), pair.alias("text")))


def rendered(units: DataFrame, strings: DataFrame, language: str) -> DataFrame:
    """(filename, text) of translation files, the pieces() of each in one row: for files that fit one."""
    files = pieces(units, strings, language).groupBy("filename").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "text"))).alias("l"))
    texts = lambda part: F.transform(F.filter("l", lambda x: x["part"] == part), lambda x: x["text"])
    rest = F.concat(F.lit(f"translate {language} strings:\n\n"), F.array_join(texts(1), "\n\n"))
    both = F.concat(texts(0), F.when(F.size(texts(1)) > 0, F.array(rest)).otherwise(F.array().cast("array<string>")))
    return files.select("filename", F.array_join(both, "\n\n").alias("text"))


def report_lines(rows: DataFrame) -> DataFrame:
    """(seq, line) of an untranslated report from (seq, filename, line, text)."""
    return rows.select("seq", F.concat("filename", F.lit(":"), F.col("line").cast("string"), F.lit("  "), escape_report(F.col("text"))).alias("report"))


def audit_lines(items: DataFrame, order: tuple[str, ...] = ("untranslated", "wrong_lang", "mixed", "traditional")) -> DataFrame:
    """(rank, seq, report) of audit items, by category in a fixed order."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category"))
    text = F.concat(F.lit("["), "src_file", F.lit(":"), F.col("src_line").cast("string"), F.lit("]\n  原文: "), escape_report(F.col("original")), F.lit("\n  译文: "), escape_report(F.col("translation")))
    return items.where("category is not null").select(rank.alias("rank"), "seq", text.alias("report"))


def repaired(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """(path, n, line): the text between the first and last quote of fixed lines replaced. fixes: path, n, translation."""
    joined = lines.join(fixes.select("path", "n", F.col("translation").alias("_t")), ["path", "n"], "left")
    old = F.rlike(F.trim("line"), F.lit("^old "))
    new = F.concat(F.regexp_extract("line", r'^([^"]*)"', 1), encode_say(F.col("_t")), F.regexp_extract("line", r'"([^"]*)$', 1))
    return joined.withColumn("line", F.when(F.col("_t").isNotNull() & ~old & F.rlike("line", F.lit('".*"')), new).otherwise(F.col("line"))).drop("_t")


def stale_compiled(files: DataFrame) -> DataFrame:
    """Compiled files that have a source sibling: (path) of those to delete."""
    stem = F.regexp_replace(F.lower("path"), r"c$", "")
    compiled, sources = files.where(F.rlike(F.lower("path"), F.lit(r"\.rpym?c$"))), files.where(F.rlike(F.lower("path"), F.lit(r"\.rpym?$")))
    return compiled.withColumn("_s", stem).join(sources.select(F.lower("path").alias("_s")).distinct(), "_s", "left_semi").select("path")


def write_files(rendered_files: DataFrame, path: str) -> None:
    """Every filename as one file of its text below path.

    Spark writes and commits the texts beside path; then each is renamed to its name. A filename given twice, or
    one that leaves path, is refused before anything is moved. Files of an earlier run stay unless named again.
    """
    spark = rendered_files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to_path = jvm.org.apache.hadoop.fs.Path
    beside = f"{path.rstrip('/')}.new"
    once = rendered_files.groupBy("filename").agg(F.max("text").alias("value"), F.count("*").alias("n"))
    bad = F.col("filename").isNull() | (F.col("n") > 1) | F.rlike("filename", F.lit(r"^$|^/|(^|/)\.\.(/|$)"))
    checked = once.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("not to be written: "), F.coalesce("filename", F.lit("null"))))).otherwise(F.col("value")))
    checked.select("value", "filename").write.mode("overwrite").partitionBy("filename").text(beside, lineSep="\n")
    fs = to_path(path).getFileSystem(conf)
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for folder in fs.listStatus(to_path(beside)):
        name = folder.getPath().getName()
        if name.startswith("filename="):
            target = to_path(f"{path.rstrip('/')}/{unescape(name[9:])}")
            fs.mkdirs(target.getParent())
            fs.delete(target, False)
            (part,) = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            if not fs.rename(part, target):
                raise OSError(f"{target} can't be moved")
    fs.delete(to_path(beside), True)


def untranslated_report(dialogue: DataFrame, strings: DataFrame, errors: DataFrame, *, most_errors: int = 20) -> DataFrame:
    """(part, seq, report) of a report in sections, to be ordered by both. A section without rows has no header.

    dialogue, strings: seq, filename, line, text; errors: seq, message, of which each is shown once where it came first,
    `most_errors` of them.
    """
    once = errors.groupBy("message").agg(F.min("seq").alias("seq")).orderBy("seq").limit(most_errors)
    shown = once.select("seq", F.concat(F.lit("- "), "message").alias("report"))
    out = None
    for part, (title, rows) in enumerate((("== 对话 ==", report_lines(dialogue)), ("== 字符串 ==", report_lines(strings)), ("== 翻译错误详情（去重） ==", shown))):
        rows = rows.select(F.lit(part).alias("part"), F.col("seq").cast("long").alias("seq"), "report")
        head = rows.limit(1).select(F.lit(part).alias("part"), F.lit(None).cast("long").alias("seq"), F.lit(title).alias("report"))
        out = head.unionByName(rows) if out is None else out.unionByName(head).unionByName(rows)
    return out


def pending_lines(units: DataFrame, text: str = "text", translation: str = "translation") -> DataFrame:
    """(seq, report) of a pause marker: the units that have no translation, or their source for one."""
    todo = units.where(F.col(translation).isNull() | (F.col(translation) == F.col(text)))
    return todo.select("seq", F.concat(F.lit("  "), "filename", F.lit(":"), F.col("line").cast("string"), F.lit("  "), F.col(text)).alias("report"))


def pause_counts(units: DataFrame, text: str = "text", translation: str = "translation") -> DataFrame:
    """(n_done, n_pending) of the head of a pause marker."""
    todo = F.col(translation).isNull() | (F.col(translation) == F.col(text))
    return units.agg(F.count_if(~todo).alias("n_done"), F.count_if(todo).alias("n_pending"))


def fix_blocks(resolved: DataFrame, language: str) -> DataFrame:
    """(identifier, block) of a file of fixes, to be ordered by identifier. resolved: identifier, who, what, translation."""
    lead = F.when(F.col("who") != "", F.concat("who", F.lit(" "))).otherwise(F.lit(""))
    block = F.concat(F.lit(f"translate {language} "), "identifier", F.lit(":\n\n    # "), lead, encode_say(F.col("what")), F.lit("\n    "), lead, encode_say(F.col("translation")))
    return resolved.select("identifier", block.alias("block"))


def imported_lines(queue: DataFrame, found: DataFrame, text: str, order: list[str]) -> DataFrame:
    """(*order, report) to append to a report: texts from elsewhere that it does not hold yet."""
    return append_queue(queue, found, text, order).select(*order, F.concat(F.lit("外部导入:0  "), escape_report(F.col(text))).alias("report"))


def write_progress(progress: DataFrame, path: str) -> None:
    """progress (kind, text, translation, fp) as Parquet, written beside path and moved there.

    A writer that dies leaves the old rows, and progress may read path itself. Between the two moves a reader may
    find nothing at path; then the old rows are at path.old.
    """
    spark = progress.sparkSession
    to_path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, at = to_path(f"{path}.new"), to_path(f"{path}.old"), to_path(path)
    progress.write.mode("overwrite").parquet(f"{path}.new")
    fs = at.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, at):
        raise OSError(f"{path}.new can't be moved")
    fs.delete(old, True)


def drop_path(spark: SparkSession, path: str) -> bool:
    """Deletes path if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(at, True)) if fs.exists(at) else False
