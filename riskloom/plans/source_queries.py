"""Registered scans and sinks.  Files are written by Spark from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators.ranking import position_block
from riskloom.plans import sql as q
from riskloom.plans.registry import query
from riskloom.plans.views import Lake
from riskloom.session import shared_dir
from riskloom.sources import feeds, files, sinks

# One line per message, so that files may be split anywhere.
_FLAT = f"regexp_replace(text, '[{q.WS}]+', ' ', 'g')"


@query("message_table", "S1", f"""
    SELECT {q.strip(_FLAT)} AS message, count(*) AS n FROM conversations WHERE length({q.strip('text')}) > 0 GROUP BY 1""")
def message_table(lake: Lake):
    folder = shared_dir(lake.spark, "message-table")
    flat = F.regexp_replace("text", f"[{q.WS}]+", " ")
    lake.table("conversations").select(flat.alias("message"), "role").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    table = files.message_table(lake.spark, folder)
    return files.numbered_messages(table).groupBy("message").agg(F.count("*").alias("n"))


@query("conversation_rows", "S1 W1", q.with_views("message_rows", """
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pos) + 1 AS row, message FROM message_rows"""))
def conversation_rows(lake: Lake):
    from riskloom.operators.scoring import numbered_rows

    return numbered_rows(lake.message_rows()).select("document_id", "row", "message")


@query("csv_text_lines", "S2", f"SELECT role || ' ' || {q.strip(_FLAT)} AS line, count(*) AS n FROM conversations GROUP BY 1")
def csv_text_lines(lake: Lake):
    folder = shared_dir(lake.spark, "csv-text")
    flat = F.regexp_replace(F.regexp_replace("text", f"[{q.WS}]+", " "), "^ | $", "")
    table = lake.table("conversations").select("conv_id", "role", flat.alias("body"), "turn")
    table.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    spark = lake.spark
    lines = files.csv_lines(spark, folder)
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@query("json_text", "S3", """
    SELECT conv_id, turn, role || chr(10) || text || chr(10) || 'deep' AS text FROM conversations""")
def json_text(lake: Lake):
    body = F.to_json(F.struct(
        "turn", "role", F.struct(F.array("text").alias("parts"), F.lit(True).alias("flag")).alias("body"),
        F.array(F.struct(F.array(F.array(F.lit("deep"))).alias("z"), F.lit(1.5).alias("a"))).alias("tail")))
    return lake.table("conversations").select("conv_id", "turn", files.json_text(body).alias("text"))


@query("text_files", "S4", "SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY source")
def text_files(lake: Lake):
    folder = shared_dir(lake.spark, "text-files")
    lake.table("documents").select("source", "text").write.partitionBy("source").text(folder)
    read = files.text_files(lake.spark, f"{folder}/*/*.txt")
    return read.groupBy(F.regexp_extract("document_id", "source=([^/]+)", 1).alias("source")).agg(F.sum(F.length("text")).alias("chars"))


_READERS = "MAP {'txt': 'text', 'csv': 'csv', 'json': 'json', 'pdf': 'external', 'docx': 'external', 'xlsx': 'external', 'xls': 'external'}"


@query("file_dispatch", "S5", f"""
    SELECT name, extension, {_READERS}[extension] AS reader, CASE WHEN {_READERS}[extension] IS NULL THEN 'unsupported file type .' || extension END AS problem
    FROM (SELECT name, lower(regexp_extract(name, '\\.([^./]+)$', 1)) AS extension FROM (
        SELECT source || '/' || doc_id || '.' || (CASE doc_id % 6 WHEN 0 THEN 'TXT' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' WHEN 3 THEN 'Pdf' WHEN 4 THEN 'exe' ELSE 'xls' END) AS name FROM documents))""")
def file_dispatch(lake: Lake):
    kinds = F.array(*[F.lit(x) for x in ("TXT", "csv", "json", "Pdf", "exe", "xls")])
    name = F.concat("source", F.lit("/"), F.col("doc_id"), F.lit("."), F.get(kinds, (F.col("doc_id") % 6).cast("int")))
    named = lake.table("documents").select(name.alias("name")).withColumn("extension", files.extension(F.col("name")))
    ext = F.col("extension")
    return named.withColumn("reader", files.reader_of(ext)).withColumn("problem", files.refusal(ext))


@query("feed_entries", "S6 F7", f"""
    SELECT feed, 'rss:' || substr(sha1('post-' || doc_id || '|' || title || '|' || lang), 1, 24) AS external_id, title,
           {q.strip("title || chr(10) || chr(10) || body")} AS text, feed AS url, lang AS published
    FROM (SELECT source AS feed, doc_id, lang, 'Post ' || doc_id AS title, {q.strip(_FLAT)} AS body FROM documents)""")
def feed_entries(lake: Lake):
    flat = F.regexp_replace(F.regexp_replace("text", f"[{q.WS}]+", " "), "^ | $", "")
    shaped = F.struct(
        F.concat(F.lit("Post "), F.col("doc_id")).alias("title"), flat.alias("description"),
        F.concat(F.lit("post-"), F.col("doc_id")).alias("guid"), F.col("lang").alias("updated"))
    xml = F.to_xml(shaped, {"rowTag": "item"})
    entries = lake.table("documents").select(F.col("source").alias("feed"), "doc_id", feeds.parse_entry(xml).alias("entry"))
    items = feeds.feed_items(entries, "rss", position_block("doc_id"), order="doc_id")
    return items.select("feed", "external_id", "title", "text", "url", "published")


@query("report_export", "S12 F12", q.with_views("analyses doc_keywords", f"""
    , kw AS (SELECT doc_id * {q.STEP} AS analysis_id, string_agg(keyword, '; ' ORDER BY rank) AS keywords FROM doc_keywords GROUP BY doc_id)
    SELECT CAST(analysis_id AS VARCHAR) AS id, analysis_type, status, printf('%.4f', threat_score) AS threat_score, threat_level,
           CASE WHEN status = 'completed' THEN '{{"main":"' || printf('%.4f', threat_score) || '"}}' ELSE '' END AS model_scores, '' AS sentiment, '' AS language,
           coalesce(keywords, '') AS keywords, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at
    FROM analyses LEFT JOIN kw USING (analysis_id)"""))
def report_export(lake: Lake):
    score = F.format_string("%.4f", "threat_score")
    joined = lake.analyses().join(lake.analysis_keywords(), "analysis_id", "left").withColumnRenamed("analysis_id", "id")
    full = (joined.withColumn("model_scores", F.when(F.col("status") == "completed", F.create_map(F.lit("main"), score)))
            .withColumn("sentiment", F.lit(None).cast("string")).withColumn("language", F.lit(None).cast("string")))
    folder = shared_dir(lake.spark, "report")
    sinks.write_report(full, folder)
    back = lake.spark.read.option("header", True).option("escape", '"').csv(folder)
    return back.na.fill("")


@query("document_status", "S11", q.with_views("analyses", f"""
    SELECT d.doc_id AS document_id, coalesce(a.status, 'pending') AS status FROM documents d LEFT JOIN analyses a ON a.analysis_id = d.doc_id * {q.STEP} AND a.threat_score >= 0.3"""))
def document_status(lake: Lake):
    uploads = lake.table("documents").select(F.col("doc_id").alias("document_id"), F.lit("pending").alias("status"))
    done = lake.analyses().where(F.col("threat_score") >= 0.3).select("analysis_id", "status")
    tied = uploads.select("document_id", (F.col("document_id") * lake.step).alias("analysis_id")).join(done, "analysis_id")
    return sinks.with_status(uploads, tied)


@query("stored_analyses", "S11", q.with_views("analyses", "SELECT CAST(created_at AS DATE) AS day, status, count(*) AS n FROM analyses GROUP BY ALL"))
def stored_analyses(lake: Lake):
    folder = shared_dir(lake.spark, "analyses")
    sinks.write_analyses(lake.analyses(), folder)
    return lake.spark.read.parquet(folder).groupBy("day", "status").agg(F.count("*").alias("n"))
